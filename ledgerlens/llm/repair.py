"""Conversation structure repair by generalised LR parsing.

The roles of a conversation must follow a grammar (``ROLES``: an optional
system turn, then pairs of user and assistant; or nothing).  An SLR table
with lists of actions drives the parser.  Its stacks form a graph: a stack
node is (state, node below) and exists once, so stacks share what lies under
them.  Before every row, and at the end, any top may insert an empty turn;
every row is then kept, given another role, or deleted.  Each edit has its
weight, and where two derivations reach the same stack top only the one with
the smaller (cost, audit) lives on; the audit is the string of the edits'
initials.

Audits are compared without being built.  Tops that have just consumed row i
end in that row's edit, so none of their audits is a prefix of another, and
their order is decided by (order of the tops before row i, edits since).

A stack may be dropped when it costs over ``slack`` more than the cheapest:
with the role grammar any stack can take over another one's further plan for
at most a deletion (of a system turn) and two insertions more, so such a
stack can neither win nor tie.  Edits that all live tops share are applied
at once and their rows let go.

Rows come sorted by (conversation, turn, role, text) and are read as a
stream; a conversation spread over many batches is never gathered, only its
undecided rows and 16 bytes for each distinct (role, text) are held.  One
conversation is read by one task by nature, as its digest is one hash over
its text in order.

Defined cases: null role and text become one space (``damage``) and a null
turn sorts first; a null conv_id is a conversation of its own; repeated rows
are rows of their own and the later ones count as duplicates; a role outside
the grammar can't be kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Lower-case letters are role initials, others rules: a conversation is empty or ends in an Answered pair, whose Users may follow a System turn.
#: The rules are left-linear, so settled stacks hold one symbol and equal futures mean equal tops.
ROLES = (("C", ""), ("C", "A"), ("A", "Ua"), ("U", "u"), ("U", "Su"), ("U", "Au"), ("S", "s"))
LEGAL_PAIRS = frozenset(("su", "ua", "au"))
_INK = re.compile(r"[^\x20\x09-\x0D]")


@dataclass(frozen=True)
class Weights:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3
    #: None keeps every stack.
    slack: int | None = 10


# --- the table ----------------------------------------------------------------

class Table:
    """SLR table of a grammar: ``action[state][terminal]`` lists ("shift", state), ("reduce", rule) and ("accept", 0)."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.rules = (("'", rules[0][0]), *rules)
        heads = {h for h, _ in self.rules}
        follow = self._follow(heads)
        start = self._closure({(0, 0)}, heads)
        states, self.goto, self.action = [start], [], []
        for items in states:  # grows while it is walked
            go: dict[str, int] = {}
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                nxt = self._closure({(r, d + 1) for r, d in items if self.rules[r][1][d:d + 1] == symbol}, heads)
                if nxt not in states:
                    states.append(nxt)
                go[symbol] = states.index(nxt)
            act: dict[str, list[tuple[str, int]]] = {}
            for symbol, state in go.items():
                if symbol not in heads:
                    act.setdefault(symbol, []).append(("shift", state))
            for r, d in sorted(items):
                if d == len(self.rules[r][1]):
                    for t in follow[self.rules[r][0]]:
                        act.setdefault(t, []).append(("reduce", r) if r else ("accept", 0))
            self.goto.append(go)
            self.action.append(act)

    def _closure(self, items: set[tuple[int, int]], heads: set[str]) -> frozenset[tuple[int, int]]:
        todo = list(items)
        while todo:
            r, d = todo.pop()
            symbol = self.rules[r][1][d:d + 1]
            for i, (head, _) in enumerate(self.rules):
                if symbol in heads and head == symbol and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return frozenset(items)

    def _follow(self, heads: set[str]) -> dict[str, set[str]]:
        empty: set[str] = set()
        first: dict[str, set[str]] = {h: set() for h in heads}
        follow: dict[str, set[str]] = {h: set() for h in heads}
        follow["'"].add("$")
        size = -1
        while size != (size := len(empty) + sum(map(len, first.values())) + sum(map(len, follow.values()))):
            for head, body in self.rules:
                after = set(follow[head])
                for x in reversed(body):
                    if x in heads:
                        follow[x] |= after
                        after = first[x] | (after if x in empty else set())
                    else:
                        after = {x}
                starts = True
                for x in body:
                    if starts:
                        first[head] |= first[x] if x in heads else {x}
                        starts = x in empty
                if starts:
                    empty.add(head)
        return follow


@dataclass(eq=False)
class Node:
    """A stack top: its state and the node below."""

    state: int
    below: Node | None


class Parser:
    """Stacks of a table, each node made once."""

    def __init__(self, rules: tuple[tuple[str, str], ...] = ROLES):
        self.table = Table(rules)
        self.nodes: dict[tuple[int, Node | None], Node] = {}
        self.moves: dict[tuple[Node, str], list[Node]] = {}
        self.start = self._node(0, None)

    def _node(self, state: int, below: Node | None) -> Node:
        return self.nodes.setdefault((state, below), Node(state, below))

    def _reduced(self, node: Node, rule: int) -> Node:
        head, body = self.table.rules[rule]
        for _ in body:
            node = node.below
        return self._node(self.table.goto[node.state][head], node)

    def _settled(self, node: Node) -> Node:
        """``node`` after the reductions that its state asks for whatever comes next."""
        while len(only := {a for actions in self.table.action[node.state].values() for a in actions}) == 1:
            ((kind, rule),) = only
            if kind != "reduce":
                break
            node = self._reduced(node, rule)
        return node

    def shift(self, top: Node, terminal: str) -> list[Node]:
        """The tops after reading ``terminal``, all its reductions done; for "$": [top] if the input may end here."""
        found = self.moves.get((top, terminal))
        if found is None:
            found, todo, seen = [], [top], {top}
            while todo:
                node = todo.pop()
                for kind, to in self.table.action[node.state].get(terminal, ()):
                    if kind == "shift":
                        found.append(self._settled(self._node(to, node)))
                    elif kind == "accept":
                        found.append(node)
                    elif (nxt := self._reduced(node, to)) not in seen:
                        seen.add(nxt)
                        todo.append(nxt)
            self.moves[top, terminal] = found
        return found


# --- the weighted search ---------------------------------------------------------

@dataclass
class Repairer:
    """The live stack tops of one conversation: rows go in by ``read``, edits come out of ``decided`` and ``finish``."""

    parser: Parser
    weights: Weights = field(default_factory=Weights)
    editable: str = "ua"

    def __post_init__(self) -> None:
        # node -> (cost, order of its audit, edits as a chain of [chain before, edits of a row])
        self.tops: dict[Node, tuple[int, int, list]] = {self.parser.start: (0, 0, [None, ()])}

    def _inserted(self) -> dict[Node, tuple[int, int, str, tuple, list]]:
        """node -> (cost, order, letters since, edits since, chain), insertions from every top included."""
        best = {node: (cost, order, "", (), chain) for node, (cost, order, chain) in self.tops.items()}
        todo = list(best)
        while todo:
            node = todo.pop()
            cost, order, letters, edits, chain = best[node]
            if self.weights.slack is not None and cost > min(t[0] for t in self.tops.values()) + self.weights.slack:
                continue
            for symbol in self.editable:
                for to in self.parser.shift(node, symbol):
                    new = (cost + self.weights.insert, order, letters + INSERT, (*edits, (INSERT, symbol)), chain)
                    if to not in best or new[:4] < best[to][:4]:
                        best[to] = new
                        todo.append(to)
        return best

    def read(self, symbol: str, must_delete: bool, truncated: bool) -> None:
        w = self.weights
        after: dict[Node, tuple[int, int, str, tuple, list]] = {}

        def reach(node: Node, new: tuple[int, int, str, tuple, list]) -> None:
            if node not in after or new[:4] < after[node][:4]:
                after[node] = new

        for node, (cost, order, letters, edits, chain) in self._inserted().items():
            reach(node, (cost + w.delete, order, letters + DELETE, (*edits, (DELETE, "")), chain))
            if must_delete:
                continue
            stays = cost + (w.truncated if truncated else 0)
            for to in self.parser.shift(node, symbol):
                reach(to, (stays, order, letters + KEEP, (*edits, (KEEP, symbol)), chain))
            for role in self.editable:
                for to in self.parser.shift(node, role):
                    reach(to, (stays + w.rerole, order, letters + REROLE, (*edits, (REROLE, role)), chain))
        least = min(new[0] for new in after.values())
        live = sorted((n for n, new in after.items() if w.slack is None or new[0] <= least + w.slack), key=lambda n: after[n][1:4])
        self.tops = {node: (after[node][0], order, [after[node][4], after[node][3]]) for order, node in enumerate(live)}

    @staticmethod
    def _walk(chain: list) -> list[list]:
        out = []
        while chain is not None:
            out.append(chain)
            chain = chain[0]
        return out[::-1]

    def decided(self) -> list[tuple[str, str]]:
        """Edits that every live top shares; they are given once."""
        chains = [self._walk(chain) for _, _, chain in self.tops.values()]
        n = 0
        while all(len(c) > n and c[n] is chains[0][n] for c in chains):
            n += 1
        shared, out = chains[0][:n], []
        for link in shared:
            out += link[1]
        if shared:
            shared[-1][0], shared[-1][1] = None, ()
        return out

    def finish(self) -> tuple[int, list[tuple[str, str]]]:
        """(cost, the edits not given yet) of the cheapest derivation, ties by the least audit."""
        ends = [new for node, new in self._inserted().items() if self.parser.shift(node, "$")]
        cost, _, _, edits, chain = min(ends, key=lambda new: new[:4])
        return cost, [e for link in self._walk(chain) for e in link[1]] + list(edits)


# --- conversations ------------------------------------------------------------------

def fault_of(text: str, is_repeat: bool) -> str:
    """"blank", "duplicate", "truncated" or ""; the first that holds."""
    stripped = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
    if not _INK.search(text):
        return "blank"
    if is_repeat:
        return "duplicate"
    return "" if stripped[-1] in ".!?" else "truncated"


class Conversation:
    """One conversation, read row by row; ``out(edit, role, text, turn)`` gets every edit's turn in order (deleted ones too)."""

    #: Rows between two looks for edits that all tops share.
    EVERY = 64

    def __init__(self, parser: Parser, weights: Weights, names: dict[str, str], out: Callable[[str, str, str, int | None], None]):
        self.search, self.names, self.out = Repairer(parser, weights, "".join(names)), names, out
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.last_initial = None
        self.distinct = self.n = 0
        self.seen: set[bytes] = set()
        self.held: deque[tuple[str, str, int | None]] = deque()

    def row(self, turn: int | None, role: str, text: str) -> None:
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        fault = fault_of(text, key in self.seen)
        self.seen.add(key)
        if fault:
            self.counts[fault] += 1
        if self.last_initial is not None and self.last_initial + role[:1] not in LEGAL_PAIRS:
            self.counts["illegal"] += 1
        self.last_initial = role[:1]
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        self.held.append((role, text, turn))
        self.search.read(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        self.n += 1
        if self.n % self.EVERY == 0:
            self._apply(self.search.decided())

    def _apply(self, edits: list[tuple[str, str]]) -> None:
        for edit, symbol in edits:
            if edit == INSERT:
                self.out(edit, self.names[symbol], "", None)
            else:
                role, text, turn = self.held.popleft()
                self.out(edit, self.names[symbol] if edit == REROLE else role, text, turn)

    def end(self) -> dict[str, int]:
        cost, edits = self.search.finish()
        self._apply(edits)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"gaps": gaps, **self.counts, "cost": cost}


#: Roles that an edit may give, by initial.
NAMES = {"u": "user", "a": "assistant"}


def damage(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32("conv_id:turn") % 20; null values count as one space."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    return convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.when(kind == 4, F.lit("user")).otherwise(filled("role")).alias("role"), text.alias("text"),
                        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("int").alias("copies"))


def as_rows(convs: DataFrame) -> DataFrame:
    """Undamaged rows in the form that ``report`` and ``repaired`` take; null role and text become one space."""
    return convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).alias("copies"))


def _sorted(rows: DataFrame) -> DataFrame:
    return (rows.select("conv_id", "turn", "role", "text", "copies").repartition("conv_id")
            .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text"))


def _conversations(batches: Iterator[pa.RecordBatch], start: Callable[[int | None], Conversation],
                   done: Callable[[int | None, Conversation], None]) -> Iterator[None]:
    """Feeds sorted rows to one ``Conversation`` after another; yields after every batch and at the end."""
    conv_id, conv = None, None
    for batch in batches:
        for cid, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if conv is None or cid != conv_id:
                if conv is not None:
                    done(conv_id, conv)
                conv_id, conv = cid, start(cid)
            for _ in range(copies):
                conv.row(turn, role, text)
        yield
    if conv is not None:
        done(conv_id, conv)
    yield


def report(rows: DataFrame, rules: tuple[tuple[str, str], ...] = ROLES, weights: Weights = Weights()) -> DataFrame:
    """(conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation."""
    longs = ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, out, kept = Parser(rules), [], {}

        def start(_: int | None) -> Conversation:
            audit, digest, lines = [], hashlib.sha256(), []

            def edit(kind: str, role: str, text: str, turn: int | None) -> None:
                audit.append(kind)
                if kind != DELETE:
                    digest.update(("\n" * bool(lines) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    lines[:] = [True]

            conv = Conversation(parser, weights, NAMES, edit)
            kept[0] = (audit, digest)
            return conv

        def done(conv_id: int | None, conv: Conversation) -> None:
            found = conv.end()
            audit, digest = kept[0]
            out.append((conv_id, conv.n, *(found[c] for c in longs[1:]), "".join(audit), digest.hexdigest()))

        for _ in _conversations(batches, start, done):
            if out:
                cols = list(zip(*out))
                kinds = [pa.int64()] * 8 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", *longs, "audit", "repaired_sha256"])
                out.clear()

    return _sorted(rows).mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in longs) + ", audit string, repaired_sha256 string")


def repaired(rows: DataFrame, rules: tuple[tuple[str, str], ...] = ROLES, weights: Weights = Weights()) -> DataFrame:
    """(conv_id, place, role, text, edit, turn): the repaired turns, ``place`` from 0; inserted ones have no turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, out = Parser(rules), []

        def start(conv_id: int | None) -> Conversation:
            place = [0]

            def edit(kind: str, role: str, text: str, turn: int | None) -> None:
                if kind != DELETE:
                    out.append((conv_id, place[0], role, text, kind, turn))
                    place[0] += 1

            return Conversation(parser, weights, NAMES, edit)

        for _ in _conversations(batches, start, lambda _, conv: conv.end()):
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["conv_id", "place", "role", "text", "edit", "turn"])
                out.clear()

    return _sorted(rows).mapInArrow(run, "conv_id long, place long, role string, text string, edit string, turn long")
