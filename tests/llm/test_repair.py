import hashlib
import random
import re
import time
import zlib
from functools import lru_cache

import pytest
from llm_helpers import CLASHING

from ledgerlens.llm import repair
from ledgerlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"
GOES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLE = {2: "user", 3: "assistant"}


def brute(rows):
    """Faults, cost, audit and repaired lines of (turn, role, text) rows in order, by the cost to go from every place."""
    seen, faults = set(), []
    for _, role, text in rows:
        ink = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserts):
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        nxt = 3 if state == 2 else 2
        if inserts < 3:
            c, a, out = best(i, nxt, inserts + 1)
            options.append((c + 3, "I" + a, (f"{ROLE[nxt]}:", *out)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, out = best(i + 1, state, 0)
            options.append((c + 4, "D" + a, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                c, a, out = best(i + 1, nxt, 0)
                options.append((c + 3 + extra, "R" + a, (f"{ROLE[nxt]}:{text}", *out)))
                if (state, role[:1]) in GOES:
                    c, a, out = best(i + 1, GOES[state, role[:1]], 0)
                    options.append((c + extra, "K" + a, (f"{role}:{text}", *out)))
        return min(options, default=(10**9, "", ()))

    cost, audit, out = best(0, 0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def damaged(rows):
    """(turn, role, text) rows of each conversation after the contract's damage."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out[conv] += [row, row] if kind == 3 else [row]
    return {c: sorted(r, key=lambda x: (x[0] is not None, x)) for c, r in out.items()}


def check(got, want):
    assert {r.conv_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert {k: r[k] for k in want[r.conv_id]} == want[r.conv_id], r.conv_id


def run(rows, slack=10, every=64):
    """One conversation through the parser alone."""
    audit, lines = [], []

    def out(kind, role, text, turn):
        audit.append(kind)
        if kind != "D":
            lines.append(f"{role}:{text}")

    conv = repair.Conversation(repair.Parser(), repair.Weights(slack=slack), repair.NAMES, out)
    conv.EVERY = every
    for row in rows:
        conv.row(*row)
    return {**conv.end(), "audit": "".join(audit), "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    check(QUERIES["op11_conversation_repair"](spark, SF001).collect(), {c: brute(r) for c, r in damaged(rows).items()})


@pytest.mark.parametrize("slack,every", [(10, 1), (10, 3), (None, 2)])
def test_random_conversations_equal_brute_force(slack, every):
    rng = random.Random(slack)
    for _ in range(1500):
        rows = [(i, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", ""]), rng.choice(["Hi.", f"Hi {i}.", f"Hi {i}!", "cut", "cut off", " \n"]))
                for i in range(rng.randint(0, 9))]
        assert run(rows, slack, every) == brute(tuple(rows)), rows


def test_dropping_dear_stacks_changes_nothing():
    rng = random.Random(5)
    for _ in range(40):
        rows = [(i, rng.choice(["user", "assistant", "system"]), rng.choice([f"Hi {i}.", f"Hi {i}", "", "Same."])) for i in range(rng.randint(30, 120))]
        assert run(rows, 10, 4) == run(rows, None, 10**9)


def test_table_takes_the_role_grammar():
    parser = repair.Parser()
    for n in range(7):
        for k in range(3**n):
            word = "".join("sua"[k // 3**i % 3] for i in range(n))
            tops = [parser.start]
            for c in word:
                tops = [t for x in tops for t in parser.shift(x, c)]
            ends = [t for x in tops for t in parser.shift(x, "$")]
            assert bool(ends) == bool(re.fullmatch("(s?(ua)+)?", word)), word


def test_ambiguous_grammar_keeps_both_stacks():
    parser = repair.Parser((("E", "EE"), ("E", "x")))
    tops = [parser.start]
    for c in "xxx":
        tops = [t for x in tops for t in parser.shift(x, c)]
    assert len(tops) == 2 and any(parser.shift(t, "$") for t in tops)


EDGE = [(1, None, None, None), (1, 2, "user", None), (2, 0, None, "x."), (None, 0, "user", "a."), (None, 1, "assistant", "b."), (3, 0, "user", ""),
        (3, 0, "user", ""), (4, 5, "assistant", "é漢."), (4, 5, "assistant", "é漢."), (4, 9, "system", "z."), (5, None, "user", "q?"),
        (6, 0, "user", "w " * 100_000 + "."), (6, 1, "assistant", " \t\n\x0b\x0c\r"), (7, -3, "user", "\xa0"), (7, 8, "ünder", "\x00.")]


def edge_frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", *[F.lit(1).alias(c) for c in [*CLASHING, "copies", "audit"]])


def test_edge_rows(spark):
    check(repair.report(repair.damage(edge_frame(spark, EDGE))).collect(), {c: brute(tuple(r)) for c, r in damaged(EDGE).items()})


def test_empty_table(spark):
    empty = edge_frame(spark, [])
    assert repair.report(repair.damage(empty)).collect() == [] and repair.repaired(repair.as_rows(empty)).collect() == []


def test_conversation_of_dropped_rows_is_returned(spark):
    key = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    (row,) = repair.report(repair.damage(edge_frame(spark, [(*key, "user", "a.")]))).collect()
    assert row.audit == "" and row.cost == row.gaps == 0 and row.repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_repaired_turns_follow_the_grammar(spark):
    convs = spark.read.parquet(f"{SF001}/conversations.parquet")
    by, audits = {}, {r.conv_id: r for r in repair.report(repair.damage(convs)).collect()}
    for r in repair.repaired(repair.damage(convs)).collect():
        by.setdefault(r.conv_id, []).append(r)
    for conv, turns in by.items():
        turns.sort(key=lambda r: r.place)
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in turns))
        assert audits[conv].audit.replace("D", "") == "".join(r.edit for r in turns)
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == audits[conv].repaired_sha256


def test_a_conversation_of_many_rows(spark):
    """A third of all rows in one conversation, all users: time in proportion to the rows."""
    began = time.time()
    rows = [(i, "user", f"Hi {i}.") for i in range(20_000)]
    got = run(rows)
    assert got["cost"] == 3 * 10_000 and len(got["audit"]) == 20_000 and time.time() - began < 60
    n = 3000
    many = [(1, i, "user" if i % 2 == 0 else "assistant", f"Hi {i}.") for i in range(n)] + [(2 + i // 2, i % 2, ["user", "assistant"][i % 2], "Yo.") for i in range(2 * n)]
    got = {r.conv_id: r for r in repair.report(repair.as_rows(spark.createDataFrame(many, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].audit == "K" * n and got[1].cost == 0 and len(got) == n + 1


def test_edits_are_given_early():
    search = repair.Repairer(repair.Parser())
    given = 0
    for i in range(1000):
        search.read("ua"[i % 2], False, False)
        given += len(search.decided())
    assert given >= 990
