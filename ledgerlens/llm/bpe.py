"""BPE encoding and decoding by a tokenization automaton.

The merges, in order, define a deterministic automaton over tokens that
accepts the correct tokenizations and nothing else.  It starts as one state with a loop for every base symbol.  The gadget of merge
(u, v) -> w does three things: every state with an arc u gets an arc w, the
state behind w is a copy of the state behind v, and the state behind u loses
its arc v (if u = v, that state doesn't get the arc w either).  The automaton
is not built: nearly every pair of tokens has its arc, so its states and
transitions would be some square of the vocabulary.  Only the gadgets are
kept, by the token that each one makes and the arc it cuts, and an arc's
presence is decided lazily, by a test of the two tokens down the chain of
gadgets that is kept for the next time.

A pre-split word is encoded by a search over the tokens that spell it,
longest first, from a trie: a token without an arc from the one before it is
passed over, and the search steps back from a position that none leaves.
Each prefix of the word has exactly one accepted path, so such a position
stays closed and is tried once.  What follows a token in a word of usual
length is searched as a word of its own, and kept: a token and the path of the
rest are the word's path if the token has an arc to that path's first token,
as a path is accepted by its neighbouring tokens.  So words with equal ends
share their search.  Decoding emits the arcs' labels.

Texts go through the tokenizer file's own steps first: added tokens, the
normalizers NFC, white space and lower case, the split pattern and the
byte-level alphabet.  ``Tokenizer`` raises if the file asks for any other.
Letters, numbers and lower case are those of the Unicode versions that the library knows.

Ids are packed as little-endian unsigned 32-bit integers, the layout of
token files.  Defined cases: null text is the empty text (no ids, empty
decoded text); repeated rows, a null doc_id and an empty table pass through.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, map_batches, text_bytes

#: Ends of words, and pieces between white space, that a worker keeps the ids of: those asked for since the last
#: ``CACHE_WORDS`` new ones, and as many before them; some ten MB each.
CACHE_WORDS = 100_000
#: Symbols of a word whose ends are kept.
SHORT = 64


#: Code points that Python's split() takes for white space and Unicode doesn't.
_SEPARATORS = regex.compile("[\x1c-\x1f]").search


# Where the tables of ``regex`` and of Python differ from the library's, whose split pattern knows
# the letters and numbers of Unicode 16 and whose lower case is that of Unicode 17.
# Letters and numbers that ``regex`` knows and the library's pattern doesn't: first and last code point.
_NOT_YET = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F))
# Capitals that Python doesn't know: first, last and the first one's lower case.
_LATE_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))

_NEWER = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _NOT_YET) + "]")
_CAPITAL = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in _LATE_CAPITALS) + "]")
_LOWER = {c: low + c - a for a, b, low in _LATE_CAPITALS for c in range(a, b + 1)}


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.made: dict[int, tuple[int, int, int]] = {}  # token: (gadget, u, v)
        self.cut: dict[tuple[int, int], int] = {}  # arc that a gadget takes away: the gadget
        for i, (u, v) in enumerate(merges):
            a, b = vocab[u], vocab[v]
            self.made[vocab[u + v]] = (i, a, b)
            self.cut[a, b] = i
        self.trie: dict = {}  # by symbol; 0: the token that ends here, 1: the same with the word's end
        for t, i in vocab.items():
            final = bool(suffix) and t.endswith(suffix)
            node = self.trie
            for c in t[:-len(suffix)] if final else t:
                node = node.setdefault(c, {})
            node[int(final or not suffix)] = i
            if not suffix:
                node[0] = i
        self.longest = max(map(len, vocab), default=0)
        self.table: dict[int, dict[int, bool]] = {}  # state: its arcs looked up so far
        self.kept = 0
        self.loop = (-1, -1, -1)
        self.packed = [i.to_bytes(4, "little") for i in range(max(vocab.values(), default=-1) + 1)]
        self.tails: dict[str, tuple[int, bytes]] = {}  # ends of words: their first token and ids
        self.older: dict[str, tuple[int, bytes]] = {}

    def _arc(self, state: int, token: int, before: int) -> bool:
        """Whether the state behind token ``state`` has arc ``token`` once all gadgets under ``before`` are in."""
        while True:
            if self.cut.get((state, token), before) < before:
                return False
            i, _, right = self.made.get(state, self.loop)
            j, u, v = self.made.get(token, self.loop)
            if i < 0 and j < 0:
                return True
            if j >= i:  # gadget j gave the arc to states that had its u (for a state made by j itself: to the copied one)
                if state == u == v:
                    return False
                state, token, before = (right if i == j else state), u, j
            else:  # gadget i copied the state behind its v
                state, before = right, i

    def arc(self, state: int, token: int) -> bool:
        row = self.table.setdefault(state, {})
        found = row.get(token)
        if found is None:
            found = row[token] = self._arc(state, token, 1 << 60)
            self.kept += 1
        return found

    def _arcs(self, word: str, a: int) -> list[tuple[int, int]]:
        """(token, where it ends) of the tokens that spell the word from ``a`` on, longest last."""
        n, node, out, b = len(word), self.trie, [], a
        for c in word[a:a + self.longest]:
            node = node.get(c)
            if node is None:
                return out
            b += 1
            if 0 in node and b < n:
                out.append((node[0], b))
        if b == n and 1 in node:
            out.append((node[1], n))
        return out

    def ids(self, word: str) -> bytes:
        """The word's packed ids."""
        if not 0 < len(word) <= SHORT:
            return np.array(self.encode(word), "<u4").tobytes()
        if self.kept > 2 * CACHE_WORDS:
            self.table, self.kept = {}, 0
        if len(self.tails) > CACHE_WORDS:
            self.tails, self.older = {}, self.tails
        return self._tail(word)[1]

    def _tail(self, word: str) -> tuple[int, bytes]:
        """The first token and the packed ids of a short word, (-1, nothing) if no path ends it."""
        found = self.tails.get(word) or self.older.get(word)
        if found is None:
            n, arcs, found = len(word), self._arcs(word, 0), (-1, b"")
            while arcs:
                token, end = arcs.pop()
                if end == n:
                    found = token, self.packed[token]
                    break
                rest = word[end:]
                first, ids = self.tails.get(rest) or self._tail(rest)
                if first < 0:
                    continue
                row = self.table.get(token)
                yes = row.get(first) if row is not None else None
                if self.arc(token, first) if yes is None else yes:
                    found = token, self.packed[token] + ids
                    break
        self.tails[word] = found
        return found

    def encode(self, word: str) -> list[int]:
        """The word's ids.  Beside them the search keeps eight bytes a token and one a symbol, so a word of many MB is no matter."""
        if self.kept > 2 * CACHE_WORDS:
            self.table, self.kept = {}, 0
        n, table = len(word), self.table
        if not n:
            return []
        # Only one accepted path leads to a position, so a position from which none ends the word stays closed.
        closed = bytearray(n + 1)
        states, starts = array("i"), array("i")  # the path: tokens behind the present one, and where each present one began
        state, at, arcs, row = -1, 0, self._arcs(word, 0), None
        while at < n:
            while arcs:
                token, end = arcs.pop()
                if closed[end]:
                    continue
                if row is not None:
                    found = row.get(token)
                    if not (self.arc(state, token) if found is None else found):
                        continue
                states.append(state)
                starts.append(at)
                state, at = token, end
                row = table.setdefault(token, {})
                arcs = self._arcs(word, at) if at < n else []
                break
            else:
                closed[at] = 1
                failed, state, at = at, states.pop(), starts.pop()
                # Tokens are tried longest first, so those that end before the closed place are still to try.
                arcs = [x for x in self._arcs(word, at) if x[1] < failed]
                row = table.setdefault(state, {}) if state >= 0 else None
        return [*states[1:], state]


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenizer:
    def __init__(self, content: bytes):
        conf = json.loads(content)
        model = conf["model"]
        kinds = [x["type"] for x in conf["normalizer"]["normalizers"]]
        split, level = conf["pre_tokenizer"]["pretokenizers"]
        if (kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]
                or level["use_regex"] or level["add_prefix_space"] or conf["decoder"] or model["type"] != "BPE"
                or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))):
            raise ValueError("the tokenizer file uses steps that this operator doesn't have")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        if any(t.get(k) for t in conf["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("the tokenizer file has added tokens of a kind that this operator doesn't have")
        self.added = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.added_start = os.path.commonprefix(list(self.added))
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        space = r"\p{White_Space}"
        pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", space))
        self.words, self.found = pattern.findall, pattern.finditer
        self.blank = regex.compile(space + "+")
        self.letters = _alphabet()
        labels = {i: t for t, i in (model["vocab"] | self.added).items()}
        self.labels = [labels.get(i) for i in range(max(labels) + 1)]
        self.chunks: dict[str, bytes] = {}  # ids of what stands between white space
        self.older: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        # Printable ASCII stands for itself; a word holds no blank.
        symbols = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
        return self.automaton.ids(symbols)

    def _split(self, part: str) -> list[str]:
        """The pattern's words, with the letters and numbers that the library doesn't know yet taken for neither."""
        return [part[m.start():m.end()] for m in self.found(_NEWER.sub("\uffff", part))]

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            # Lower case is taken code point by code point: a final sigma is like any other.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if _CAPITAL.search(text):
                text = text.translate(_LOWER)
        # White space only parts words here, so runs of it need no replacing.
        text = text.lower()
        parts = self.blank.split(text) if _SEPARATORS(text) else text.split()
        if len(self.chunks) > CACHE_WORDS:
            self.chunks, self.older = {}, self.chunks
        chunks = self.chunks
        for part in set(parts).difference(chunks):
            ids = self.older.get(part)
            if ids is None:
                known = part.isascii() or not _NEWER.search(part)
                if known and part.isalpha():  # one run of letters
                    ids = self._word(part)
                else:
                    ids = b"".join(map(self._word, self.words(part) if known else self._split(part)))
            chunks[part] = ids
        return b"".join(map(chunks.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        if self.added_split is None or self.added_start not in text:
            return self._plain(text)
        parts = self.added_split.split(text)
        return b"".join(np.uint32(self.added[p]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_MADE: dict[str, Tokenizer] = {}


def tokenizer(content: bytes) -> Tokenizer:
    """The compiled tokenizer; a worker process makes it once."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Tokenizer(content)
    return _MADE[key]


def _content(spark: SparkSession, path: str):
    """The file as a broadcast: the driver reads it, so executors need no copy (a fixed size, some MB)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _through(df: DataFrame, col: str, out: str, kind: str, fn) -> DataFrame:
    """``df`` with ``fn`` of ``col`` as a further column ``out``."""
    at = df.columns.index(col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, fn(batch.column(at))], [*batch.schema.names, out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{out}` {kind}"])
    return map_batches(df, run, schema, sized_by=at)


def encode(df: DataFrame, text_col: str, path: str, out: str = "ids") -> DataFrame:
    """``df`` with the packed ids of ``text_col`` as binary column ``out``."""
    held = _content(df.sparkSession, path)

    def fn(column: pa.Array) -> pa.Array:
        t = tokenizer(held.value)
        return pa.array([t.encode(b.decode()) for b in text_bytes(column)], pa.binary())

    return _through(df, text_col, out, "binary", fn)


def decode(df: DataFrame, ids_col: str, path: str, out: str = "decoded") -> DataFrame:
    """``df`` with the labels of the packed ids as string column ``out``."""
    held = _content(df.sparkSession, path)

    def fn(column: pa.Array) -> pa.Array:
        t = tokenizer(held.value)
        return pa.array([t.decode(b or b"") for b in column.to_pylist()], pa.string())

    return _through(df, ids_col, out, "string", fn)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every document: ``encode`` and ``decode`` in one pass, so a task needs one worker."""
    held = _content(docs.sparkSession, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(held.value)
        ids = [t.encode(b.decode()) for b in text_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([t.decode(i) for i in ids], pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, decoded string", sized_by=1)
