"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Texts are lower-cased (A-Z), split into pieces and words; every word starts
a suffix of at most ``max_words`` words of its piece.  Suffixes are routed
over the cluster by language and leading words, and each task sorts pointers
to them by multikey quicksort: partitions are split three ways around a
pivot word, the equal part moves on to the next word, and its size is the
count of the phrase read so far.  Partitions under ``least`` are abandoned,
which is final since all suffixes of a pair of leading words lie in one task.

Three things keep the routed rows few and even:

* a first pass counts hashed word pairs and sets a bit for every pair that
  may be frequent (``BITMAP_BITS`` bits, whatever the input; collisions only
  let more through).  A frequent phrase holds frequent pairs only, so a
  suffix ends before its first other pair and counts stay exact;
* equal suffixes of a task's text are one row with a count;
* a pair with more occurrences than half a mean task's share is routed by
  all words of the suffix instead, at most one row of each task under one
  key; its partitions aren't abandoned but summed up once more (at most
  twice as many such pairs as tasks, so their set is small).

Candidates are scored by their weakest cut with decimals, as products pass
64 bits.  One longer candidate with a word more decides whether a phrase is
dropped: if any longer one is frequent enough, so is one between them.

Defined cases: a null text is empty, a null language is ``und``; repeated
rows count as often as they stand there; ties go by score, count and phrase
in UTF-8 byte order; an empty table gives an empty result; other columns are
never read.  Long texts are cut into blocks that overlap by a suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import chunks, joined, mix, partitions, span_hashes, stage

LEAST, MAX_WORDS, TOP = 100, 5, 2000
BITMAP_BITS = 26
#: Words of which equal pairs or suffixes are counted together; five ranks of a block's words fit two 64-bit keys.
BLOCK = 1_000_000
_RANK_BITS = 21
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 0 a word's byte, 1 a blank, 2 the end of a piece.
_KIND = bytes(2 if b in b".,;:!?\n\x0b\x0c\r" else 1 if b in b" \t" else 0 for b in range(256))
_PAIR = np.uint64(0x9E3779B97F4A7C15)


# --- words of texts -----------------------------------------------------------

class Words:
    """Words of many texts in a row: their bytes, and where pieces and languages change."""

    def __init__(self) -> None:
        self.bytes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.follows: list[np.ndarray] = []
        self.langs: list[np.ndarray] = []
        self.codes: dict[str, int] = {}
        self.n = 0

    def add(self, texts: list[bytes], langs: list[str]) -> None:
        raw, offsets = joined(texts, b"\n")
        low = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
        kind = np.frombuffer(raw.tobytes().translate(_KIND), np.uint8)
        word = np.concatenate([[False], kind == 0])  # ends with the separator
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        per_text = np.diff(np.searchsorted(starts, offsets))
        codes = np.array([self.codes.setdefault(x, len(self.codes)) for x in langs], np.int32)
        self.bytes.append(low[kind == 0])
        self.sizes.append((ends - starts).astype(np.int32))
        self.follows.append(np.concatenate([[False], piece[1:] == piece[:-1]])[:len(starts)])
        self.langs.append(np.repeat(codes, per_text))
        self.n += len(starts)

    def take(self) -> Block:
        block = Block(np.concatenate(self.bytes), np.concatenate(self.sizes), np.concatenate(self.follows), np.concatenate(self.langs),
                      list(self.codes))
        self.__init__()
        return block


class Block:
    """Encoded words: ``code`` into ``vocabulary``, ``lang`` into ``langs``; ``follows``: in the piece of the word before."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, follows: np.ndarray, lang: np.ndarray, langs: list[str]):
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        encoded = words.dictionary_encode()
        self.code, self.vocabulary = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
        self.follows, self.lang, self.langs = follows, lang, langs
        self.word_hash, self.lang_hash = hashes(self.vocabulary), hashes(pa.array([x.encode() for x in langs], pa.large_binary()))

    def pairs(self) -> np.ndarray:
        """A hash of each word and the next, with the language; the last word has none."""
        h = self.word_hash[self.code]
        return mix((h[:-1] ^ self.lang_hash[self.lang[:-1]]) * _PAIR + h[1:])


def hashes(words: pa.Array) -> np.ndarray:
    data, ends = joined([w for w in words.to_pylist()], b"")
    return span_hashes(data, ends[:-1], ends[1:]) if len(words) else np.zeros(0, np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """(text, lang) batches as blocks of about ``BLOCK`` words."""
    words = Words()
    for batch in batches:
        texts = [x or b"" for x in batch.column(0).cast(pa.large_binary()).to_pylist()]
        langs = batch.column(1).to_pylist()
        for a, b in chunks([len(x) for x in texts]):
            words.add(texts[a:b], langs[a:b])
            if words.n >= BLOCK:
                yield words.take()
    if words.n:
        yield words.take()


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))


# --- pass one: pairs that may be frequent -------------------------------------------

def pair_counts(docs: DataFrame, text_col: str, lang_col: str, least: int) -> DataFrame:
    """(pair, n): hashed pairs of neighbouring words that stand ``least`` times or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            pair, n = np.unique(block.pairs()[block.follows[1:]], return_counts=True)
            for a in range(0, len(pair), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(pair[a:a + (1 << 17)].view(np.int64)), pa.array(n[a:a + (1 << 17)])], ["pair", "n"])

    return (_texts(docs, text_col, lang_col).mapInArrow(run, "pair long, n long")
            .groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def bitmap(pairs: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bit for every pair, by its low ``bits`` bits; at most 2**bits / 64 rows reach the driver."""
    slot = F.col("pair").bitwiseAND((1 << bits) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    rows = pairs.groupBy((slot / 64).cast("long").alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(max(1, (1 << bits) // 64), np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _held(bitmap: np.ndarray, pair: np.ndarray) -> np.ndarray:
    slot = pair & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


# --- pass two: suffixes, routed by leading words ------------------------------------------

#: What a routed row is: a language's words in all, a word, a suffix routed by two words, one routed by all its words.
TOTAL, WORD, SUFFIX, SPREAD = range(4)


def suffixes(docs: DataFrame, text_col: str, lang_col: str, may: np.ndarray, hot: np.ndarray, max_words: int) -> DataFrame:
    """(route, kind, lang, phrase, n): equal rows of a block are one, with their number."""
    sent = docs.sparkSession.sparkContext.broadcast((may, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, hot = sent.value
        for block in _blocks(batches):
            names = pa.array(block.langs, pa.string())
            total = np.bincount(block.lang, minlength=len(block.langs))
            yield _routed(block.lang_hash, TOTAL, names, pa.array([""] * len(names), pa.string()), total)
            word, n = np.unique(block.code * len(block.langs) + block.lang, return_counts=True)
            code, lang = word // len(block.langs), word % len(block.langs)
            yield from _sliced(mix(block.word_hash[code] ^ block.lang_hash[lang]), np.full(len(word), WORD, np.int8), names.take(pa.array(lang)),
                               block.vocabulary.take(pa.array(code)).cast(pa.binary()).cast(pa.string()), n)
            pair = block.pairs()
            on = np.zeros(len(block.code), bool)  # this word and the next may be a frequent pair
            on[:-1] = block.follows[1:] & _held(may, pair)
            for a in range(0, len(on), BLOCK):
                yield from _distinct(block, names, on, pair, hot, a, min(a + BLOCK, len(on)), max_words)

    return _texts(docs, text_col, lang_col).mapInArrow(run, "route long, kind tinyint, lang string, phrase string, n long")


def _distinct(block: Block, names: pa.Array, on: np.ndarray, pair: np.ndarray, hot: np.ndarray, a: int, b: int, max_words: int) -> Iterator[pa.RecordBatch]:
    """Rows of the suffixes that start in words ``a`` to ``b``."""
    at = a + np.flatnonzero(on[a:b])
    if not len(at):
        return
    columns, more = [block.code[at]], np.ones(len(at), bool)
    for k in range(1, max_words):
        before = np.minimum(at + k - 1, len(on) - 1)
        more = more & on[before] & (at + k < len(on))
        columns.append(np.where(more, block.code[np.minimum(at + k, len(on) - 1)], -1))
    ranks = np.unique(np.concatenate(columns))
    lang = block.lang[at]
    wide = max(len(ranks), len(block.langs)) >> _RANK_BITS
    key = [lang.astype(np.int64)]
    for k, column in enumerate(columns):
        rank = np.searchsorted(ranks, column)
        if k % 3 == 2 or wide:
            key.append(rank)
        else:
            key[-1] = key[-1] << _RANK_BITS | rank
    order = np.lexsort(key[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for column in key:
        new[1:] |= column[order[1:]] != column[order[:-1]]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    pick = order[first]
    parts = [block.vocabulary.take(pa.array(c[pick], mask=c[pick] < 0)).cast(pa.binary()).cast(pa.string()) for c in columns]
    phrase = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
    route = pair[at[pick]]
    spread = hot[np.minimum(np.searchsorted(hot, route), max(len(hot) - 1, 0))] == route if len(hot) else np.zeros(len(pick), bool)
    whole = route.copy()
    for c in columns[2:]:
        whole = mix(whole * _PAIR + np.where(c[pick] < 0, np.uint64(1), block.word_hash[c[pick]]))
    yield from _sliced(np.where(spread, whole, route), np.where(spread, SPREAD, SUFFIX).astype(np.int8), names.take(pa.array(lang[pick])), phrase, n)


def _sliced(route: np.ndarray, kind: np.ndarray, lang: pa.Array, phrase: pa.Array, n: np.ndarray, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(route), size):
        yield pa.RecordBatch.from_arrays([pa.array(route[a:a + size].view(np.int64)), pa.array(kind[a:a + size]), lang[a:a + size],
                                          phrase[a:a + size], pa.array(n[a:a + size].astype(np.int64))], ["route", "kind", "lang", "phrase", "n"])


def _routed(route: np.ndarray, kind: int, lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return next(_sliced(route, np.full(len(route), kind, np.int8), lang, phrase, n, max(len(route), 1)))


# --- the sort -----------------------------------------------------------------------

def multikey(keys: np.ndarray, pointers: np.ndarray, weights: np.ndarray, depth: int, least: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(pointer, depth, count) arrays of every prefix of up to ``depth`` keys whose suffixes weigh ``least`` or more.

    Multikey three-way quicksort of ``pointers`` into ``keys`` (a suffix ends
    at -1).  All partitions take one step at a time: partition p lies at
    ``first[p]`` and compares the key ``level[p]`` places on.  The equal part
    is a prefix and its weight a count; parts under ``least`` are abandoned.
    """
    first, level = np.zeros(min(1, len(pointers)), np.int64), np.zeros(min(1, len(pointers)), np.int64)
    while len(pointers):
        sizes = np.diff(np.append(first, len(pointers)))
        part = np.repeat(np.arange(len(first)), sizes)
        key = keys[pointers + level[part]]
        low, mid, high = key[first], key[first + sizes // 2], key[first + sizes - 1]
        pivot = np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high))  # the median of three
        side = np.sign(key - pivot[part]) + 1
        slot = part * 3 + side
        count = np.bincount(slot, minlength=3 * len(first))
        weight = np.bincount(slot, weights=weights, minlength=3 * len(first)).astype(np.int64)
        order = np.empty(len(pointers), np.int64)  # where each pointer goes: its part's start, and its rank there
        start = np.concatenate([[0], np.cumsum(count)])
        for s in range(3):
            rank = np.cumsum(side == s)
            mine = np.flatnonzero(side == s)
            before = rank[first] - (side[first] == s)
            order[start[slot[mine]] + rank[mine] - 1 - before[part[mine]]] = mine
        pointers, weights = pointers[order], weights[order]
        deeper = np.repeat(level, 3)
        deeper[1::3] += 1
        keep = weight >= least
        keep[1::3] &= pivot >= 0
        equal = np.flatnonzero(keep[1::3]) * 3 + 1
        for d in np.unique(deeper[equal]):
            at = equal[deeper[equal] == d]
            yield pointers[start[at]], int(d), weight[at]
        keep[1::3] &= deeper[1::3] < depth
        alive = np.repeat(keep, count)
        pointers, weights = pointers[alive], weights[alive]
        first, level = np.concatenate([[0], np.cumsum(count[keep])])[:-1], deeper[keep]


def _counted(kind: int, lang: pa.ChunkedArray, phrase: pa.ChunkedArray, n: np.ndarray, max_words: int, least: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, n) rows of the prefixes of one kind of routed rows."""
    langs = lang.combine_chunks().dictionary_encode()
    texts = phrase.combine_chunks().cast(pa.large_binary()).to_pylist()
    if kind == TOTAL:
        sums = np.bincount(langs.indices.to_numpy(), weights=n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([langs.dictionary, pa.array([""] * len(sums), pa.string()), pa.array(np.zeros(len(sums), np.int64)), pa.array(sums)],
                                         ["lang", "phrase", "words", "n"])
        return
    data, ends = joined(texts, b" ")
    stops = np.flatnonzero(data == 32)
    sizes = np.diff(np.concatenate([[-1], stops])) - 1
    block = Block(data[data != 32], sizes, np.zeros(0, bool), np.zeros(0, np.int64), [])
    lengths = np.diff(np.searchsorted(stops, ends))
    # a suffix's keys: its language, its words, -1
    width = lengths + 2
    first = np.concatenate([[0], np.cumsum(width)])[:-1]
    keys = np.full(int(width.sum()), -1, np.int64)
    keys[first] = langs.indices.to_numpy()
    words_at = np.repeat(first + 1, lengths) + np.arange(len(block.code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys[words_at] = block.code
    shallow = 1 if kind == WORD else 2
    for pointer, d, count in multikey(keys, first, n, 1 + (1 if kind == WORD else max_words), 1 if kind == SPREAD else least):
        if d - 1 < shallow:
            continue
        parts = [block.vocabulary.take(pa.array(keys[pointer + 1 + k])).cast(pa.binary()).cast(pa.string()) for k in range(d - 1)]
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys[pointer])), pc.binary_join_element_wise(*parts, " "),
                                          pa.array(np.full(len(pointer), d - 1, np.int64)), pa.array(count)], ["lang", "phrase", "words", "n"])


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, max_words: int = MAX_WORDS,
                  bits: int = BITMAP_BITS, rows_held: int = BLOCK // 2) -> DataFrame:
    """(lang, phrase, words, n): every phrase of 1 to ``max_words`` words that stands ``least`` times or more, and, with the
    empty phrase, all words of the language."""
    n_parts = partitions(docs.sparkSession)
    pairs = stage(pair_counts(docs, text_col, lang_col, least))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    hot = pairs.where(F.col("n") > total / (2 * n_parts)).select("pair").toPandas()["pair"].to_numpy(np.int64).view(np.uint64)  # 2 n_parts at most
    rows = suffixes(docs, text_col, lang_col, bitmap(pairs, bits), np.sort(hot), max_words)
    # all rows of a route lie next to each other, so whole routes can be sorted a bounded number of rows at a time
    routed = rows.repartition("route").sortWithinPartitions("route")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            for kind in range(4):
                mine = table.filter(pc.equal(table["kind"], kind))
                if mine.num_rows:
                    for out in _counted(kind, mine["lang"], mine["phrase"], mine["n"].to_numpy(), max_words, least):
                        if out.num_rows:
                            yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            if sum(b.num_rows for b in held) >= rows_held:
                route = batch.column(0).to_numpy()
                new = np.flatnonzero(route != held[-1].column(0)[-1].as_py())
                if len(new):
                    held.append(batch.slice(0, int(new[0])))
                    yield from flush()
                    batch = batch.slice(int(new[0]))
            held.append(batch)
        if held:
            yield from flush()

    counts = routed.mapInArrow(run, "lang string, phrase string, words long, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return counts.where((F.col("words") == 0) | (F.col("n") >= least))


# --- scores ---------------------------------------------------------------------------

def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, max_words: int = MAX_WORDS,
                 top: int = TOP, percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` candidates by their weakest cut."""
    counts = stage(phrase_counts(docs, text_col, lang_col, least, max_words))
    found = counts.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    parts = F.split("phrase", " ")
    # phrases inside a candidate with one word more, and the largest count of such
    inner = (found.where("words >= 3")
             .select("lang", F.col("a").alias("longer"), F.explode(F.array(F.array_join(F.slice(parts, 2, F.size(parts) - 1), " "),
                                                                           F.array_join(F.slice(parts, 1, F.size(parts) - 1), " "))).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = (found.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer"))
    cuts = (kept.withColumn("parts", parts).select("lang", "phrase", "a", "parts", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("left"),
                    F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts") - F.col("k")), " ").alias("right")))
    part = counts.where("words >= 1")
    scored = (cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
              .join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
              .join(counts.where("words = 0").select("lang", "n"), "lang"))
    exact = "cast(cast(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) as decimal(19,0)) * cast(n as decimal(19,0)) as decimal(38,0))"
    exact = F.expr(f"{exact} div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))")
    weakest = (scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
               .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (weakest.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
