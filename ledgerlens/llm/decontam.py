"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, case-folded (A-Z).  A document's words
around its seeds are aligned with the item's words (match +2, mismatch and
gap -1); the score is the best alignment's over that of the item with
itself, so an edited or paraphrased copy scores according to what is left
of it.

Seeds that no copy over the threshold can avoid: an alignment of m of an
item's L words that scores a share t has at most 2m - 2tL mismatches and
gaps, so of the m - 1 steps from one matched word to the next at least
ceil(tL) - 1 pass over one mismatch or gap or none.  Such a step is a pair of
words that stand one or two apart in the item and one or two apart in the
text.  So every pair one or two apart is an n-gram that may be a seed; the
documents' own counts (a pass over all of them) say which are rare, the
commonest places of an item are left out, half as many as its copies must
share, and a stretch of text is aligned where the other half of them stand
and at least as many of the item's words as the threshold needs.

Items of under ``SHORT`` words decide too little by half: only whole copies
of them match.

The test items are a stated query set: they are read in blocks of at most
``BLOCK_CHARS``, and a block's words are what gets broadcast.  The documents
are scanned and never shuffled, so no source, text or item can make a hot
task; an alignment holds two rows of its table, and a longer stretch of
seeds is aligned in windows that overlap by the longest alignment that
counts.

Defined cases: null and empty texts match nothing; neither do items without
words; equal items match alike; repeated rows each keep a row; an empty
benchmark leaves every document clean; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import chunks, fresh, joined, map_batches, mix, span_hashes, text_bytes

#: Items of fewer words match as a whole.
SHORT = 4
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, 1
BLOCK_CHARS = 8_000_000

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


@dataclass
class Words:
    """Words of several texts side by side."""
    hashes: np.ndarray
    starts: np.ndarray  # byte offsets in each word's text
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # where each text's words start, and one more at the end


def words_of(texts: list[bytes]) -> Words:
    data, at = joined([t.lower() for t in texts], b" ")
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    doc = np.searchsorted(at, starts, "right") - 1
    return Words(span_hashes(data, starts, ends), starts - at[doc], ends - at[doc], doc, np.searchsorted(doc, np.arange(len(texts) + 1)))


def pairs(w: Words, singles: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of the words' pairs one and two apart within a text; single words too if asked."""
    hashes, at = [], []
    for apart in (1, 2):
        n = max(len(w.hashes) - apart, 0)
        whole = np.flatnonzero(w.doc[:n] == w.doc[apart:])
        hashes.append(mix(w.hashes[:n][whole] * np.uint64(0x9E3779B97F4A7C15) + w.hashes[apart:][whole]))
        at.append(whole)
    if singles:
        hashes.append(mix(w.hashes))
        at.append(np.arange(len(w.hashes)))
    return np.concatenate(hashes), np.concatenate(at)


@dataclass
class Block:
    """Items of one block; seeds: sorted hashes with the (item, word) places of each."""
    ids: list[int]
    words: Words
    seeds: np.ndarray
    lead: np.ndarray
    place: np.ndarray  # index of a word in ``words``
    singles: bool
    share: np.ndarray  # per item: the least score share, the seeds that a copy must hold, and the words it may lie apart
    least: np.ndarray
    reach: np.ndarray

    def holds(self) -> np.ndarray:
        seen = np.zeros(1 << 18, bool)
        seen[(self.seeds & np.uint64(0x3FFFF)).astype(np.int64)] = True
        return seen

    def rare(self, counts: np.ndarray) -> "Block":
        """The block without the commonest places of each item; ``counts``: how often each seed stands in the corpus."""
        size = np.diff(self.words.first)
        common = np.zeros(len(self.words.hashes))
        of = np.repeat(np.arange(len(self.seeds)), np.diff(self.lead))
        np.add.at(common, self.place, counts[of])
        order = np.lexsort((-common, self.words.doc))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - self.words.first[self.words.doc[order]]
        drop = self.least // 2  # of the places that a copy shares at least
        keep = rank[self.place] >= drop[self.words.doc[self.place]]
        lead = np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=len(self.seeds)))])
        some = np.flatnonzero(np.diff(lead))
        return Block(self.ids, self.words, self.seeds[some], np.append(lead[some], lead[-1]), self.place[keep], self.singles, self.share,
                     np.where(size > 1, self.least - drop, 1), self.reach)


def block_of(items: list[tuple[int, bytes]], threshold: float = THRESHOLD) -> Block:
    w = words_of([t for _, t in items])
    size = np.diff(w.first)
    share = np.where(size < SHORT, 1.0, threshold)
    singles = bool((size == 1).any())
    h, at = pairs(w, singles)
    if singles:  # a single word is a seed of its own item only
        mine = np.arange(len(h)) < len(h) - len(w.hashes)
        mine |= size[w.doc[at]] == 1
        h, at = h[mine], at[mine]
    order = np.argsort(h, kind="stable")
    seeds, lead = np.unique(h[order], return_index=True)
    least = np.maximum(np.ceil(share * size - 1e-9).astype(np.int64) - 1, 1)
    reach = size + np.floor(2 * size * (1 - share) + 1e-9).astype(np.int64)
    return Block([i for i, _ in items], w, seeds, np.append(lead, len(h)), at[order], singles, share, least, reach)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    rows = (benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
            .where("i is not null and t is not null").orderBy("i", "t"))
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append((r.i, r.t.encode()))
        size += len(held[-1][1])
        if size > BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def found(block: Block, seen: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(seed number, index of its first word) of the block's seeds among the words."""
    h, at = pairs(w, block.singles)
    maybe = seen[(h & np.uint64(0x3FFFF)).astype(np.int64)]
    h, at = h[maybe], at[maybe]
    if not len(h) or not len(block.seeds):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = np.minimum(np.searchsorted(block.seeds, h), len(block.seeds) - 1)
    hit = block.seeds[k] == h
    return k[hit], at[hit]


def _rows(item: np.ndarray, text: np.ndarray, local: bool) -> Iterator[np.ndarray]:
    """The alignment table's rows, one after another; ``local``: an alignment may start anywhere, else at the corner."""
    at = np.arange(len(text) + 1)
    prev = np.zeros(len(text) + 1, np.int64) if local else -GAP * at
    for i, word in enumerate(item, 1):
        row = np.empty_like(prev)
        row[0] = 0 if local else -GAP * i
        np.maximum(prev[:-1] + np.where(text == word, MATCH, MISMATCH), prev[1:] - GAP, out=row[1:])
        if local:
            np.maximum(row, 0, out=row)
        prev = np.maximum.accumulate(row + GAP * at) - GAP * at  # gaps along the text
        yield prev


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, end word) of the best local alignment's stretch of ``text``, in two rows of memory."""
    best, last, end = 0, 0, 0
    for i, row in enumerate(_rows(item, text, True), 1):
        if row[j := int(row.argmax())] > best:
            best, last, end = int(row[j]), i, j
    if not best:
        return 0, 0, 0
    # Backwards from there, the shortest stretch with that score.
    start = 0
    for row in _rows(item[:last][::-1], text[:end][::-1], False):
        if len(hit := np.flatnonzero(row == best)):
            start = max(start, end - int(hit[0]))
    return best, start, end


def windows(start: int, end: int, reach: int) -> Iterator[tuple[int, int]]:
    """``start`` to ``end`` in windows of bounded size; every stretch of ``reach`` words lies in one."""
    while end - start > 8 * reach:
        yield start, start + 8 * reach
        start += 7 * reach
    yield start, end


def stretches(block: Block, w: Words, k: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first word, end word) wherever enough of an item's seeds lie close enough together."""
    count = block.lead[k + 1] - block.lead[k]
    place = block.place[np.repeat(block.lead[k], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    at = np.repeat(at, count)
    item = block.words.doc[place]
    order = np.lexsort((place, at, item))
    item, at, place = item[order], at[order], place[order]
    if not len(at):
        return
    # One place a word of the text counts; a text's words are numbered on, so (item, word) tells texts apart.
    new = np.append(True, (item[1:] != item[:-1]) | (at[1:] != at[:-1]))
    item, at = item[new], at[new]
    need, reach = block.least[item], block.reach[item]
    far = np.minimum(np.arange(len(at)) + need - 1, len(at) - 1)
    good = (np.arange(len(at)) + need - 1 < len(at)) & (item[far] == item) & (at[far] - at < reach) & (w.doc[at[far]] == w.doc[at])
    held = None
    for x in np.flatnonzero(good).tolist():
        i, doc, pad = int(item[x]), int(w.doc[at[x]]), int(reach[x])
        left, right = max(int(at[x]) - pad, int(w.first[doc])), min(int(at[far[x]]) + pad + 1, int(w.first[doc + 1]))
        if held and held[:2] == (doc, i) and left <= held[3]:
            held = (doc, i, held[2], max(right, held[3]))
            continue
        if held:
            yield held
        held = (doc, i, left, right)
    if held:
        yield held


def matches(block: Block, seen: np.ndarray, texts: list[bytes]) -> list[list[dict]]:
    """Per text, the items that it holds: item_id, score, and the stretch in bytes."""
    out: list[list[dict]] = [[] for _ in texts]
    for lo, hi in chunks([len(t) + 1 for t in texts]):
        w = words_of(texts[lo:hi])
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for doc, i, left, right in stretches(block, w, *found(block, seen, w)):
            words = block.words.hashes[block.words.first[i]:block.words.first[i + 1]]
            top, share = MATCH * len(words), float(block.share[i])
            for lead, tail in windows(left, right, int(block.reach[i])):
                if MATCH * np.isin(words, w.hashes[lead:tail]).sum() < share * top:
                    continue  # even with all of these aligned
                score, j, end = align(words, w.hashes[lead:tail])
                if score >= share * top and score / top > best.get((doc, i), (0.0,))[0]:
                    best[doc, i] = (score / top, int(w.starts[lead + j]), int(w.ends[lead + end - 1]))
        for (d, i), (score, start, end) in sorted(best.items()):
            out[lo + d].append({"item_id": block.ids[i], "score": score, "start": start, "end": end})
    return out


def seed_counts(docs: DataFrame, text_col: str, held) -> np.ndarray:
    """How often each seed of the broadcast block stands in the texts; a number a seed reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        seen, total = block.holds(), np.zeros(len(block.seeds), np.int64)
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for lo, hi in chunks([len(t) + 1 for t in texts]):
                k, _ = found(block, seen, words_of(texts[lo:hi]))
                total += np.bincount(k, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["seed", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(held.value.seeds), np.int64)
    out[rows["seed"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def with_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "matches",
                 threshold: float = THRESHOLD, id_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with the test items that each text holds, as array column ``out``; all other columns stay."""
    spark = docs.sparkSession
    kind = "array<struct<item_id:bigint,score:double,start:int,end:int>>"
    got = docs.withColumn(out, F.array().cast(kind))
    struct = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
    for items in item_blocks(benchmark, id_col, item_text):
        every = spark.sparkContext.broadcast(block_of(items, threshold))
        held = spark.sparkContext.broadcast(every.value.rare(seed_counts(docs, text_col, every)))
        at, to = got.columns.index(text_col), got.columns.index(out)

        def run(batch: pa.RecordBatch, held=held, at=at, to=to) -> pa.RecordBatch:
            new = matches(held.value, held.value.holds(), text_bytes(batch.column(at)))
            before = batch.column(to).to_pylist()
            columns = list(batch.columns)
            columns[to] = pa.array([a + b for a, b in zip(before, new)], struct)
            return pa.RecordBatch.from_arrays(columns, batch.schema.names)

        got = map_batches(got, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in got.schema.fields), sized_by=at)
    return got


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, max_score), one row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_matches(rows, benchmark, "text", "hits").select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"),
        F.array_sort(F.transform("hits", lambda h: h["item_id"])).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("max_score"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a test item."""
    (hits,) = fresh(docs, "_hits")
    return with_matches(docs, benchmark, text_col, hits).where(F.size(hits) == 0).drop(hits)
