"""Line deduplication by a segment-partition edit join.

A document's lines (stripped of ASCII white space) of ``min_bytes`` or more
take part.  Lines within ``MAX_EDITS`` = 2 edits (UTF-8 bytes) are linked,
linked lines form classes, and of each class only the first occurrence, by
ascending doc_id and line, stays.  Shorter lines stay, unless ``exact_bytes``
asks for them: those of so many bytes or more are then classes of equal lines.

The join: a line of length l is cut into three segments at fixed places for
its length; two edits leave one of them whole.  Every distinct line puts its
segments into an index under (l, segment number, segment), and looks up, for
the lengths l, l-1 and l-2, the substrings at the few places where a segment
can have gone (the multi-match-aware places).  The lookup is one join on the
hashed key.  Its condition carries a signature: an edit changes the parity
of at most two of 32 byte classes and four of 32 byte-pair classes, so
variants of one line that lie further apart are never emitted.  What is left
is verified with a bit-parallel edit distance in a band of two around the
diagonal.

Equal lines are one row of the join, so a line that a third of the corpus
holds costs one lookup; its occurrences meet only in grouped minima.

Defined cases: null text is left null; blank lines always stay;
rows of one doc_id are ordered by text hash, rows equal in id and text count
as one document; null ids come last; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import components, fresh, joined, map_batches, mix, partitions, span_hashes, stage, text_bytes

MAX_EDITS = 2
MIN_BYTES = 24
_BLANK = b" \t\r\x0b\x0c"
#: Places that line i of a length may be looked up at: (length difference, segment, shift).
SHIFTS = [(d, i, s) for d in range(MAX_EDITS + 1) for i in range(MAX_EDITS + 1)
          for s in range(max(-i, d - (MAX_EDITS - i)), min(i, d + (MAX_EDITS - i)) + 1)]
_BITS = 1 << 25
INDEX = MAX_EDITS + 1  # stands for a length difference in rows that are in the index


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def lines_of(text: bytes, min_bytes: int) -> list[tuple[int, bytes]]:
    """(number, stripped line) of the lines that take part."""
    out = []
    for i, line in enumerate(text.split(b"\n")):
        line = line.strip(_BLANK)
        if len(line) >= min_bytes:
            out.append((i, line))
    return out


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_bytes: int) -> DataFrame:
    """(line, id, th, at): every line that takes part; th is the hash of the whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lh, n, at, th = [], [], [], []
        for t in text_bytes(batch.column(1)):
            got = lines_of(t, min_bytes)
            n.append(len(got))
            th.append(line_hash(t))
            lh += [line_hash(x) for _, x in got]
            at += [i for i, _ in got]
        of = np.repeat(np.arange(batch.num_rows), n)
        return pa.RecordBatch.from_arrays([pa.array(lh, pa.int64()), batch.column(0).take(pa.array(of)), pa.array(np.array(th, np.int64)[of]), pa.array(at, pa.int32())],
                                          ["line", "id", "th", "at"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return map_batches(rows, run, "line long, id long, th long, at int", sized_by=1)


def signatures(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Parities of 32 byte classes (low half) and 32 byte-pair classes of each line."""
    one = (np.uint64(1) << (mix(data.astype(np.uint64)) & np.uint64(31)))
    pair = data[:-1].astype(np.uint64) * np.uint64(256) + data[1:]
    two = np.append(np.uint64(1) << ((mix(pair) & np.uint64(31)) + np.uint64(32)), np.uint64(0))
    # The separator after a line is taken out; pairs with it on either side too.
    breaks = np.zeros(len(data), bool)
    breaks[starts[1:] - 1] = True
    breaks[-1] = True
    one[breaks] = 0
    two[breaks] = 0
    two[np.maximum(np.flatnonzero(breaks) - 1, 0)] = 0
    return np.bitwise_xor.reduceat(one ^ two, starts)


def segment_rows(docs: DataFrame, text_col: str, min_bytes: int) -> DataFrame:
    """(key, line, sig, d): a batch's distinct lines under their segments' and lookups' keys."""
    parts = MAX_EDITS + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = sorted({x for t in text_bytes(batch.column(0)) for _, x in lines_of(t, min_bytes)})
        if not lines:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], pa.int32())], ["key", "line", "sig", "d"])
        data, at = joined(lines, b"\n")
        start, n = at[:-1], at[1:] - at[:-1] - 1
        sig, ids = signatures(data, start), np.array([line_hash(x) for x in lines], np.int64)
        spans, keys, rows, kinds = [], [], [], []
        for d, i, s in [(INDEX, i, 0) for i in range(parts)] + [x for x in SHIFTS if x[0] or x[2]]:
            length = n - (d if d != INDEX else 0)
            a = start + length * i // parts + s
            b = start + length * (i + 1) // parts + s
            fits = np.flatnonzero((length >= min_bytes) & (a >= start) & (b <= start + n))
            spans.append((a[fits], b[fits]))
            keys.append(mix(length[fits].astype(np.uint64) * np.uint64(4) + np.uint64(i)))
            rows.append(fits)
            kinds.append(np.full(len(fits), d, np.int32))
        h = span_hashes(data, np.concatenate([a for a, _ in spans]), np.concatenate([b for _, b in spans])) ^ np.concatenate(keys)
        of = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[of]), pa.array(sig[of].view(np.int64)), pa.array(np.concatenate(kinds))],
                                          ["key", "line", "sig", "d"])

    return map_batches(docs.select(F.col(text_col).cast("string").alias("t")), run, "key long, line long, sig long, d int", sized_by=0)


def within(a: bytes, b: bytes, most: int) -> bool:
    """Whether the edit distance is ``most`` or less: bit-parallel columns, banded around the diagonal."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    i = next((i for i in range(n) if a[i] != b[i]), n)
    a, b = a[i:], b[i:]
    n = min(len(a), len(b))
    j = next((j for j in range(n) if a[-1 - j] != b[-1 - j]), n)
    a, b = a[:len(a) - j], b[:len(b) - j]
    m = len(a)
    if not m or not b:
        return max(m, len(b)) <= most
    places: dict[int, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    band = (1 << (2 * most + 1)) - 1
    pv, mv, score = full, 0, m
    for k, c in enumerate(b):
        window = (band << (k - most)) if k >= most else band >> (most - k)
        eq = places.get(c, 0) & window  # a match off the band lies on no path of ``most`` edits
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        if score - (len(b) - 1 - k) > most:
            return False
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return score <= most


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """A set bit for the low bits of every line hash in ``wanted``: 4 MB, whatever their number.

    It keeps lines that nobody asks for out of the exact join behind it.
    """
    bit = F.col("line").bitwiseAND(F.lit(_BITS - 1))
    words = (wanted.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(line & 63 AS INT))").alias("m"))
             .groupBy("w").agg(F.bit_or("m").alias("m")).toPandas())
    out = np.zeros(_BITS >> 6, np.uint64)
    out[words["w"].to_numpy()] = words["m"].to_numpy(np.int64).view(np.uint64)
    return out


def links(docs: DataFrame, text_col: str, min_bytes: int) -> DataFrame:
    """(u, v): hashes of distinct lines within ``MAX_EDITS`` edits."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = segment_rows(docs, text_col, min_bytes).repartition(n, "key").distinct()
    table, look = rows.where(F.col("d") == INDEX).alias("a"), rows.alias("b")
    off = F.when(F.col("b.d") == INDEX, 0).otherwise(F.col("b.d"))
    x = F.col("a.sig").bitwiseXOR(F.col("b.sig"))
    low = F.bit_count(x.bitwiseAND(F.lit((1 << 32) - 1)))
    pairs = table.join(look, (F.col("a.key") == F.col("b.key")) & (F.col("a.line") != F.col("b.line"))
                      & ((F.col("b.d") != INDEX) | (F.col("a.line") < F.col("b.line")))
                      & (low <= 2 * MAX_EDITS - off) & (F.bit_count(F.shiftrightunsigned(x, 32)) <= 4 * MAX_EDITS))
    pairs = stage(pairs.select(F.least("a.line", "b.line").alias("u"), F.greatest("a.line", "b.line").alias("v")).distinct())
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("line")).distinct()
    held = spark.sparkContext.broadcast(_bitmap(wanted))

    def texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = {line_hash(x): x for t in text_bytes(batch.column(0)) for _, x in lines_of(t, min_bytes)}
        keys = np.fromiter(got, np.int64, len(got))
        bit = keys & (_BITS - 1)
        maybe = (held.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
        keys = keys[maybe]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([got[k] for k in keys.tolist()], pa.binary())], ["line", "bytes"])

    every = map_batches(docs.select(F.col(text_col).cast("string").alias("t")), texts, "line long, bytes binary", sized_by=0)
    of = stage(every.join(wanted, "line", "left_semi").groupBy("line").agg(F.first("bytes").alias("bytes")))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        u, v, a, b = (c.to_pylist() for c in batch.columns)
        good = [i for i in range(len(u)) if within(a[i], b[i], MAX_EDITS)]
        return pa.RecordBatch.from_arrays([pa.array([u[i] for i in good], pa.int64()), pa.array([v[i] for i in good], pa.int64())], ["u", "v"])

    both = (pairs.join(of.select(F.col("line").alias("u"), F.col("bytes").alias("a")), "u")
            .join(of.select(F.col("line").alias("v"), F.col("bytes").alias("b")), "v").select("u", "v", "a", "b"))
    return map_batches(both, verify, "u long, v long")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES,
             exact_bytes: int | None = None) -> DataFrame:
    """(id, th, drop): per document that loses lines, their numbers in order."""
    classes = components(links(docs, text_col, min_bytes))
    occ = occurrences(docs, id_col, text_col, min_bytes if exact_bytes is None else max(min(exact_bytes, min_bytes), 1))
    occ = stage(occ.join(classes, occ.line == classes.node, "left").select(F.coalesce("root", "line").alias("c"), "id", "th", "at").distinct())
    # What stays is a grouped minimum; the others are found by place, so a line that many documents hold meets in no join.
    first = occ.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th", "at")).alias("p")).select("p.*")
    same = F.col("o.id").eqNullSafe(F.col("f.id")) & (F.col("o.th") == F.col("f.th")) & (F.col("o.at") == F.col("f.at"))
    again = occ.alias("o").join(first.alias("f"), same, "left_anti")
    return again.groupBy("id", "th").agg(F.sort_array(F.collect_list("at")).alias("drop"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES,
          removed: str = "removed_lines", exact_bytes: int | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, and their number as column ``removed``."""
    th, key, drop, other = fresh(docs, "_th", "_id", "_drop", "_id2")
    names = list(docs.columns)
    at = names.index(text_col)

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([line_hash(t) for t in text_bytes(batch.column(at))], pa.int64())], [*batch.schema.names, th])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = map_batches(docs, hashed, f"{fields}, `{th}` long", sized_by=at).withColumn(key, F.col(id_col).cast("long"))
    gone = removals(docs, id_col, text_col, min_bytes, exact_bytes).select(F.col("id").alias(other), F.col("th").alias(th + "2"), F.col("drop").alias(drop))
    both = rows.join(gone, F.col(key).eqNullSafe(F.col(other)) & (F.col(th) == F.col(th + "2")), "left")
    both = both.select(*docs.columns, F.coalesce(drop, F.array().cast("array<int>")).alias(drop))

    def rebuilt(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
            if gone:
                gone = set(gone)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            out.append(text)
        columns = list(batch.columns)
        columns[at] = pa.array(out, pa.string())
        columns[-1] = pc.list_value_length(columns[-1]).cast(pa.int64())
        return pa.RecordBatch.from_arrays(columns, [*names, removed])

    return map_batches(both, rebuilt, f"{fields}, `{removed}` long", sized_by=at)
