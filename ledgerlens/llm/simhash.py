"""SimHash near-duplicates by multi-index hashing.

A text is lower-cased (A-Z), cut into words at ASCII white space and into
shingles of ``shingle`` words (repeats count; fewer words: the whole
sequence; none: fingerprint zero).  A fingerprint bit is one if it is set in
more than half the shingles' XXH64 values (seed 42).  Fingerprints link at
``max_bits`` or fewer differing bits.

Search: the fingerprint is cut into two 32-bit segments.  Two fingerprints
within four bits agree within two bits on at least one segment, so both
enumerate the Hamming ball of radius one around that segment and meet in the
table at a value between them; the join's condition then verifies the
complete distance.  Equal fingerprints are one table row, so copies never
pair up.  Fingerprints within two bits are linked first, through the 64-bit
values between them (a value has at most 65 fingerprints around it, so
these groups are bounded), and the table search links different components
only: a large group of near copies makes a star, never all its pairs.

Defined cases: null text is the empty text; a null doc_id has a row, links
like any other, and is never a component_id unless the whole component has
none; repeated rows each keep a row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import components, fresh, map_batches, partitions, stage, text_bytes

SEED = 42
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, 8).copy().view(np.uint64).ravel()


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Per array, the 64-bit value of the bits set in over half its hashes (empty: zero)."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([hashes[i] for i in full])
    lanes = _LANES[flat.astype(">u8").view(np.uint8).reshape(-1, 8)]  # eight one-byte counters per word
    blocks = -(-sizes[full] // 255)  # a counter holds 255 at most
    first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    of = np.repeat(np.arange(len(full)), blocks)
    lead = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    at = first[of] + 255 * (np.arange(len(of)) - lead[of])
    counts = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(-1, 64)
    counts = np.add.reduceat(counts, lead, axis=0, dtype=np.int64)
    bits = counts * 2 > sizes[full][:, None]
    out[full] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    start = total = 0
    for i, text in enumerate(texts):
        held.append(shingle_hashes(text, shingle))
        total += len(held[-1])
        if total > 200_000 or i == len(texts) - 1:
            out[start:i + 1] = majority(held)
            held, start, total = [], i + 1, 0
    return out


def fingerprint_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, id_type: str = "long") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = fingerprints(text_bytes(batch.column(1)), shingle)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast(id_type).alias("id"), F.col(text_col).cast("string").alias("t")), run, f"id {id_type}, fp long", sized_by=1)


def _ball(value: Column, bits: int) -> Column:
    """The value and every value one bit from it."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(bits)])
    return F.explode(F.transform(masks, lambda m: value.bitwiseXOR(m)))


def _low(values: Column, bits: int = 32) -> Column:
    return values.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(node, root) over distinct fingerprints ``fps`` (column fp) that have links."""
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0 to 4: two segments of radius-one balls cover four bits")
    spark = fps.sparkSession
    if max_bits < 2:
        near = spark.createDataFrame([], "u long, v long")
    else:
        around = fps.repartition(partitions(spark)).select("fp", _ball(F.col("fp"), 64).alias("c")).groupBy("c").agg(F.collect_list("fp").alias("m"))
        near = (around.where(F.size("m") > 1).select(F.array_min("m").alias("v"), F.explode("m").alias("u"))
                .where("u <> v"))
    near = stage(near.distinct())
    group = components(near)
    tagged = stage(fps.join(group, fps.fp == group.node, "left").select("fp", F.coalesce("root", "fp").alias("g")))
    sides = []
    for seg, part in enumerate((_low(F.col("fp")), _low(F.shiftrightunsigned("fp", 32)))):
        sides.append(tagged.select(F.lit(seg).alias("seg"), _ball(part, 32).alias("c"), "fp", "g"))
    rows = sides[0].unionAll(sides[1])
    a, b = rows.alias("a"), rows.alias("b")
    at = lambda t: F.when(F.col("a.seg") == 0, _low(F.col(t))).otherwise(_low(F.shiftrightunsigned(t, 32)))
    x = at("a.fp").bitwiseXOR(at("b.fp"))
    lowest = x.bitwiseAND(-x)
    # Of the values between two segments one is told apart, so a pair meets once a segment.
    once = F.col("a.c").bitwiseXOR(at("a.fp")) == F.when(F.bit_count(x) < 2, F.lit(0).cast("long")).otherwise(lowest)
    far = a.join(b, (F.col("a.seg") == F.col("b.seg")) & (F.col("a.c") == F.col("b.c")) & (F.col("a.fp") < F.col("b.fp"))
                 & (F.col("a.g") != F.col("b.g")) & once
                 & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits))
    far = far.select(F.col("a.g").alias("u"), F.col("b.g").alias("v"))
    held = tagged.where("g <> fp").select(F.col("fp").alias("u"), F.col("g").alias("v"))
    return components(far.unionAll(held))


def classes_of(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component_fp, component_id) of every fingerprint in ``rows`` (id, fp)."""
    reps = stage(rows.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = links(reps.select("fp"), max_bits)
    member = stage(reps.join(roots, reps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("component_fp")))
    lowest = member.groupBy("component_fp").agg(F.min("rep").alias("component_id"))
    return member.join(lowest, "component_fp").select("fp", "component_fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp, component_fp), one row per input row.

    component_id is the smallest id reachable over links; fp is the
    fingerprint as a signed long, component_fp the class's smallest fp.
    """
    rows = stage(fingerprint_rows(docs, id_col, text_col, shingle))
    return rows.join(classes_of(rows, max_bits), "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id", "fp", "component_fp")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of ``docs`` per component: smallest id (null last), then smallest text hash; all columns stay.

    Only (id, text hash) pairs of the rows that stay are joined back, so the
    documents cross the network once.
    """
    th, n, own = fresh(docs, "_th", "_n", "_id")
    hashed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    prints = fingerprint_rows(hashed.select(F.struct("id", F.xxhash64("text").alias("th")).alias("id"), "text"), "id", "text", shingle, "struct<id:bigint,th:bigint>")
    rows = stage(prints.select("id.id", "id.th", "fp"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    first = (rows.join(classes_of(rows, max_bits), "fp").groupBy("component_fp").agg(F.min(place).alias("p"))
             .select(F.col("p.id").alias(own), F.col("p.th").alias(th)))
    kept = docs.withColumn(n, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = kept.join(first, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(n) == F.col(th)))
    once = Window.partitionBy(own, th).orderBy(*[F.col(c) for c in docs.columns if c != text_col] or [F.lit(0)])
    return kept.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(*docs.columns)
