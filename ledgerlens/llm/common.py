"""Helpers shared by the training-data operators.

Every operator reads only the columns it names, so extra columns (also ones
whose names equal an output column) never reach its plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint_dir

#: Text handled by one numpy pass; a longer document makes a pass of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have yet, derived from ``wanted``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def stage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder named by ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null becomes the empty string."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
                sized_by: int | None = None) -> DataFrame:
    """``fn`` over every Arrow batch of ``df``; empty batches are left out.

    ``sized_by`` names a text or binary column: batches are then cut so that
    it holds about ``CHUNK_BYTES`` in each, which bounds a worker's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if sized_by is None:
                yield fn(batch)
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(sized_by)), 0).to_pylist()
            for a, b in chunks(sizes):
                yield fn(batch.slice(a, b - a))

    return df.mapInArrow(run, schema)


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about ``limit``."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


# --- connected components ---------------------------------------------------

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v: two longs).

    Alternating large-star and small-star rounds: each round links every
    node to the smallest neighbour of a neighbour, with grouped minima only,
    so a node with very many links is pre-aggregated and never gathered.
    ``root`` is the smallest node of the component.
    """
    n = partitions(edges.sparkSession)
    cur = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u <> v").distinct())
        cur = stage(small)
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots).repartition(n, "node")


# --- vectorised text kernels --------------------------------------------------

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``data[starts:ends]``, from one prefix sum."""
    up = powers(len(data) + 1, _B)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=h[1:])
    down = powers(len(data) + 1, _BINV)
    n = (ends - starts).astype(np.uint64)
    return mix(((h[ends] - h[starts]) * down[starts]) ^ (n * np.uint64(0xD6E8FEB86659FD93)))


def joined(texts: list[bytes], sep: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with ``sep`` after every text, and each text's start (one more at the end)."""
    data = np.frombuffer(sep.join(texts) + sep, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(sep)
    return data, np.concatenate([[0], np.cumsum(sizes)])
