"""Corpus pipeline: documents in, token ids of clean, distinct documents out.

Each stage calls one operator of ``ledgerlens.llm`` on all rows its
predecessor kept; its result is written as Parquet in the shared folder and
read again as the next one's documents.  All stages but the last return the
columns of ``documents`` (extra columns pass through untouched).

Null texts count as empty ones throughout; rows with a null doc_id stay
unless a stage's own decision rejects them; an empty table passes all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontam, linedup, simhash, toxicity
from ledgerlens.llm.common import fresh, table
from ledgerlens.llm.queries import tokenizer_path
from ledgerlens.session import scratch_path

SHINGLE, MAX_BITS = 4, 4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the toxicity threshold; labels are learned from the rows that reach this stage."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "_toxicity")
    return toxicity.with_score(docs, model, "text", score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document, or an earlier place in the same one, has."""
    (removed,) = fresh(docs, "_removed")
    rows = linedup.dedup(docs, "doc_id", "text", removed=removed, exact_bytes=1)
    n_chars = [F.length("text").cast(f.dataType).alias(f.name) if f.name == "n_chars" else F.col(f.name) for f in docs.schema.fields]
    return rows.select(*n_chars)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id."""
    return simhash.keep_first(docs, "doc_id", "text", SHINGLE, MAX_BITS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), "text")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): packed ids, and the digest of what they decode to."""
    rows = bpe.round_trip(docs, tokenizer_path(), "doc_id", "text")
    return rows.select(F.col("id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_neardup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: Fingerprints, trained scores and tokens have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
