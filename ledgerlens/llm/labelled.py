"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: Column) -> Column:
    """Whether the id's fold, crc32 of its text modulo five, is 0.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id",
           text_col: str = "text") -> tuple[DataFrame, float]:
    """((id, y, text) of at most ``per_class`` ids of either class, the share of class one).

    The ids are those with the smallest hash among the labelled ones outside
    the held-out fold; the share counts them all.  Ids whose labels
    contradict each other are left out.  Of several rows with one id the
    smallest text stands.
    """
    spark = docs.sparkSession
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
             .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
             .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    ids = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()]
    small = spark.createDataFrame(ids, "id long, y int")
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
            .join(F.broadcast(small), "id").groupBy("id", "y").agg(F.min("text").alias("text")))
    return rows, share
