"""Rows and fixtures that the tests of this folder share."""

import pytest

SF001 = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(40_000))
EDGE = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa."), (2, ""), (3, None), (None, "Alpha beta gamma delta epsilon zeta eta theta iota kappa."),
        (4, "Alpha beta gamma delta epsilon zeta eta theta iota kappa."), (4, "Alpha beta gamma delta epsilon zeta eta theta iota kappa."),
        (5, LONG), (6, " \t\n\x0b "), (7, "é漢字\U0001F44D \x00 <|endoftext|> Σ"), (7, "another text under the same id"), (8, LONG + " end")]
#: Columns whose names equal those that the operators use or return.
CLASHING = ["id", "key", "line", "fp", "th", "h", "score", "matches", "runs", "hits", "node", "root", "ids", "decoded", "t", "_th", "_fp", "u", "v", "component_id"]


def frame(spark, rows=EDGE, clash=True):
    """A documents table of (doc_id, text) rows with columns whose names clash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"),
                     *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING if clash else [])])


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    """doc_id, text of the smallest table, as Python rows by id."""
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect())
