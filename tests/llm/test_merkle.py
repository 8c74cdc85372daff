import duckdb
from llm_helpers import SF001, edge, frame, nothing  # noqa: F401
from pyspark.sql import functions as F

from ledgerlens.llm import merkle
from ledgerlens.llm.queries import ORACLES, QUERIES


def prints(spark, *texts):
    df = merkle.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "fp")
    return [r.fp for r in df.orderBy("i").collect()]


def like(spark, a, b, fn=merkle.likeness):
    return spark.createDataFrame([(a, b)], "a string, b string").select(fn(F.col("a"), F.col("b")).alias("x")).first().x


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF001}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(ORACLES["op9_merkle_fingerprints"]).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op9_merkle_fingerprints"](spark, SF001).collect()}
    assert got == want


def test_roots_and_branches(spark):
    text = "\n".join(f"Paragraph {i} tells one thing. Then another, longer thing." for i in range(40))
    edited = text.replace("Paragraph 17 tells", "Paragraph 17 hides")
    a, b, c, d = prints(spark, text, edited, text, text + " ")
    assert a == c and a != b and a != d
    assert like(spark, a, c) == 1.0 and 0.9 < like(spark, a, b) < 1.0
    assert [tuple(x)[1] for x in like(spark, a, b, merkle.differing)].__len__() == 1
    where = like(spark, a, b, merkle.differing)[0]
    sections = a.split("/")[1].split("|")
    assert sections[where.section].split(":")[1].split(";")[where.paragraph] in a and sections[where.section] not in b
    assert like(spark, a, c, merkle.differing) == []


def test_plan_has_no_python_and_no_single_partition(spark):
    plan = QUERIES["op9_merkle_fingerprints"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


def test_edge_rows(spark, edge, nothing):
    rows = merkle.with_next(edge, "doc_id", "text", buckets=3).collect()
    assert len(rows) == edge.count()
    order = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in edge.collect())
    want = sorted((k[0][1] if k[0][0] else None, k[1], n[1]) .__repr__() for k, n in zip(order, order[1:] + order[:1]))
    assert sorted((r.id, r.text, r.next_text).__repr__() for r in rows) == want
    assert merkle.with_next(nothing, "doc_id", "text").collect() == []
    only = merkle.with_next(frame(spark, [(5, "abc")]), "doc_id", "text").collect()
    assert [(r.text, r.next_text) for r in only] == [("abc", "abc")]
    empty, null, x = prints(spark, "", None, "x")
    assert empty == null and like(spark, empty, x) == 0.0 and like(spark, empty, null) == 1.0


def test_half_edited_counts_code_points(spark):
    df = spark.createDataFrame([("a👍bc漢", "XYZ"), ("ab", ""), ("", "q"), ("a", "q")], "t string, n string")
    assert [r.e for r in df.select(merkle.half_edited(F.col("t"), F.col("n")).alias("e")).collect()] == ["a👍bXY", "a", "", "a"]
