"""Inbox stream (X3): three availableNow runs over an inbox that receives
new files, a re-sent file and then nothing new."""

from pyspark.sql import functions as F

from conftest import SF001
from ledgerlens.operators import store as ST
from ledgerlens.sources.statements import rendered_statement_tables
from ledgerlens.streaming.inbox import start_inbox


def test_inbox_runs_are_idempotent(spark, tmp_path):
    tables = rendered_statement_tables(spark, SF001).cache()
    inbox, archive, store, quarantine, ckpt = (str(tmp_path / d) for d in ("in", "arch", "store", "q", "ck"))

    def run():
        q = start_inbox(spark, inbox + "/*", archive, store, quarantine, ckpt, None,
                        created_at="2024-01-01 00:00:00", as_of_year=1998)
        q.awaitTermination()
        return ST.read_store(spark, store).count()

    first_year = tables.agg(F.min("table_no")).first()[0]
    tables.filter(F.col("table_no") <= first_year).write.json(f"{inbox}/a")
    n1 = run()
    tables.filter(F.col("table_no") >= first_year).write.json(f"{inbox}/b")   # first year sent again
    n2 = run()
    n3 = run()                                                       # nothing new
    keys = ST.read_store(spark, store).select("txn_type", "source")
    assert 0 < n1 < n2 == n3
    assert keys.count() == keys.distinct().count()                   # exactly once by source key
    # an unrecognised document goes to quarantine, not to the store
    spark.createDataFrame([("junk", 0, 0, ["foo", "bar"]), ("junk", 0, 1, ["1", "2"])],
                          "doc string, table_no int, row_no long, cells array<string>").write.json(f"{inbox}/c")
    assert run() == n3
    assert spark.read.parquet(quarantine).filter(F.col("doc") == "junk").count() == 1


def _inbox(spark, tmp_path, **more):
    inbox, archive, store, quarantine, ckpt = (str(tmp_path / d) for d in ("in", "arch", "store", "q", "ck"))

    def run():
        start_inbox(spark, inbox, archive, store, quarantine, ckpt, None, created_at="2024-01-01 00:00:00", as_of_year=1998, **more).awaitTermination()

    return inbox, store, quarantine, run


def test_unreadable_files_go_to_quarantine_and_the_others_are_stored(spark, tmp_path):
    tables = rendered_statement_tables(spark, SF001).filter(F.col("table_no") <= 3)
    inbox, store, quarantine, run = _inbox(spark, tmp_path, fmt="parquet")
    docs = sorted(r.doc for r in tables.select("doc").distinct().collect())[:3]
    assert len(docs) == 3
    tables = tables.filter(F.col("doc").isin(docs)).cache()
    for i, doc in enumerate(docs):
        tables.filter(F.col("doc") == doc).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
    (tmp_path / "in").mkdir()
    good = []
    for i, _ in enumerate(docs):
        (part,) = (tmp_path / f"w{i}").glob("part-*.parquet")
        (tmp_path / "in" / f"doc [{i}].parquet").write_bytes(part.read_bytes())
        good.append(part)
    (tmp_path / "in" / "junk.parquet").write_text("this is no parquet file")
    (tmp_path / "in" / "cut.parquet").write_bytes(good[0].read_bytes()[:-200])
    (tmp_path / "in" / "empty.parquet").write_bytes(b"")
    run()
    from ledgerlens.plans import pipelines as PL

    want = PL.statement_pipeline(tables, None, spark.createDataFrame([], "txn_type string, source string"), None,
                                 created_at="2024-01-01 00:00:00", as_of_year=1998).saved
    key = lambda df: sorted(tuple(r) for r in df.select("txn_type", "source").collect())
    assert key(ST.read_store(spark, store)) == key(want) and want.count() > 0
    bad = {r.file.rsplit("/", 1)[1]: r.reason for r in spark.read.parquet(quarantine).where("file is not null").collect()}
    assert set(bad) >= {"junk.parquet", "cut.parquet"} and all("FAILED_READ_FILE" in r for r in bad.values())
    run()
    assert key(ST.read_store(spark, store)) == key(want)


def test_corrupt_gzip_lines_are_set_aside_whole(spark, tmp_path):
    """The first lines of a cut archive could be read; none of them is stored."""
    import gzip

    from ledgerlens.schemas import STATEMENT_TABLE
    from ledgerlens.streaming.inbox import read_files

    line = '{"doc":"d%d","table_no":0,"row_no":%d,"cells":["a%d"]}\n'
    whole = gzip.compress("".join(line % (1, i, i * 7919) for i in range(5000)).encode())
    (tmp_path / "good.json.gz").write_bytes(gzip.compress((line % (2, 0, 0)).encode()))
    (tmp_path / "cut.json.gz").write_bytes(whole[:len(whole) // 2])
    frames, bad = read_files(spark, [str(tmp_path / n) for n in ("cut.json.gz", "good.json.gz")], STATEMENT_TABLE, "json")
    assert {r.doc for f in frames for r in f.collect()} == {"d2"}
    assert [p.rsplit("/", 1)[1] for p, _ in bad] == ["cut.json.gz"]


def test_other_errors_stop_the_batch(spark, tmp_path):
    import pytest

    from ledgerlens.schemas import STATEMENT_TABLE
    from ledgerlens.streaming.inbox import read_files

    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_files(spark, [str(tmp_path / "nowhere.json")], STATEMENT_TABLE, "json")


def test_a_document_split_over_files_waits_for_all_its_parts(spark, tmp_path):
    from ledgerlens.plans import pipelines as PL
    from ledgerlens.streaming import inbox as IN

    tables = rendered_statement_tables(spark, SF001).cache()
    doc = tables.groupBy("doc").agg(F.count_distinct("table_no").alias("n")).orderBy(F.desc("n"), "doc").first()
    assert doc.n >= 2
    mine = tables.filter(F.col("doc") == doc.doc).withColumn("n_parts", F.lit(doc.n).cast("int"))
    first = mine.agg(F.min("table_no")).first()[0]
    inbox, store, quarantine, run = _inbox(spark, tmp_path)
    mine.filter(F.col("table_no") == first).write.mode("append").json(inbox)
    run()
    assert IN._or_empty(spark, store, "source string").count() == 0
    mine.filter(F.col("table_no") == first).write.mode("append").json(inbox)  # sent again
    run()
    assert IN._or_empty(spark, store, "source string").count() == 0
    mine.filter(F.col("table_no") > first).write.mode("append").json(inbox)
    run()
    want = PL.statement_pipeline(tables.filter(F.col("doc") == doc.doc), None, spark.createDataFrame([], "txn_type string, source string"), None,
                                 created_at="2024-01-01 00:00:00", as_of_year=1998).saved
    key = lambda df: sorted(tuple(r) for r in df.select("txn_type", "source").collect())
    assert key(ST.read_store(spark, store)) == key(want) and want.count() > 0
    assert spark.read.parquet(quarantine).count() == 0


def test_a_replayed_batch_gives_the_same_state(spark, tmp_path):
    """Batch 1 runs twice (as after a lost driver): the same pending rows, quarantine and store."""
    from ledgerlens.streaming import inbox as IN

    rows = "doc string, table_no int, row_no long, cells array<string>, n_parts int"
    for name, data in (("a", [("d", 0, 0, ["x"], 2)]), ("b", [("e", 0, 0, ["y"], 3), ("d", 1, 0, ["z"], 2)]), ("c", [("f", 0, 0, ["w"], None)])):
        spark.createDataFrame(data, rows).coalesce(1).write.json(str(tmp_path / name))
    files = {n: [str(p) for p in (tmp_path / n).glob("part-*.json")] for n in "abc"}
    args = dict(store_path=str(tmp_path / "s"), quarantine_path=str(tmp_path / "q"), mappings=None, created_at="2024-01-01 00:00:00", as_of_year=1998, max_wait=1)
    IN.process_batch(spark, files["a"], 0, **args)
    seen = []
    for _ in range(2):
        IN.process_batch(spark, files["b"], 1, **args)
        pending = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "q-pending/kind=tables/batch_id=1")).select("doc", "waited").collect())
        held = sorted((r.doc, r.reason) for r in spark.read.parquet(str(tmp_path / "q/kind=tables/batch_id=1")).collect())
        seen.append((pending, held))
    assert seen[0] == seen[1] == ([("e", 0)], [("d", "unknown format")])
    for batch, want in ((2, []), (3, [("e", "incomplete document")])):
        IN.process_batch(spark, files["c"], batch, **args)
        held = [(r.doc, r.reason) for r in spark.read.parquet(str(tmp_path / f"q/kind=tables/batch_id={batch}")).collect()]
        assert [h for h in held if h[0] == "e"] == want
