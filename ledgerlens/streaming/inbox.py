"""Statement inbox as a Structured Streaming job.

New extracted-statement files (``STATEMENT_TABLE`` or ``STATEMENT_TEXT``
rows as JSON or Parquet) dropped into an inbox folder are picked up by the
file source.  The stream itself carries only the files' paths; each
micro-batch reads its files in ``foreachBatch`` and runs the statement
pipeline: parse, check the keys (txn_type, source) against the store through
its key index (the batch's buckets only, not the whole store), categorise,
embed, append to the store partitioned by ``txn_type``.

A bad file never stops the flow: when reading a batch's files fails, the
files are halved until those that can't be read stand alone; they go to the
quarantine table with the reason, as a whole, and the others are stored.
Errors that no file causes still stop the batch.  Documents in an
unrecognised format and lines that are no records go to quarantine too.

A document's pages (or tables) may come in several files when its rows say
how many there are (``n_parts``): they are kept in a pending table, one
version a micro-batch, until all are there.  A document that is still
incomplete after ``max_wait`` further batches goes to quarantine.  Rows
without ``n_parts`` belong to documents whose file holds them whole, as the
PDF they were extracted from does.

Exactly-once is by source key: a replayed micro-batch after executor or
driver loss reads the pending version before it, re-runs the key check
against what was already appended, and writes its quarantine and pending
folders anew, so nothing is stored twice; the checkpoint (under the shared
checkpoint folder) records which files were consumed.  Finished files are
moved to an archive folder by the source (``cleanSource=archive``); the flow
never depends on the inbox being empty.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import statements as SM
from ledgerlens.operators import store as ST
from ledgerlens.plans import pipelines as PL
from ledgerlens.schemas import STATEMENT_TABLE, STATEMENT_TEXT
from ledgerlens.session import stage_table

SCHEMAS = {"tables": STATEMENT_TABLE, "text": STATEMENT_TEXT}
#: The column that numbers a document's parts.
PARTS = {"tables": "table_no", "text": "page_no"}
#: Spark's error class when a file's content can't be read.
_UNREADABLE = "FAILED_READ_FILE"


def _or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table; empty only if its path doesn't exist yet.  Any other error stops the batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_files(spark: SparkSession, paths: list[str], schema: T.StructType, fmt: str) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """(persisted frames of the files that can be read, (path, reason) of the others).

    One read if all are good; else the files are halved, so k bad ones among
    n cost about k log n further reads.
    """
    if not paths:
        return [], []
    names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]  # names, not glob patterns
    rows = spark.read.schema(schema).format(fmt).load(names).persist()
    try:
        rows.count()
        return [rows], []
    except Exception as e:  # noqa: BLE001 - only files that can't be read are set aside
        rows.unpersist()
        found = re.search(rf"\[({_UNREADABLE}[.\w]*)\]", str(e))
        if not found:
            raise
        if len(paths) == 1:
            return [], [(paths[0], found[1])]
    half = len(paths) // 2
    good, bad = read_files(spark, paths[:half], schema, fmt)
    more, worse = read_files(spark, paths[half:], schema, fmt)
    return good + more, bad + worse


def gather(rows: DataFrame, pending: DataFrame, part: str, max_wait: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(complete, pending, given up): rows of documents with ``n_parts`` by whether all their parts are there.

    ``pending`` rows carry ``waited``, the batches that their document has
    been waiting for; equal rows (a part sent again) count once.
    """
    columns = [c for c in rows.columns if c != "waited"]
    every = rows.withColumn("waited", F.lit(0)).unionByName(pending.withColumn("waited", F.col("waited") + 1))
    every = every.groupBy(*columns).agg(F.max("waited").alias("waited"))
    state = every.groupBy("doc").agg(F.max("n_parts").alias("need"), F.count_distinct(part).alias("have"), F.max("waited").alias("doc_waited"))
    held = every.join(state, "doc").withColumn("whole", F.col("have") >= F.col("need"))
    late = F.col("doc_waited") > max_wait
    pick = lambda which: held.where(which).select(*columns, F.col("doc_waited").alias("waited"))
    return pick(F.col("whole")).drop("waited"), pick(~F.col("whole") & ~late), pick(~F.col("whole") & late)


def process_batch(spark: SparkSession, paths: list[str], batch_id: int, *, store_path: str, quarantine_path: str,
                  mappings: DataFrame | None, created_at: str, as_of_year: int, kind: str = "tables", fmt: str = "json",
                  max_wait: int = 100) -> None:
    """One micro-batch: the files at ``paths``, and what earlier ones left pending."""
    columns = SCHEMAS[kind].fieldNames()
    schema = T.StructType([*SCHEMAS[kind].fields, T.StructField("n_parts", T.IntegerType())])
    waiting = T.StructType([*schema.fields, T.StructField("waited", T.IntegerType())])
    pending_path = f"{quarantine_path.rstrip('/')}-pending/kind={kind}"
    waiting_none = spark.createDataFrame([], waiting)
    frames, bad = read_files(spark, paths, schema, fmt)
    try:
        data = frames[0] if frames else spark.createDataFrame([], schema)
        for more in frames[1:]:
            data = data.unionByName(more)
        known = data.filter(F.col("doc").isNotNull())
        before = _or_empty(spark, f"{pending_path}/batch_id={batch_id - 1}", waiting)
        parted, ready, late = known.where("n_parts is not null"), known.where("n_parts is null"), waiting_none
        if parted.select("doc").unionByName(before.select("doc")).limit(1).count():  # no version means that none is pending
            whole, pending, late = gather(parted, before, PARTS[kind], max_wait)
            pending.write.mode("overwrite").parquet(f"{pending_path}/batch_id={batch_id}")
            ready = ready.unionByName(whole)
        ready = ready.select(*columns)
        tables, pages = (ready, None) if kind == "tables" else (None, ready)

        parsed, formats = SM.parse_statements(tables, pages, as_of_year)
        parsed = stage_table(parsed)
        none = F.lit(None).cast("string").alias("file")
        unknown = formats.filter(F.col("format") == "unknown").select("doc", F.lit("unknown format").alias("reason"), none)
        incomplete = late.select("doc").distinct().select("doc", F.lit("incomplete document").alias("reason"), none)
        # A line that is no record of the schema has no document.
        broken = data.filter(F.col("doc").isNull()).groupBy("doc").agg(F.lit("unreadable rows").alias("reason")).select("doc", "reason", none)
        files = spark.createDataFrame([(None, f"unreadable file: {why}", p) for p, why in bad], "doc string, reason string, file string")
        # One folder per batch, overwritten if the batch is replayed.
        (unknown.unionByName(incomplete).unionByName(broken).unionByName(files)
         .write.mode("overwrite").parquet(f"{quarantine_path}/kind={kind}/batch_id={batch_id}"))
        result = PL.statement_pipeline(tables, pages, ST.stored_at(spark, store_path), mappings, created_at=created_at, as_of_year=as_of_year, parsed=parsed)
        PL.append_result(result, store_path, index=True)
    finally:
        for frame in frames:
            frame.unpersist()


def start_inbox(spark: SparkSession, inbox: str, archive: str, store_path: str, quarantine_path: str,
                checkpoint: str, mappings: DataFrame | None, created_at: str, as_of_year: int,
                fmt: str = "json", available_now: bool = True, kind: str = "tables", max_files: int = 1000, max_wait: int = 100):
    """Start the inbox stream; with ``available_now`` it drains what is
    there and stops (a scheduled run), otherwise it keeps polling.

    ``kind`` is 'tables' (STATEMENT_TABLE files: multi-column and card-cell
    statements) or 'text' (STATEMENT_TEXT pages: card text statements).
    Both kinds may feed the same store, each with its own checkpoint.
    ``max_files`` bounds a micro-batch, and the paths that it fetches.
    """
    # The source lists files; their content is read by process_batch.
    src = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
           .option("cleanSource", "archive").option("sourceArchiveDir", archive)
           .option("maxFilesPerTrigger", max_files)
           .load(inbox).select("path"))

    def run(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r.path for r in batch.collect())  # max_files at most
        process_batch(batch.sparkSession, paths, batch_id, store_path=store_path, quarantine_path=quarantine_path, mappings=mappings,
                      created_at=created_at, as_of_year=as_of_year, kind=kind, fmt=fmt, max_wait=max_wait)

    writer = src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
