"""Transaction store and mapping-table maintenance as dataset-to-dataset jobs.

No row-level storage engine is built: the transaction store is a Parquet
folder partitioned by ``txn_type`` that is appended to, and every other
change is a dataset-to-dataset job over the files it concerns, whose result
is committed as the table's next version (``versions``).  Reads and joins
stay declarative.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions.merchant import reclean
from ledgerlens.functions.text import strip_ws
from ledgerlens.operators.store_keys import drop_index, known_keys
from ledgerlens.operators.versions import (  # noqa: F401 - a table's versions are part of this module's API
    Changed, append_rows, change_files, change_table, current_version, read_version, save_version, version_files)
from ledgerlens.session import CODEC, shuffles_let_go, stage
from ledgerlens.sources.csv_records import read_records

TXN_COLUMNS = ["id", "txn_date", "amount", "currency", "merchant", "category", "sub_category",
               "payment_method", "bank_name", "source", "raw_text", "embedding", "created_at"]


# --- J1 ---------------------------------------------------------------------------------

def first_per_key(df: DataFrame, keys: list[str], order: list[Column], dealt_anew: bool = True) -> DataFrame:
    """Keep one row per key: the first by ``order`` (ties broken by all columns).

    A rank limited to one is cut per task before the shuffle, so a key that
    holds a third of the rows moves one row per task.  The key is ranked as
    one struct: rows already dealt by a part of it (a document) are dealt
    anew by all of it.  Without ``dealt_anew`` the rows stay dealt by the
    key's columns, as a join by them wants.
    """
    key, rank = "_first_key", "_first_rank"
    by = Window.partitionBy(*([key] if dealt_anew else keys)).orderBy(*order, *[F.col(c) for c in df.columns if c not in keys])
    return (df.withColumn(key, F.struct(*keys)).withColumn(rank, F.row_number().over(by))
            .filter(F.col(rank) == 1).select(*df.columns))


#: A store's keys: its rows, or a function from a batch's rows to those of its keys that are stored.
Stored = DataFrame | Callable[[DataFrame], DataFrame]


def stored_at(spark: SparkSession, path: str) -> Stored:
    """The store at ``path`` for the key checks, through its key index."""
    return lambda batch: known_keys(spark, path, batch)


def dedup_against_store(batch: DataFrame, store: Stored, order: list[Column] | None = None,
                        keys: tuple[str, ...] = ("txn_type", "source")) -> DataFrame:
    """Rows of ``batch`` whose key is not yet in ``store``; in-batch
    duplicates keep the first row by ``order``.  Debits and credits are
    checked separately because ``txn_type`` is part of the key."""
    first = first_per_key(batch, list(keys), order or [F.col(keys[-1])])
    known = store.select(*keys) if isinstance(store, DataFrame) else store(batch)
    return first.join(known, list(keys), "left_anti")


# --- S11 / M5 / M6 ------------------------------------------------------------------------

def to_store_rows(parsed: DataFrame, created_at: str | Column | None = None) -> DataFrame:
    """Shape rows for the store: id and currency default at the sink.

    The id is a UUID made from the key (txn_type, source), so a retried task
    gives the same; rows without a source get a random one.
    """
    ts = (F.lit(created_at).cast("timestamp_ntz") if isinstance(created_at, str)
          else created_at if created_at is not None else F.localtimestamp())
    keyed = F.regexp_replace(F.md5(F.concat_ws("|", "txn_type", "source")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    cols = {
        "id": F.when(F.col("source").isNotNull(), keyed).otherwise(F.expr("uuid()")) if "source" in parsed.columns else F.expr("uuid()"),
        "currency": F.coalesce(F.col("currency"), F.lit(K.DEFAULT_CURRENCY)) if "currency" in parsed.columns
        else F.lit(K.DEFAULT_CURRENCY),
        "embedding": F.col("embedding") if "embedding" in parsed.columns else F.lit(None).cast("array<float>"),
        "created_at": ts,
    }
    out = []
    for c in TXN_COLUMNS:
        if c in cols:
            out.append(cols[c].alias(c))
        elif c in parsed.columns:
            out.append(F.col(c))
        else:
            out.append(F.lit(None).cast("string").alias(c))
    return parsed.select(*out, F.col("txn_type"))


def dealt_rows(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges of type and date, so a file spans few dates and
    Parquet's min/max statistics let a date filter skip files, not only row
    groups."""
    return rows.repartitionByRange("txn_type", "txn_date").sortWithinPartitions("txn_type", "txn_date")


def append_transactions(rows: DataFrame, path: str, dealt: bool = False) -> None:
    """Append to the store; one physical table partitioned by ``txn_type``
    (debit = expenses, credit = credits), in ``dealt_rows``' order (``dealt``:
    the rows come in it)."""
    with shuffles_let_go(rows.sparkSession):
        ((rows if dealt else dealt_rows(rows))
         .write.mode("append").option("compression", CODEC).partitionBy("txn_type").parquet(path))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- M1 / M2 / M4 / M5 on versioned tables -----------------------------------------------------

def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, as_of: str) -> Changed:
    """M1 on a stored table: only files that hold a pattern of ``incoming`` are rewritten, new patterns go with them."""
    keys = incoming.select(F.lower(strip_ws(F.col("raw_pattern"))).alias("raw_pattern")).distinct()
    return change_files(spark, path, lambda t: t.join(keys, "raw_pattern", "left_semi"),
                        lambda rows, table: upsert_mappings(rows, incoming, as_of, ids_after=table))


def delete_from_table(spark: SparkSession, path: str, pattern: str) -> bool:
    """M2 on a stored table: only the files that hold the pattern are rewritten; tells whether it existed."""
    key = pattern.lower().strip()
    done = change_files(spark, path, lambda t: t.filter(F.col("raw_pattern") == key), lambda rows, _: delete_mapping(rows, pattern)[0])
    return done.rewritten > 0


def delete_bad_from_table(spark: SparkSession, path: str) -> Changed:
    """M5 on a stored table: only files that hold bad rows are rewritten."""
    return change_files(spark, path, lambda t: t.filter(bad_row()), lambda rows, _: delete_bad_rows(rows))


def reclean_table(spark: SparkSession, path: str) -> Changed:
    """M4 on a stored table: only files that hold a merchant whose clean form differs are rewritten."""
    columns = lambda t: t.select(*[c for c in t.columns if c not in ("old_merchant", "change")])

    def hit(table: DataFrame) -> DataFrame:
        names = table.filter(F.col("merchant") != "").select("merchant").distinct()
        stale = names.filter(~reclean("merchant").eqNullSafe(F.col("merchant")))
        return table.join(stale, "merchant", "left_semi")

    return change_files(spark, path, hit, lambda rows, _: columns(reclean_existing(rows)))


def bad_row() -> Column:
    """The rows that Q5 reports: a plain predicate, so a scan's file statistics can use it; NULL counts as false."""
    return (F.col("amount") > K.MAX_AMOUNT) | F.col("merchant").isin(*K.BAD_MERCHANTS)


def delete_bad_rows(df: DataFrame) -> DataFrame:
    """NULL-safe complement of the bad-row filter."""
    return df.filter(~F.coalesce(bad_row(), F.lit(False)))


def truncate_expenses(spark: SparkSession, path: str, schema) -> None:
    """Empty the debit partition only (credits untouched)."""
    drop_index(spark, path)
    spark.createDataFrame([], schema).drop("txn_type").write.mode("overwrite").parquet(f"{path}/txn_type=debit")


def drop_expenses(spark: SparkSession, path: str) -> None:
    """``DROP TABLE IF EXISTS`` for the debit table: the store is rewritten
    with the credits only.  Written beside the store first, so the partition
    overwrite reads nothing that it replaces; a missing table is no error."""
    try:
        store = read_store(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    credits = stage(store.filter(F.col("txn_type") == "credit"))
    drop_index(spark, path)
    credits.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("txn_type").parquet(path)


# --- S12 --------------------------------------------------------------------------------------

def publish_bi_views(spark: SparkSession, expenses: DataFrame, credits: DataFrame) -> list[str]:
    """Register the four reporting views for a BI reader."""
    from ledgerlens.plans import reports as R

    views = {
        "v_monthly_spend": R.monthly_spend(expenses),
        "v_category_spend": R.category_spend(expenses),
        "v_top_merchants": R.top_merchants(expenses),
        "v_monthly_income_vs_expense": R.income_vs_expense(expenses, credits),
    }
    expenses.createOrReplaceTempView("expenses")
    credits.createOrReplaceTempView("credits")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


# --- S10 --------------------------------------------------------------------------------------

def read_mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    """Mapping CSV files -> rows with ``status`` ok / skipped and a reason.

    Comment lines start with '#' (also when quoted, '"#'); the first other
    line of each file is its header, which names the columns.  Required:
    pattern, clean name, category; priority must be an integer (0 where the
    file has no such column).  Quoted values may hold line breaks; blank
    lines are no rows.  ``line_no`` orders rows by file name, then place.
    A file of any size is cut into records in parallel (``csv_records``).
    """
    records = read_records(spark, path).filter(~F.col("value").startswith('"#') & (F.regexp_replace("value", r"\s", "") != ""))
    heads = records.groupBy("file").agg(F.min(F.struct("at", "value")).alias("h"))
    names_of = F.transform(F.split("h.value", ","), lambda h: F.lower(strip_ws(F.regexp_replace(h, '"', ""))))
    wide = heads.agg(F.max(F.size(F.split("h.value", ",")))).first()[0] or 1  # as many columns as the widest header names
    ddl = ", ".join(f"`c{i}` string" for i in range(wide))
    parsed = (records.join(heads, "file").filter(F.col("at") > F.col("h.at"))
              .select("file", "at", names_of.alias("names"), F.from_csv(F.col("value"), ddl, {"multiLine": "true", "escape": '"'}).alias("r")))
    values = F.array(*[F.col(f"r.c{i}") for i in range(wide)])
    parsed = parsed.select("names", values.alias("values"), F.struct("file", "at").alias("line_no"))

    def field(name: str, default: str = "") -> Column:
        at = F.array_position("names", F.lit(name)).cast("int")
        return F.when(at > 0, F.coalesce(F.try_element_at("values", at), F.lit(""))).otherwise(F.lit(default))

    pattern = F.lower(strip_ws(field("raw_pattern")))
    clean = strip_ws(field("clean_name"))
    cat = strip_ws(field("category"))
    sub = strip_ws(field("sub_category"))
    pri_raw = strip_ws(field("priority", "0"))
    pri_ok = pri_raw.rlike(r"^[+-]?\d+$")
    status = (F.when((pattern == "") | (clean == "") | (cat == ""), F.lit("skipped_missing"))
              .when(~pri_ok, F.lit("skipped_priority"))
              .otherwise(F.lit("ok")))
    return parsed.select(
        pattern.alias("raw_pattern"), clean.alias("clean_name"), cat.alias("category"), sub.alias("sub_category"),
        F.when(pri_ok, pri_raw.try_cast("int")).alias("priority"), "line_no", status.alias("status"))


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with its position (from 1) by ``order`` as column ``out``, without one window over everything.

    Rows are sorted in ranges and numbered inside them; only the ranges'
    sizes are added up in one place.
    """
    pid, inside = "_range", "_inside"
    dealt = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(pid, F.spark_partition_id()))
    local = dealt.withColumn(inside, F.row_number().over(Window.partitionBy(pid).orderBy(*order)))
    sizes = dealt.groupBy(pid).agg(F.count("*").alias("n")).collect()  # a row per partition
    before, total = {}, 0
    for r in sorted(sizes):
        before[r[pid]] = total
        total += r["n"]
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col(pid)] if before else F.lit(0)
    return local.withColumn(out, (F.col(inside) + base).cast("int")).drop(pid, inside)


# --- M1 / M2 / M3 -------------------------------------------------------------------------------

def upsert_mappings(existing: DataFrame, incoming: DataFrame, as_of: str, ids_after: DataFrame | None = None) -> DataFrame:
    """Insert or update by normalised pattern; the last duplicate in the
    batch wins (by ``line_no``); updates keep ``id`` and ``created_at`` and
    stamp ``updated_at``; new patterns get ids after the current maximum
    (of ``ids_after``, where ``existing`` is only a part of the table),
    in order of first appearance."""
    now = F.lit(as_of).cast("timestamp_ntz")
    inc = incoming.select(
        F.lower(strip_ws(F.col("raw_pattern"))).alias("raw_pattern"),
        strip_ws(F.col("clean_name")).alias("clean_name"),
        strip_ws(F.col("category")).alias("category"),
        strip_ws(F.coalesce(F.col("sub_category"), F.lit(""))).alias("sub_category"),
        F.coalesce(F.col("priority"), F.lit(0)).cast("int").alias("priority"),
        F.col("line_no"),
    )
    last = (inc.groupBy("raw_pattern")
            .agg(F.max_by(F.struct("clean_name", "category", "sub_category", "priority"), "line_no").alias("v"),
                 F.min("line_no").alias("first_line")))
    ex = existing.select("id", "raw_pattern", "clean_name", "category", "sub_category", "priority",
                         "created_at", "updated_at")
    new = number_rows(last.join(ex.select("raw_pattern"), "raw_pattern", "left_anti").select("raw_pattern", "first_line"), ["first_line", "raw_pattern"], "new_rank")
    j = ex.alias("e").join(last.alias("n"), "raw_pattern", "full_outer").join(new.select("raw_pattern", "new_rank"), "raw_pattern", "left")
    # One scalar from a dimension table: the next free id.
    max_id = (existing if ids_after is None else ids_after).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    staged = j.select(
        "raw_pattern", F.col("e.id").alias("old_id"), "new_rank",
        F.coalesce(F.col("n.v.clean_name"), F.col("e.clean_name")).alias("clean_name"),
        F.coalesce(F.col("n.v.category"), F.col("e.category")).alias("category"),
        F.coalesce(F.col("n.v.sub_category"), F.col("e.sub_category")).alias("sub_category"),
        F.coalesce(F.col("n.v.priority"), F.col("e.priority")).alias("priority"),
        F.coalesce(F.col("e.created_at"), now).alias("created_at"),
        F.when(F.col("n.v").isNotNull(), now).otherwise(F.col("e.updated_at")).alias("updated_at"),
    )
    return staged.select(
        F.coalesce(F.col("old_id"), (F.lit(max_id) + F.col("new_rank")).cast("int")).alias("id"),
        "raw_pattern", "clean_name", "category", "sub_category", "priority", "created_at", "updated_at")


def lookup_mapping(mappings: DataFrame, pattern: str) -> DataFrame:
    return mappings.filter(F.col("raw_pattern") == pattern.lower().strip())


def import_report(parsed: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: patterns added, patterns updated and rows skipped by an import of ``parsed`` rows."""
    ok = parsed.filter(F.col("status") == "ok").select("raw_pattern").distinct()
    known = ok.join(existing.select("raw_pattern", F.lit(True).alias("known")), "raw_pattern", "left")
    counts = known.agg(F.count_if(F.col("known").isNull()).alias("added"), F.count_if(F.col("known")).alias("updated"))
    skipped = parsed.agg(F.count_if(F.col("status") != "ok").alias("skipped"))
    return counts.select("added", "updated", F.lit(0).alias("k")).join(skipped.withColumn("k", F.lit(0)), "k").drop("k")


def delete_mapping(mappings: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Remaining mappings and a one-row frame telling whether it existed."""
    key = pattern.lower().strip()
    remaining = mappings.filter(F.col("raw_pattern") != key)
    existed = mappings.agg(F.count_if(F.col("raw_pattern") == key).alias("n")).select(
        F.lit(key).alias("raw_pattern"), (F.col("n") > 0).alias("existed"))
    return remaining, existed


# --- M4 ------------------------------------------------------------------------------------------

def reclean_existing(txns: DataFrame) -> DataFrame:
    """Re-run cleaning on every non-empty merchant; ``change`` is
    cleaned / nulled / unchanged (empty and NULL merchants are skipped).

    The cleaning runs once per distinct merchant and is joined back.
    """
    keys = txns.filter(F.col("merchant").isNotNull() & (F.col("merchant") != "")).select("merchant").distinct()
    decided = keys.select("merchant", reclean("merchant").alias("new_merchant"))
    j = txns.join(decided, "merchant", "left")
    skipped = F.col("merchant").isNull() | (F.col("merchant") == "")
    change = (F.when(skipped, F.lit(None).cast("string"))
              .when(F.col("new_merchant").eqNullSafe(F.col("merchant")), F.lit("unchanged"))
              .when(F.col("new_merchant").isNull(), F.lit("nulled"))
              .otherwise(F.lit("cleaned")))
    return j.select(*[c for c in txns.columns if c != "merchant"], F.col("merchant").alias("old_merchant"),
                    F.when(skipped, F.col("merchant")).otherwise(F.col("new_merchant")).alias("merchant"),
                    change.alias("change"))


def reclean_counts(recleaned: DataFrame) -> DataFrame:
    return recleaned.filter(F.col("change").isNotNull()).groupBy("change").agg(F.count(F.lit(1)).alias("n"))
