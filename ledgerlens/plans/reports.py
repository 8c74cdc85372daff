"""Reporting jobs over the debit/credit tables.

Every report is a declarative DataFrame plan: filters and column pruning
reach the Parquet scan, aggregates run partial (map-side) before the
shuffle, so a hot merchant or category collapses to one row per task
before anything moves.  Unpartitioned windows and sorts only ever run on
already-aggregated input (one row per month/category).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerlens import constants as K
from ledgerlens.operators.store import number_rows
from ledgerlens.session import partitions


# Columns appended to every user-facing order so ties (repeated source keys)
# resolve the same way on every run and engine.
TIE_BREAK = ["source", "amount", "merchant", "category", "sub_category", "payment_method", "bank_name"]


def _tie_break() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in TIE_BREAK]


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def month_of(ts: Column) -> Column:
    return F.trunc(ts, "month")


# --- A1 / A4 / J5 -------------------------------------------------------------

def monthly_spend(expenses: DataFrame) -> DataFrame:
    """month -> total_spent, txn_count."""
    return (expenses.groupBy(month_of(F.col("txn_date")).alias("month"))
            .agg(F.sum("amount").alias("total_spent"), F.count(F.lit(1)).alias("txn_count")))


def income_vs_expense(expenses: DataFrame, credits: DataFrame) -> DataFrame:
    """Monthly income vs expense; both sides are pre-aggregated before the
    full outer join, so the join sees one row per month per side."""
    e = (expenses.groupBy(month_of(F.col("txn_date")).alias("month"))
         .agg(F.sum("amount").alias("expenses")))
    c = (credits.groupBy(month_of(F.col("txn_date")).alias("month"))
         .agg(F.sum("amount").alias("income")))
    j = e.join(c, "month", "full_outer")
    exp = F.coalesce(F.col("expenses"), F.lit(0))
    inc = F.coalesce(F.col("income"), F.lit(0))
    return j.select("month", exp.alias("expenses"), inc.alias("income"), (inc - exp).alias("net"))


def income_vs_expense_labelled(all_txn: DataFrame) -> DataFrame:
    """Same report from one store scan carrying ``table_name``: one
    conditional aggregate per month replaces two aggregates and the full
    outer join (a month appears when either table has rows in it)."""
    agg = all_txn.groupBy(month_of(F.col("txn_date")).alias("month")).agg(
        F.sum(F.when(F.col("table_name") == "expenses", F.col("amount"))).alias("expenses"),
        F.sum(F.when(F.col("table_name") == "credits", F.col("amount"))).alias("income"))
    exp = F.coalesce(F.col("expenses"), F.lit(0))
    inc = F.coalesce(F.col("income"), F.lit(0))
    return agg.select("month", exp.alias("expenses"), inc.alias("income"), (inc - exp).alias("net"))


# --- A2 / W1 --------------------------------------------------------------------

def category_spend(expenses: DataFrame) -> DataFrame:
    """COALESCE(category,'Other') -> totals, plus row_id by total desc.

    NULL merges into 'Other' while '' stays its own group.  The ranking
    window has no partition: it runs on the aggregated rows only (one per
    category), so the single-partition exchange is bounded by the number
    of categories, never by the number of transactions.
    """
    agg = (expenses.groupBy(F.coalesce(F.col("category"), F.lit(K.OTHER_CATEGORY)).alias("category"))
           .agg(F.sum("amount").alias("total_spent"), F.count(F.lit(1)).alias("txn_count")))
    w = Window.orderBy(F.col("total_spent").desc(), F.col("category").asc())
    return agg.select(F.row_number().over(w).alias("row_id"), "category", "total_spent", "txn_count")


# --- A3 / T-1 -----------------------------------------------------------------------

def top_merchants(expenses: DataFrame, k: int = K.TOP_MERCHANTS) -> DataFrame:
    """Top-k merchants by spend (TakeOrderedAndProject: per-task top-k, then merge)."""
    agg = (expenses.filter(F.col("merchant").isNotNull())
           .groupBy("merchant")
           .agg(F.sum("amount").alias("total_spent"), F.count(F.lit(1)).alias("txn_count"),
                F.avg("amount").alias("avg_amount")))
    return agg.orderBy(F.col("total_spent").desc(), F.col("merchant").asc()).limit(k)


# --- A5 ------------------------------------------------------------------------------

def quality_report(all_txn: DataFrame) -> DataFrame:
    """Per table: total, missing merchant, Other/NULL category, empty sub-category.

    One pass with conditional counts instead of one query per counter.
    ``all_txn`` carries a ``table_name`` column (see ``all_transactions``).
    """
    return all_txn.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_blank(F.col("merchant"))).alias("missing_merchant"),
        F.count_if((F.col("category") == K.OTHER_CATEGORY) | F.col("category").isNull()).alias("other_category"),
        F.count_if(_blank(F.col("sub_category"))).alias("empty_sub_category"),
    )


# --- A6 --------------------------------------------------------------------------------

def merchant_frequency(expenses: DataFrame, k: int = K.TOP_MERCHANTS) -> DataFrame:
    agg = (expenses.filter(F.col("merchant").isNotNull() & (F.col("merchant") != ""))
           .groupBy("merchant").agg(F.count(F.lit(1)).alias("cnt")))
    return agg.orderBy(F.col("cnt").desc(), F.col("merchant").asc()).limit(k)


# --- A7 ------------------------------------------------------------------------------------

_POPULATION = [
    ("amount", lambda: F.col("amount").isNotNull()),
    ("txn_date", lambda: F.col("txn_date").isNotNull()),
    ("merchant", lambda: F.col("merchant").isNotNull() & (F.col("merchant") != "")
     & (F.col("merchant") != K.UNKNOWN_MERCHANT)),
    ("category", lambda: F.col("category").isNotNull() & (F.col("category") != K.OTHER_CATEGORY)),
    ("sub_category", lambda: F.col("sub_category").isNotNull() & (F.col("sub_category") != "")),
    ("payment_method", lambda: F.col("payment_method").isNotNull() & (F.col("payment_method") != "")),
    ("bank_name", lambda: F.col("bank_name").isNotNull() & (F.col("bank_name") != "")),
    ("embedding", lambda: F.col("embedding").isNotNull()),
]


def field_population(expenses: DataFrame) -> DataFrame:
    """Filled counts and integer percent per field, one row per field.

    A single aggregate pass produces all counts; ``stack`` turns the one
    row into eight.  Percent is ``100*n div total`` and NULL on an empty
    table (the reference stops early there).
    """
    cols = [F.count(F.lit(1)).alias("total")] + [F.count_if(cond()).alias(name) for name, cond in _POPULATION]
    wide = expenses.agg(*cols)
    stack = "stack({n}, {pairs}) as (field, filled)".format(
        n=len(_POPULATION), pairs=", ".join(f"'{name}', `{name}`" for name, _ in _POPULATION))
    long = wide.selectExpr("total", stack)
    return long.select("field", "filled", "total",
                       F.when(F.col("total") > 0, F.expr("(filled * 100) div total")).alias("pct"))


# --- A8 -------------------------------------------------------------------------------------

def category_breakdown(expenses: DataFrame) -> DataFrame:
    return (expenses.groupBy("category").agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.col("cnt").desc(), F.col("category").asc_nulls_last()))


def payment_breakdown(expenses: DataFrame) -> DataFrame:
    return (expenses.groupBy("payment_method").agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.col("cnt").desc(), F.col("payment_method").asc_nulls_last()))


# --- A9 / Q6 -------------------------------------------------------------------------------

def ilike_filter(df: DataFrame, merchant: str | None = None, category: str | None = None,
                 payment_method: str | None = None, start_date=None, end_date=None) -> DataFrame:
    """Conjunctive optional filters; a filter is added only when set.

    The date bounds are plain comparisons, so they reach the Parquet scan
    as pushed filters; the ILIKE ones are evaluated after the scan.
    """
    out = df
    if merchant:
        out = out.filter(F.col("merchant").ilike(f"%{merchant}%"))
    if category:
        out = out.filter(F.col("category").ilike(f"%{category}%"))
    if payment_method:
        out = out.filter(F.col("payment_method").ilike(f"%{payment_method}%"))
    if start_date is not None:
        out = out.filter(F.col("txn_date") >= F.lit(start_date).cast("timestamp_ntz"))
    if end_date is not None:
        out = out.filter(F.col("txn_date") <= F.lit(end_date).cast("timestamp_ntz"))
    return out


def filtered_total(df: DataFrame, **filters) -> DataFrame:
    """Global SUM(amount) with the optional filters; 0 when nothing matches."""
    return ilike_filter(df, **filters).agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("total"))


# --- Q1..Q5 ----------------------------------------------------------------------------------

def missing_merchant(df: DataFrame) -> DataFrame:
    return df.filter(_blank(F.col("merchant")))


def uncategorised(df: DataFrame) -> DataFrame:
    return df.filter((F.col("category") == K.OTHER_CATEGORY) | F.col("category").isNull())


def empty_sub_category(df: DataFrame) -> DataFrame:
    return df.filter(_blank(F.col("sub_category")))


def _needs_merchant() -> Column:
    m = F.col("merchant")
    return m.isNull() | (m == "") | (m == K.UNKNOWN_MERCHANT)


def _needs_category() -> Column:
    return (F.col("category") == K.OTHER_CATEGORY) | F.col("category").isNull()


def review_backlog(expenses: DataFrame, credits: DataFrame, table: str = "both",
                   issue: str = "both") -> DataFrame:
    """Rows needing attention, labelled by table, newest first within table."""
    return review_backlog_labelled(all_transactions(expenses, credits), table, issue)


def review_backlog_labelled(all_txn: DataFrame, table: str = "both", issue: str = "both") -> DataFrame:
    """``review_backlog`` over one table carrying ``table_name`` (one scan
    when both tables live in one store)."""
    if issue == "merchant":
        cond = _needs_merchant()
    elif issue == "category":
        cond = _needs_category()
    else:
        cond = _needs_merchant() | _needs_category()
    if table in ("expenses", "credits"):
        cond = cond & (F.col("table_name") == table)
    out = all_txn.filter(cond)
    return out.orderBy(*_review_order())


def bad_rows(df: DataFrame) -> DataFrame:
    """Amount above the ceiling OR a bare article as merchant (set union by row)."""
    return df.filter((F.col("amount") > K.MAX_AMOUNT) | F.col("merchant").isin(*K.BAD_MERCHANTS))


# --- U1 ----------------------------------------------------------------------------------------

def all_transactions(expenses: DataFrame, credits: DataFrame) -> DataFrame:
    return (expenses.withColumn("table_name", F.lit("expenses"))
            .unionByName(credits.withColumn("table_name", F.lit("credits"))))


# --- T-2 / T-3 / T-4 --------------------------------------------------------------------------

def latest_records(expenses: DataFrame, n: int = 5) -> DataFrame:
    """Newest n by created_at; source breaks ties so the answer is stable."""
    return expenses.orderBy(F.col("created_at").desc_nulls_last(), *_tie_break()).limit(n)


def mapping_order(mappings: DataFrame) -> DataFrame:
    """Mappings by priority desc, id asc, with the listing ``position``."""
    ranked = number_rows(mappings.withColumn("_down", -F.col("priority")), ["_down", "id"], "position")
    return ranked.drop("_down")


def _review_order() -> list[Column]:
    """Source keys may repeat, so the tie-break columns make the order total and paging deterministic."""
    table_rank = F.when(F.col("table_name") == "expenses", 0).otherwise(1)
    return [table_rank, F.col("txn_date").desc_nulls_last(), *_tie_break()]


def review_page(expenses: DataFrame, credits: DataFrame, page: int,
                page_size: int = K.REVIEW_PAGE_SIZE) -> DataFrame:
    return review_page_labelled(all_transactions(expenses, credits), page, page_size)


def review_page_labelled(all_txn: DataFrame, page: int, page_size: int = K.REVIEW_PAGE_SIZE) -> DataFrame:
    """One page of the review backlog over a single total order.

    ``offset``/``limit`` on a global sort: each task keeps only its top
    offset+limit rows before the merge, so a page never collects the
    backlog.  An out-of-range page is simply empty.
    """
    page = max(1, int(page))
    return review_backlog_labelled(all_txn).offset((page - 1) * page_size).limit(page_size)


def write_review_pages(all_txn: DataFrame, path: str) -> None:
    """The review backlog as an order-statistic table, so any page is read without sorting the backlog.

    ``rows`` holds the backlog dealt by ranges of its order, a folder a
    range, ``sizes`` how many rows each range has, and ``columns`` no rows.  Rows that are equal
    in the order are told apart by where they were read, so no range grows
    with the copies of one row.
    """
    spark = all_txn.sparkSession
    backlog = all_txn.filter(_needs_merchant() | _needs_category()).withColumn("_at", F.monotonically_increasing_id())
    order = [*_review_order(), F.col("_at")]
    (backlog.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id())
     .write.partitionBy("_range").parquet(f"{path}/rows"))
    backlog.limit(0).coalesce(1).write.parquet(f"{path}/columns")
    rows = spark.read.schema(StructType([*backlog.schema.fields, StructField("_range", IntegerType())])).parquet(f"{path}/rows")
    rows.groupBy("_range").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/sizes")


def read_review_page(spark: SparkSession, path: str, page: int, page_size: int = K.REVIEW_PAGE_SIZE) -> DataFrame:
    """One page of a table that ``write_review_pages`` wrote: only the ranges that hold its rows are read.  Past the
    last page it is empty."""
    first = (max(1, int(page)) - 1) * page_size
    hit, before, skip = [], 0, 0
    for r in spark.read.schema("_range int, n long").parquet(f"{path}/sizes").orderBy("_range").collect():  # a row per range
        if before < first + page_size and before + r.n > first:
            skip = skip if hit else first - before
            hit.append(r["_range"])
        before += r.n
    rows = spark.read.parquet(*[f"{path}/rows/_range={i}" for i in hit] or [f"{path}/columns"])
    return rows.orderBy(*_review_order(), "_at").offset(max(0, skip)).limit(page_size).drop("_at")


def review_totals(expenses: DataFrame, credits: DataFrame,
                  page_size: int = K.REVIEW_PAGE_SIZE) -> DataFrame:
    return review_totals_labelled(all_transactions(expenses, credits), page_size)


def review_totals_labelled(all_txn: DataFrame, page_size: int = K.REVIEW_PAGE_SIZE) -> DataFrame:
    """Backlog size and page count (a separate one-row aggregate)."""
    backlog = all_txn.filter(_needs_merchant() | _needs_category())
    return (backlog.agg(F.count(F.lit(1)).alias("total"))
            .withColumn("total_pages", F.expr(f"(total + {page_size} - 1) div {page_size}")))
