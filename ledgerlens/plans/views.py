"""Reporting views kept up to date from a versioned table's files.

A version is a set of files that never change, so a file's partial sums stay
right for as long as it exists.  ``refresh`` aggregates only the files that
have no partial sums yet and appends those to a versioned table beside the
transactions; a view of any version is a sum over the partial rows of that
version's files.  An append costs the new files, a delete or a re-clean the
rewritten ones; files that are gone drop out by the join with the manifest,
so nothing is ever subtracted.

Partial rows are one a file and month, category or merchant: a month or a
merchant that holds a third of the rows is one row a file.  Two refreshes at
once can't count a file twice: the later commit is refused and repeated on
what the first one left to do.

Defined cases: NULL months, categories and merchants are groups as in the
reports; amounts that are all NULL add up to NULL; a table without rows has
empty views; repeated rows count as often as they stand; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.operators import versions as VS
from ledgerlens.plans.reports import month_of

MONTH, CATEGORY, MERCHANT = "month", "category", "merchant"


def _partials_path(path: str) -> str:
    return f"{path}/partials"


def partial_sums(rows: DataFrame) -> DataFrame:
    """(file, kind, month, category, merchant, total, n, n_amounts) of rows with ``_in_file``: one pass for all three kinds."""
    keys = {MONTH: month_of(F.col("txn_date")), CATEGORY: F.coalesce(F.col("category"), F.lit(K.OTHER_CATEGORY)), MERCHANT: F.col("merchant")}
    named = rows.select(F.col("_in_file").alias("file"), *[c.alias(k) for k, c in keys.items()], "amount")
    sets = [[F.col("file"), F.col(k)] for k in keys]
    # The bits of grouping_id tell which key a row is for: 0 where it is grouped by.
    got = named.groupingSets(sets, "file", *keys).agg(
        F.grouping_id().alias("gid"), F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"), F.count("amount").alias("n_amounts"))
    kind = F.when(F.col("gid") == 0b011, MONTH).when(F.col("gid") == 0b101, CATEGORY).otherwise(MERCHANT)
    return got.select("file", kind.alias("kind"), *keys, "total", "n", "n_amounts")


def refresh(spark: SparkSession, path: str) -> VS.Changed:
    """Add the partial sums of the files of ``path``'s last version that have none."""
    where = _partials_path(path)
    if not VS.current_version(spark, where):
        # The first writer sets the table up; a second one's empty version takes nothing away.
        VS.create_version(spark.createDataFrame([], partial_sums(VS.table_with_files(spark, path)).schema), where)

    def missing(none: DataFrame, have: DataFrame) -> DataFrame:
        return none.unionByName(partial_sums(VS.table_with_files(spark, path, without=have.select("file").distinct())))

    return VS.change_files(spark, where, lambda t: t.filter(F.lit(False)), missing)


def drop_stale(spark: SparkSession, path: str) -> VS.Changed:
    """Take out the partial sums of files that the last version no longer has (views of older versions want a refresh then)."""
    live = VS.version_files(spark, path).select("file")
    return VS.change_files(spark, _partials_path(path), lambda t: t.join(live, "file", "left_anti"),
                           lambda rows, _: rows.join(live, "file", "left_semi"))


class StaleViews(LookupError):
    """Files of the version asked for have no partial sums yet."""


def _partials(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    """The partial rows of a version's files."""
    files = VS.version_files(spark, path, version)
    have = VS.read_version(spark, _partials_path(path))
    lacking = files.join(have.filter(F.col("kind") == MONTH), "file", "left_anti")
    if not lacking.isEmpty():
        raise StaleViews(f"refresh the views of {path} first")
    return have.join(files.select("file"), "file", "left_semi")


def _sums(partials: DataFrame, kind: str) -> DataFrame:
    return (partials.filter(F.col("kind") == kind).groupBy(kind)
            .agg(F.sum("total").cast(partials.schema["total"].dataType).alias("total_spent"), F.sum("n").alias("txn_count"), F.sum("n_amounts").alias("n_amounts")))


def monthly_spend(partials: DataFrame) -> DataFrame:
    return _sums(partials, MONTH).select("month", "total_spent", "txn_count")


def category_spend(partials: DataFrame) -> DataFrame:
    """The rank's window runs on one row a category."""
    rank = F.row_number().over(Window.orderBy(F.col("total_spent").desc(), F.col("category").asc()))
    return _sums(partials, CATEGORY).select(rank.alias("row_id"), "category", "total_spent", "txn_count")


def top_merchants(partials: DataFrame, avg_type: str, k: int = K.TOP_MERCHANTS) -> DataFrame:
    average = F.try_divide("total_spent", "n_amounts").cast(avg_type)
    rows = _sums(partials, MERCHANT).filter(F.col("merchant").isNotNull())
    return (rows.select("merchant", "total_spent", "txn_count", average.alias("avg_amount"))
            .orderBy(F.col("total_spent").desc(), F.col("merchant").asc()).limit(k))


def income_vs_expense(expenses: DataFrame, credits: DataFrame) -> DataFrame:
    e = _sums(expenses, MONTH).select("month", F.col("total_spent").alias("expenses"))
    c = _sums(credits, MONTH).select("month", F.col("total_spent").alias("income"))

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return (e.join(c, "month", "full_outer")
            .select("month", known("expenses").alias("expenses"), known("income").alias("income"), (known("income") - known("expenses")).alias("net")))


def publish(spark: SparkSession, expenses: str, credits: str, as_of: tuple[int | None, int | None] = (None, None)) -> list[str]:
    """Register the four reporting views over the versioned tables at two paths, refreshed as far as needed.

    ``as_of`` names versions of the two tables; the last ones if None.
    """
    refreshed = []
    for path, version in zip((expenses, credits), as_of):
        if version is None:
            refresh(spark, path)
        refreshed.append(_partials(spark, path, version))
    spent, earned = refreshed
    amounts = VS.read_version(spark, expenses, as_of[0])
    avg_type = amounts.agg(F.avg("amount").alias("a")).schema["a"].dataType.simpleString()
    views = {"v_monthly_spend": monthly_spend(spent), "v_category_spend": category_spend(spent),
             "v_top_merchants": top_merchants(spent, avg_type), "v_monthly_income_vs_expense": income_vs_expense(spent, earned)}
    amounts.createOrReplaceTempView("expenses")
    VS.read_version(spark, credits, as_of[1]).createOrReplaceTempView("credits")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
