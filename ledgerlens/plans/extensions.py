"""Features the reference documents but does not implement.

Choices not fixed by the specification are stated here and in the README:
period bands, the coefficient-of-variation cut-off, budget thresholds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Our choice: day-gap bands (inclusive) and the spacing consistency cut-off.
PERIOD_BANDS = [
    ("weekly", 5, 9),
    ("biweekly", 12, 16),
    ("monthly", 26, 35),
    ("quarterly", 85, 100),
    ("annual", 350, 380),
]
MAX_CV = 0.35
MIN_CHARGES = 3
BUDGET_WARN = 0.8


# --- E1 ------------------------------------------------------------------------------------

def recurring_candidates(expenses: DataFrame, key: str = "merchant") -> DataFrame:
    """Per merchant: charge count, mean day gap between consecutive charge
    days, its coefficient of variation, band, average amount, last and
    next expected date, and ``is_recurring``.

    Charges are first reduced to one row per (merchant, day) with partial
    aggregation; the consecutive-gap window then sorts at most one row per
    calendar day per merchant, whatever the merchant's volume.
    """
    days = (expenses.filter(F.col(key).isNotNull())
            .groupBy(key, F.to_date("txn_date").alias("day"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amt")))
    w = Window.partitionBy(key).orderBy("day")
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    stats = gaps.groupBy(key).agg(
        F.sum("n").alias("n_charges"),
        F.count("gap").alias("n_gaps"),
        F.avg("gap").alias("avg_gap"),
        F.stddev_pop("gap").alias("sd_gap"),
        (F.sum("amt").cast("double") / F.sum("n")).alias("avg_amount"),
        F.max("day").alias("last_date"),
    )
    cv = F.when(F.col("avg_gap") > 0, F.col("sd_gap") / F.col("avg_gap"))
    band = F.lit(None).cast("string")
    for name, lo, hi in reversed(PERIOD_BANDS):
        band = F.when((F.col("avg_gap") >= lo) & (F.col("avg_gap") <= hi), F.lit(name)).otherwise(band)
    out = stats.select(
        key, "n_charges", "n_gaps", "avg_gap", cv.alias("cv"), band.alias("period"),
        F.round(F.col("avg_amount"), 2).alias("avg_amount"), "last_date",
        F.date_add("last_date", F.round("avg_gap").cast("int")).alias("next_date"),
    )
    return out.withColumn("is_recurring", (F.col("n_charges") >= MIN_CHARGES) & F.col("period").isNotNull()
                          & F.coalesce(F.col("cv") <= MAX_CV, F.lit(False)))


def recurring_payments(expenses: DataFrame, key: str = "merchant") -> DataFrame:
    return recurring_candidates(expenses, key).filter("is_recurring").drop("is_recurring")


# --- E2 ------------------------------------------------------------------------------------

def budget_status(expenses: DataFrame, budgets: DataFrame, as_of: str) -> DataFrame:
    """Month-to-date spend per budgeted category vs its limit:
    ok / warning (>= 80 %) / exceeded (>= 100 %).

    The date filter reaches the scan; the spend aggregate has one row per
    category, so joining the budget table is a small join.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    start = F.date_trunc("month", now).cast("timestamp_ntz")
    spend = (expenses.filter((F.col("txn_date") >= start) & (F.col("txn_date") <= now))
             .groupBy(F.coalesce(F.col("category"), F.lit("Other")).alias("category"))
             .agg(F.sum("amount").alias("spent")))
    j = budgets.join(spend, "category", "left")
    spent = F.coalesce(F.col("spent"), F.lit(0))
    used = spent.cast("double") / F.col("monthly_limit").cast("double")
    status = (F.when(used >= 1, F.lit("exceeded")).when(used >= BUDGET_WARN, F.lit("warning"))
              .otherwise(F.lit("ok")))
    return j.select("category", "monthly_limit", spent.alias("spent"),
                    F.round(used * 100, 2).alias("pct_used"), status.alias("status"))


# --- E3 ------------------------------------------------------------------------------------

def apply_category_overrides(txns: DataFrame, overrides: DataFrame, mappings: DataFrame | None) -> DataFrame:
    """User corrections keyed by merchant win over rules and the built-in
    map.  Overrides are an equi-join on the lower-cased merchant (small
    table, broadcast by AQE when small); other rows keep the rule result."""
    from ledgerlens.operators.rules import categorize

    # One correction per merchant: of several the greatest (category, sub-category), so rows never multiply.
    ov = (overrides.groupBy(F.lower("merchant").alias("_om"))
          .agg(F.max(F.struct("category", F.coalesce("sub_category", F.lit("")).alias("sub"))).alias("o"))
          .select("_om", F.col("o.category").alias("_oc"), F.col("o.sub").alias("_os")))
    base = categorize(txns.withColumn("_key", F.lower(F.coalesce("merchant", F.lit("")))), mappings)
    j = base.join(ov, base["_key"] == ov["_om"], "left")
    return j.select(
        *[c for c in base.columns if c not in ("category", "sub_category", "_key")],
        F.coalesce(F.col("_oc"), F.col("category")).alias("category"),
        F.when(F.col("_oc").isNotNull(), F.col("_os")).otherwise(F.col("sub_category")).alias("sub_category"),
    )
