"""CSV files cut into records in parallel.

A quoted value may hold line breaks, so whether a line begins a record hangs
on all lines before it.  Files are read as lines in byte ranges; what a line
does to the quoting state is a function of two states (outside, inside a
quoted value): it keeps the state, swaps it, or leads to one state from
both.  Such functions compose, so the state before a line is the result of
the last line that leads to one state, swapped by the lines since.  Inside a
range this is a window over its lines (a range is bounded by
``spark.sql.files.maxPartitionBytes``), over ranges one over a row a range.
Only lines of records that span lines are then brought together.

Quoting follows the common dialect: a quote opens a value only at its
start, doubled quotes inside stand for one, what follows a closing quote is
taken as it is, and a quote in an unquoted value is an ordinary character.
A value whose quote is never closed takes the rest of its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTED = r'[^"]*+(?:""[^"]*+)*+'  # after the opening quote
_FIELD = rf'(?:"{_QUOTED}"[^,]*+|[^",][^,]*+)?'
_OPENS = rf'(?s)\A(?:{_FIELD},)*+"{_QUOTED}\z'  # begun outside, ends inside
_CLOSES = rf'(?s)\A{_QUOTED}"[^,]*+(.*)\z'  # begun inside: the value ends, then further fields


def _effect(line: Column) -> tuple[Column, Column]:
    """Whether a line begun outside, and one begun inside, a quoted value ends inside one."""
    quotes = line.contains('"')
    outside = quotes & line.rlike(_OPENS)
    inside = ~quotes | ~line.rlike(_CLOSES) | F.regexp_extract(line, _CLOSES, 1).rlike(_OPENS)
    return outside, inside


def _state(before: Column, fixed: Column, swaps: Column) -> Column:
    """The state after ``swaps`` swaps, of which ``fixed.swaps`` were made before a line that led to ``fixed.inside``."""
    return (F.when(fixed.isNull(), before != (swaps % 2 == 1))
            .otherwise(fixed["inside"] != ((swaps - fixed["swaps"]) % 2 == 1)))


def read_records(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """(file, at, value): the records of the CSV files at ``path``; ``at`` orders a file's records.

    Lines that start with ``comment`` are no part of the file, as are blank
    lines between records.  Line breaks inside values become ``\\n``.
    """
    raw = (spark.read.text(path)
           .select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("id"), "value")
           .filter(~F.col("value").startswith(comment)))
    outside, inside = _effect(F.col("value"))
    by_line = Window.partitionBy("file", "block").orderBy("id")
    so_far, earlier = by_line.rowsBetween(Window.unboundedPreceding, 0), by_line.rowsBetween(Window.unboundedPreceding, -1)
    swapped = F.count_if(F.col("outside") & ~F.col("inside"))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct("inside", "swaps"))
    lines = (raw.withColumns({"outside": outside, "inside": inside})
             .withColumns({"no": F.row_number().over(by_line), "swaps": swapped.over(so_far)})
             .withColumn("fixed", fixed)
             .withColumns({"swaps_before": F.coalesce(F.lag("swaps").over(by_line), F.lit(0)),
                           "fixed_before": F.last("fixed", ignorenulls=True).over(earlier)}))


    def before(begins: Column) -> Column:
        return _state(begins, F.col("fixed_before"), F.col("swaps_before"))

    # One row a range: what it does to the state, and its last record's first line for either state that it may begin with.
    ranges = lines.groupBy("file", "block").agg(
        F.max("swaps").alias("swaps"), F.max_by("fixed", F.when(F.col("fixed").isNotNull(), F.col("no"))).alias("last"),
        F.max(F.when(~before(F.lit(False)), F.col("no"))).alias("if_outside"), F.max(F.when(~before(F.lit(True)), F.col("no"))).alias("if_inside"))
    by_range = Window.partitionBy("file").orderBy("block")
    ranges_before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    ended = _state(F.lit(False), F.col("last"), F.col("swaps"))
    odd = F.when(F.col("last").isNull(), F.col("swaps") % 2).otherwise(F.lit(0))
    states = (ranges.withColumns({"total": F.sum(odd).over(by_range.rowsBetween(Window.unboundedPreceding, 0)), "ended": ended})
              .withColumn("known", F.when(F.col("last").isNotNull(), F.struct(F.col("ended").alias("inside"), F.col("total").alias("swaps"))))
              .withColumns({"known_before": F.last("known", ignorenulls=True).over(ranges_before),
                            "total_before": F.coalesce(F.lag("total").over(by_range), F.lit(0))})
              .withColumn("begins", _state(F.lit(False), F.col("known_before"), F.col("total_before")))
              .withColumn("first_line", F.when(F.col("begins"), F.col("if_inside")).otherwise(F.col("if_outside")))
              .withColumn("own", F.when(F.col("first_line").isNotNull(), F.struct("block", F.col("first_line").alias("no"))))
              .select("file", "block", "begins", F.last("own", ignorenulls=True).over(ranges_before).alias("carried")))

    placed = lines.join(states, ["file", "block"]).withColumn("inside_before", before(F.col("begins")))
    placed = placed.select("file", "block", "no", "value", "inside_before",
                           F.when(F.col("inside_before"), F.col("inside")).otherwise(F.col("outside")).alias("inside_after"),
                           F.coalesce(F.last(F.when(~F.col("inside_before"), F.struct("block", "no")), ignorenulls=True).over(
                               Window.partitionBy("file", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)), F.col("carried")).alias("at"))
    one_line = ~F.col("inside_before") & ~F.col("inside_after")
    whole = placed.filter(one_line & (F.trim("value") != "")).select("file", "at", "value")
    parts = F.array_sort(F.collect_list(F.struct("block", "no", "value")))
    joined = (placed.filter(~one_line).groupBy("file", "at")
              .agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value")))
    return whole.unionByName(joined)
