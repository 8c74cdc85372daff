"""Document fingerprints: a Merkle tree over paragraphs and sections.

Built-in functions only.  Lines are the paragraphs; a paragraph's leaves are
its clauses (cut at white space after a clause-ending letter or mark, so an
edit moves no later cut).  A section ends after a paragraph whose hash
starts with 0-3, again decided by content alone.  Paragraph node: SHA-256
of its text; section node: SHA-256 of its paragraphs' nodes; root: SHA-256
of the section nodes.  The fingerprint lists the tree:

    root/section:paragraph=clause,clause;paragraph=...|section:...

Equal texts have equal roots; ``differing`` walks the listed branches to the
paragraphs that differ; ``likeness`` is the share of common nodes (Dice over
distinct nodes), 1 for equal roots.

Defined cases: null text is the empty text, whose tree is a root alone (its
likeness to any other text is 0); a null doc_id sorts first; rows of one
doc_id follow each other by text; the next document of an only row is the
row itself; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, partitions

_CUT = "\x01"
_NODE_HEX, _CLAUSE_HEX = 20, 6


def _sha(c: Column, n: int = 64) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def _paragraph(p: Column) -> Column:
    clauses = F.split(F.regexp_replace(p, r"([nr.,;:!?|])(\s)", f"$1{_CUT}$2"), _CUT)
    listed = F.array_join(F.transform(clauses, lambda c: F.substring(F.md5(c), 1, _CLAUSE_HEX)), ",")
    node = _sha(p, _NODE_HEX)
    ends = F.substring(node, 1, 1) < "4"
    return F.when(p == "", F.lit(";")).otherwise(F.concat(node, F.lit("="), listed, F.when(ends, "|").otherwise(";")))


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of ``text_col`` as column ``out``."""
    (tmp,) = fresh(df, "_sections")
    text = F.coalesce(F.col(text_col), F.lit(""))
    listed = F.array_join(F.transform(F.split(text, "\n", -1), _paragraph), "")
    sections = F.split(F.when(text == "", "").otherwise(listed), r"\|", -1)
    df = df.withColumn(tmp, F.transform(F.filter(sections, lambda s: s != ""), lambda s: F.concat(_sha(s, _NODE_HEX), F.lit(":"), s)))
    body = F.array_join(tmp, "|")
    return df.withColumn(out, F.concat(_sha(body), F.lit("/"), body)).drop(tmp)


def _nodes(fp: Column) -> Column:
    flat = F.translate(fp, "/|:;=", ",,,,,")
    return F.array_distinct(F.filter(F.split(flat, ","), lambda t: t != ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of nodes that two trees have in common."""
    x, y = _nodes(a), _nodes(b)
    dice = 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when(a == b, F.lit(1.0)).otherwise(dice)


def differing(a: Column, b: Column) -> Column:
    """Paragraphs of ``a`` whose branch ``b`` lacks, as structs (section, paragraph), both from 0.

    A section that both trees have is skipped whole, so only differing
    branches are compared at paragraph level.
    """
    def sections(fp: Column) -> Column:
        return F.split(F.substring_index(fp, "/", -1), r"\|")

    theirs = sections(b)
    here = F.transform(sections(a), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    changed = F.filter(here, lambda x: ~F.array_contains(theirs, x["s"]))
    known = F.split(F.translate(F.substring_index(b, "/", -1), "|:", ";;"), ";")

    def paragraphs(x: Column) -> Column:
        listed = F.split(F.substring_index(x["s"], ":", -1), ";")
        marked = F.transform(listed, lambda p, j: F.when((p != "") & ~F.array_contains(known, p), F.struct(x["i"].alias("section"), j.alias("paragraph"))))
        return F.filter(marked, lambda m: m.isNotNull())

    return F.when(a == b, F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.flatten(F.transform(changed, paragraphs)))


def with_next(docs: DataFrame, id_col: str, text_col: str, buckets: int | None = None) -> DataFrame:
    """(id, text, next_text): every row with the text of the next by ascending id, the last with the first's.

    Rows go to ranges of ids (cut at approximate quantiles, so no range
    holds much more than its share); each range also gets a copy of the
    next range's first row, and a window inside the range does the rest.
    Only range cuts and first ids, at most ``buckets`` of each, reach the driver.
    """
    spark = docs.sparkSession
    n = buckets or partitions(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cuts = sorted(set(base.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    bucket = reduce(lambda acc, c: acc + (F.coalesce("id", F.lit(-(1 << 63))) >= int(c)).cast("int"), cuts, F.lit(0))
    rows = base.select("id", "text", bucket.alias("b"), F.lit(False).alias("copy"))
    firsts = sorted((r.b, r.f[0], r.f[1]) for r in rows.groupBy("b").agg(
        F.min(F.struct(F.col("id").isNotNull(), F.coalesce("id", F.lit(0)))).alias("f")).collect())
    if not firsts:
        return rows.select("id", "text", F.col("text").alias("next_text"))
    heads = [(firsts[i - 1][0], known, first) for i, (_, known, first) in enumerate(firsts)]
    lead = spark.createDataFrame(heads, "b int, known boolean, first long")
    copies = (base.join(F.broadcast(lead), (F.col("id").isNotNull() == F.col("known")) & (F.coalesce("id", F.lit(0)) == F.col("first")))
              .groupBy("b", "id").agg(F.min("text").alias("text")).select("id", "text", "b", F.lit(True).alias("copy")))
    order = Window.partitionBy("b").orderBy("copy", F.col("id").asc_nulls_first(), "text")
    return (rows.unionByName(copies).withColumn("next_text", F.lead("text").over(order))
            .where("not copy").select("id", "text", "next_text"))


def half_edited(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of ``following``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))
