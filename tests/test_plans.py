"""Plan-shape checks: the properties the design relies on at scale."""

import contextlib
import io

import pytest

from conftest import SF001


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def q():
    import __spark_entry__ as E

    return E.queries()


def test_date_filter_and_columns_reach_the_scan(spark, q):
    p = plan(q["filtered_total"](spark, SF001))
    assert "GreaterThanOrEqual(l_shipdate" in p and "LessThanOrEqual(l_shipdate" in p
    scan = [line for line in p.splitlines() if line.startswith("ReadSchema") and "l_partkey" in line][0]
    for unused in ("l_quantity", "l_discount", "l_tax", "l_linestatus"):
        assert unused not in scan


def test_aggregates_are_partial_before_the_shuffle(spark, q):
    p = plan(q["monthly_spend"](spark, SF001))
    assert p.count("HashAggregate") >= 2 and "Exchange" in p


def test_top_k_is_take_ordered(spark, q):
    assert "TakeOrderedAndProject" in plan(q["top_merchants"](spark, SF001))
    assert "TakeOrderedAndProject" in plan(q["semantic_search"](spark, SF001))


@pytest.mark.parametrize("name", ["categorize_mappings", "apply_mappings", "answer_questions",
                                  "statement_rows_multicol", "dedup_against_store"])
def test_no_cartesian_products(spark, q, name):
    p = plan(q[name](spark, SF001))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_parsers_stay_on_the_jvm(spark, q):
    for name in ("parse_alerts", "clean_merchant", "redact_pii", "statement_rows_card_cell"):
        p = plan(q[name](spark, SF001))
        assert "EvalPython" not in p and "PythonUDF" not in p, name


def test_no_document_window_in_statement_parsing(spark, q):
    for name in ("detect_statement_format", "statement_year"):
        assert "Window " not in plan(q[name](spark, SF001)), name
    # Copies are ranked by the whole key, dealt anew after the document join, cut to one row a task before.
    p = plan(q["statement_lines_card_text"](spark, SF001))
    assert "hashpartitioning(_first_key" in p
    assert p.count("WindowGroupLimit") >= 2


def test_copies_move_one_row_a_task(spark, q):
    p = plan(q["dedup_against_store"](spark, SF001))
    assert "WindowGroupLimit" in p and "SortAggregate" not in p


def test_rendered_inputs_are_not_dealt_or_copied(spark, q):
    from ledgerlens.plans import catalog

    for name in ("message_records", "parse_alerts"):
        q[name](spark, SF001)
    assert not {"mail-payloads", "alert-messages"} & {key[2] for key in catalog._RENDERED}
    # What must be a file is written by the tasks that render it.
    back = catalog.materialized(spark, SF001, "three-parts", lambda: spark.range(30).repartition(3))
    assert len(back.inputFiles()) == 3 and back.count() == 30


def test_only_card_rows_meet_their_tables(spark, q):
    tree = q["statement_rows_card_cell"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("Join Inner") < tree.index("RLIKE")


def test_trimming_needs_no_pattern(spark):
    from pyspark.sql import functions as F

    from ledgerlens.functions.text import WHITE_SPACE, strip_ws

    texts = [a + "x" + inner + "y" + b for a in (*WHITE_SPACE, "", "​") for inner in ("", " \n ") for b in (*WHITE_SPACE, "\r\n", "\x1c")] + ["", "　 \n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tree = df.select(strip_ws("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in tree.lower()
    assert df.filter(~strip_ws("t").eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_failing_date_formats_are_not_tried(spark):
    from ledgerlens import constants as K
    from ledgerlens.functions import parsing as P
    from pyspark.sql import functions as F

    texts = ["1/2/1998", "01/02/98", "1-2-1998", "31-12-69", "3 May 1998", "03  may  1998", "4 September 1999", "4 Sep 1999", "4 SEP 99", "31/02/1998",
             "1998-02-01", "", "x", "1/2/19999", "1/2/998", "1/2/+19999", "1-2--1998", "1/2-98", "1 2 1998", "5 Sept 2001", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = F.coalesce(*[F.try_to_date(F.regexp_replace("t", r"\s+", " ") if " " in f else F.col("t"), f) for f in K.DATE_FORMATS])
    rows = df.select("t", P.parse_date("t").isNull().alias("got"), bare.isNull().alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == []
    tried = [P._may_match(F.lit("4 Sep 1999"), f) for f in K.DATE_FORMATS]
    assert list(spark.range(1).select(*tried).first()) == [False, False, False, False, True, True]


def test_copies_are_counted_without_their_text(spark):
    from pyspark.sql import functions as F

    from ledgerlens.plans.pipelines import resolve_copies

    rows = [("debit", "a", 1, "x", "failed"), ("debit", "a", 2, "y", "parsed"), ("debit", "a", 3, "z", "failed"), ("debit", "a", 2, "y", "parsed"),
            ("debit", "b", 1, "x", "failed"), ("debit", "c", 1, "x", "parsed"), ("debit", "c", 1, "x", "failed_too"), ("debit", None, 1, "x", "parsed"),
            ("debit", "d", 5, "x", "parsed"), ("debit", "d", 6, "w", "parsed")]
    parsed = spark.createDataFrame(rows, "txn_type string, source string, msg_ts long, raw_text string, status string")
    store = spark.createDataFrame([("debit", "c"), ("debit", "c")], "txn_type string, source string")
    keys, order = ["txn_type", "source"], [F.col("msg_ts"), F.col("raw_text")]
    saved, counts = resolve_copies(parsed, store, keys, order, F.col("status") == "parsed")
    assert sorted((r.source, r.msg_ts) for r in saved.collect()) == [("a", 2), ("d", 5)]
    assert [tuple(r) for r in counts([]).collect()] == [(2, 5, 3)]  # a: 1 before its first; b; the null key
    assert [tuple(r) for r in resolve_copies(parsed, store, keys, order)[1](["txn_type"]).collect()] == [("debit", 3, 6, 1)]
    tree = counts([])._jdf.queryExecution().optimizedPlan().toString()
    alone = resolve_copies(parsed.filter("source = 'd'"), store, keys, order)[1]([])._jdf.queryExecution().optimizedPlan().toString()
    assert "_ord" in tree and "_ord" not in alone  # texts are put in order only where failed and parsed copies meet
