"""Golden rows and invariants for the operators (rules, statements,
questions, search, store, pipelines, stream)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from ledgerlens.functions import parsing as P
from ledgerlens.operators import questions as QA
from ledgerlens.operators import rules as RU
from ledgerlens.operators import search as V
from ledgerlens.operators import statements as SM
from ledgerlens.operators import store as ST
from ledgerlens.plans import pipelines as PL
from ledgerlens.schemas import MERCHANT_MAPPING, STATEMENT_TABLE, STATEMENT_TEXT

RULES = [
    (1, "swiggy instamart", "Swiggy Instamart", "Food", "Grocery Delivery", 10),
    (2, "swiggy", "Swiggy", "Food", "Food Delivery", 0),
    (3, "ajio", "Ajio", "Shopping", "Fashion", 0),
    (4, "jio", "Jio", "Bills", "Telecom", 0),
    (5, "uber", "Uber", "Transport", "Ride Hailing", 0),
    (6, "mystery", "Mystery", "Other", "Misc", 0),
]


@pytest.fixture(scope="module")
def mappings(spark):
    return spark.createDataFrame([r + (None, None) for r in RULES], MERCHANT_MAPPING)


def _txns(spark, merchants):
    return spark.createDataFrame([(m, None, None) for m in merchants],
                                 "merchant string, category string, sub_category string")


def test_first_match_vs_fold(spark, mappings):
    tx = _txns(spark, ["swiggy instamart", "ajio", "Ola Cabs", None, "mystery amazon"])
    first = {r.merchant: (r.category, r.sub_category) for r in RU.categorize(tx, mappings).collect()}
    assert first["Swiggy Instamart"] == ("Food", "Grocery Delivery")
    assert first["Ajio"] == ("Shopping", "Fashion")
    assert first["Ola Cabs"] == ("Transport", "Ride Hailing")          # built-in map, 'ola'
    assert first[None] == ("Other", "")
    # a mapping with category 'Other' keeps its name but falls to the built-in map
    assert first["Mystery"] == ("Shopping", "Online Shopping")
    fold = {r.merchant: (r.category, len(r.hits)) for r in RU.apply_mappings(tx, mappings).collect()}
    assert fold["Swiggy"] == ("Food", 2)
    assert fold["Jio"] == ("Bills", 2)


def test_many_rules_and_odd_patterns(spark):
    """One plan for any number of rules; a backslash before a plain letter is that letter."""
    rules = [(i, f"shop{i:05d}x", f"Shop {i}", "Shopping", "", 0, None, None) for i in range(6000)]
    rules += [(7001, "a\\bc", "Abc", "Food", "", 9, None, None), (7002, "50\\%", "Half", "Food", "", 9, None, None)]
    maps = spark.createDataFrame(rules, MERCHANT_MAPPING)
    tx = _txns(spark, ["my shop04999x!", "shop05998x shop00001x", "xabcx", "50% off", "505 off"])
    fold = {r.merchant: len(r.hits) for r in RU.apply_mappings(tx, maps).collect()}
    assert fold == {"Shop 4999": 1, "Shop 5998": 1, "Abc": 1, "Half": 1, "505 off": 0} or fold["Shop 1"] == 1
    first = sorted(r.merchant for r in RU.apply_mappings(tx, maps, first_match_only=True).collect())
    assert "Shop 4999" in first and "Shop 1" in first and "50% off" in first


def test_apply_report_total_equals_hits(spark, mappings):
    tx = _txns(spark, ["swiggy instamart", "ajio", "ajio", "uber"])
    rep = RU.apply_report(tx, tx.limit(0), mappings).collect()
    hits = RU.apply_mappings(tx, mappings).select(F.sum(F.size("hits"))).first()[0]
    assert sum(r.expenses for r in rep) == hits == 7


def test_interpret_question(spark):
    df = spark.createDataFrame([("swiggy last week",), ("food this month",), ("yesterday",)], "t string")
    rows = df.select(QA.interpret_question("t", "2024-03-10 15:00:00").alias("f")).select("f.*").collect()
    assert rows[0].merchant == "week" and rows[0].start_date == dt.datetime(2024, 3, 3, 15, 0)
    assert rows[1].merchant == "month" and rows[1].category == "food"
    assert rows[2].merchant is None and rows[2].start_date == dt.datetime(2024, 3, 9)
    assert rows[2].end_date == dt.datetime(2024, 3, 10)


def test_answer_questions_paths_agree(spark):
    exp = spark.createDataFrame(
        [("Swiggy Food", "food", "UPI", dt.datetime(2024, 3, 9, 12), Decimal("10.00")),
         ("Uber", "transport", "CARD", dt.datetime(2024, 3, 9, 13), Decimal("5.00")),
         ("50% off", "food", "UPI", dt.datetime(2024, 3, 9, 14), Decimal("7.00"))],
        "merchant string, category string, payment_method string, txn_date timestamp_ntz, amount decimal(12,2)")
    qs = spark.createDataFrame([(1, "spent on swiggy"), (2, "yesterday"), (3, "food upi 50%"), (4, "nothing xyz")],
                               "question_id long, text string")
    got = {r.question_id: r.total for r in QA.answer_questions(qs, exp, "2024-03-10 09:00:00").collect()}
    assert got == {1: Decimal("10.00"), 2: Decimal("22.00"), 3: Decimal("7.00"), 4: Decimal("0.00")}


def test_guarded_sql(spark):
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("t_guard")
    assert QA.guarded_sql(spark, "```sql\nSELECT x FROM t_guard\n```").collect()[0].x == 1
    with pytest.raises(QA.UnsafeQuery):
        QA.guarded_sql(spark, "select updated_at from t_guard")


def test_suggest_pattern_and_candidates(spark):
    df = spark.createDataFrame([("Paid to SWIGGY ORDER via UPI", "Swiggy Foods"),
                                ("spent at big bazaar", "Big Bazaar")], "t string, l string")
    got = [r[0] for r in df.select(QA.suggest_pattern("t", "l")).collect()]
    assert got == ["swiggy", "big bazaar"]
    cands = df.select(QA.pattern_candidates("t")).first()[0]
    # the payment phrase is greedy (up to 40 chars); the upper-case run
    # follows; 'UPI' alone is a noise word
    assert cands == ["swiggy order via upi", "swiggy order"]


def test_statement_formats_and_rows(spark):
    tables = spark.createDataFrame([
        ("d1", 0, 0, ["Txn Date", "Value Date", "Description", "Ref No", "Debit", "Credit", "Balance"]),
        ("d1", 0, 1, ["05/01/2024", "05/01/2024", "SWIGGY 123456789", "R1", "250.00", "", "9,000.00"]),
        ("d1", 0, 2, ["06/01/2024", "06/01/2024", "SALARY", "R2", "", "50,000.00", ""]),
        ("d1", 0, 3, ["Total", "", "", "", "", "", ""]),
        ("d2", 0, 0, ["Date & Time Transaction Description Amount"]),
        ("d2", 0, 1, ["05/01/2024| 10:30 AMAZON PAY + C 1,234.50 l"]),
    ], STATEMENT_TABLE)
    fm = {r.doc: r.format for r in SM.detect_statement_format(tables, None).collect()}
    assert fm == {"d1": "sbi", "d2": "card_cell"}
    formats = SM.detect_statement_format(tables, None)
    rows = sorted((r.merchant, r.amount, r.txn_type) for r in SM.statement_rows_multicol(tables, formats).collect())
    assert rows == [("SALARY", Decimal("50000.00"), "credit"), ("SWIGGY", Decimal("250.00"), "debit")]
    cc = SM.statement_rows_card_cell(tables, formats).first()
    assert (cc.merchant, cc.amount, cc.txn_type) == ("AMAZON PAY", Decimal("1234.50"), "credit")


def test_card_text_year_rollover_and_installments(spark):
    text = "\n".join([
        "American Express", "Membership Number XXXX", "Statement period from December 10 to", "January 9",
        "Statement date 09/01/2025",
        "December 15 NETFLIX MUMBAI 649.00", "January 3 IKEA INDIA PVT LTD~~~~~ 1,200.00",
        "January 3 IKEA INDIA PVT LTD~~~~~ 1,200.00", "January 5 PAYMENT RECEIVED THANK YOU 5,000.00",
        "Installment Plan Transactions", "January 6 FINANCE CHARGES 10.00", "January 7 INSTALLMENT PRINCIPAL 2/6 100.00",
        "January 8 INSURANCE COVER 50.00",
    ])
    pages = spark.createDataFrame([("a1", 1, text)], STATEMENT_TEXT)
    formats = SM.detect_statement_format(None, pages)
    rows = sorted((r.txn_date.date(), r.merchant, r.txn_type)
                  for r in SM.statement_lines_card_text(pages, formats, 2030).collect())
    assert rows == [
        (dt.date(2024, 12, 15), "NETFLIX", "debit"),
        (dt.date(2025, 1, 3), "IKEA INDIA", "debit"),
        (dt.date(2025, 1, 5), "PAYMENT RECEIVED THANK YOU", "credit"),
        (dt.date(2025, 1, 8), "INSURANCE COVER", "debit"),
    ]


def test_semantic_search_matches_numpy(spark):
    import numpy as np

    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = emb.orderBy("vec_id").collect()
    q = rows[3].embedding
    got = [r.vec_id for r in V.semantic_search(emb, q, tie_cols=["vec_id"]).collect()]
    mat = np.array([r.embedding for r in rows], dtype=np.float64)
    d = np.sqrt(((mat - np.array(q, dtype=np.float64)) ** 2).sum(axis=1))
    want = [rows[i].vec_id for i in np.lexsort(([r.vec_id for r in rows], d))[:5]]
    assert got == want
    batch = V.semantic_search_batch(emb, spark.createDataFrame([(7, [float(x) for x in q])],
                                                               "query_id long, query_vec array<double>"))
    assert [r.vec_id for r in batch.orderBy("rank").collect()] == want


def test_dedup_against_store(spark):
    batch = spark.createDataFrame([("debit", "s1", 2), ("debit", "s1", 1), ("credit", "s1", 3), ("debit", "s2", 4)],
                                  "txn_type string, source string, n int")
    store = spark.createDataFrame([("debit", "s2")], "txn_type string, source string")
    got = sorted(tuple(r) for r in ST.dedup_against_store(batch, store, order=[F.col("n")]).collect())
    assert got == [("credit", "s1", 3), ("debit", "s1", 1)]


def test_upsert_last_duplicate_wins(spark):
    ex = spark.createDataFrame([(1, "swiggy", "Swiggy", "Food", "", 0, None, None)], MERCHANT_MAPPING)
    inc = spark.createDataFrame([(" SWIGGY ", "Swiggy One", "Food", "", 1, 1), ("zomato", "Z", "Food", None, None, 2),
                                 ("zomato", "Zomato", "Food", "", 3, 3)],
                                "raw_pattern string, clean_name string, category string, sub_category string, "
                                "priority int, line_no long")
    got = {r.raw_pattern: (r.id, r.clean_name, r.priority)
           for r in ST.upsert_mappings(ex, inc, "2024-01-01 00:00:00").collect()}
    assert got == {"swiggy": (1, "Swiggy One", 1), "zomato": (2, "Zomato", 3)}


def test_alert_pipeline_rerun_saves_nothing(spark, tmp_path):
    from ledgerlens.plans import pipelines as PL
    from ledgerlens.sources import tables as S

    pay = S.mail_payloads(spark, SF001)
    empty = spark.createDataFrame([], "txn_type string, source string")
    first = PL.alert_pipeline(pay, empty, None, created_at="2024-01-01 00:00:00")
    s = first.summary.first()
    n_msgs = S.mail_payloads(spark, SF001).count()
    n_txn = __import__("ledgerlens.sources.mail", fromlist=["x"]).message_records(pay).count()
    assert s.saved + s.skipped + s.failed == n_txn <= n_msgs
    path = str(tmp_path / "store")
    ST.append_transactions(first.saved, path)
    second = PL.alert_pipeline(pay, ST.read_store(spark, path), None, created_at="2024-01-01 00:00:00")
    assert second.saved.count() == 0
    assert second.summary.first().saved == 0


def test_query_blocks_are_exact(spark, monkeypatch):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    queries = V.centroids(emb, "label").withColumnRenamed("label", "query_id")
    one = sorted(tuple(r) for r in V.semantic_search_batch(emb, queries).collect())
    monkeypatch.setattr("ledgerlens.operators.vector_index.QUERY_BLOCK", 1)
    many = sorted(tuple(r) for r in V.semantic_search_batch(emb, queries).collect())
    assert one == many and len(one) > 0


def test_answers_equal_row_by_row_filters(spark):
    """Totals against plain Python over every kind of filter, wildcard words and backslashes included."""
    days = [dt.datetime(2024, 3, 10, 8), dt.datetime(2024, 3, 9, 12), dt.datetime(2024, 3, 5), dt.datetime(2024, 2, 20), dt.datetime(2023, 1, 1), None]
    rows = [(m, c, p, d, Decimal(1 + i)) for i, (m, c, p, d) in enumerate(
        (m, c, p, d) for m in ("Swiggy Food", "a_b 50%", "a\\c", None) for c in ("food", "Shopping", None) for p in ("UPI", "", None) for d in days)]
    exp = spark.createDataFrame(rows, "merchant string, category string, payment_method string, txn_date timestamp_ntz, amount decimal(12,2)")
    texts = ["yesterday", "today", "x", "food", "upi", "spent on swiggy", "food last week swiggy", "upi month a_b", "what 50%", "show %", "show __", "find a\\c",
             "find a\\\\c", "shopping today swiggy", "find q\\", "", "spent on swiggy"]
    qs = spark.createDataFrame(list(enumerate(texts)), "question_id long, text string")
    got = {r.question_id: r for r in QA.answer_questions(qs, exp, "2024-03-10 09:00:00").collect()}
    assert len(got) == len(texts)

    def like(value, word):
        import re
        out, i = "", 0
        word = "%" + word + "%"
        while i < len(word):
            if word[i] == "\\" and i + 1 < len(word):
                i += 1
                out += re.escape(word[i])
            else:
                out += {"%": ".*", "_": "."}.get(word[i], re.escape(word[i]))
            i += 1
        return re.fullmatch(out, value.lower(), re.S) is not None

    for i, r in got.items():
        total = sum(a for m, c, p, d, a in rows
                    if (r.merchant is None or m is not None and like(m, r.merchant)) and (r.category is None or c is not None and r.category in c.lower())
                    and (r.payment_method is None or p is not None and "upi" in p.lower())
                    and (r.start_date is None or d is not None and d >= r.start_date) and (r.end_date is None or d is not None and d <= r.end_date))
        assert r.total == total, texts[i]


def test_end_month_across_blank_lines_and_pages(spark):
    pages = spark.createDataFrame([
        ("b1", 1, "Statement period from November 10 to\n   \n\nDecember 9"),
        ("b2", 1, "Statement date 09/01/2025\nperiod from December 10 to"),
        ("b2", 2, "  January 9\nJanuary 3 SHOP 10.00"),
        ("b3", 1, "from May 1 to June 1"),
        ("b4", 1, "statement from December 5 to"), ("b4", 2, "  \n "), ("b4", 3, None), ("b4", 5, "January 4"),
        ("b5", 1, "period to March 3, valid to"), ("b5", 2, "May 1"),
    ], STATEMENT_TEXT)
    facts = {r.doc: (r.year, r.end_month) for r in SM.statement_facts(pages, 2030).collect()}
    assert facts == {"b1": (2030, 12), "b2": (2025, 1), "b3": (2030, 6), "b4": (2030, 1), "b5": (2030, 3)}


def test_single_scan_forms_equal_two_table_forms(spark, mappings):
    from ledgerlens.plans import reports as R
    from ledgerlens.sources import tables as S

    e, c, a = S.expenses(spark, SF001), S.credits(spark, SF001), S.all_transactions(spark, SF001)

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    assert rows(R.income_vs_expense(e, c)) == rows(R.income_vs_expense_labelled(a))
    assert rows(R.review_backlog(e, c).select("source", "table_name")) == \
        rows(R.review_backlog_labelled(a).select("source", "table_name"))
    assert rows(RU.apply_report(e, c, mappings)) == rows(RU.apply_report_labelled(a, mappings))


# --- input that is not what it should be -------------------------------------------------------

def test_unreadable_mail_fails_alone(spark):
    import base64

    from ledgerlens.schemas import RAW_PAYLOAD
    from ledgerlens.sources.mail import message_records

    enc = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
    good = "Rs.500.00 debited from a/c XX1 at SHOP on 01/02/2024"
    html = "<html><p>Rs&#46;70.00 debited from a/c XX1 at CAF&#xC9;&rsquo;S on 01/02/2024 &amp;lt; &#0;</p></html>"
    rows = [(i, 1706745600000 + k, ["INBOX"], {"headers": [{"name": "From", "value": "x"}], "parts": [], "body": {"data": d}})
            for k, (i, d) in enumerate([("ok", enc(good)), ("bad", "%%%not base64%%%"), ("cut", "abcde"), ("html", enc(html)), ("none", None)])]
    pay = spark.createDataFrame(rows, RAW_PAYLOAD)
    text = {r.message_id: r.raw_text for r in message_records(pay, keep_all=True).collect()}
    assert text["ok"] == good and text["bad"] is None and text["cut"] is None and text["none"] == ""
    assert text["html"] == "Rs.70.00 debited from a/c XX1 at CAF\u00c9\u2019S on 01/02/2024 &lt; \ufffd"
    run = PL.alert_pipeline(pay, spark.createDataFrame([], "txn_type string, source string"), None, created_at="2024-01-01 00:00:00")
    s = run.summary.first()
    assert (s.saved, s.failed) == (2, 2)


def test_a_body_is_decoded_once(spark):
    from ledgerlens.plans import catalog as C

    plan = C.QUERIES["message_records"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("unbase64(") <= 2  # one for parts, one for the body


def test_white_space_is_unicode(spark):
    from ledgerlens.functions.merchant import clean_merchant
    from ledgerlens.functions.text import strip_ws

    df = spark.createDataFrame([("\u00a0 SWIGGY MUMBAI\u00a0",)], "t string")
    r = df.select(strip_ws("t").alias("s"), clean_merchant("t").alias("m")).first()
    assert r.s == "SWIGGY MUMBAI" and r.m == "SWIGGY"


def test_documents_without_a_first_row_are_unknown(spark):
    tables = spark.createDataFrame([("d1", 0, 0, []), ("d1", 0, 1, ["x"]), ("d2", 0, 1, ["x"]), ("d3", 0, 0, None)], STATEMENT_TABLE)
    pages = spark.createDataFrame([("p1", 1, "  "), ("p2", 1, None)], STATEMENT_TEXT)
    got = {r.doc: r.format for r in SM.detect_statement_format(tables, pages).collect()}
    assert got == dict.fromkeys(("d1", "d2", "d3", "p1", "p2"), "unknown")
    assert SM.statement_rows_card_cell(tables, SM.detect_statement_format(tables, None)).count() == 0


def test_mapping_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('# rules\n"# quoted",x\nraw_pattern,clean_name,category,priority\nSwiggy,Swiggy,Food,3\n\n'
                                    'ola,"Ola\nCabs",Transport,\n,No,Food,1\nbad,Bad,Food,x\n')
    (tmp_path / "b.csv").write_text("clean_name,raw_pattern,category\r\nUber,UBER,Transport\r\n")
    rows = {r.raw_pattern: r for r in ST.read_mapping_csv(spark, str(tmp_path)).collect()}
    assert {k: (r.clean_name, r.priority, r.status) for k, r in rows.items()} == {
        "swiggy": ("Swiggy", 3, "ok"), "ola": ("Ola\nCabs", None, "skipped_priority"), "": ("No", 1, "skipped_missing"),
        "bad": ("Bad", None, "skipped_priority"), "uber": ("Uber", 0, "ok")}
    have = spark.createDataFrame([("uber",)], "raw_pattern string")
    assert tuple(ST.import_report(ST.read_mapping_csv(spark, str(tmp_path)), have).first()) == (1, 1, 3)


def test_overrides_never_multiply_rows(spark, mappings):
    from ledgerlens.plans.extensions import apply_category_overrides

    ov = spark.createDataFrame([("Ajio", "A", ""), ("ajio", "B", "b")], "merchant string, category string, sub_category string")
    assert [(r.category, r.sub_category) for r in apply_category_overrides(_txns(spark, ["ajio"]), ov, mappings).collect()] == [("B", "b")]


# --- versioned tables, guard, routed answers -----------------------------------------------------

def test_versions_swap_whole_and_settle(spark, tmp_path, mappings):
    path = str(tmp_path / "mappings")
    ST.save_version(mappings, path)
    batch = spark.createDataFrame([("New One", "New", "Food", "", 1, 0), ("swiggy", "Swiggy!", "Food", "", 1, 1), ("next one", "N", "Food", "", 1, 2)],
                                  "raw_pattern string, clean_name string, category string, sub_category string, priority int, line_no int")
    change = lambda t: ST.upsert_mappings(t, batch, "2024-01-01 00:00:00")
    assert ST.change_table(spark, path, change) == 2
    once = sorted(ST.read_version(spark, path).collect(), key=repr)
    assert ST.change_table(spark, path, change) == 3
    assert sorted(ST.read_version(spark, path).collect(), key=repr) == once
    top = mappings.agg(F.max("id")).first()[0]
    assert {r.raw_pattern: r.id for r in once if r.id > top} == {"new one": top + 1, "next one": top + 2}
    assert ST.read_version(spark, path, 1).count() == mappings.count()
    # An uncommitted version (a job that died) is not seen, and written over.
    mappings.limit(1).write.parquet(f"{path}/data/version=4")
    assert ST.read_version(spark, path).count() == len(once)
    assert ST.change_table(spark, path, lambda t: ST.delete_mapping(t, "NEW ONE ")[0]) == 4
    assert ST.read_version(spark, path).count() == len(once) - 1


def test_guard_reads_views_only(spark, tmp_path):
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("t_guard2")
    (tmp_path / "secret.txt").write_text("secret")
    for q in (f"select * from text.`{tmp_path}/secret.txt`", "select reflect('java.lang.System', 'getProperty', 'user.home')",
              "select java_method('java.lang.System', 'getProperty', 'user.home') from t_guard2", "select * from nowhere"):
        with pytest.raises(QA.UnsafeQuery):
            QA.guarded_sql(spark, q).collect()
    assert QA.guarded_sql(spark, "select x from t_guard2").first().x == 1


def test_each_question_is_answered_by_its_path(spark):
    exp = spark.createDataFrame([("s1", "Swiggy", "food", "UPI", "swiggy dinner order", dt.datetime(2024, 3, 9), Decimal("5.00")),
                                 ("s2", "Uber", "transport", "CARD", "uber airport ride", dt.datetime(2024, 3, 9), Decimal("7.00"))],
                                "source string, merchant string, category string, payment_method string, raw_text string, txn_date timestamp_ntz, amount decimal(12,2)")
    qs = spark.createDataFrame([(1, "how much was spent on swiggy"), (2, "uber airport ride")], "question_id long, text string")
    got = {r.question_id: r for r in QA.answer_routed(qs, exp, "2024-03-10 09:00:00", k=1).collect()}
    assert (got[1].route, got[1].total, got[1].matches) == ("sql", Decimal("5.00"), None)
    assert (got[2].route, got[2].total, got[2].matches) == ("semantic", None, ["s2"])


def test_registered_questions_are_answered_by_their_path(spark):
    """Every user question has its label's answer: the total that J6 gives, or the nearest transactions."""
    from ledgerlens.plans import catalog as C

    got = {r.question_id: r for r in C.QUERIES["answer_routed"](spark, SF001).collect()}
    assert {i: r.route for i, r in got.items()} == {r.question_id: r.route for r in C.QUERIES["route_questions"](spark, SF001).collect()}
    totals = {r.question_id: r.total for r in C.QUERIES["answer_questions"](spark, SF001).collect()}
    sources = {r.source for r in C._exp(spark, SF001).select("source").collect()}
    assert {r.route for r in got.values()} == {"sql", "semantic"}
    for i, r in got.items():
        if r.route == "sql":
            assert r.total == totals[i] and r.matches is None
        else:
            assert r.total is None and len(set(r.matches)) == 5 and set(r.matches) <= sources


def test_bound_rows_reach_every_rule(spark):
    """No registered query passes because its rule never fires."""
    from ledgerlens.plans import catalog as C

    q = {n: C.QUERIES[n](spark, SF001) for n in ("is_transaction_message", "is_safe_select", "route_questions", "interpret_question", "bad_rows")}
    assert q["is_transaction_message"].filter("is_txn").count() > 0 and q["is_safe_select"].filter("safe").count() > 0
    assert q["route_questions"].select("route").distinct().count() == 2 and q["bad_rows"].count() > 0
    i = q["interpret_question"].agg(*[F.count(c) for c in ("start_date", "end_date", "category", "payment_method")]).first()
    assert all(i)
    assert C.QUERIES["recurring_payments"](spark, SF01).filter("is_recurring").count() > 0
    assert C.QUERIES["answer_questions"](spark, SF001).filter("total > 0").count() > 0
    assert C.QUERIES["redact_pii"](spark, SF001).filter("text like '%Ref#[REDACTED]%' and text like '%REDACTED_CARD%' and text like '%REDACTED_PIN%'").count() > 0


def test_mapping_csv_of_any_width(spark, tmp_path):
    """The named columns of a 40-column file are found wherever they stand, beside a narrow file."""
    names = [f"extra{i}" for i in range(40)]
    names[3], names[17], names[25], names[39] = "raw_pattern", "category", "priority", "clean_name"
    values = [f"x{i}" for i in range(40)]
    values[3], values[17], values[25], values[39] = "SWIGGY", '"Food, out"', "7", '"Swiggy\nOne"'
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(values) + "\n")
    (tmp_path / "b.csv").write_text("raw_pattern,clean_name,category\nuber,Uber,Transport\n")
    got = sorted(tuple(r) for r in ST.read_mapping_csv(spark, str(tmp_path)).select("raw_pattern", "clean_name", "category", "priority", "status").collect())
    assert got == [("swiggy", "Swiggy\nOne", "Food, out", 7, "ok"), ("uber", "Uber", "Transport", 0, "ok")]


# --- file-level copy-on-write, commits of several writers ----------------------------------------

def _files(spark, path):
    return {r.file for r in ST.version_files(spark, path).collect()}


def test_only_files_with_changed_rows_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, f"s{i:03d}", Decimal(i), "Shop") for i in range(200)]
    rows[150] = (150, "s150", Decimal("99999999"), "Shop")
    df = spark.createDataFrame(rows, "n int, source string, amount decimal(12,2), merchant string").repartitionByRange(8, "n")
    assert ST.save_version(df, path) == 1
    before = _files(spark, path)
    assert len(before) == 8
    done = ST.delete_bad_from_table(spark, path)
    after = _files(spark, path)
    assert (done.version, done.rewritten, done.kept) == (2, 1, 7) and len(before & after) == 7
    assert sorted(r.n for r in ST.read_version(spark, path).collect()) == [i for i in range(200) if i != 150]
    assert ST.read_version(spark, path, 1).count() == 200
    assert ST.delete_bad_from_table(spark, path).version == 2  # nothing to change: no version
    # a change that leaves no row keeps the schema, and the table can grow again
    ST.change_files(spark, path, lambda t: t, lambda r, _: r.limit(0))
    assert ST.read_version(spark, path).columns == ["n", "source", "amount", "merchant"] and ST.read_version(spark, path).count() == 0
    ST.change_files(spark, path, lambda t: t.limit(0), lambda r, _: r.unionByName(df.limit(3)))
    assert ST.read_version(spark, path).count() == 3


def test_reclean_rewrites_files_with_stale_merchants(spark, tmp_path):
    path = str(tmp_path / "t")
    names = ["Shop"] * 40 + ["swiggy@ybl", None, "", "12345"]
    df = spark.createDataFrame(list(enumerate(names)), "n int, merchant string").repartitionByRange(6, "n")
    clean = sorted((r.n, r.merchant) for r in ST.reclean_existing(df).collect())
    ST.save_version(df, path)
    done = ST.reclean_table(spark, path)
    assert 0 < done.rewritten < 6 and done.rewritten + done.kept == 6
    assert sorted((r.n, r.merchant) for r in ST.read_version(spark, path).collect()) == clean
    assert ST.reclean_table(spark, path).version == done.version  # settled


def test_of_two_writers_none_loses_its_update(spark, tmp_path, mappings):
    """A second writer commits while the first one works: the first repeats its change on the newer version."""
    path = str(tmp_path / "m")
    ST.save_version(mappings.repartition(4), path)
    batch = spark.createDataFrame([("first", "First", "A", "", 1, 0)], "raw_pattern string, clean_name string, category string, sub_category string, priority int, line_no int")
    other = batch.select(F.lit("second").alias("raw_pattern"), *batch.columns[1:])
    tries = []

    def change(rows, table):
        tries.append(ST.current_version(spark, path))
        if len(tries) == 1:
            assert ST.upsert_table(spark, path, other, "2024-01-01 00:00:00").version == 2
        return ST.upsert_mappings(rows, batch, "2024-01-01 00:00:00", ids_after=table)

    keys = ["first"]
    assert ST.change_files(spark, path, lambda t: t.filter(F.col("raw_pattern").isin(keys)), change).version == 3
    assert tries == [1, 2]
    top = mappings.agg(F.max("id")).first()[0]
    got = {r.raw_pattern: r.id for r in ST.read_version(spark, path).collect()}
    assert got["second"] == top + 1 and got["first"] == top + 2 and len(got) == mappings.count() + 2
    # a whole rewrite is repeated the same way, and leaves no files of the refused try
    runs = []

    def drop(t):
        runs.append(1)
        if len(runs) == 1:
            ST.delete_from_table(spark, path, "second")
        return t.filter("raw_pattern <> 'first'")

    assert ST.change_table(spark, path, drop) == 5 and len(runs) == 2
    assert {r.raw_pattern for r in ST.read_version(spark, path).collect()} == set(got) - {"first", "second"}
    assert len(list((tmp_path / "m" / "data").iterdir())) == len(list((tmp_path / "m" / "manifests").iterdir())) == 5


# --- patterns ranked over a backlog, ids ------------------------------------------------------------

def test_ranked_patterns_are_the_greedy_cover(spark, monkeypatch):
    """Equal to a plain greedy cover over all candidates, also when the first few patterns don't suffice."""
    import random

    draw = random.Random(5)
    sets = [sorted(draw.sample([f"p{i:02d}" for i in range(40)], draw.randint(0, 4))) for _ in range(300)]
    monkeypatch.setattr(QA, "pattern_candidates", lambda c: F.filter(F.split(c, ","), lambda p: p != ""))
    df = spark.createDataFrame([(",".join(s),) for s in sets], "raw_text string").repartition(3)
    for n in (1, 2, 60):
        want, open_ = [], [s for s in sets if s]
        while open_ and len(want) < n:
            gain = {p: sum(p in s for s in open_) for s in open_ for p in s}
            best = min(gain, key=lambda p: (-gain[p], p))
            want.append((len(want) + 1, best, sum(best in s for s in sets), gain[best]))
            open_ = [s for s in open_ if best not in s]
        assert sorted(tuple(r) for r in QA.rank_patterns(df, n=n).collect()) == want
    assert QA.rank_patterns(df.limit(0), n=3).count() == 0


def test_store_ids_come_from_the_key(spark):
    rows = spark.createDataFrame([("debit", "a"), ("credit", "a"), ("debit", "b"), ("debit", None), ("debit", None)], "txn_type string, source string")
    once, again = ({(r.txn_type, r.source): r.id for r in ST.to_store_rows(rows).filter("source is not null").collect()} for _ in range(2))
    assert once == again and len(set(once.values())) == 3 and all(len(i) == 36 for i in once.values())
    assert len({r.id for r in ST.to_store_rows(rows).collect()}) == 5


def test_review_pages_are_those_of_the_sorted_backlog(spark, tmp_path):
    """Every page, also over range borders and with a third of the rows equal, reads only the ranges it needs."""
    from ledgerlens.plans import reports as R

    rows = [("expenses" if i % 3 else "credits", f"s{i // 2}", dt.datetime(2024, 1, 1 + i % 28) if i % 5 else None, Decimal(i), None if i % 2 else "M",
             "Other" if i % 4 else None, "", "UPI", "B") for i in range(60)] + [("expenses", "same", dt.datetime(2024, 2, 1), Decimal(1), None, "Other", "", "UPI", "B")] * 30
    df = spark.createDataFrame(rows, "table_name string, source string, txn_date timestamp_ntz, amount decimal(12,2), merchant string, category string, "
                                     "sub_category string, payment_method string, bank_name string").repartition(4)
    path = str(tmp_path / "pages")
    R.write_review_pages(df, path)
    want = [tuple(r) for r in R.review_backlog_labelled(df).collect()]
    pages = -(-len(want) // 7)
    got = [[tuple(r) for r in R.read_review_page(spark, path, p, 7).select(*df.columns).collect()] for p in (1, 4, pages, pages + 1)]
    assert got == [want[(p - 1) * 7:p * 7] for p in (1, 4, pages, pages + 1)] and got[3] == [] and got[2]
    opened = {f.split("_range=")[1].split("/")[0] for f in R.read_review_page(spark, path, 4, 7).inputFiles()}
    assert 1 <= len(opened) <= 2 < spark.read.parquet(f"{path}/sizes").count()
    R.write_review_pages(df.limit(0), str(tmp_path / "none"))
    assert R.read_review_page(spark, str(tmp_path / "none"), 1).count() == 0


# --- costly expressions are evaluated once a row ----------------------------------------------------

def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_statement_rows_are_parsed_once(spark):
    """A filter on parsed dates and amounts isn't pushed below their computation, which would parse twice."""
    t = spark.createDataFrame([("d", 0, 0, ["a"])], "doc string, table_no int, row_no long, cells array<string>")
    p = spark.createDataFrame([("d", 0, "x")], "doc string, page_no long, text string")
    f = spark.createDataFrame([("d", "axis", 0)], "doc string, format string, start_table int")
    for df in (SM.statement_rows_multicol(t, f), SM.statement_rows_card_cell(t, f)):
        assert _optimized(df).count("d MMMM yyyy") == 1
    assert _optimized(SM.statement_lines_card_text(p, f, 1998)).count("make_timestamp") == 1


def test_pattern_candidates_are_found_once(spark, monkeypatch):
    plans, real = [], QA.stage
    monkeypatch.setattr(QA, "stage", lambda df: (plans.append(_optimized(df)), real(df))[1])
    df = spark.createDataFrame([("Payment to Foo Bar",)], "raw_text string").repartition(2)
    assert [r.pattern for r in QA.rank_patterns(df, n=2).collect()] == ["foo bar"]
    assert plans[0].count("paid to|payment to|at|for merchant") == 1


def test_message_text_is_lowered_once(spark):
    from ledgerlens.sources import mail as ML

    pay = spark.createDataFrame([], "id string, internalDate long, payload struct<headers:array<struct<name:string,value:string>>,"
                                    "parts:array<struct<mimeType:string,body:struct<data:string>>>,body:struct<data:string>>")
    assert _optimized(ML.message_records(pay)).count("lower(raw_text") == 1


def test_dates_and_amounts_that_no_format_can_have(spark):
    """The tests that spare a failing parse let everything through that parses."""
    dates = {"5/9/1996": 1996, "05-09-69": 1969, "05-09-68": 2068, "13 SEP 1996": 1996, "1 may 2001": 2001, "1  September\t1996": 1996, "3 Sept 1996": None,
             "Opening Balance": None, "-5/9/1996": None, "31/02/1996": None, "1996-09-05": None, "": None, "5 sep 96": None, "3 Februar 1996": None}
    got = spark.createDataFrame([(k,) for k in dates], "v string").select("v", F.year(P.parse_date("v")).alias("y")).collect()
    assert {r.v: r.y for r in got} == dates
    amounts = {"": None, " ": None, "1,234.50": Decimal("1234.50"), "\u0663": Decimal("3.00"), "1e3": Decimal("1000.00"), ".5": Decimal("0.50"), "NaN": None, "x5": None, "5x": None}
    got = spark.createDataFrame([(k,) for k in amounts], "v string").select("v", P.parse_amount("v").alias("a")).collect()
    assert {r.v: r.a for r in got} == amounts


# --- disk of the ingest pipelines -------------------------------------------------------------------

def test_staged_tables_let_their_shuffle_files_go(spark):
    import time

    from ledgerlens.session import _CLEANUP, stage_table

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: {f.getName() for f in (disk.getAllFiles().apply(i) for i in range(disk.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    before = held()
    rows = spark.range(50_000).selectExpr("id", "uuid() u").repartition(7, "u")
    assert stage_table(rows).count() == 50_000 and spark.conf.get(_CLEANUP, "false") == "false"
    for _ in range(100):
        new = held() - before
        if sum(".data" in f for f in new) <= 8:  # the count's own
            break
        time.sleep(0.1)
    shuffles = {f.split("_")[1] for f in held() - before if f.endswith(".data")}
    assert len(shuffles) <= 1


def test_saved_rows_are_shuffled_without_a_copy_of_their_order(spark):
    rows = spark.createDataFrame([("debit", "a", dt.datetime(2024, 1, 1), "x", "d2"), ("debit", "a", dt.datetime(2024, 1, 1), "x", "d1"), ("debit", "b", None, None, "d3"),
                                  ("debit", "b", None, "y", "d3"), (None, "c", None, "z", "d4"), ("credit", "k", None, "z", "d5")],
                                 "txn_type string, source string, txn_date timestamp_ntz, raw_text string, doc string").repartition(3)
    store = spark.createDataFrame([("credit", "k")], "txn_type string, source string")
    saved, counts = PL.resolve_copies(rows, store, ["txn_type", "source"], [F.col("doc"), F.col("txn_date"), F.col("raw_text")])
    assert "_ord" not in _optimized(saved)
    assert sorted((r.source, r.doc, r.raw_text) for r in saved.collect()) == [("a", "d1", "x"), ("b", "d3", None)]
    assert [tuple(r) for r in counts([]).collect()] == [(2, 3, 1)]


def test_rows_meet_few_decided_merchants_without_a_shuffle(spark):
    from ledgerlens.session import stage_table

    rows = spark.createDataFrame([("Big Shop", None, None)] * 20, "merchant string, category string, sub_category string").repartition(3)
    plain, settled = RU.categorize(rows, None), RU.categorize(rows, None, settle=stage_table)
    assert sorted(map(tuple, settled.collect())) == sorted(map(tuple, plain.collect()))
    assert "BroadcastHashJoin" in settled._jdf.queryExecution().executedPlan().toString()


def test_expenses_are_counted_once_for_all_questions(spark, tmp_path):
    """The grouped expenses feed three branches of the plan; their rows are read by one of them only, before."""
    path = str(tmp_path / "expenses")
    spark.createDataFrame([("blue shop", "Food", "UPI", dt.datetime(2024, 3, 9), Decimal("5.00"))] * 3,
                          "merchant string, category string, payment_method string, txn_date timestamp_ntz, amount decimal(12,2)").write.parquet(path)
    qs = spark.createDataFrame([(1, "total upi spend on shop"), (2, "week"), (3, "spend at nowhere")], "question_id long, text string")
    out = QA.answer_questions(qs, spark.read.parquet(path), "2024-03-10 09:00:00")
    assert {r.question_id: r.total for r in out.collect()} == {1: Decimal("15.00"), 2: Decimal("15.00"), 3: Decimal("0.00")}
    assert path not in _optimized(out) and not any(f.startswith(f"file://{path}") or path in f for f in out.inputFiles())
