"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver tables (through the bindings in
``ledgerlens.sources.tables``) so that its work grows with them.  Money
columns are returned as DOUBLE (exact: the decimal sums are converted
once, at the end) so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import merchant as M
from ledgerlens.functions import parsing as P
from ledgerlens.functions.text import strip_ws
from ledgerlens.operators import alerts as AL
from ledgerlens.operators import questions as QA
from ledgerlens.operators import rules as RU
from ledgerlens.operators import search as V
from ledgerlens.operators import statements as SM
from ledgerlens.operators import store as ST
from ledgerlens.plans import extensions as EX
from ledgerlens.plans import fixtures as FX
from ledgerlens.plans import pipelines as PL
from ledgerlens.plans import reports as R
from ledgerlens.plans import views as VW
from ledgerlens.schemas import BUDGET
from ledgerlens.session import scratch_path, write_table
from ledgerlens.sources import mail as ML
from ledgerlens.sources import statements as SS
from ledgerlens.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed "as of" instant for time-relative operators (the reference uses now()).
AS_OF = "1998-08-02 10:30:00"


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def as_double(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


_RENDERED: dict[tuple, str] = {}
_RENDER_FROM = ("lineitem", "orders", "part")


def _table_state(spark, sf):
    """Names, sizes and times of the files that inputs are rendered from: a listing, no rows are read."""
    listed = [spark.read.format("binaryFile").load(f"{sf.rstrip('/')}/{t}.parquet").select("path", "length", "modificationTime") for t in _RENDER_FROM]
    return tuple(tuple(r) for files in listed for r in files.orderBy("path").collect())


def materialized(spark, sf, name, build):
    """An input rendered from the driver tables: statements arrive as
    exported files, so it is written once (under the shared checkpoint
    folder), by the tasks that render it, and read back.  Changed tables are
    rendered anew."""
    key = (spark.sparkContext.applicationId, sf, name, _table_state(spark, sf))
    if key not in _RENDERED:
        path = _scratch(spark, name)
        write_table(build(), path)
        _RENDERED[key] = path
    return spark.read.parquet(_RENDERED[key])


def _scratch(spark, name):
    return scratch_path(spark, name)


def _exp(spark, sf):
    return S.expenses(spark, sf)


def _cred(spark, sf):
    return S.credits(spark, sf)


REVIEW_COLS = ["table_name", "source", "txn_date", "amount", "merchant", "category", "sub_category",
               "payment_method", "bank_name"]


# --- reports --------------------------------------------------------------------

@register("monthly_spend")
def q_monthly_spend(spark, sf):
    return as_double(R.monthly_spend(_exp(spark, sf)), "total_spent")


@register("category_spend")
def q_category_spend(spark, sf):
    return as_double(R.category_spend(_exp(spark, sf)), "total_spent")


@register("top_merchants")
def q_top_merchants(spark, sf):
    df = R.top_merchants(_exp(spark, sf))
    return df.select("merchant", F.col("total_spent").cast("double").alias("total_spent"), "txn_count",
                     F.round(F.col("avg_amount").cast("double"), 6).alias("avg_amount"))


@register("income_vs_expense")
def q_income_vs_expense(spark, sf):
    return as_double(R.income_vs_expense_labelled(S.all_transactions(spark, sf)), "expenses", "income", "net")


@register("quality_report")
def q_quality_report(spark, sf):
    return R.quality_report(S.all_transactions(spark, sf))


@register("merchant_frequency")
def q_merchant_frequency(spark, sf):
    return R.merchant_frequency(_exp(spark, sf))


@register("field_population")
def q_field_population(spark, sf):
    return R.field_population(_exp(spark, sf))


@register("category_breakdown")
def q_category_breakdown(spark, sf):
    return R.category_breakdown(_exp(spark, sf))


@register("payment_breakdown")
def q_payment_breakdown(spark, sf):
    return R.payment_breakdown(_exp(spark, sf))


@register("filtered_total")
def q_filtered_total(spark, sf):
    df = R.filtered_total(_exp(spark, sf), merchant="widget", category="small",
                          payment_method="upi", start_date="1995-01-01 00:00:00",
                          end_date="1997-12-31 00:00:00")
    return as_double(df, "total")


@register("ilike_filters")
def q_ilike_filters(spark, sf):
    df = R.ilike_filter(_exp(spark, sf), merchant="gear", category="m", start_date="1994-06-01 00:00:00")
    return as_double(df.select("source", "txn_date", "amount", "merchant", "category", "payment_method"), "amount")


@register("missing_merchant")
def q_missing_merchant(spark, sf):
    return as_double(R.missing_merchant(_all_txn(spark, sf)).select("table_name", "source", "txn_date", "amount", "merchant"), "amount")


@register("uncategorised")
def q_uncategorised(spark, sf):
    return as_double(R.uncategorised(_all_txn(spark, sf)).select("table_name", "source", "txn_date", "amount", "category"), "amount")


@register("empty_sub_category")
def q_empty_sub_category(spark, sf):
    return as_double(R.empty_sub_category(_all_txn(spark, sf)).select("table_name", "source", "txn_date", "amount", "sub_category"), "amount")


@register("review_backlog")
def q_review_backlog(spark, sf):
    return as_double(R.review_backlog_labelled(S.all_transactions(spark, sf)).select(*REVIEW_COLS), "amount")


@register("review_page")
def q_review_page(spark, sf):
    path = scratch_path(spark, "review-pages")
    R.write_review_pages(S.all_transactions(spark, sf).select(*REVIEW_COLS), path)
    return as_double(R.read_review_page(spark, path, page=4).select(*REVIEW_COLS), "amount")


@register("review_totals")
def q_review_totals(spark, sf):
    return R.review_totals_labelled(S.all_transactions(spark, sf))


@register("bad_rows")
def q_bad_rows(spark, sf):
    return as_double(R.bad_rows(_exp(spark, sf)).select("source", "amount", "merchant"), "amount")


@register("all_transactions")
def q_all_transactions(spark, sf):
    df = R.all_transactions(_exp(spark, sf), _cred(spark, sf))
    return as_double(df.select("table_name", "source", "txn_date", "amount", "merchant"), "amount")


@register("latest_records")
def q_latest_records(spark, sf):
    df = R.latest_records(_exp(spark, sf))
    return as_double(df.select("source", "created_at", "amount", "merchant", "category", "sub_category",
                               "payment_method", "bank_name"), "amount")


# --- parsers over alert text rendered from lineitem x part ----------------------------


def _alerts(spark, sf):
    """RAW_MESSAGE input: alert messages, rendered as they are read (no copy of them is dealt or written)."""
    return S.alert_messages(spark, sf)


@register("parse_alerts")
def q_parse_alerts(spark, sf):
    df = AL.parse_alerts(_alerts(spark, sf))
    return as_double(df.select("source", "status", "txn_date", "amount", "merchant", "payment_method",
                               "bank_name"), "amount")


@register("extract_amount")
def q_extract_amount(spark, sf):
    return as_double(_alerts(spark, sf).select("message_id", P.extract_amount("raw_text").alias("amount")), "amount")


@register("extract_merchant")
def q_extract_merchant(spark, sf):
    return _alerts(spark, sf).select("message_id", P.extract_merchant("raw_text").alias("merchant"))


@register("extract_vpa")
def q_extract_vpa(spark, sf):
    return _alerts(spark, sf).select("message_id", P.extract_vpa("raw_text").alias("vpa"))


@register("extract_payment_method")
def q_extract_payment_method(spark, sf):
    return _alerts(spark, sf).select("message_id", P.extract_payment_method("raw_text").alias("payment_method"))


@register("extract_txn_date")
def q_extract_txn_date(spark, sf):
    return _alerts(spark, sf).select("message_id", P.extract_txn_date("raw_text", "timestamp").alias("txn_date"))


@register("clean_merchant")
def q_clean_merchant(spark, sf):
    phrase = P.extract_merchant("raw_text")
    return _alerts(spark, sf).select("message_id", phrase.alias("phrase"), M.clean_merchant(phrase).alias("merchant"))


@register("clean_vpa")
def q_clean_vpa(spark, sf):
    vpa = P.extract_vpa("raw_text")
    return (_alerts(spark, sf).filter(vpa.isNotNull())
            .select("message_id", vpa.alias("vpa"), M.clean_vpa(vpa).alias("merchant")))


def _order_dates(spark, sf):
    """Order dates rendered in the six accepted layouts plus invalid ones."""
    o = S.read_table(spark, sf, "orders")
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 8
    text = (F.when(k == 0, F.date_format(d, "d/M/yyyy"))
            .when(k == 1, F.date_format(d, "dd-MM-yyyy"))
            .when(k == 2, F.date_format(d, "dd/MM/yy"))
            .when(k == 3, F.date_format(d, "d-M-yy"))
            .when(k == 4, F.upper(F.date_format(d, "d MMMM yyyy")))
            .when(k == 5, F.date_format(d, "dd  MMM yyyy"))
            .when(k == 6, F.concat(F.lit("31/02/"), F.date_format(d, "yyyy")))
            .otherwise(F.date_format(d, "yyyy-MM-dd")))
    return o.select("o_orderkey", text.alias("date_text"), "o_totalprice")


@register("parse_date")
def q_parse_date(spark, sf):
    df = _order_dates(spark, sf)
    return df.select("o_orderkey", "date_text", P.parse_date("date_text").alias("parsed"))


@register("parse_amount")
def q_parse_amount(spark, sf):
    o = S.read_table(spark, sf, "orders")
    k = F.col("o_orderkey") % 5
    p = F.col("o_totalprice").cast("decimal(12,2)")
    text = (F.when(k == 0, F.format_number(p, 2))
            .when(k == 1, F.concat(F.lit(" "), p.cast("string"), F.lit(" ")))
            .when(k == 2, (-p).cast("string"))
            .when(k == 3, (p * 100).cast("string"))
            .otherwise(F.concat(p.cast("string"), F.lit("x"))))
    df = o.select("o_orderkey", text.alias("amount_text"))
    return as_double(df.select("o_orderkey", "amount_text", P.parse_amount("amount_text").alias("amount")), "amount")


@register("is_transaction_message")
def q_is_transaction_message(spark, sf):
    return S.documents(spark, sf).select("doc_id", P.is_transaction_message("text").alias("is_txn"))


# --- mail export chain ------------------------------------------------------------------

def _payloads(spark, sf):
    """RAW_PAYLOAD input: mail payloads, rendered as they are read (no copy of them is dealt or written)."""
    return S.mail_payloads(spark, sf)


@register("decode_mime_body")
def q_decode_mime_body(spark, sf):
    return _payloads(spark, sf).select("id", ML.decode_mime_body("payload").alias("body"))


@register("message_records")
def q_message_records(spark, sf):
    return ML.message_records(_payloads(spark, sf))


@register("resolve_bank")
def q_resolve_bank(spark, sf):
    p = _payloads(spark, sf)
    return p.select("id", ML.sender("payload").alias("sender"), ML.resolve_bank(ML.sender("payload")).alias("bank_name"))


@register("html_to_text")
def q_html_to_text(spark, sf):
    pages = S.read_table(spark, sf, "pages")
    return pages.select("page_id", ML.html_to_text("html").alias("text"))


@register("mail_query_filter")
def q_mail_query_filter(spark, sf):
    return ML.mail_query_filter(_payloads(spark, sf), as_of=AS_OF).select("id", "internalDate")


@register("mail_latest_n")
def q_mail_latest_n(spark, sf):
    return ML.mail_latest_n(_payloads(spark, sf)).select("id", "internalDate")


# --- merchant rules ----------------------------------------------------------------------

def _all_txn(spark, sf):
    return S.all_transactions(spark, sf)


@register("categorize_mappings")
def q_categorize_mappings(spark, sf):
    df = RU.categorize(_all_txn(spark, sf), FX.test_mappings(spark))
    return df.select("table_name", "source", "merchant", "category", "sub_category")


@register("categorize_fallback")
def q_categorize_fallback(spark, sf):
    df = RU.categorize(_all_txn(spark, sf), None)
    return df.select("table_name", "source", "merchant", "category", "sub_category")


@register("apply_mappings")
def q_apply_mappings(spark, sf):
    df = _changed(spark, "transactions", _all_txn(spark, sf).select("table_name", "source", "merchant", "category", "sub_category"),
                  lambda t: RU.apply_mappings(t, FX.test_mappings(spark)))
    return df.select("table_name", "source", "merchant", "category", "sub_category",
                     F.size("hits").alias("n_hits"))


@register("apply_report")
def q_apply_report(spark, sf):
    return RU.apply_report_labelled(S.all_transactions(spark, sf), FX.test_mappings(spark))


# --- store and mapping maintenance ---------------------------------------------------------


def _parsed_debits(spark, sf):
    """Alert pipeline rows as the mail flow stores them (all debits)."""
    return (AL.parse_alerts(_alerts(spark, sf)).filter(F.col("status") == "parsed")
            .withColumn("txn_type", F.lit("debit")))


@register("dedup_against_store")
def q_dedup_against_store(spark, sf):
    store = S.bound_transactions(spark, sf).filter(F.col("txn_date") < F.lit("1995-01-01").cast("timestamp_ntz"))
    out = ST.dedup_against_store(_parsed_debits(spark, sf), store, order=[F.col("raw_text"), F.col("txn_date")])
    return as_double(out.select("source", "txn_date", "amount", "merchant"), "amount")


@register("append_transactions")
def q_append_transactions(spark, sf):
    path = scratch_path(spark, "store")
    rows = ST.to_store_rows(S.bound_transactions(spark, sf), created_at=AS_OF)
    ST.append_transactions(rows, path)
    back = ST.read_store(spark, path)
    return as_double(back.select("source", "txn_type", "txn_date", "amount", "currency", "merchant"), "amount")


@register("publish_bi_views")
def q_publish_bi_views(spark, sf):
    ST.publish_bi_views(spark, _exp(spark, sf), _cred(spark, sf))
    return spark.sql("SELECT merchant, CAST(total_spent AS DOUBLE) AS total_spent, txn_count, "
                     "ROUND(CAST(avg_amount AS DOUBLE), 6) AS avg_amount FROM v_top_merchants")


@register("maintained_views")
def q_maintained_views(spark, sf):
    """S12 kept up to date: the four views after an append and a deletion of bad rows, from the files' partial sums."""
    expenses, credits = scratch_path(spark, "expenses"), scratch_path(spark, "credits")
    columns = ["source", "txn_date", "amount", "merchant", "category"]
    rows, late = _exp(spark, sf).select(columns), F.coalesce(F.col("txn_date") >= F.lit("1995-01-01").cast("timestamp_ntz"), F.lit(False))
    ST.save_version(rows.filter(~late), expenses)
    ST.save_version(_cred(spark, sf).select(columns), credits)
    VW.refresh(spark, expenses)
    ST.append_rows(spark, expenses, rows.filter(late))
    VW.refresh(spark, expenses)
    ST.delete_bad_from_table(spark, expenses)
    VW.publish(spark, expenses, credits)
    return spark.sql("""
        SELECT 'monthly_spend' AS view, CAST(month AS STRING) AS key, CAST(total_spent AS DOUBLE) AS total,
               CAST(NULL AS DOUBLE) AS further, txn_count AS n FROM v_monthly_spend
        UNION ALL SELECT 'category_spend', category, CAST(total_spent AS DOUBLE), CAST(row_id AS DOUBLE), txn_count FROM v_category_spend
        UNION ALL SELECT 'top_merchants', merchant, CAST(total_spent AS DOUBLE), ROUND(CAST(avg_amount AS DOUBLE), 6), txn_count FROM v_top_merchants
        UNION ALL SELECT 'income_vs_expense', CAST(month AS STRING), CAST(income AS DOUBLE), CAST(net AS DOUBLE), NULL FROM v_monthly_income_vs_expense""")


@register("delete_bad_rows")
def q_delete_bad_rows(spark, sf):
    path = scratch_path(spark, "expenses")
    ST.save_version(_exp(spark, sf).select("source", "amount", "merchant"), path)
    ST.delete_bad_from_table(spark, path)
    return as_double(ST.read_version(spark, path).select("source", "amount"), "amount")


def _mapping_csv(spark, sf) -> str:
    """A mapping CSV rendered from the distinct part names (comments, a
    header, some rows with a bad priority or no category)."""
    part = S.read_table(spark, sf, "part")
    names = part.groupBy("p_name").agg(F.min("p_type").alias("t"), F.min("p_brand").alias("b"))
    pri = F.when(F.col("p_name").startswith("cold"), F.lit("x")).otherwise((F.length("p_name") % 7).cast("string"))
    cat = F.when(F.col("p_name").startswith("hot"), F.lit("")).otherwise(F.initcap("t"))
    body = names.select(F.lit(2).alias("k"), F.col("p_name").alias("o"),
                        F.concat_ws(",", F.upper("p_name"), F.initcap("p_name"), cat, F.col("b"), pri).alias("value"))
    head = spark.createDataFrame([(0, "", "# mapping rules"), (1, "", "raw_pattern,clean_name,category,sub_category,priority"),
                                  (1, "~", '"# quoted comment, skipped too"')], "k int, o string, value string")
    path = scratch_path(spark, "mapcsv")
    # Bounded by the name vocabulary, so one ordered file is fine here.
    head.unionByName(body).orderBy("k", "o").coalesce(1).select("value").write.text(path)
    return path


@register("read_mapping_csv")
def q_read_mapping_csv(spark, sf):
    df = ST.read_mapping_csv(spark, _mapping_csv(spark, sf))
    return df.select("raw_pattern", "clean_name", "category", "sub_category", "priority", "status")


def _changed(spark, name, table, change):
    """``table`` stored, changed by a versioned rewrite, and read back."""
    path = scratch_path(spark, name)
    ST.save_version(table, path)
    ST.change_table(spark, path, change)
    return ST.read_version(spark, path)


def _upserted(spark, sf):
    """The path of a mapping table after an import of the CSV."""
    path = scratch_path(spark, "mappings")
    rows = ST.read_mapping_csv(spark, _mapping_csv(spark, sf)).filter(F.col("status") == "ok")
    ST.save_version(FX.test_mappings(spark), path)
    ST.upsert_table(spark, path, rows, as_of=AS_OF)
    return path


@register("upsert_mappings")
def q_upsert_mappings(spark, sf):
    return ST.read_version(spark, _upserted(spark, sf)).select("id", "raw_pattern", "clean_name", "category", "sub_category", "priority")


@register("lookup_mapping")
def q_lookup_mapping(spark, sf):
    return ST.lookup_mapping(ST.read_version(spark, _upserted(spark, sf)), "  Blue Widget ").select("id", "raw_pattern", "clean_name")


@register("delete_mapping")
def q_delete_mapping(spark, sf):
    path = _upserted(spark, sf)
    existed = ST.delete_from_table(spark, path, "GEAR")
    return ST.read_version(spark, path).select("id", "raw_pattern", F.lit(existed).alias("existed"))


def _raw_merchants(spark, sf):
    a = _alerts(spark, sf)
    vpa, phrase = P.extract_vpa("raw_text"), P.extract_merchant("raw_text")
    return a.select(F.col("message_id").alias("source"), F.coalesce(vpa, phrase).alias("merchant"))


@register("reclean_existing")
def q_reclean_existing(spark, sf):
    rows = _changed(spark, "raw-merchants", _raw_merchants(spark, sf), ST.reclean_existing)
    return rows.select("source", "old_merchant", "merchant", "change")


@register("reclean_counts")
def q_reclean_counts(spark, sf):
    return ST.reclean_counts(ST.reclean_existing(_raw_merchants(spark, sf)))


# --- vector search -----------------------------------------------------------------------------

def _query_vector(spark, sf):
    first = S.read_table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()
    return first[0]


@register("semantic_search")
def q_semantic_search(spark, sf):
    emb = S.read_table(spark, sf, "embeddings")
    out = V.semantic_search(emb, _query_vector(spark, sf), tie_cols=["vec_id"])
    return out.select("vec_id", "label", F.round("distance", 4).alias("distance"))


@register("semantic_search_unfiltered")
def q_semantic_search_unfiltered(spark, sf):
    emb = S.read_table(spark, sf, "embeddings")
    return V.semantic_search_unfiltered(emb, _query_vector(spark, sf), tie_cols=["vec_id"]).select("vec_id", "label")


@register("semantic_search_batch")
def q_semantic_search_batch(spark, sf):
    emb = S.read_table(spark, sf, "embeddings")
    queries = V.centroids(emb, "label").withColumnRenamed("label", "query_id")
    out = V.semantic_search_batch(emb, queries)
    return out.select("query_id", "vec_id", "rank", F.round("distance", 4).alias("distance"))


@register("embed_transactions")
def q_embed_transactions(spark, sf):
    e = V.embed_transactions(S.bound_transactions(spark, sf, costly=True), dim=64)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, v: a + v * v))
    return e.select("source", F.size("embedding").alias("dims"), F.round(norm, 3).alias("norm"))


# --- questions ----------------------------------------------------------------------------------

def _user_questions(spark, sf):
    c = S.conversations(spark, sf).filter(F.col("role") == "user")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text")


@register("interpret_question")
def q_interpret_question(spark, sf):
    q = _user_questions(spark, sf)
    return q.select("question_id", QA.interpret_question("text", AS_OF).alias("f")).select("question_id", "f.*")


@register("answer_questions")
def q_answer_questions(spark, sf):
    out = QA.answer_questions(_user_questions(spark, sf), _exp(spark, sf), AS_OF)
    return as_double(out.select("question_id", "total"), "total")


@register("route_questions")
def q_route_questions(spark, sf):
    return QA.route_questions(_user_questions(spark, sf)).select("question_id", "route")


@register("answer_routed")
def q_answer_routed(spark, sf):
    return as_double(QA.answer_routed(_user_questions(spark, sf), S.expenses(spark, sf, costly=True), AS_OF), "total")


GUARDED_SQL = "```sql\nSELECT category, CAST(SUM(amount) AS DOUBLE) AS total FROM expenses GROUP BY category\n```"


@register("guarded_sql")
def q_guarded_sql(spark, sf):
    ST.publish_bi_views(spark, _exp(spark, sf), _cred(spark, sf))
    return QA.guarded_sql(spark, GUARDED_SQL)


def _conv(spark, sf):
    return S.conversations(spark, sf)


@register("strip_code_fence")
def q_strip_code_fence(spark, sf):
    return _conv(spark, sf).select("conv_id", "turn", P.strip_code_fence("text").alias("sql"))


@register("is_safe_select")
def q_is_safe_select(spark, sf):
    return _conv(spark, sf).select("conv_id", "turn", P.is_safe_select("text").alias("safe"))


@register("is_structured_question")
def q_is_structured_question(spark, sf):
    return _conv(spark, sf).select("conv_id", "turn", P.is_structured_question("text").alias("structured"))


@register("pattern_candidates")
def q_pattern_candidates(spark, sf):
    return _alerts(spark, sf).select("message_id", QA.pattern_candidates("raw_text").alias("candidates"))


@register("rank_patterns")
def q_rank_patterns(spark, sf):
    return QA.rank_patterns(_alerts(spark, sf), n=20)


@register("suggest_pattern")
def q_suggest_pattern(spark, sf):
    j = S._lineitem_part(spark, sf)
    return j.select(S._source_key().alias("message_id"),
                    QA.suggest_pattern(S.alert_text_expr(), F.initcap("p_name")).alias("pattern"))


# --- documents ------------------------------------------------------------------------------------

def _docs(spark, sf):
    return S.documents(spark, sf)


@register("redact_pii")
def q_redact_pii(spark, sf):
    return _docs(spark, sf).select("doc_id", P.redact_pii("text").alias("text"))


@register("row_hash")
def q_row_hash(spark, sf):
    d = _docs(spark, sf)
    doc = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return d.select("doc_id", P.row_hash("text").alias("row_hash"), P.source_key(doc, "text").alias("source"))


@register("embedding_text")
def q_embedding_text(spark, sf):
    return S.bound_transactions(spark, sf).select("source", P.embedding_text().alias("text"))


# --- statements -----------------------------------------------------------------------------------


AS_OF_YEAR = 1998


def _stmt_tables(spark, sf):
    return materialized(spark, sf, "stmt-tables", lambda: SS.rendered_statement_tables(spark, sf))


def _stmt_text(spark, sf):
    return materialized(spark, sf, "stmt-text", lambda: SS.rendered_statement_text(spark, sf))


@register("read_statement_tables")
def q_read_statement_tables(spark, sf):
    path = scratch_path(spark, "stmt-tables")
    _stmt_tables(spark, sf).write.parquet(path)
    back = SS.read_statement_tables(spark, path)
    return back.select("doc", "table_no", "row_no", F.size("cells").alias("n_cells"))


@register("read_statement_text")
def q_read_statement_text(spark, sf):
    return SS.statement_lines(_stmt_text(spark, sf))


@register("detect_statement_format")
def q_detect_statement_format(spark, sf):
    return SM.detect_statement_format(_stmt_tables(spark, sf), _stmt_text(spark, sf))


def _stmt_out(df):
    return as_double(df.select("doc", "source", "txn_date", "amount", "txn_type", "merchant", "bank_name"), "amount")


@register("statement_rows_multicol")
def q_statement_rows_multicol(spark, sf):
    t = _stmt_tables(spark, sf)
    return _stmt_out(SM.statement_rows_multicol(t, SM.detect_statement_format(t, None)))


@register("statement_rows_card_cell")
def q_statement_rows_card_cell(spark, sf):
    t = _stmt_tables(spark, sf)
    return _stmt_out(SM.statement_rows_card_cell(t, SM.detect_statement_format(t, None)))


@register("statement_lines_card_text")
def q_statement_lines_card_text(spark, sf):
    p = _stmt_text(spark, sf)
    return _stmt_out(SM.statement_lines_card_text(p, SM.detect_statement_format(None, p), AS_OF_YEAR))


@register("installment_section_flag")
def q_installment_section_flag(spark, sf):
    flags = SM.installment_flags(SS.statement_lines(_stmt_text(spark, sf)))
    return flags.filter("in_section").select("doc", "page_no", "line_no")


@register("statement_year")
def q_statement_year(spark, sf):
    return SM.statement_facts(_stmt_text(spark, sf), AS_OF_YEAR).select("doc", "year", "end_month")


@register("first_occurrence")
def q_first_occurrence(spark, sf):
    """Every card-text line keyed like the parser keys it, first one kept."""
    lines = SS.statement_lines(_stmt_text(spark, sf))
    keyed = lines.select("doc", "page_no", "line_no",
                         P.source_key(F.col("doc"), strip_ws(F.col("line"))).alias("source"))
    return SM.first_occurrence(keyed).select("doc", "source", "page_no", "line_no")


# --- ingest pipelines ----------------------------------------------------------------------------


_PIPE_COLS = ["source", "txn_type", "txn_date", "amount", "merchant", "category", "sub_category", "payment_method",
              "bank_name"]


def _history(spark, sf):
    """Rows already in the store: transactions dated before 1995."""
    return S.bound_transactions(spark, sf).filter(F.col("txn_date") < F.lit("1995-01-01").cast("timestamp_ntz"))


def _alert_run(spark, sf):
    return PL.alert_pipeline(_payloads(spark, sf), _history(spark, sf), FX.test_mappings(spark), created_at=AS_OF)


def _appended(spark, result):
    """The rows that a run added to a store, read back from it."""
    path = scratch_path(spark, "ingest")
    PL.append_result(result, path)
    return ST.read_store(spark, path)


@register("alert_pipeline")
def q_alert_pipeline(spark, sf):
    return as_double(_appended(spark, _alert_run(spark, sf)).select(*_PIPE_COLS), "amount")


@register("ingest_summary")
def q_ingest_summary(spark, sf):
    return _alert_run(spark, sf).summary


def _statement_run(spark, sf):
    t, p = _stmt_tables(spark, sf), _stmt_text(spark, sf)
    parsed = materialized(spark, sf, "stmt-parsed", lambda: SM.parse_statements(t, p, AS_OF_YEAR)[0])
    store = parsed.filter(F.col("txn_date") < F.lit("1995-01-01").cast("timestamp_ntz"))
    return PL.statement_pipeline(t, p, store, FX.test_mappings(spark), created_at=AS_OF, as_of_year=AS_OF_YEAR,
                                 parsed=parsed)


@register("statement_pipeline")
def q_statement_pipeline(spark, sf):
    return as_double(_appended(spark, _statement_run(spark, sf)).select(*_PIPE_COLS), "amount")


@register("statement_ingest_summary")
def q_statement_ingest_summary(spark, sf):
    return _statement_run(spark, sf).summary


# --- streaming inbox ---------------------------------------------------------------------------------

@register("inbox_stream")
def q_inbox_stream(spark, sf):
    """Extracted statement files dropped into two inboxes (tables and text
    pages) - the tables arrive in two drops, the second re-sending a year
    already processed - run through the inbox streams into one store;
    returns the store."""
    from ledgerlens.streaming.inbox import start_inbox

    base = _scratch(spark, "inbox")
    store, quarantine = f"{base}/store", f"{base}/quarantine"
    mappings = FX.test_mappings(spark)
    inputs = {"tables": _stmt_tables(spark, sf), "text": _stmt_text(spark, sf)}
    first_year = {"tables": F.col("table_no") <= 3, "text": F.lit(True)}
    rest = {"tables": F.col("table_no") >= 3}

    def run(kind):
        q = start_inbox(spark, f"{base}/in-{kind}/*", f"{base}/archive-{kind}", store, quarantine,
                        f"{base}/ckpt-{kind}", mappings, created_at=AS_OF, as_of_year=AS_OF_YEAR, kind=kind)
        q.awaitTermination()

    for kind, df in inputs.items():
        # A file carries whole documents, as a statement PDF does.
        df.filter(first_year[kind]).repartition("doc").write.option("compression", "gzip").json(f"{base}/in-{kind}/drop1")
        run(kind)
        if kind in rest:  # re-send: one year of tables arrives again
            df.filter(rest[kind]).repartition("doc").write.option("compression", "gzip").json(f"{base}/in-{kind}/drop2")
            run(kind)
    out = ST.read_store(spark, store)
    return as_double(out.select("source", "txn_type", "txn_date", "amount"), "amount")


# --- extensions (documented, not implemented by the reference) -----------------------------------


BUDGETS = [("ECONOMY", 5_000_000), ("LARGE", 1_000_000), ("SMALL", 20_000_000), ("MEDIUM", 3_000_000),
           ("Other", 100_000), ("Travel", 1_000)]
OVERRIDES = [("blue widget", "Gifts", "Toys"), ("red gear", "Auto", ""), ("Unknown", "Review", "")]


@register("recurring_payments")
def q_recurring_payments(spark, sf):
    out = EX.recurring_candidates(_exp(spark, sf))
    return out.select("merchant", "n_charges", "n_gaps", F.round("avg_gap", 4).alias("avg_gap"),
                      F.round("cv", 4).alias("cv"), "period", "avg_amount", "last_date", "next_date", "is_recurring")


@register("budget_status")
def q_budget_status(spark, sf):
    from decimal import Decimal

    budgets = spark.createDataFrame([(c, Decimal(v), "INR") for c, v in BUDGETS], BUDGET)
    out = EX.budget_status(_exp(spark, sf), budgets, "1998-07-20 12:00:00")
    return as_double(out, "monthly_limit", "spent")


@register("category_overrides")
def q_category_overrides(spark, sf):
    ov = spark.createDataFrame(OVERRIDES, "merchant string, category string, sub_category string")
    out = EX.apply_category_overrides(_all_txn(spark, sf), ov, FX.test_mappings(spark))
    return out.select("table_name", "source", "merchant", "category", "sub_category")


# --- remaining inventory keys ----------------------------------------------------------------------

@register("read_messages")
def q_read_messages(spark, sf):
    """Payloads exported as JSON files, read back with the explicit schema."""
    path = _scratch(spark, "mail-export")
    _payloads(spark, sf).write.option("compression", "gzip").json(path)  # many files, read a file a task
    return ML.read_messages(spark, path).select("id", "internalDate", F.size("payload.headers").alias("n_headers"))


@register("category_rank")
def q_category_rank(spark, sf):
    return R.category_spend(_exp(spark, sf)).select("category", "row_id")


@register("mapping_order")
def q_mapping_order(spark, sf):
    """T-3: mappings by priority desc, id asc, with the listing position."""
    return R.mapping_order(ST.read_version(spark, _upserted(spark, sf))).select("id", "raw_pattern", "priority", "position")


def _store_with_both(spark, sf):
    path = _scratch(spark, "store-m6")
    ST.append_transactions(ST.to_store_rows(S.bound_transactions(spark, sf), created_at=AS_OF), path)
    return path


@register("truncate_expenses")
def q_truncate_expenses(spark, sf):
    path = _store_with_both(spark, sf)
    schema = ST.read_store(spark, path).schema
    ST.truncate_expenses(spark, path, schema)
    out = ST.read_store(spark, path)
    return as_double(out.select("txn_type", "source", "amount"), "amount")


@register("drop_expenses")
def q_drop_expenses(spark, sf):
    path = _store_with_both(spark, sf)
    ST.drop_expenses(spark, path)
    out = ST.read_store(spark, path)
    return as_double(out.select("txn_type", "source", "amount"), "amount")


@register("source_key")
def q_source_key(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", P.source_key(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), "text")
                    .alias("source"))
