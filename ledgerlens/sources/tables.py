"""Readers for the driver tables and their binding to transaction shapes.

The driver ships TPC-H-like tables.  ``bound_transactions`` turns
``lineitem`` x ``part`` into the reference's transaction shape; the alert
and payload builders render per-row bank alert text from the same rows so
that every parser job reads data whose size grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; pruning/pushdown happen in the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores (one row group a file) dealt over them, before costly expressions; others stay as read."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def _lineitem_part(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    if costly:
        li = spread(li)
    part = read_table(spark, sf_dir, "part")
    # Plain equi-join: Spark picks broadcast only when ``part`` is under the
    # autoBroadcastJoinThreshold (its own size check); otherwise sort-merge.
    return li.join(part, li["l_partkey"] == part["p_partkey"], "inner")


def _source_key() -> Column:
    return F.concat(F.lit("syn:"), F.col("l_orderkey").cast("string"), F.lit("-"),
                    F.col("l_linenumber").cast("string"))


RENT = "City Rent"


def _bound_merchant() -> Column:
    # Line 7 carries no merchant, line 6 an empty, 'Unknown' or bad one, so
    # the quality reports see every kind; line 5 of a month's first day is
    # the rent, which recurs.
    return (F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
            .when((F.col("l_linenumber") == 5) & (F.dayofmonth("l_shipdate") == 1), F.lit(RENT))
            .when((F.col("l_linenumber") == 6) & (F.col("l_suppkey") % 4 == 2), F.lit("the"))
            .when((F.col("l_linenumber") == 6) & (F.col("l_suppkey") % 4 == 0), F.lit(""))
            .when((F.col("l_linenumber") == 6) & (F.col("l_suppkey") % 4 == 1), F.lit("Unknown"))
            .otherwise(F.col("p_name")))


def bound_transactions(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    """All transactions (debits and credits) with a ``txn_type`` column; ``costly`` work on them follows."""
    j = _lineitem_part(spark, sf_dir, costly)
    return j.select(
        _source_key().alias("source"),
        F.col("l_shipdate").alias("txn_date"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"),
        F.lit("INR").alias("currency"),
        _bound_merchant().alias("merchant"),
        F.when(F.col("p_type") == "STANDARD", F.lit(None).cast("string"))
         .when(F.col("p_type") == "PROMO", F.lit("Other"))
         .otherwise(F.col("p_type")).alias("category"),
        F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("sub_category"),
        F.when(F.col("l_linenumber") % 4 == 0, F.lit("UPI"))
         .when(F.col("l_linenumber") % 4 == 1, F.lit("CREDIT CARD"))
         .when(F.col("l_linenumber") % 4 == 2, F.lit("NEFT"))
         .otherwise(F.lit("")).alias("payment_method"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("HDFC"))
         .when(F.col("l_suppkey") % 3 == 1, F.lit("SBI"))
         .otherwise(F.lit("AXIS")).alias("bank_name"),
        alert_text_expr().alias("raw_text"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_returnflag") == "R", F.lit("credit")).otherwise(F.lit("debit")).alias("txn_type"),
    )


def expenses(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    return bound_transactions(spark, sf_dir, costly).filter(F.col("txn_type") == "debit").drop("txn_type")


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound_transactions(spark, sf_dir).filter(F.col("txn_type") == "credit").drop("txn_type")


def all_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables in one scan, labelled like ``expenses UNION ALL credits``
    (the store is one table partitioned by txn_type)."""
    t = bound_transactions(spark, sf_dir)
    label = F.when(F.col("txn_type") == "debit", F.lit("expenses")).otherwise(F.lit("credits"))
    return t.withColumn("table_name", label).drop("txn_type")


def _epoch_millis(ts_ntz: Column) -> Column:
    """Milliseconds since the epoch of a zone-less timestamp (no session zone)."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts_ntz)


def _card_digits() -> Column:
    return F.lpad((F.col("l_suppkey") % 10000).cast("string"), 4, "0")


def alert_text_expr() -> Column:
    """Bank alert text for one lineitem x part row.

    Four shapes, chosen by line number: a plain debit with a numeric date,
    a card spend with a named date and an IN<city> suffix, a UPI debit with
    a VPA and a two-digit year, and a NEFT alert without date or merchant
    (date falls back to the message time; 'credited' ones fail to parse).
    """
    amt = F.col("l_extendedprice").cast("decimal(12,2)")
    ship = F.col("l_shipdate")
    kind = F.col("l_linenumber") % 4
    t1 = F.concat(F.lit("INR "), amt.cast("string"), F.lit(" debited from a/c XX"), _card_digits(),
                  F.lit(" via UPI on "), F.date_format(ship, "dd/MM/yyyy"), F.lit(" at "), F.col("p_name"))
    t2 = F.concat(F.lit("Rs."), F.format_number(amt, 2), F.lit(" spent on credit card XX"), _card_digits(),
                  F.lit(" on "), F.date_format(ship, "dd MMM yyyy"), F.lit(" at "), F.upper(F.col("p_name")),
                  F.lit(" INMUMBAI"))
    t3 = F.concat(F.lit("Rs "), amt.cast("string"), F.lit(" debited from A/c no. XX"), _card_digits(),
                  F.lit(" on "), F.date_format(ship, "dd-MM-yy"), F.lit(" to VPA "),
                  F.regexp_replace(F.col("p_name"), " ", "."), F.lit("@okaxis (UPI Ref No "),
                  F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit(")"))
    t4 = F.concat(F.lit("Your a/c XX"), _card_digits(), F.lit(" is "),
                  F.when(F.col("l_suppkey") % 2 == 0, F.lit("debited")).otherwise(F.lit("credited")),
                  F.lit(" by INR "), amt.cast("string"), F.lit(" via NEFT. Info: "), F.upper(F.col("p_name")))
    return (F.when(kind == 1, t1).when(kind == 2, t2).when(kind == 3, t3).otherwise(t4))


SENDERS_BY_SUPPLIER = [
    "HDFC Bank InstaAlerts <alerts@hdfcbank.bank.in>",
    "SBI <cbsalerts@sbi.co.in>",
    "Axis Bank Alerts <alerts@axis.bank.in>",
]


def once(value: Column) -> Column:
    """A value computed once a row: nothing is pulled through a generator, however often the value is looked at above it."""
    return F.explode(F.array(value))


def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW_MESSAGE rows: one alert per lineitem row."""
    j = _lineitem_part(spark, sf_dir, costly=True)
    return j.select(
        F.lit("gmail").alias("source"),
        _source_key().alias("message_id"),
        _epoch_millis(F.col("l_shipdate")).alias("timestamp"),
        once(alert_text_expr()).alias("raw_text"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("HDFC"))
         .when(F.col("l_suppkey") % 3 == 1, F.lit("SBI"))
         .otherwise(F.lit("Axis")).alias("bank_name"),
    )


def mail_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW_PAYLOAD rows (mail export shape) rendered from lineitem x part.

    Line numbers 1, 5 carry one text/plain part; 3, 7 an attachment part
    that must be ignored plus an HTML part; even ones a single top-level
    body.  Bodies are URL-safe base64 without padding.
    """
    j = _lineitem_part(spark, sf_dir, costly=True).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", once(alert_text_expr()).alias("alert_text"))
    text = F.col("alert_text")

    def b64url(c: Column) -> Column:
        return F.rtrim(F.replace(F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_")), F.lit("="))

    sender = (F.when(F.col("l_suppkey") % 3 == 0, F.lit(SENDERS_BY_SUPPLIER[0]))
              .when(F.col("l_suppkey") % 3 == 1, F.lit(SENDERS_BY_SUPPLIER[1]))
              .otherwise(F.lit(SENDERS_BY_SUPPLIER[2])))
    headers = F.array(
        F.struct(F.lit("Subject").alias("name"), F.lit("Transaction alert").alias("value")),
        F.struct(F.lit("From").alias("name"), sender.alias("value")),
    )
    html = F.concat(F.lit("<html><body><p>"), text, F.lit("</p></body></html>"))
    part_t = "struct<mimeType:string,body:struct<data:string>>"

    def part(mime: str, data: Column) -> Column:
        return F.struct(F.lit(mime).alias("mimeType"), F.struct(data.alias("data")).alias("body"))

    parts = (F.when(F.col("l_linenumber") % 4 == 1, F.array(part("text/plain", b64url(text))))
             .when(F.col("l_linenumber") % 4 == 3,
                   F.array(part("application/pdf", b64url(F.lit("%PDF-1.4"))), part("text/html", b64url(html))))
             .otherwise(F.array().cast(f"array<{part_t}>")))
    body = F.struct(F.when(F.col("l_linenumber") % 2 == 0, b64url(text)).alias("data"))
    return j.select(
        _source_key().alias("id"),
        _epoch_millis(F.col("l_shipdate")).alias("internalDate"),
        F.array(F.lit("INBOX"), F.lit("CATEGORY_PERSONAL")).alias("labelIds"),
        once(F.struct(headers.alias("headers"), parts.alias("parts"), body.alias("body"))).alias("payload"),
    )


#: What users (and a query log) say besides, by (conv_id + turn) % 20.
SAYINGS = {
    0: "how much did I spend on widget", 1: "total upi spend last month on gear", 2: "week", 3: "month", 4: "shopping this week gizmo",
    5: "```sql\nselect category, amount from expenses\n```", 6: "select merchant from expenses where amount > 10",
    7: "Select 1; drop table expenses", 8: "yesterday", 9: "today", 10: "upi",
}
#: Added to the turn of a row that a saying follows; real turns are below it.
SAID_TURN = 500


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation rows as they are, and further rows that ask about transactions."""
    c = read_table(spark, sf_dir, "conversations")
    k = ((F.col("conv_id") + F.col("turn")) % 20).cast("int")
    said = F.element_at(F.create_map(*[F.lit(x) for kv in SAYINGS.items() for x in kv]), k)
    both = F.array(F.struct("turn", "text"), F.struct((F.col("turn") + SAID_TURN).alias("turn"), said.alias("text")))
    own = F.when(k.isin(list(SAYINGS)), both).otherwise(F.slice(both, 1, 1))
    others = [x for x in c.columns if x not in ("turn", "text")]
    return c.select(*others, F.explode(own).alias("r")).select(*[F.col(f"r.{x}") if x in ("turn", "text") else F.col(x) for x in c.columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every fifth with the kinds of personal data an alert holds."""
    d = read_table(spark, sf_dir, "documents")
    note = F.concat(F.lit(" A/c HDFC4**1234 debited INR 5, PIN "), F.lpad((F.col("doc_id") % 1000000).cast("string"), 6, "7"), F.lit(" Ref# 12"))
    return d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", note)).otherwise(F.col("text")))
