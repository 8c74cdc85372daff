"""Alert parser (P11): RAW_MESSAGE -> parsed transactions with a status.

One projection over the message table: the score, the amount, the
merchant (VPA beats text phrase) and the date are all column expressions.
Rows that the reference would drop or fail on stay in the output with
``status = 'failed'`` and a ``reason`` so counts reconcile without a
second pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions import merchant as M
from ledgerlens.functions import parsing as P


def parse_alerts(messages: DataFrame, text_col: str = "raw_text", ts_col: str = "timestamp") -> DataFrame:
    # Stage 1: each pattern is searched once; later stages reuse the hits.
    # (CollapseProject keeps the stages apart because the extracted values
    # are referenced several times.)
    source = F.col("message_id") if "message_id" in messages.columns else F.col("source")
    bank = F.col("bank_name") if "bank_name" in messages.columns else F.lit("")
    t = F.col(text_col)
    s1 = messages.select(
        source.alias("source"), bank.alias("bank_name"), t.alias("raw_text"), F.col(ts_col).alias("_ts"),
        F.regexp_extract(t, K.AMOUNT_RE, 1).alias("_amt"),
        F.regexp_extract(t, K.MERCHANT_RE, 1).alias("_phrase"),
        F.regexp_extract(t, K.VPA_RE, 1).alias("_vpa"),
        F.lower(t).contains("debited").alias("_debited"),
    )
    # A match of any of the three patterns always captures a non-empty group.
    score = ((F.col("_amt") != "").cast("int") + ((F.col("_phrase") != "") | (F.col("_vpa") != "")).cast("int")
             + F.col("_debited").cast("int"))
    s2 = s1.select("*", score.alias("_score"), P.amount_from_capture(F.col("_amt")).alias("_amount"))
    reason = (F.when(F.col("_score") < 2, F.lit("low_score"))
              .when(F.col("_amount").isNull(), F.lit("bad_amount")))
    s3 = s2.select("*", reason.alias("reason"))
    ok = F.col("reason").isNull()
    merchant = (F.when(F.col("_vpa") != "", M.clean_vpa(F.col("_vpa")))
                .when(F.col("_phrase") != "",
                      F.coalesce(M.clean_merchant(F.col("_phrase")), F.lit(K.UNKNOWN_MERCHANT)))
                .otherwise(F.lit(K.UNKNOWN_MERCHANT)))
    return s3.select(
        F.when(ok, F.lit("parsed")).otherwise(F.lit("failed")).alias("status"),
        "reason",
        F.when(ok, P.extract_txn_date(F.col("raw_text"), F.col("_ts"))).alias("txn_date"),
        F.when(ok, F.col("_amount")).alias("amount"),
        F.when(ok, merchant).alias("merchant"),
        F.when(ok, P.extract_payment_method(F.col("raw_text"))).alias("payment_method"),
        "bank_name", "source", "raw_text", F.col("_ts").alias("msg_ts"),
    )
