"""Golden rows for the scalar parsers (derived by reading the rules)."""

import datetime as dt
from decimal import Decimal

from conftest import one_col
from ledgerlens.functions import merchant as M
from ledgerlens.functions import parsing as P
from ledgerlens.functions.text import title_case


def test_clean_merchant(spark):
    cases = {
        "PHARMEASY INMUMBAI": "PHARMEASY",
        "EMI AMAZON PVT LTD": "AMAZON",
        "OPENAI *CHATGPT SUBSCR": "OPENAI CHATGPT SUBSCR",
        "SWIGGY 123456789": "SWIGGY",
        "1% on all DCC Transaction": None,
        "inform you that": None,
        "ab": None,
        "": None,
        None: None,
        "  Zomato   Ltd  ": "Zomato Ltd",
        "Zomato Private Limited": "Zomato",
        "SWIGGYBANGALORE": "SWIGGY",
        "SHOP NEW DELHI": "SHOP",
        "Ref# 1234 charge": None,
        "a b c d e f g": None,
        "x" * 60: "x" * 50,
    }
    got = one_col(spark, list(cases), M.clean_merchant)
    assert dict(zip(cases, got)) == cases


def test_clean_vpa(spark):
    cases = {
        "9876543210@ybl": "UPI Transfer",
        "q809008926@ybl": "UPI Transfer",
        "gpay-utility@ok": "UPI Transfer",
        "gpay-corner-shop@ok": "Corner Shop",
        "phi.xpressbees@icici": "Xpressbees",
        "xpress2bees@icici": "Xpress2Bees",
        "gpay-12345@okaxis": "UPI Transfer",
        "gpay-ab@ok": "UPI Transfer",
        "paytmqr123@paytm": "UPI Transfer",
        "ybl.abc@ybl": "UPI Transfer",
        "12.ab@x": "UPI Transfer",
        "red.widget@okaxis": "Widget",
        "ab@x": "UPI Transfer",
        "big_bazaar@x": "Big Bazaar",
    }
    got = one_col(spark, list(cases), M.clean_vpa)
    assert dict(zip(cases, got)) == cases


def test_title_case(spark):
    got = one_col(spark, ["xpress2bees", "corner shop", "HELLO-world"], title_case)
    assert got == ["Xpress2Bees", "Corner Shop", "Hello-World"]


def test_parse_amount(spark):
    got = one_col(spark, ["1,234.50", "0", "-5", "10000001", "abc", None, "", "10000000", "NaN"], P.parse_amount)
    assert got == [Decimal("1234.50"), None, None, None, None, None, None, Decimal("10000000.00"), None]


def test_parse_date(spark):
    got = one_col(spark, ["1/2/2024", "01/02/75", "5 JANUARY 2024", "31/02/2024", "05  Jan 2024",
                          "1-2-24", "05 Sept 2024", None], P.parse_date)
    d = dt.datetime
    assert got == [d(2024, 2, 1), d(1975, 2, 1), d(2024, 1, 5), None, d(2024, 1, 5), d(2024, 2, 1), None, None]


def test_is_transaction_message(spark):
    assert one_col(spark, ["Rs.500 debited", "your account"], P.is_transaction_message) == [True, False]


def test_is_safe_select(spark):
    got = one_col(spark, ["select updated_at from x", "WITH a AS (select 1) select * from a", "SELECT 1"],
                  P.is_safe_select)
    assert got == [False, False, True]


def test_redact_pii(spark):
    got = one_col(spark, ["Ref# 123456789012", "card 4111XXXXXX1234 mail a.b@c.com pin 560001 Ref#77"],
                  P.redact_pii)
    assert got == ["Ref# [REDACTED_ACCT]",
                   "card [REDACTED_CARD] mail [REDACTED_EMAIL] pin [REDACTED_PIN] Ref#[REDACTED]"]


def test_strip_code_fence(spark):
    assert one_col(spark, ["```sql\nSELECT 1\n```"], P.strip_code_fence) == ["SELECT 1"]


def test_alert_fields(spark):
    text = "Rs.1,234.50 spent on credit card XX0001 on 05 Jan 2024 at HOT GEAR INMUMBAI"
    df = spark.createDataFrame([(text, 0)], "t string, ts long")
    r = df.select(P.extract_amount("t").alias("a"), M.clean_merchant(P.extract_merchant("t")).alias("m"),
                  P.extract_payment_method("t").alias("pm"), P.extract_txn_date("t", "ts").alias("d")).first()
    assert (r.a, r.m, r.pm, r.d) == (Decimal("1234.50"), "HOT GEAR", "CREDIT CARD", dt.datetime(2024, 1, 5))
