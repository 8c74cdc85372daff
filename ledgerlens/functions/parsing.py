"""Column expressions that parse alert and statement text.

All of them are built-in Spark expressions, so they run inside whole-stage
codegen next to the scan; none needs Python on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions.text import col_, contains_any, count_present, let, replace_if, strip_ws


# --- P1 ---------------------------------------------------------------------------

def is_transaction_message(text: Column | str) -> Column:
    """At least two of the alert keywords occur (case-insensitive)."""
    return let(F.lower(col_(text)), lambda t: count_present(t, K.TRANSACTION_KEYWORDS) >= 2)


# --- P2 / P7 -------------------------------------------------------------------------

def _bounded_amount(num: Column) -> Column:
    ok = (num > 0) & (num <= K.MAX_AMOUNT)
    return F.when(ok, num.cast("decimal(12,2)"))


def extract_amount(text: Column | str) -> Column:
    """First ``INR``/``Rs`` amount, commas removed, kept when 0 < v <= 1e7."""
    return amount_from_capture(F.regexp_extract(col_(text), K.AMOUNT_RE, 1))


def amount_from_capture(raw: Column) -> Column:
    """Captured amount digits -> DECIMAL(12,2) within (0, 1e7], else NULL."""
    return let(_try_decimal(F.regexp_replace(raw, ",", "")), _bounded_amount)


def _try_decimal(s: Column) -> Column:
    # try_cast: malformed or oversized text becomes NULL instead of failing
    # the task under ANSI mode.  Inside it throws, which is dear for the many blanks.
    return let(s, lambda x: F.when(x != "", x.try_cast("decimal(38,10)")))


def parse_amount(val: Column | str) -> Column:
    """Statement amount cell: blank -> NULL; commas/blanks removed; 0 < v <= 1e7.

    Cast through DECIMAL, never DOUBLE: 'NaN'/'inf' are not amounts.
    """
    cleaned = strip_ws(F.regexp_replace(col_(val), ",", ""))
    return let(_try_decimal(cleaned), _bounded_amount)


# --- P3 / P4 / P5 ----------------------------------------------------------------------

def has_merchant_phrase(text: Column | str) -> Column:
    return F.regexp(col_(text), F.lit(K.MERCHANT_RE))


def extract_merchant(text: Column | str) -> Column:
    """Phrase after the leftmost payment keyword (no word boundary), or NULL."""
    m = F.regexp_extract(col_(text), K.MERCHANT_RE, 1)
    return F.when(has_merchant_phrase(text), m)


def extract_vpa(text: Column | str) -> Column:
    v = F.regexp_extract(col_(text), K.VPA_RE, 1)
    return F.when(F.regexp(col_(text), F.lit(K.VPA_RE)), v)


def extract_payment_method(text: Column | str) -> Column:
    """First payment method word, upper-cased; '' when there is none."""
    return F.upper(F.regexp_extract(col_(text), K.PAYMENT_METHOD_RE, 1))


# --- P8 / P6 --------------------------------------------------------------------------------

def _may_match(text: Column, fmt: str) -> Column:
    """Whether date text can have a format, by its separators and its last part: a parser that fails throws, which is dear."""
    sep = re.sub(r"\w", "", fmt)[0]
    last = F.length(F.substring_index(text, sep, -1))
    return text.contains(sep) & (last >= 4 if fmt.endswith("yyyy") else last == 2)


def _name_fits(text: Column, fmt: str) -> Column:
    """Whether a month's name can be whole or short, by its length: short ones have three letters, as has one whole name, its own short one."""
    name = F.length(F.split_part(text, F.lit(" "), F.lit(2)))
    return name > 3 if "MMMM" in fmt else name == 3


def parse_date(val: Column | str) -> Column:
    """Date text -> TIMESTAMP_NTZ trying six formats in order.

    Two-digit years pivot like the C library (69..99 -> 19xx).  Whitespace
    runs are collapsed before the month-name formats because those accept
    several blanks between parts.  Dates are parsed as DATE, so the result
    never depends on the session time zone.
    """
    def from_raw(raw: Column) -> Column:
        spaced = F.regexp_replace(raw, r"\s+", " ")
        tries = []
        for fmt in K.DATE_FORMATS:
            t = spaced if " " in fmt else raw
            d = F.when(_may_match(t, fmt) & _name_fits(t, fmt) if "MMM" in fmt else _may_match(t, fmt), F.try_to_date(t, fmt))
            if "yy" in fmt and "yyyy" not in fmt:
                d = let(d, lambda x: F.when(F.year(x) >= 2000 + K.TWO_DIGIT_YEAR_PIVOT,
                                            F.add_months(x, -1200)).otherwise(x))
            tries.append(d)
        return F.when(F.ascii(raw).between(ord("0"), ord("9")), F.coalesce(*tries))  # every format begins with a day

    return let(strip_ws(col_(val)), from_raw).cast("timestamp_ntz")


def epoch_millis_to_ntz(ms: Column | str) -> Column:
    """Message time (epoch ms) as a zone-less timestamp in UTC wall-clock time."""
    return F.timestamp_add("MILLISECOND", col_(ms), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def extract_txn_date(text: Column | str, fallback_ms: Column | str) -> Column:
    """First numeric date, else first named date, else the message time.

    Only the first hit of each pattern is tried, as in the reference.
    """
    d1 = parse_date(F.regexp_extract(col_(text), K.NUMERIC_DATE_RE, 1))
    d2 = parse_date(F.regexp_extract(col_(text), K.NAMED_DATE_RE, 1))
    return F.coalesce(d1, d2, epoch_millis_to_ntz(fallback_ms))


# --- P12 / P13 / P14 -----------------------------------------------------------------------

def redact_pii(text: Column | str) -> Column:
    """Card, account, e-mail, PIN, Ref# replacements in this order."""
    out = col_(text)
    for pattern, repl in K.PII_RULES:
        needs = K.PII_NEEDS.get(repl)
        out = replace_if(out, lambda x: contains_any(x, needs), pattern, repl) if needs else F.regexp_replace(out, pattern, repl)
    return out


def row_hash(raw: Column | str) -> Column:
    """First 16 hex chars of SHA-256 of the (unredacted) UTF-8 text."""
    return F.substring(F.sha2(col_(raw), 256), 1, 16)


def source_key(doc: Column | str, raw: Column | str) -> Column:
    return F.concat(F.lit("pdf:"), col_(doc), F.lit(":"), row_hash(raw))


def embedding_text(merchant="merchant", category="category", payment_method="payment_method",
                   raw_text="raw_text") -> Column:
    """Non-empty parts joined with single blanks (NULL and '' dropped)."""
    parts = F.array(col_(merchant), col_(category), col_(payment_method), col_(raw_text))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")


# --- P17 / P18 / P19 ------------------------------------------------------------------------

def strip_code_fence(sql: Column | str) -> Column:
    return strip_ws(F.regexp_replace(col_(sql), r"```(?:sql)?", ""))


def is_safe_select(sql: Column | str) -> Column:
    """Starts with 'select' and contains none of the forbidden words (substring test)."""
    q = F.lower(strip_ws(col_(sql)))
    return q.startswith("select") & ~contains_any(q, K.SQL_FORBIDDEN)


def is_structured_question(q: Column | str) -> Column:
    return contains_any(F.lower(col_(q)), K.STRUCTURED_KEYWORDS)
