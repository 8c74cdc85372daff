"""Mail export source (S1-S7): payloads -> RAW_MESSAGE rows.

The live mail API is not rebuilt; exported payloads (JSON or Parquet in
the API's message shape) are read with an explicit schema and every step
of the reference's per-message loop becomes a column expression, so a
whole mailbox export is decoded in one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions.parsing import is_transaction_message
from ledgerlens.functions.text import col_, let, strip_ws
from ledgerlens.schemas import RAW_PAYLOAD


# --- S1 -----------------------------------------------------------------------------

def read_messages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Exported payloads; never schema inference."""
    return spark.read.schema(RAW_PAYLOAD).format(fmt).load(path)


# --- S4 / S5 ------------------------------------------------------------------------

def _b64url_text(data: Column) -> Column:
    """URL-safe base64 (padding optional) -> text; bad bytes are dropped,
    data that is no base64 at all gives NULL."""
    plain = F.replace(F.replace(F.regexp_replace(data, r"[\s=]", ""), F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    padded = let(F.rtrim(plain), lambda bare: F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4)))))
    raw = F.try_to_binary(padded, F.lit("base64"))
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\ufffd"), F.lit(""))


def decode_mime_body(payload: Column | str = "payload") -> Column:
    """Concatenate text/plain and text/html parts in part order (top level
    only); with no parts, decode the payload body.  NULL if any wanted part
    can't be decoded."""
    p = col_(payload)
    wanted = F.filter(p["parts"], lambda x: x["mimeType"].isin("text/plain", "text/html")
                      & x["body"]["data"].isNotNull() & (x["body"]["data"] != ""))
    texts = F.transform(wanted, lambda x: _b64url_text(x["body"]["data"]))
    from_parts = let(texts, lambda t: F.when(~F.exists(t, lambda x: x.isNull()), F.array_join(t, "")))
    body_data = p["body"]["data"]
    from_body = F.when(body_data.isNotNull() & (body_data != ""), _b64url_text(body_data)).otherwise(F.lit(""))
    has_parts = p["parts"].isNotNull() & (F.size(p["parts"]) > 0)
    return F.when(has_parts, from_parts).otherwise(from_body)


# Named entities decoded after tag removal (fixed set); '&amp;' comes last, so what it spells stays text.
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&rsquo;", "\u2019"), ("&lsquo;", "\u2018"),
             ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&hellip;", "\u2026"), ("&bull;", "\u2022"),
             ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&reg;", "\u00ae"), ("&trade;", "\u2122"), ("&euro;", "\u20ac"), ("&pound;", "\u00a3"),
             ("&yen;", "\u00a5"), ("&cent;", "\u00a2"), ("&deg;", "\u00b0"), ("&times;", "\u00d7"), ("&amp;", "&")]
_NUMERIC = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"


def _code_point(ref: Column) -> Column:
    """The character of a numeric reference; U+FFFD for none."""
    hexed = F.regexp_extract(ref, r"(?i)x([0-9a-f]+)", 1)
    n = F.when(hexed != "", F.conv(hexed, 16, 10)).otherwise(F.regexp_extract(ref, r"([0-9]+)", 1)).cast("int")
    utf32 = F.unhex(F.lpad(F.hex(n), 8, "0"))
    valid = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(utf32, "UTF-32")).otherwise(F.lit("\ufffd"))


def _numeric_refs(text: Column) -> Column:
    """Numeric character references decoded."""
    return let(text, lambda t: F.when(t.contains("&#"), _decoded_refs(t)).otherwise(t))


def _decoded_refs(t: Column) -> Column:
    """The pieces between numeric references and what these stand for take turns."""
    refs = F.regexp_extract_all(t, F.lit(f"({_NUMERIC})"), 0)
    pieces = F.split(t, _NUMERIC, -1)
    both = F.zip_with(pieces, refs, lambda p, r: F.concat(p, F.when(r.isNotNull(), _code_point(r)).otherwise(F.lit(""))))
    return F.array_join(both, "")


def strip_html(body: Column | str) -> Column:
    """Tags -> one blank per run of tags; script/style/comments dropped;
    common entities decoded; outer whitespace stripped."""
    t = F.regexp_replace(col_(body), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?:<[^>]*>)+", " ")
    return strip_ws(let(t, lambda x: F.when(x.contains("&"), _entities(x)).otherwise(x)))


def _entities(t: Column) -> Column:
    t = _numeric_refs(t)
    for ent, ch in _ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return t


def html_to_text(body: Column | str) -> Column:
    """Only bodies containing '<html' (any case) are converted."""
    b = col_(body)
    return F.when(F.lower(b).contains("<html"), strip_html(b)).otherwise(b)


# --- S6 / S7 ------------------------------------------------------------------------------

def sender(payload: Column | str = "payload") -> Column:
    """First 'From' header (any case), else ''."""
    froms = F.filter(col_(payload)["headers"], lambda h: F.lower(h["name"]) == "from")
    return F.coalesce(F.try_element_at(froms, F.lit(1))["value"], F.lit(""))


def resolve_bank(sender_col: Column | str) -> Column:
    low = F.lower(col_(sender_col))
    out = F.lit("")
    for key, bank in reversed(K.SENDER_BANKS):
        out = F.when(low.contains(key), F.lit(bank)).otherwise(out)
    return out


def message_records(payloads: DataFrame, keep_all: bool = False) -> DataFrame:
    """RAW_MESSAGE rows (source, message_id, timestamp, raw_text, bank_name)
    for payloads whose decoded text looks like a transaction alert.

    A body that can't be decoded has NULL ``raw_text`` and stays: it ends as
    a failed message, not as a failed job.  Body and text each pass a
    one-element generator, below which no filter is pushed, so a body is
    decoded once however often the text is looked at.
    """
    cols = [F.lit("gmail").alias("source"), F.col("id").alias("message_id"), F.col("internalDate").alias("timestamp"),
            resolve_bank(sender(F.col("payload"))).alias("bank_name")]
    body = payloads.select(*cols, F.explode(F.array(decode_mime_body(F.col("payload")))).alias("body"))
    text = body.select("source", "message_id", "timestamp", "bank_name", F.explode(F.array(html_to_text("body"))).alias("raw_text"))
    out = text.select("source", "message_id", "timestamp", "raw_text", "bank_name")
    if keep_all:
        return out.withColumn("is_transaction", is_transaction_message("raw_text"))
    return out.filter(F.coalesce(is_transaction_message("raw_text"), F.lit(True)))


# --- S2 / S3 --------------------------------------------------------------------------------

def mail_query_filter(payloads: DataFrame, as_of: str, days: int = K.MESSAGE_WINDOW_DAYS) -> DataFrame:
    """The export-side source predicate: primary category, newer than
    ``days`` before ``as_of``, any query term as a word in subject or body,
    and one of the allowed senders."""
    as_of_ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                F.lit(as_of).cast("timestamp_ntz"))
    cutoff = as_of_ms - F.lit(days * 86_400_000)
    subjects = F.filter(F.col("payload.headers"), lambda h: F.lower(h["name"]) == "subject")
    subject = F.coalesce(F.try_element_at(subjects, F.lit(1))["value"], F.lit(""))
    searchable = F.concat_ws(" ", subject, decode_mime_body(F.col("payload")))
    term_re = r"(?i)\b(?:" + "|".join(K.MAIL_QUERY_TERMS) + r")\b"
    frm = F.lower(sender(F.col("payload")))
    sender_ok = F.lit(False)
    for addr in K.MAIL_SENDERS:
        sender_ok = sender_ok | frm.contains(addr)
    primary = F.array_contains(F.col("labelIds"), "CATEGORY_PERSONAL")
    return payloads.filter(primary & (F.col("internalDate") >= cutoff) & (F.col("internalDate") <= as_of_ms)
                           & searchable.rlike(term_re) & sender_ok)


def mail_latest_n(payloads: DataFrame, n: int = K.MAX_MESSAGES) -> DataFrame:
    """At most n newest messages (id breaks ties)."""
    return payloads.orderBy(F.col("internalDate").desc(), F.col("id").asc()).limit(n)
