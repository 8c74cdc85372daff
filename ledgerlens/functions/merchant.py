"""Merchant cleaning (P9) and UPI handle naming (P10) as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions.text import col_, let, strip_ws, title_case

_CITY_RE = "(?i)(?:" + "|".join(K.CITY_SUFFIXES) + r")\s*$"
_IN_CITY_RE = r"(?i)\s+IN(?:" + "|".join(K.IN_CITY_SUFFIXES) + r")\s*$"


#: The last three characters of what these patterns match at the end of a stripped text (its case aside).
_CITY_ENDS = sorted({c[-3:].lower() for c in K.CITY_SUFFIXES})
_IN_CITY_ENDS = sorted({c[-3:].lower() for c in K.IN_CITY_SUFFIXES})
_LEGAL_ENDS = ["pvt", "vt.", "ltd", "td.", "ted", "llp", "llc", "inc", "nc.", "orp", "rp."]


def _ends_like(ends: list[str]):
    return lambda t: F.lower(F.substring(t, -3, 3)).isin(ends)


def _step(m: Column, may_match, pattern: str) -> Column:
    """A stripped text without the pattern, stripped again."""
    return let(m, lambda t: F.when(may_match(t), _sub_strip(t, pattern)).otherwise(t))


def _sub_strip(c: Column, pattern: str, repl: str = "") -> Column:
    return strip_ws(F.regexp_replace(c, pattern, repl))


def clean_merchant(raw: Column | str) -> Column:
    """Normalise a raw merchant string, or NULL when it is not a merchant.

    Steps, in order: strip an EMI prefix; '*' becomes a blank; strip
    trailing reference digits, ' IN<CITY>', a bare city suffix and a legal
    suffix; collapse blanks; cut to 50 characters.  Rejected: fewer than 3
    characters, 'ref#', '%', more than 6 words, or a sentence word.
    """
    # Patterns are searched where the ends of the stripped text let them match.
    m = _step(strip_ws(col_(raw)), lambda t: F.lower(F.substring(t, 1, 3)) == "emi", K.EMI_PREFIX_RE)
    m = let(m, lambda t: F.when(t.contains("*"), _sub_strip(F.replace(t, F.lit("*"), F.lit(" ")), K.TRAILING_DIGITS_RE))
            .when(F.ascii(F.substring(t, -1, 1)).between(ord("0"), ord("9")), _sub_strip(t, K.TRAILING_DIGITS_RE)).otherwise(t))
    m = _step(m, _ends_like(_IN_CITY_ENDS), _IN_CITY_RE)
    m = _step(m, _ends_like(_CITY_ENDS), _CITY_RE)
    m = _step(m, _ends_like(_LEGAL_ENDS), K.LEGAL_SUFFIX_RE)
    m = F.regexp_replace(m, r"\s{2,}", " ")
    m = let(m, lambda t: F.when(F.length(t) > K.MAX_MERCHANT_LEN, strip_ws(F.substring(t, 1, K.MAX_MERCHANT_LEN))).otherwise(t))

    def verdict(v: Column) -> Column:
        words = F.split(v, r"\s+")
        reject = (
            (F.length(v) < K.MIN_MERCHANT_LEN)
            | F.lower(v).contains("ref#")
            | v.contains("%")
            | (F.size(words) > K.MAX_MERCHANT_WORDS)
            | F.arrays_overlap(F.transform(words, F.lower), F.array(*[F.lit(w) for w in K.SENTENCE_WORDS]))
        )
        return F.when(reject, F.lit(None).cast("string")).otherwise(v)

    r = col_(raw)
    return F.when(r.isNull() | (r == ""), F.lit(None).cast("string")).otherwise(let(m, verdict))


def clean_vpa(vpa: Column | str) -> Column:
    """Readable name from a UPI handle, or 'UPI Transfer'."""
    return let(F.substring_index(col_(vpa), "@", 1), _vpa_name)


def _vpa_name(handle: Column) -> Column:
    low = F.lower(handle)
    transfer = F.lit(K.UPI_TRANSFER)

    gpay_name = F.replace(F.substring(handle, 6, 1 << 30), F.lit("-"), F.lit(" "))
    dotted = F.filter(F.split(handle, r"\."), lambda p: (F.length(p) > 2) & ~p.rlike(r"^\d+$"))
    plain = strip_ws(F.replace(F.replace(handle, F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" ")))

    prefixed = F.lit(False)
    for p in K.VPA_TRANSFER_PREFIXES:
        prefixed = prefixed | low.startswith(p)

    return (
        F.when(handle.isNull(), F.lit(None).cast("string"))
        .when(handle.rlike(K.VPA_ALL_DIGITS_RE), transfer)
        .when(handle.rlike(K.VPA_Q_CODE_RE), transfer)
        .when(handle.rlike(K.VPA_GPAY_DIGITS_RE) | handle.rlike(K.VPA_GPAY_UTILITY_RE), transfer)
        .when(low.startswith(K.VPA_GPAY_PREFIX),
              F.when(F.length(gpay_name) >= 3, title_case(gpay_name)).otherwise(transfer))
        .when(prefixed, transfer)
        .when(low.startswith(K.VPA_PAYTM_PREFIX), transfer)
        .when(handle.contains("."),
              F.when(F.size(dotted) > 0,
                     title_case(F.replace(F.element_at(dotted, -1), F.lit("-"), F.lit(" ")))).otherwise(transfer))
        .when((F.length(plain) < 3) | plain.rlike(r"^\d+$"), transfer)
        .otherwise(title_case(plain))
    )


def reclean(merchant: Column | str) -> Column:
    """M4 rule: handles with '@' go through ``clean_vpa``, others ``clean_merchant``."""
    m = col_(merchant)
    return F.when(m.contains("@"), clean_vpa(m)).otherwise(clean_merchant(m))
