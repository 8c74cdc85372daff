"""Small text helpers shared by the parsers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a Column -> Column).

    Spark does not share a subexpression that only appears inside later
    CASE branches, so an expensive value referenced several times would be
    recomputed per reference; binding it through a one-element
    ``transform`` evaluates it exactly once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_if(c: Column, may_match, pattern: str, repl: str) -> Column:
    """``regexp_replace`` of the values that pass a cheap test, which every value with a match passes."""
    return let(c, lambda x: F.when(may_match(x), F.regexp_replace(x, pattern, repl)).otherwise(x))


#: The characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column | str) -> Column:
    """Strip leading/trailing whitespace, Unicode's too (``trim`` alone only strips blanks)."""
    return F.btrim(col_(c), F.lit(WHITE_SPACE))


def contains_pattern(word: Column) -> Column:
    """LIKE pattern ``%word%``: a backslash before anything but a wildcard or
    another backslash stands for that character alone, as in PostgreSQL
    (Spark refuses it)."""
    return F.regexp_replace(F.concat(F.lit("%"), word, F.lit("%")), r"(\\[%_\\])|\\(.)", "$1$2")


WILDCARD = r"[%_\\]"


def like_fragment(word: Column) -> Column:
    """The longest literal piece of a LIKE word (the word itself without wildcards; '' if there is none)."""
    pieces = F.split(word, r"\\.|[%_\\]")
    return F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]


def title_case(c: Column | str) -> Column:
    """Capitalise the first letter of every run of letters, lower the rest.

    ``initcap`` only capitalises after blanks; here a letter that follows a
    digit or punctuation starts a new word too ("xpress2bees" ->
    "Xpress2Bees").  Tokens are letter runs and non-letter runs.
    """
    tokens = F.regexp_extract_all(col_(c), F.lit(r"(\p{L}+|\P{L}+)"), 0)
    capped = F.transform(tokens, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30))))
    return F.array_join(capped, "")


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def count_present(c: Column, words: list[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + c.contains(w).cast("int")
    return total
