import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import EDGE, SF001, edge, frame, nothing  # noqa: F401

from ledgerlens.llm import phrases
from ledgerlens.llm.queries import QUERIES


def counts_of(docs):
    """Counter per language of word tuples of 1 to 5 words, from (lang, text) rows."""
    out = {}
    for lang, text in docs:
        count = out.setdefault("und" if lang is None else lang, Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]", piece) if w]
            for i in range(len(words)):
                for m in range(1, min(5, len(words) - i) + 1):
                    count[tuple(words[i:i + m])] += 1
    return out


def brute(docs, least=100, top=2000):
    rows = []
    for lang, count in counts_of(docs).items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        found = {p: a for p, a in count.items() if len(p) >= 2 and a >= least}
        inner = {q[i:j] for q, b in found.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1)
                 if j - i < len(q) and b >= found[q[i:j]]}
        mine = []
        for p, a in found.items():
            if p not in inner:
                score, k = min((1000 * a * n // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        rows += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1)]
    return sorted(rows)


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def docs_of(df):
    return [(r.lang, r.text) for r in df.select("lang", "text").collect()]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = rows_of(QUERIES["op12_phrase_mining"](spark, SF001))
    assert got == brute(docs_of(docs)) and len(got) > 20


@pytest.mark.parametrize("least,top", [(3, 2000), (8, 7)])
def test_other_thresholds_equal_brute_force(spark, least, top):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").repartition(5)
    assert rows_of(phrases.collocations(docs, least=least, top=top)) == brute(docs_of(docs), least, top)


def test_small_bitmap_and_small_blocks_change_nothing(spark, monkeypatch):
    """Every pair's bit set, blocks of 300 words (workers fork from here), a flush every 50 rows."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(60)
    want = {(lang, " ".join(p)): c for lang, count in counts_of(docs_of(docs)).items() for p, c in count.items() if c >= 4}
    got = {(r.lang, r.phrase): r.n for r in phrases.phrase_counts(docs, least=4, bits=6, rows_held=50).collect() if r.words}
    assert got == want


def test_one_pair_in_a_third_of_all_words(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["hot pair", "hot pair", f"w{rng.randint(0, 30)}", "x y z"]) for _ in range(200)) for _ in range(60)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(7)
    assert rows_of(phrases.collocations(docs, least=20)) == brute([("en", t) for t in texts], 20)


def test_edge_rows(spark):
    rows = [("Alpha BETA gamma! alpha beta\tgamma", None), ("É À é", "fr"), (None, "fr"), ("", None), ("a a a a a a a", "und"), ("\n\r\x0b\x0c", "en"),
            ("a  b \t a b\x00 a\xa0b a\xa0b", "en"), ("ﬁ A-B a-b A-b", "d e"), ("x y", ""), ("x y", "")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as phrase", "2 as n", "3 as route", "4 as kind")
    for least in (1, 2, 3):
        assert rows_of(phrases.collocations(docs, least=least)) == brute([(lang, t) for t, lang in rows], least)


def test_long_texts_and_clashing_columns(edge):  # noqa: F811
    assert rows_of(phrases.collocations(edge, least=2)) == brute([("en", t) for _, t in EDGE], 2)


def test_empty_table(nothing):  # noqa: F811
    assert rows_of(phrases.collocations(nothing)) == []


def test_products_beyond_64_bits(spark):
    """score = floor(1000 a n / (l r)) with exact products, where doubles and longs fail."""
    from pyspark.sql import functions as F

    counts = [("en", "", 0, 9 * 10**14 + 1), ("en", "p", 1, 10**12 + 7), ("en", "q", 1, 10**13 + 9), ("en", "p q", 2, 10**12 + 1)]
    frame = spark.createDataFrame(counts, "lang string, phrase string, words long, n long")
    real, phrases.phrase_counts = phrases.phrase_counts, lambda *a: frame
    try:
        (row,) = phrases.collocations(spark.range(0).select(F.lit("").alias("text"), F.lit("").alias("lang"))).collect()
    finally:
        phrases.phrase_counts = real
    assert row.score == 1000 * (10**12 + 1) * (9 * 10**14 + 1) // ((10**12 + 7) * (10**13 + 9))


def test_multikey_counts_prefixes():
    rng = np.random.default_rng(3)
    for least in (1, 4):
        rows = [tuple(rng.integers(0, 4, rng.integers(1, 6))) for _ in range(400)]
        weights = rng.integers(1, 5, len(rows))
        keys = np.concatenate([[*r, -1] for r in rows])
        first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])])[:-1]
        want = Counter()
        for r, w in zip(rows, weights):
            for d in range(1, min(len(r), 4) + 1):
                want[r[:d]] += int(w)
        got = {tuple(keys[p:p + d]): int(c) for ps, d, cs in phrases.multikey(keys, first, weights, 4, least) for p, c in zip(ps, cs)}
        assert got == {k: v for k, v in want.items() if v >= least}
