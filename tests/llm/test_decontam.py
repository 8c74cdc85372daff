import random

from llm_helpers import SF001, edge, frame, nothing, small  # noqa: F401

from ledgerlens.llm import decontam
from ledgerlens.llm.queries import QUERIES

ITEM = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew potent coffee behind the old stone bridge near town"


def bench(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "item_id long, text string").withColumn("matches", F.lit("x"))


def smith_waterman(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if x == y else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


def test_alignment_equals_the_full_table():
    import numpy as np

    r = random.Random(1)
    for _ in range(300):
        a, b = (np.array(r.choices(range(5), k=r.randint(1, 12)), np.uint64) for _ in range(2))
        score, start, end = decontam.align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist())
        assert score == 0 or smith_waterman(a.tolist(), b[start:end].tolist()) == score


def test_copies_edits_and_clean_text(spark):
    words = ITEM.split()
    r = random.Random(2)
    filler = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    about = lambda s: " ".join(filler[:150]) + " " + s + " " + " ".join(filler[150:300])
    edited = list(words)
    for at in (3, 9, 15, 20):
        edited[at] = "changed"
    rows = [(1, about(ITEM)), (2, about(" ".join(edited))), (3, about(ITEM.upper().replace(" ", ",\n"))), (4, about("")), (5, about(" ".join(words[:6]))),
            (6, about(" ".join(words[:12] + ["extra", "words"] + words[12:]))), (7, ITEM), (8, " ".join(reversed(words)))]
    got = {x.doc_id: x for x in decontam.contamination(frame(spark, rows), bench(spark, [(10, ITEM), (11, ITEM), (12, "too short"), (13, None), (None, ITEM)])).collect()}
    assert {i for i, x in got.items() if x.contaminated} == {1, 2, 3, 6, 7}
    assert got[1].item_ids == [10, 11] and got[1].max_score == 1.0 and got[2].max_score < 1.0
    spans = decontam.with_matches(frame(spark, rows), bench(spark, [(10, ITEM)]), out="found").where("doc_id = 1").first().found
    assert rows[0][1][spans[0].start:spans[0].end] == ITEM


def test_common_items_are_still_found(spark):
    """An item that every document holds has no rare n-gram; the rarer places are seeds all the same."""
    rows = [(i, f"intro {i} {ITEM} outro") for i in range(40)]
    assert all(x.contaminated for x in decontam.contamination(frame(spark, rows), bench(spark, [(1, ITEM)])).collect())


def test_edited_copies_are_found_alone_and_in_hot_groups(spark):
    """Most of the item's n-grams occur nowhere; those that the copy keeps stand in more than 0.1 % of the rows."""
    edited = ITEM.split()
    for at in (1, 5, 13, 17):
        edited[at] = "changed"
    filler = [(1000 + i, f"row {i} holds nothing of the items") for i in range(199)]
    for rows in ([(1, "before " + " ".join(edited) + " after")], [(i, f"{i} " + " ".join(edited)) for i in range(30)]):
        got = decontam.contamination(frame(spark, rows + filler), bench(spark, [(1, ITEM)])).where("contaminated").collect()
        assert {x.doc_id for x in got} == {i for i, _ in rows}


def test_stretches_of_common_seeds_are_cut_without_loss(spark):
    """A text full of an item's n-grams is aligned in windows; a copy anywhere in it is found."""
    common = " ".join(ITEM.split()[:4])
    for n in (0, 37, 90, 133):
        text = f"{common} x " * n + ITEM + f" y {common}" * (140 - n)
        (hit,) = decontam.matches(block := decontam.block_of([(1, ITEM.encode())], 1.0), block.holds(), [text.encode()])[0]
        assert hit["score"] == 1.0 and text[hit["start"]:hit["end"]] == ITEM
    assert list(decontam.windows(0, 100, 10)) == [(0, 80), (70, 100)]


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    items = [(i, " ".join(ITEM.split()[i:i + 12])) for i in range(8)]
    rows = [(1, ITEM), (2, "nothing here at all to see"), (3, " ".join(ITEM.split()[3:17]))]
    one = sorted(map(repr, decontam.contamination(frame(spark, rows), bench(spark, items)).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    assert sorted(map(repr, decontam.contamination(frame(spark, rows), bench(spark, items)).collect())) == one


def test_query_equals_containment(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    got = {r.doc_id: set(r.item_ids) for r in QUERIES["op10_decontamination"](spark, SF001).collect()}
    for i, text in small:
        assert {k for k, t in items if t in text} <= got[i]
    assert sum(map(bool, got.values())) <= sum(any(t in x for _, t in items) for _, x in small) + 1


def test_edge_rows(spark, edge, nothing):
    none = bench(spark, [])
    assert [r.contaminated for r in decontam.contamination(edge, none).collect()] == [False] * edge.count()
    items = bench(spark, [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa."), (2, ""), (3, "word1 of1")])
    rows = [(r.doc_id, r.n_items) for r in decontam.contamination(edge, items).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, [(1, 1), (2, 0), (3, 0), (None, 1), (4, 1), (4, 1), (5, 1), (6, 0), (7, 0), (7, 0), (8, 1)]))  # a short item matches as a whole
    assert decontam.contamination(nothing, items).collect() == []
    assert decontam.clean(edge, items).columns == edge.columns and decontam.clean(edge, items).count() == 5


def words(text):
    import re

    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, threshold=0.5):
    """Full Smith-Waterman of every text with every item."""
    out = {}
    for d, text in rows:
        for i, item in items:
            a = words(item)
            score = smith_waterman(a, words(text)) if a else 0
            out.setdefault(d, set()).update([i] if a and score >= (threshold if len(a) >= 4 else 1.0) * 2 * len(a) else [])
    return out


def test_equals_full_alignment_of_all_pairs(spark):
    """Texts of few words, full of chance hits, edited copies and short items."""
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(14)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 3, 4, 5, 6, 9, 16])))) for i in range(40)]
    rows = []
    for d in range(150):
        text = r.choices(vocabulary + [f"x{k}" for k in range(30)], k=r.randint(0, 40))
        for _, item in r.sample(items, 2):
            copy = [w for w in item.split() if r.random() > 0.15]
            for _ in range(r.randint(0, 4)):
                copy.insert(r.randint(0, len(copy)), "new")
            at = r.randint(0, len(text))
            text[at:at] = copy
        rows.append((d, " ".join(text)))
    for threshold in (0.5, 0.7):
        got = decontam.with_matches(frame(spark, rows), bench(spark, items), out="found", threshold=threshold).collect()
        want = brute(rows, items, threshold)
        assert {x.doc_id: {m.item_id for m in x.found} for x in got} == want and sum(map(len, want.values())) > 300


def test_query_equals_full_alignment(spark, small):
    """Every text of up to 600 words with every item of the table."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    got = {r.doc_id: set(r.item_ids) for r in QUERIES["op10_decontamination"](spark, SF001).collect()}
    rows = [(i, t) for i, t in small if len(words(t)) <= 600][:60] + [(i, t) for i, t in small if got[i] and len(words(t)) <= 2000][:5]
    ids = {w: n for n, w in enumerate(sorted({w for _, t in [*rows, *items] for w in words(t)}))}
    import numpy as np

    for i, text in rows:
        held = np.array([ids[w] for w in words(text)], np.int64)
        for k, item in items:
            mine = np.array([ids[w] for w in words(item)], np.int64)
            best = max((int(row.max()) for row in decontam._rows(mine, held, True)), default=0)  # held to smith_waterman above
            assert (best >= len(mine)) == (k in got[i]), (i, k)


def test_recall_of_word_edits(spark):
    """200 items of 40 words in 120 of filler: all edits that leave half of the score are found."""
    r = random.Random(4)
    fresh = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    items = [(i, [fresh() for _ in range(40)]) for i in range(200)]
    for every, share in ((5, 1.0), (4, 1.0), (3, 1.0)):
        rows = []
        for i, ws in items:
            copy = [fresh() if k % every == every - 1 else w for k, w in enumerate(ws)]
            rows.append((i, " ".join([fresh() for _ in range(60)] + copy + [fresh() for _ in range(60)])))
        got = {x.doc_id: x.item_ids for x in decontam.contamination(frame(spark, rows), bench(spark, [(i, " ".join(ws)) for i, ws in items])).collect()}
        assert sum(got[i] == [i] for i, _ in items) >= share * len(items), every


def test_words_added_between_all_words(spark):
    """No two of the item's words stand together in the copy."""
    copy = " and ".join(ITEM.split())
    (row,) = decontam.contamination(frame(spark, [(1, f"before {copy} after")]), bench(spark, [(1, ITEM)])).collect()
    assert row.contaminated and row.max_score < 0.55


def test_item_of_30000_words_in_bounded_memory():
    import time
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(1)
    item = r.integers(0, 2**60, 30_000).astype(np.uint64)
    text = np.concatenate([r.integers(0, 2**60, 3000).astype(np.uint64), item[:15_000], item[15_003:], r.integers(0, 2**60, 3000).astype(np.uint64)])
    tracemalloc.start()
    began = time.time()
    score, start, end = decontam.align(item, text)
    assert (score, start, end) == (2 * 29_997 - 3, 3000, 3000 + 29_997)
    assert tracemalloc.get_traced_memory()[1] < 50e6 and time.time() - began < 300
    tracemalloc.stop()
