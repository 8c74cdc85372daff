"""Toxicity by weak supervision.

Voters: entries of a lexicon (whole words) and of patterns (word beginnings
of 4 to 7 bytes).  Some words stand from the start; the others are found in
a bounded sample of labelled documents (``PER_CLASS`` of either class):
whatever stands in toxic documents far more often than in others, and more
than chance would allow for any of the sample's entries.  A voter votes on
a document that holds its entry.

Label model, on the same sample: each voter's firing rates under either
class (its accuracy) and the correlations between voters within a class are
estimated by expectation-maximisation, where the given labels are one more
voter of bounded accuracy; a voter's evidence is divided by its total
correlation with the others, so voters that repeat each other count once.
Its posterior class is the target on which a linear classifier over the
entries is trained (logistic loss, L2).

``score`` reads every whole text: case-folded (A-Z) words, hashed by one
prefix sum, looked up among the entries.  What is broadcast is bounded by
``VOTERS``.  Defined cases: null and empty texts hold no entry and score
like any text without one; without labelled documents of both classes every
score is the share of class one; repeated rows each keep a row; null ids
count as held out; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import chunks, joined, map_batches, span_hashes, text_bytes
from ledgerlens.llm.labelled import held_out, sample

PER_CLASS = 2500
VOTERS = 400
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.5
#: Voters that stand from the start, whatever the sample holds.
LEXICON = """idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb imbecile vermin
    trottel dummkopf abschaum arschloch idiota estupido basura escoria imbecil imbecile ordure salaud""".split()
#: Accuracy that the given labels are taken to have at most, and rounds of estimation.
LABEL_ACCURACY, ROUNDS = 0.98, 25
L2 = 0.01
#: How much likelier than a clean document a toxic one must be to hold an entry.
LEAST_RATIO = 10
#: Voters count as repeating each other from this correlation within a class on; less comes from a shared language.
LEAST_CORRELATION = 0.3


@dataclass
class Model:
    entries: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    accuracy: np.ndarray  # of each voter, from the label model
    correlation: np.ndarray
    share: float


_WORD = np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def entry_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the words and word beginnings of ``texts``; repeats included."""
    data, at = joined([t.lower() for t in texts], b" ")
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    doc = np.searchsorted(at, starts, "right") - 1
    hashes, docs = [span_hashes(data, starts, ends)], [doc]
    for k in STEMS:
        long = np.flatnonzero(ends - starts > k)
        hashes.append(span_hashes(data, starts[long], starts[long] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def presence(texts: list[bytes], entries: np.ndarray) -> np.ndarray:
    """Documents x entries: 1 where the document holds the entry."""
    out = np.zeros((len(texts), len(entries)), np.uint8)
    if not len(entries):
        return out
    seen = np.zeros(1 << 16, bool)
    seen[(entries & np.uint64(0xFFFF)).astype(np.int64)] = True
    for a, b in chunks([len(t) + 1 for t in texts]):
        h, doc = entry_hashes(texts[a:b])
        maybe = seen[(h & np.uint64(0xFFFF)).astype(np.int64)]
        h, doc = h[maybe], doc[maybe]
        at = np.minimum(np.searchsorted(entries, h), len(entries) - 1)
        hit = entries[at] == h
        out[a + doc[hit], at[hit]] = 1
    return out


def g2(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-likelihood ratio of two rates."""
    def part(k, n, p):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / (n * p)), 0) + np.where(n > k, (n - k) * np.log(np.maximum(n - k, 1e-9) / (n * (1 - p))), 0)

    p = np.clip((pos + neg) / (n_pos + n_neg), 1e-9, 1 - 1e-9)
    return 2 * (part(pos, n_pos, p) + part(neg, n_neg, p))


def find_voters(rows: DataFrame, n_pos: int, n_neg: int) -> np.ndarray:
    """Hashes of the strongest entries in ``rows`` (y, text): counted in the tasks, the best ``VOTERS`` collected."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        y = np.array(batch.column(0).to_pylist(), np.int64)
        h, doc = entry_hashes(text_bytes(batch.column(1)))
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        once = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[:len(h)]
        h, doc = h[once], doc[once]
        keys, at = np.unique(h, return_inverse=True)
        pos = np.bincount(at, weights=y[doc], minlength=len(keys)).astype(np.int64)
        every = np.bincount(at, minlength=len(keys))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), pa.array(every - pos)], ["h", "pos", "neg"])

    counted = (map_batches(rows.select("y", "text"), run, "h long, pos long, neg long", sized_by=1)
               .groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).persist())
    # Under no relation the ratio is chi-squared: all entries together pass this once in many samples.
    least = 2 * np.log(max(counted.count(), 2)) + 8
    fewest = least / (2 * np.log((n_pos + n_neg) / n_pos))
    got = (counted.where((F.col("pos") >= fewest) & (F.col("pos") * n_neg > F.col("neg") * (LEAST_RATIO * n_pos)))
           .orderBy(F.desc(F.col("pos") * n_neg - F.col("neg") * (LEAST_RATIO * n_pos)), "h").limit(4 * VOTERS).toPandas())
    counted.unpersist()
    pos, neg = got["pos"].to_numpy(np.float64), got["neg"].to_numpy(np.float64)
    strength = g2(pos, neg, n_pos, n_neg)
    best = np.argsort(-strength, kind="stable")[:VOTERS]
    best = best[strength[best] >= least]
    return got["h"].to_numpy(np.int64)[best].view(np.uint64)


def span_hashes_of(words: list[str]) -> np.ndarray:
    data, at = joined([w.encode() for w in words], b" ")
    return span_hashes(data, at[:-1], at[1:] - 1)


def label_model(fired: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class one, accuracy per voter, correlation matrix) by expectation-maximisation."""
    x = fired.astype(np.float64)
    prior = np.log(share / (1 - share))
    given = np.where(y == 1, 1.0, -1.0) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    post = np.where(y == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    corr = np.eye(x.shape[1])
    rates = np.zeros((2, x.shape[1]))
    for _ in range(ROUNDS):
        # The sample takes either class alike; pseudo-counts stand for what it doesn't hold.
        for c, w in ((1, post), (0, 1 - post)):
            rates[c] = (w @ x + 0.05) / (w.sum() + 1)
        centred = [(x - rates[c]) * np.sqrt(w)[:, None] for c, w in ((1, post), (0, 1 - post))]
        cov = centred[0].T @ centred[0] + centred[1].T @ centred[1]
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = np.abs(cov / np.outer(scale, scale))
        np.fill_diagonal(corr, 1)
        shared = np.where(corr > LEAST_CORRELATION, corr, 0).sum(axis=1)
        on = np.log(rates[1] / rates[0]) / shared
        off = np.log((1 - rates[1]) / (1 - rates[0])) / shared
        z = prior + given + x @ on + (1 - x) @ off
        post = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return post, share * rates[1] / (share * rates[1] + (1 - share) * rates[0]), corr


def train_linear(x: np.ndarray, post: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels; rows weigh so that classes have their own frequency."""
    n1 = max(1, int(y.sum()))
    row = np.where(y == 1, share / n1, (1 - share) / max(1, len(y) - n1)) * len(y)
    x = np.column_stack([x.astype(np.float64), np.ones(len(y))])
    ridge = np.full(x.shape[1], L2)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    for _ in range(30):  # Newton steps, shortened to two units a weight
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ ((p - post) * row) + ridge * w
        step = np.linalg.solve((x * (row * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), grad)
        w = w - step / max(1.0, float(np.abs(step).max()) / 2)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    rows, share = sample(docs, labels, label, per_class)
    rows = rows.persist()
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    entries = span_hashes_of(LEXICON)
    if sizes.get(0) and sizes.get(1):
        entries = np.concatenate([entries, find_voters(rows, sizes[1], sizes[0])])
    entries = np.unique(entries)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = presence(text_bytes(batch.column(2)), entries)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r.tobytes() for r in got], pa.binary())], ["id", "y", "fired"])

    got = map_batches(rows.select("id", "y", "text"), run, "id long, y int, fired binary", sized_by=2).toArrow().to_pydict()
    rows.unpersist()
    order = np.argsort(np.array(got["id"], np.int64), kind="stable")
    y = np.array(got["y"], np.int64)[order]
    if len(set(y.tolist())) < 2:
        return Model(entries, np.zeros(len(entries)), float(np.log(share / (1 - share))), np.zeros(len(entries)), np.eye(len(entries)), share)
    x = np.array([np.frombuffer(f, np.uint8) for f in got["fired"]])[order]
    post, accuracy, corr = label_model(x, y, share)
    w, b = train_linear(x, post, y, share)
    return Model(entries, w, b, accuracy, corr, share)


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    z = presence(texts, model.entries).astype(np.float64) @ model.weights + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with its toxicity as double column ``out``; all other columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scores(held.value, text_bytes(batch.column(at)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{out}` double"])
    return map_batches(docs, run, schema, sized_by=at)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_score(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                          (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
