"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its byte trigrams, hashed to ``BINS`` bins and weighted
by log count times inverse document frequency, and four shares of its words
and bytes (``SHAPES``: words that repeat the one before, words seen before,
upper-case letters, marks), which counts alone hardly show.  ``fit`` takes a
bounded sample of labelled documents (``PER_CLASS`` of either class),
finds the leading ``DIMS`` singular vectors of their weights and keeps the
projected, unit-length sample: at most 2 x PER_CLASS x DIMS floats, which is
what gets broadcast.  ``score`` projects every whole text, takes exact
cosine products with the whole sample in blocks and lets the ``NEIGHBOURS``
nearest vote, weighted by similarity and by how common their class is.

Defined cases: null and empty texts have no terms and get the share of
class one as score; without a labelled document of both classes every score
is that share; all that tie with the last neighbour vote too; repeated rows
each keep a row; null ids count as held out;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import CHUNK_BYTES, chunks, joined, map_batches, span_hashes, text_bytes
from ledgerlens.llm.labelled import held_out, sample

BINS = 1024
DIMS = 48
PER_CLASS = 2000
NEIGHBOURS = 25
THRESHOLD = 0.3
_BLOCK = 512
SHAPES = 4
SHAPE_WEIGHT = 1.5


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # (BINS + SHAPES) x DIMS
    vectors: np.ndarray  # sample x DIMS, unit length
    labels: np.ndarray
    share: float  # of class one among all labelled documents


def shapes(texts: list[bytes]) -> np.ndarray:
    """Documents x SHAPES shares, 0 to 1."""
    out = np.zeros((len(texts), SHAPES), np.float32)
    for lo, hi in chunks([len(t) + 1 for t in texts]):
        data, at = joined(texts[lo:hi], b" ")
        word = data > 32
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        n = hi - lo
        doc = np.searchsorted(at, starts, "right") - 1
        words = np.maximum(np.bincount(doc, minlength=n), 1)
        h = span_hashes(data, starts, ends)
        again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out[lo:hi, 0] = np.bincount(doc[1:][again], minlength=n) / words
        order = np.lexsort((h, doc))
        known = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        out[lo:hi, 1] = np.bincount(doc[order][1:][known], minlength=n) / words
        size = np.maximum(np.diff(at) - 1, 1)
        for k, mask in ((2, (data >= 65) & (data <= 90)), (3, word & ~((data >= 48) & (data <= 57) | (data >= 65) & (data <= 90) | (data >= 97) & (data <= 122) | (data >= 128)))):
            out[lo:hi, k] = np.add.reduceat(mask.astype(np.int64), at[:-1]) / size
    return out


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Documents x (BINS trigram counts, SHAPES shares).  Long documents are counted piece by piece."""
    return np.hstack([_trigrams(texts), shapes(texts)])


def _trigrams(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), BINS), np.float32)
    data, at = joined(texts, b"\n\n")
    for lo in range(0, len(data) - 2, CHUNK_BYTES):
        part = data[lo:lo + CHUNK_BYTES + 2].astype(np.uint32)
        h = (part[:-2] * np.uint32(0x9E3779B1)) ^ (part[1:-1] * np.uint32(0x85EBCA77)) ^ (part[2:] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        bins = (h >> np.uint32(22)).astype(np.int64)
        doc = np.searchsorted(at, np.arange(lo, lo + len(bins)), "right") - 1
        inside = np.arange(lo, lo + len(bins)) + 2 < at[doc + 1] - 2  # the whole trigram lies in the text
        first, last = int(doc[0]), int(doc[-1])
        flat = np.bincount((doc[inside] - first) * BINS + bins[inside], minlength=(last - first + 1) * BINS)
        out[first:last + 1] += flat.reshape(-1, BINS)
    return out


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = np.log1p(counts[:, :BINS]) * idf
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
    return np.hstack([w, SHAPE_WEIGHT * np.sqrt(counts[:, BINS:])])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    rows, share = sample(docs, labels, label, per_class)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = term_counts(text_bytes(batch.column(2))).astype("<f4")
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in counts], pa.binary())], ["id", "y", "terms"])

    got = map_batches(rows, run, "id long, y int, terms binary", sized_by=2).toArrow().to_pydict()
    order = np.argsort(np.array(got["id"], np.int64), kind="stable")
    counts = np.array([np.frombuffer(t, "<f4") for t in got["terms"]], np.float32).reshape(-1, BINS + SHAPES)[order]
    y = np.array(got["y"], np.int64)[order]
    idf = (np.log((1 + len(y)) / (1 + (counts[:, :BINS] > 0).sum(axis=0))) + 0.1).astype(np.float32)
    w = weights(counts, idf)
    # Subspace iteration for the leading right singular vectors.
    q = np.random.default_rng(7).standard_normal((BINS + SHAPES, DIMS + 16)).astype(np.float32)
    for _ in range(8):
        q, _ = np.linalg.qr(w.T @ (w @ q)) if len(y) else (q, None)
    if len(y):
        _, _, vt = np.linalg.svd(w @ q, full_matrices=False)
        q = q @ vt.T
    basis = np.ascontiguousarray(q[:, :DIMS], dtype=np.float32)
    return Model(idf, basis, unit(w @ basis).astype(np.float32), y, share)


def votes(model: Model, counts: np.ndarray) -> np.ndarray:
    out = np.full(len(counts), model.share)
    if len(set(model.labels.tolist())) < 2:
        return out
    n1 = int(model.labels.sum())
    # The sample takes either class alike, the vote counts it at its own frequency's root.
    odds = np.sqrt(np.array([(1 - model.share) / (len(model.labels) - n1), model.share / n1]))
    k = min(NEIGHBOURS, len(model.labels))
    full = np.flatnonzero(counts[:, :BINS].sum(axis=1) > 0)
    for lo in range(0, len(full), _BLOCK):
        at = full[lo:lo + _BLOCK]
        near = unit(weights(counts[at], model.idf) @ model.basis) @ model.vectors.T
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        doc, voter = np.nonzero(near >= last[:, None])
        w = np.clip(near[doc, voter], 1e-6, None) ** 4 * odds[model.labels[voter]]
        out[at] = np.bincount(doc, w * model.labels[voter], len(at)) / np.bincount(doc, w, len(at))
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = votes(held.value, term_counts(text_bytes(batch.column(1))))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return (map_batches(rows, run, "doc_id long, score double", sized_by=1)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
