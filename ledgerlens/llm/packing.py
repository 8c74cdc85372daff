"""Concatenate and cut: documents' token ids as one stream, cut at fixed windows.

Pass one encodes every document (a row's ids, then the end id) and stages
the rows in the shared folder, which fixes their partitions and order; the
token totals of the partitions, one number each, are summed up on the driver
and give every partition its place in the stream.  Pass two walks each
partition with a running sum, so a document's place is known without a
shuffle, and cuts it where a window of ``width`` tokens ends.  A piece
carries the document's id and offsets (the boundary record).

All windows are full but those of the last ``total % width`` tokens: these
are cut into windows of falling powers of two, so that no sequence holds any
padding.  ``sequences`` puts the pieces of each sequence together.

Ids are those of the tokenizers library.  A byte-level file's ranks are read
from its vocabulary and walked by tiktoken, which gives the same ids several
times faster (tests compare them over all code points); texts that hold an
added token's string or a run of ``LONG_RUN`` characters without a break go
through tokenizers itself.  Long texts are encoded in parts, cut before a
blank that follows a visible ASCII character, where no token can reach over.

Defined cases: a null text is empty, an empty text has only its end id; a
null doc_id stays null; repeated rows are documents of their own; an empty
table gives no pieces; other columns are never read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_batches, stage

WIDTH, END_ID = 2048, 1
#: Characters of one encoding call, and the run of letters, digits, marks or white space that tokenizers' heap takes better.
PART, LONG_RUN = 1 << 20, 1000
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=[!-~])(?= )")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters whose ids, in a row, are those of the whole."""
    at = 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


class Encoder:
    """Ids of a byte-level BPE file, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, content: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(content)
        self.slow.no_truncation()
        self.slow.no_padding()
        spec = json.loads(content)
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError("packing reads byte-level BPE files without a normalizer")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in model["vocab"].items() if token not in added}
        self.quick = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("|".join([*map(re.escape, sorted(added)), rf"(?<!\S)\S{{{LONG_RUN}}}", rf"\s{{{LONG_RUN}}}"]))

    def ids(self, text: str) -> np.ndarray:
        if self.odd.search(text):
            return np.array([i for p in parts(text) for i in self.slow.encode(p, add_special_tokens=False).ids], np.uint32)
        return np.concatenate([self.quick.encode_to_numpy(p, disallowed_special=()) for p in parts(text)]).astype(np.uint32)


@lru_cache(maxsize=2)
def _encoder(content: str) -> Encoder:
    return Encoder(content)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): every document's ids and the end id, as little-endian unsigned 32-bit integers."""
    with open(tokenizer_path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed size, some MB

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(held.value)
        end = np.array([end_id], "<u4").tobytes()
        out = [encoder.ids(t or "").astype("<u4").tobytes() + end for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, ids binary", sized_by=1)


def windows(total: int, width: int = WIDTH) -> np.ndarray:
    """Where the windows after the last full one start, and the end: falling powers of two."""
    at, rest = total - total % width, total % width
    edges = [at]
    while rest:
        step = 1 << (rest.bit_length() - 1)
        at, rest = at + step, rest - step
        edges.append(at)
    return np.array(edges, np.int64)


def cut(start: int, n: int, width: int, tail: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset in it) of the pieces of the ``n`` tokens from ``start`` of the stream."""
    out, at, end, full = [], start, start + n, int(tail[0])
    while at < end:
        if at < full:
            seq, low = at // width, at - at % width
            high = low + width
        else:
            i = int(np.searchsorted(tail, at, "right")) - 1
            seq, low, high = full // width + i, int(tail[i]), int(tail[i + 1])
        stop = min(end, high)
        out.append((at - start, stop - at, seq, at - low))
        at = stop
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
         end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), one row per piece."""
    if width < 1 or width & (width - 1):
        raise ValueError("width must be a power of two")
    rows = stage(encode(docs, tokenizer_path, id_col, text_col, end_id)).select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    totals = rows.groupBy("part").agg((F.sum(F.length("ids")) / 4).cast("long").alias("n")).collect()  # a number a partition
    base, total = {}, 0
    for part, n in sorted((r.part, r.n) for r in totals):
        base[part], total = total, total + n
    held, tail = docs.sparkSession.sparkContext.broadcast(base), windows(total, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            out: list[tuple] = []
            pieces: list[bytes] = []
            size = 0
            for part, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                at = held.value[part] if at is None else at
                raw = memoryview(ids.as_buffer())
                n = len(raw) // 4
                for start, length, seq, offset in cut(at, n, width, tail):
                    out.append((doc, start, length, n, seq, offset))
                    pieces.append(bytes(raw[4 * start:4 * (start + length)]))
                at, size = at + n, size + len(raw)
                if size >= 1 << 22:
                    yield _batch(out, pieces)
                    out, pieces, size = [], [], 0
            if out:
                yield _batch(out, pieces)

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _batch(rows: list[tuple], ids: list[bytes]) -> pa.RecordBatch:
    doc, start, length, n, seq, offset = (pa.array(c, pa.int64()) for c in zip(*rows))
    return pa.RecordBatch.from_arrays([doc, start, length, pa.array(ids, pa.binary()), n, seq, offset],
                                      ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, input_ids binary, pieces): each sequence's ids in order and its boundary records.

    A sequence has at most ``width`` pieces, so its group is small by nature.
    """
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return (pieces.groupBy("sequence_id").agg(held.alias("p"))
            .select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"),
                    F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("input_ids"),
                    F.transform("p", lambda x: F.struct(x["offset"], x["doc_id"], x["start"], x["length"])).alias("pieces")))
