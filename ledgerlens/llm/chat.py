"""Chat formatting with offset-aligned loss masks.

A conversation's rows, ordered by turn (then role and text), are rendered
whole:

    <turn>role
    text</turn>

Inside roles and texts a backslash goes before every backslash and before
the ``<`` of a control string, and a role's line break is written ``\\n``, so
``read_back`` restores the turns from the rendered string alone.

The rendered conversation is encoded once, with offsets (code points; bytes
of one code point share its offset).  Turn spans and token spans are both
sorted, so two binary searches find the tokens that a turn's text touches;
their offsets, clipped to the turn, make the loss spans, and the tokens
make the loss mask.

Defined cases: null text or role is the empty string; a null turn sorts
first; a null conv_id is a conversation of its own; repeated rows are turns
of their own; an empty table gives an empty result.  A conversation is one
value, so its rows come together in one task by nature.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_batches

OPEN, CLOSE = "<turn>", "</turn>"
LOSS_ROLES = ("assistant",)
_CONTROL = re.compile(r"\\|<(?=/?turn>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn>((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/?turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """(rendered string, (role, start, end) of every turn's text in it)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}".replace("\n", "\\n") + "\n", escape(text)
        spans.append((role, at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{CLOSE}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a rendered conversation at {at}")
        role = _ESCAPED.sub(lambda e: "\n" if e[1] == "n" else e[1], m[1])
        turns.append((role, unescape(m[2])))
        at = m.end()
    return turns


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(mask per token, loss spans): tokens meeting the sorted ``spans`` and their offsets clipped to them."""
    mask = np.zeros(len(starts), bool)
    out: list[tuple[int, int]] = []
    for a, b in spans:
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if lo >= hi or a == b:
            continue
        mask[lo:hi] = True
        s, e = np.maximum(starts[lo:hi], a), np.minimum(ends[lo:hi], b)
        gap = np.flatnonzero(s[1:] > np.maximum.accumulate(e)[:-1]) + 1
        first = np.concatenate([[0], gap])
        out += [(int(s[i]), int(e[i:j].max())) for i, j in zip(first, [*gap, len(s)])]
    return mask, out


@lru_cache(maxsize=2)
def _tokenizer(content: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content)
    t.encode_special_tokens = True  # control strings of the vocabulary are ordinary text
    t.no_truncation()
    t.no_padding()
    return t


def format_conversations(convs: DataFrame, tokenizer_path: str, loss_roles: Sequence[str] = LOSS_ROLES) -> DataFrame:
    """(conv_id, n_turns, formatted, input_ids, loss_mask, loss_spans), one row per conversation."""
    with open(tokenizer_path, encoding="utf-8") as f:
        held = convs.sparkSession.sparkContext.broadcast(f.read())  # a fixed size, some MB
    roles = set(loss_roles)
    rows = (convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
            .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
            .select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = _tokenizer(held.value)
        out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "formatted", "input_ids", "loss_mask", "loss_spans")}
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            formatted, spans = render(list(zip(role, text)))
            enc = t.encode(formatted, add_special_tokens=False)
            offsets = np.array(enc.offsets, np.int64).reshape(-1, 2)
            mask, loss = masked(offsets[:, 0], offsets[:, 1], [(a, b) for r, a, b in spans if r in roles])
            for k, v in zip(out, (conv, len(role), formatted, enc.ids, mask.astype(np.int8), [{"start": a, "end": b} for a, b in loss])):
                out[k].append(v)
        return pa.RecordBatch.from_arrays([
            pa.array(out["conv_id"], pa.int64()), pa.array(out["n_turns"], pa.int64()), pa.array(out["formatted"], pa.string()),
            pa.array(out["input_ids"], pa.list_(pa.int32())), pa.array(out["loss_mask"], pa.list_(pa.int8())),
            pa.array(out["loss_spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], list(out))

    def small(batches):
        for batch in batches:  # a few conversations at a time
            for a in range(0, batch.num_rows, 64):
                yield run(batch.slice(a, 64))

    return rows.mapInArrow(small, "conv_id long, n_turns long, formatted string, input_ids array<int>, loss_mask array<tinyint>, "
                                  "loss_spans array<struct<start:int,end:int>>")


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from ``format_conversations``: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            turns = read_back(text)
            loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
            rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_batches(formatted.select("conv_id", "formatted", "loss_spans"), run,
                       "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
