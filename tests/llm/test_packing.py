import random

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import EDGE, SF001, edge, frame, nothing  # noqa: F401
from tokenizers import Tokenizer

from ledgerlens.llm import packing
from ledgerlens.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return packing.Encoder(f.read())


def held(pieces, width=packing.WIDTH):
    """Pieces as {doc rows}, after checking that sequences have no gaps and no padding."""
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    assert sorted(by) == list(range(len(by)))
    for seq, ps in by.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == width or at < width and at & (at - 1) == 0
        assert at == width or seq >= len(by) - width.bit_length()


def texts_of(pieces):
    """Sorted (doc_id, ids) of documents, repeated rows included, from their pieces in stream order."""
    out, cur = [], []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.start == len(cur)
        cur += np.frombuffer(p.ids, "<u4").tolist()
        if len(cur) == p.doc_tokens:
            out.append((p.doc_id, cur))
            cur = []
    assert not cur
    return sorted(out, key=repr)


def test_whole_table_is_packed_as_the_library_encodes(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = packing.pack(docs.repartition(5), PATH).collect()
    held(rows)
    assert texts_of(rows) == sorted(((r.doc_id, [*library(r.text or ""), 1]) for r in docs.collect()), key=repr)


def test_edge_rows(edge, library):  # noqa: F811
    rows = packing.pack(edge, PATH).collect()
    held(rows)
    assert texts_of(rows) == sorted(((d, [*library(t or ""), 1]) for d, t in EDGE), key=repr)


def test_empty_table(nothing):  # noqa: F811
    assert packing.pack(nothing, PATH).collect() == []


@pytest.mark.parametrize("width", [1, 2, 8, 64])
def test_any_width(spark, library, width):
    rows = packing.pack(frame(spark, [(i, "ab c" * (i % 7)) for i in range(40)]).repartition(6), PATH, width=width).collect()
    held(rows, width)
    assert [d for d, _ in texts_of(rows)] == sorted(range(40), key=lambda i: repr((i, [*library("ab c" * (i % 7)), 1])))


def test_width_is_a_power_of_two(edge):  # noqa: F811
    with pytest.raises(ValueError):
        packing.pack(edge, PATH, width=100)


def test_ids_equal_the_library_on_hard_strings(encoder, library):
    rng = random.Random(7)
    alphabet = ["a", "Z", " ", "  ", "\n", "\t", "'s", "'LL", "9", "é", "漢", " ", " ", "\U0001F44D", "\x00", ".", "<|endoftext|>", "ß", "́", "½", "﻿"]
    for _ in range(2000):
        s = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert encoder.ids(s).tolist() == library(s), repr(s)


def test_ids_equal_the_library_on_every_code_point(encoder, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 512):
        s = " ".join(f"a{c}b 1{c}2 .{c}." for c in points[a:a + 512])
        assert encoder.ids(s).tolist() == library(s), a


def test_parts_change_nothing(encoder, library):
    rng = random.Random(3)
    text = "".join(rng.choices(["word", " ", "  ", "\n", ".", "it's", "é", "   "], k=4000))
    cut = list(packing.parts(text, 50))
    assert "".join(cut) == text and len(cut) > 100
    assert [i for p in cut for i in library(p)] == library(text)


def test_one_very_long_word_and_blank_run(encoder):
    import time

    began = time.time()
    assert len(encoder.ids("ab" * 500_000)) > 0 and len(encoder.ids(" " * 1_000_000)) > 0
    assert time.time() - began < 60


def test_sequences_hold_their_pieces(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(40)
    pieces = packing.pack(docs, PATH).cache()
    got = {r.sequence_id: bytes(r.input_ids) for r in packing.sequences(pieces).collect()}
    want = {}
    for p in sorted(pieces.collect(), key=lambda p: (p.sequence_id, p.offset)):
        want[p.sequence_id] = want.get(p.sequence_id, b"") + bytes(p.ids)
    assert got == want and all(len(v) == 4 * 2048 for k, v in got.items() if k < len(got) - 12)


def test_query_columns(spark):
    import zlib

    rows = QUERIES["op13_packing"](spark, SF001)
    assert rows.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = packing.pack(spark.read.parquet(f"{SF001}/documents.parquet"), PATH).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in rows.collect()) == sorted((p.doc_id, p.start, zlib.crc32(p.ids)) for p in pieces)
