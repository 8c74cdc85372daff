import hashlib
import json
import random
import time

import numpy as np
import pytest
from llm_helpers import SF001, edge, nothing, small  # noqa: F401

from ledgerlens.llm import bpe
from ledgerlens.llm.queries import QUERIES, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def want(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


HARD = ["", " ", "Hello's WORLD'S don't I'll 'sx''s", "a<|endoftext|>b<|startoftext|><|endoftext", "aaaaaaaaaaaaaaa aaaa lllllll !!!!!!!!! ----- .......... ??!!",
        "ΟΔΟΣ Σ σς İstanbul ǅ", "é é ﬁ Å ½ Ⅷ ٣ 1234", "漢字 हिन्दी 👍🏽 \x85  x　y", "a\x1cb\x1f c", "</w> a</w>b <w", "x" * 5000, "\x00\x01 \x7f ₹ ﻿"]


def test_automaton_equals_the_library(library):
    r = random.Random(3)
    t = bpe.Tokenizer(open(tokenizer_path(), "rb").read())
    texts = HARD + ["".join(r.choices(a, k=300)) for a in ("abehilnorst ", "aab", "esESéÉ'.!? ", "-=_*#", "thein ") for _ in range(25)]
    for text in texts:
        ids, decoded = want(library, text)
        got = t.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids, text[:60]
        assert t.decode(got) == decoded


def test_every_code_point_equals_the_library(library):
    t = bpe.Tokenizer(open(tokenizer_path(), "rb").read())
    texts = [f"a{chr(c)}b {chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 20_000):
        some = texts[at:at + 20_000]
        for text, e in zip(some, library.encode_batch(some, add_special_tokens=False)):
            assert np.frombuffer(t.encode(text), "<u4").tolist() == e.ids, ascii(text)


def test_one_very_long_word_takes_linear_time(library):
    t = bpe.Tokenizer(open(tokenizer_path(), "rb").read())
    word = "".join(random.Random(5).choices("abehilnorst", k=1_000_000))
    start = time.process_time()
    ids = np.frombuffer(t.encode(word), "<u4").tolist()
    assert time.process_time() - start < 20  # a square of the length takes longer by far
    assert ids == want(library, word)[0]


def test_words_with_equal_ends_share_their_search(monkeypatch):
    t = bpe.Tokenizer(open(tokenizer_path(), "rb").read())
    walks, walk = [], bpe.Automaton._arcs
    monkeypatch.setattr(bpe.Automaton, "_arcs", lambda self, word, a: walks.append(word) or walk(self, word, a))
    r = random.Random(6)
    ends = ["".join(r.choices("bcdfghjklmnpqrtvwxz", k=24)) for _ in range(20)]
    words = [a + b + e for e in ends for a in "qxz" for b in "jkvw"]
    ids = t.encode(" ".join(words))
    assert len(walks) < len(ids) // 8  # walks from fewer than half of the places where a token begins
    assert ids == b"".join(np.array(t.automaton.encode(w), "<u4").tobytes() for w in words)


@pytest.mark.parametrize("kept", [2, 40])
def test_ids_do_not_depend_on_what_is_kept(library, monkeypatch, kept):
    monkeypatch.setattr(bpe, "CACHE_WORDS", kept)
    monkeypatch.setattr(bpe, "SHORT", 12)
    t = bpe.Tokenizer(open(tokenizer_path(), "rb").read())
    r = random.Random(7)
    words = ["".join(r.choices("abehilnorst", k=r.randint(1, 30))) for _ in range(60)] + ["it's", "3rd,", "naïve", "x1y2", "ΟΔΟΣ"]
    for _ in range(40):
        text = " ".join(r.choices(words, k=50))
        assert np.frombuffer(t.encode(text), "<u4").tolist() == want(library, text)[0]
        assert len(t.chunks) <= kept + 50 and len(t.older) <= kept + 50


def test_added_tokens_of_other_kinds_are_refused():
    conf = json.load(open(tokenizer_path()))
    conf["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        bpe.Tokenizer(json.dumps(conf).encode())


def test_arcs_are_the_compatible_pairs(library):
    """The automaton has arc b after a exactly if encoding their joined symbols gives the two tokens back."""
    t = bpe.Tokenizer(open(tokenizer_path(), "rb").read()).automaton
    r = random.Random(4)
    inner = [i for s, i in t.vocab.items() if not s.endswith("</w>")]
    final = [(s, i) for s, i in t.vocab.items() if s.endswith("</w>")]
    label = {i: s for s, i in t.vocab.items()}
    for _ in range(2000):
        a, (s, b) = r.choice(inner), r.choice(final)
        word = label[a] + s[:-4]
        assert t.arc(a, b) == (t.encode(word) == [a, b])


def test_query_equals_the_library(spark, small, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op5_bpe_automaton"](spark, SF001).collect()}
    for i, text in small:
        ids, decoded = want(library, text)
        assert got.pop(i) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert not got


def test_edge_rows(edge, nothing, library):
    rows = bpe.round_trip(edge, tokenizer_path()).collect()
    assert len(rows) == edge.count()
    texts = {}
    for r in edge.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for r in rows:
        assert any(np.frombuffer(bytes(r.ids), "<u4").tolist() == want(library, t)[0] and r.decoded == want(library, t)[1] for t in texts[r.id])
    assert bpe.round_trip(nothing, tokenizer_path()).collect() == []
