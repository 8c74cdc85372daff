"""The corpus pipeline against plain Python on the smallest table, and its defined cases."""

import hashlib

import corpus_pipeline as P
import numpy as np
from llm_helpers import SF001, edge, nothing, small  # noqa: F401
from test_linedup import brute as brute_lines
from test_simhash import brute_classes, brute_print

from ledgerlens.llm.queries import tokenizer_path


def test_run_equals_plain_python(spark, small):
    import tokenizers

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    kept = {r.doc_id for r in P.drop_toxic(spark, docs, SF001).select("doc_id").collect()}
    assert len(kept) >= 0.8 * len(small)
    texts = brute_lines([(i, t) for i, t in small if i in kept])
    ids = sorted(texts)
    roots = brute_classes([brute_print(texts[i]) for i in ids])
    first = {}
    for i, root in zip(ids, roots):
        first.setdefault(root, i)
    items = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    left = [i for i in sorted(first.values()) if not any(t in texts[i] for t in items)]
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = {}
    for i in left:
        enc = library.encode(texts[i], add_special_tokens=False).ids
        want[i] = (len(enc), np.array(enc, "<u4").tobytes(), hashlib.sha256(library.decode(enc, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in P.run(spark, SF001).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, edge, nothing):
    for docs in (edge, nothing):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF001)
            assert out.dtypes == docs.dtypes, name
            assert out.count() <= docs.count()
        assert P.tokenize(spark, docs, SF001).count() == docs.count()


def test_n_chars_follows_the_text(spark, edge):
    for r in P.drop_repeated_lines(spark, edge, SF001).collect():
        assert r.n_chars == (len(r.text) if r.text is not None else None)
