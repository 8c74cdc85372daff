import re

import xxhash
from llm_helpers import SF001, edge, frame, nothing, small  # noqa: F401

from ledgerlens.llm import simhash
from ledgerlens.llm.queries import QUERIES


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_query_equals_brute_force(spark, small):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_neardup"](spark, SF001).collect()}
    prints = [brute_print(t) for _, t in small]
    roots = brute_classes(prints)
    first = {}
    for (i, _), root in zip(small, roots):
        first[root] = min(first.get(root, i), i)
    assert got == {i: (f"{p:016x}", first[r]) for (i, _), p, r in zip(small, prints, roots)}


def test_links_at_every_distance_and_chain(spark):
    """Fingerprints 0 to 6 bits apart, in either segment and across both; a hub with many neighbours."""
    base = 0x0123_4567_89AB_CDEF
    prints = [base, base ^ 0xF, base ^ (0xF << 60), base ^ 0x8000_0001_0001_0001, base ^ 0x3F_0000, base ^ 0x1F << 20, base ^ 0xF ^ 0xF00]
    prints += [(base * 7 + k) % 2**64 ^ 1 << k for k in range(64)]
    signed = [p - 2**64 if p >> 63 else p for p in dict.fromkeys(prints)]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    root = {r.node: r.root for r in simhash.links(df, 4).collect()}
    classes = brute_classes([s % 2**64 for s in signed])
    for i, a in enumerate(signed):
        for j, b in enumerate(signed[:i]):
            assert (root.get(a, a) == root.get(b, b)) == (classes[i] == classes[j])


def test_edge_rows(spark, edge, nothing):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = "0" * 16
    assert by[2, zero] == by[3, zero] == by[6, zero] == 2  # empty, null and blank texts link like any other
    alpha = {r.fingerprint for r in rows if r.doc_id in (1, None)}
    assert len(alpha) == 1 and by[None, alpha.pop()] == 1
    assert simhash.near_duplicates(nothing).collect() == []
    lone = simhash.near_duplicates(frame(spark, [(None, "x")])).collect()
    assert [(r.doc_id, r.component_id) for r in lone] == [(None, None)]


def test_keep_first_keeps_one_row_a_class(spark, edge, nothing):
    kept = simhash.keep_first(edge)
    assert kept.columns == edge.columns
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    assert [g[0] for g in got if g[1] and g[1].startswith("Alpha")] == [1]
    assert [g[0] for g in got if not (g[1] or "").strip()] == [2]
    assert simhash.keep_first(nothing).collect() == []
    only = simhash.keep_first(frame(spark, [(4, "a b c d e"), (4, "a b c d e")])).collect()
    assert len(only) == 1
