import random

import pytest
from llm_helpers import LONG, SF001, edge, frame, nothing, small  # noqa: F401

from ledgerlens.llm import linedup
from ledgerlens.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    r = random.Random(2)
    for _ in range(4000):
        a = bytes(r.choices(b"ab", k=r.randint(0, 9)))
        b = bytearray(a)
        for _ in range(r.randint(0, 4)):
            at = r.randint(0, len(b))
            b[at:at + r.randint(0, 1)] = r.choice([b"a", b"c", b""])
        for most in (1, 2, 3):
            assert linedup.within(a, bytes(b), most) == (distance(a, bytes(b)) <= most)


def brute(rows, min_bytes=24, exact_bytes=1):
    """Exact reference over (id, text) rows with distinct ids: texts without later lines of a class."""
    every = [(i, k, x.strip(" \t\r\x0b\x0c").encode()) for i, t in sorted(rows) for k, x in enumerate(t.split("\n"))]
    occ = [(i, k, x) for i, k, x in every if len(x) >= exact_bytes]
    lines = sorted({x for _, _, x in occ}, key=len)
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1:] if len(a) >= min_bytes else ():
            if len(b) - len(a) > 2:
                break
            if abs(sum(a) - sum(b)) <= 510 and linedup.within(a, b, 2):
                parent[find(b)] = find(a)
    seen, drop = set(), {}
    for i, k, line in occ:
        c = find(line)
        if c in seen:
            drop.setdefault(i, set()).add(k)
        seen.add(c)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop.get(i, ())) for i, t in rows}


def test_query_equals_brute_force(spark, small):
    import hashlib

    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in brute(small).items()}
    got = {r.doc_id: r.kept_sha256 for r in QUERIES["op8_line_dedup"](spark, SF001).collect()}
    assert got == want


def test_variants_of_lines(spark):
    """Lines with up to four edits anywhere, lengths from the least on, and multi-byte letters."""
    r = random.Random(9)
    base = ["".join(r.choices("abcdefg é", k=n)) for n in (24, 25, 26, 31, 60, 61, 200)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(r.randint(1, 4)):
            t = list(r.choice(base))
            for _ in range(r.randint(0, 4)):
                at = r.randint(0, len(t))
                t[at:at + r.randint(0, 1)] = r.choice([["x"], ["é"], []])
            lines.append("".join(t))
        rows.append((i, "\n".join(lines)))
    for exact in (1, 24):
        got = {x.doc_id: x.text for x in linedup.dedup(frame(spark, rows), exact_bytes=exact).collect()}
        assert got == brute(rows, exact_bytes=exact)


def test_short_lines_are_taken_out_as_exact_copies(spark):
    """With ``exact_bytes``; lines that differ by one byte and blank ones stay, and the others go as before."""
    long = "a line of more than twenty-four bytes"
    rows = [(1, f"Les.\n\nLea.\n{long}"), (2, f" Les.\t\n\nNew.\n{long}!"), (3, f"Les.\n\nNew\nLea.\n{'x' * 23}\n{'x' * 22}y"), (4, f"é\nNew.\n{'x' * 23}\né")]
    got = {x.doc_id: (x.text, x.removed_lines) for x in linedup.dedup(frame(spark, rows), exact_bytes=1).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\n\nNew."[1:], 2), 3: (f"\nNew\n{'x' * 23}\n{'x' * 22}y", 2), 4: ("é", 3)}
    got = {x.doc_id: x.text for x in linedup.dedup(frame(spark, rows), exact_bytes=5).collect()}
    assert got[2] == " Les.\t\n\nNew." and got[4] == "é\nNew.\né"
    assert {x.doc_id: x.text for x in linedup.dedup(frame(spark, rows)).collect()} == brute(rows, exact_bytes=24)


@pytest.mark.parametrize("edits", range(3))
def test_a_pair_meets_under_some_key(spark, edits):
    r = random.Random(edits)
    for n in (24, 25, 40, 100):
        a = bytes(r.choices(b"abcdefghij", k=n))
        for _ in range(10):
            b = bytearray(a)
            for _ in range(edits):
                at = r.randint(0, len(b))
                b[at:at + r.randint(0, 1)] = r.choice([b"z", b""])
            rows = brute([(1, a.decode()), (2, bytes(b).decode())], exact_bytes=24)
            assert rows[2] == ("" if len(b) >= 24 else bytes(b).decode())


def test_edge_rows(spark, edge, nothing):
    out = linedup.dedup(edge)
    assert out.columns == [*edge.columns, "removed_lines"]
    rows = [(r.doc_id, r.text, r.removed_lines) for r in out.collect()]
    assert len(rows) == edge.count()
    assert (3, None, 0) in rows and (2, "", 0) in rows and (6, " \t\n\x0b ", 0) in rows
    alpha = [(i, n) for i, t, n in rows if i in (1, 4, None)]
    assert sorted(alpha, key=repr) == sorted([(1, 0), (4, 1), (4, 1), (None, 1)], key=repr)
    assert (5, LONG, 0) in rows
    assert linedup.dedup(nothing).collect() == []
