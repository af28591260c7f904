"""op7: refinement against brute force, equal texts, repeated rows and null ids."""

import random

import numpy as np

from weftgraph.llm import op7_repeats

from . import cases
from .test_big_ops import query


def test_refine():
    rng = random.Random(9)
    length, side, q = op7_repeats.LENGTH, op7_repeats.SIDE, op7_repeats.Q
    for letters in ("ab", "abcdefgh"):
        rows = []
        for bucket in range(6):
            base = bytearray("".join(rng.choice(letters) for _ in range(2 * side + q)).encode())
            for _ in range(rng.randint(1, 9)):
                own = bytearray(base)
                for _ in range(rng.choice([0, 1, 2])):
                    k = rng.choice([*range(side), *range(side + q, len(base))])
                    own[k] = ord(rng.choice(letters))
                low, high = rng.choice([0, 0, 20]), rng.choice([len(base), len(base), 150])
                rows.append((bucket, bytes(own[low:high]), side - low))
        found = op7_repeats.refine(np.array([r[0] for r in rows]), [r[1] for r in rows], np.array([r[2] for r in rows]))
        seen = set()
        for n, (bucket, around, at) in enumerate(rows):
            for offset in range(side + 1):
                start = offset - (side - at)
                window = around[start : start + length] if start >= 0 else b""
                if len(window) < length:
                    assert not found[n, offset]
                    continue
                assert found[n, offset] == ((bucket, offset, window) in seen)
                seen.add((bucket, offset, window))


def test_equal_texts(spark, monkeypatch):
    rng = random.Random(3)
    a, b = cases.prose(rng, 60), cases.prose(rng, 70)
    data = [(5, a), (5, a), (3, a), (9, a), (1, b), (None, b), (None, b), (4, "x" + b), (6, None), (None, None), (7, b), (8, "z" * 99), (2, a[:150] + b[:99])]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in query(monkeypatch, spark, "op7_repeats", cases.frame(spark, data)).collect())
    n, m = len(a), len(b)
    # doc 2 comes before doc 3, null before 1
    want = [(-1, 0, 0, 0), (-1, m, 0, 0), (-1, m, 0, 0), (1, m, m, 1), (2, 249, 0, 0), (3, n, 150, 1), (4, m + 1, m, 1), (5, n, n, 1), (5, n, n, 1), (6, 0, 0, 0), (7, m, m, 1), (8, 99, 0, 0), (9, n, n, 1)]
    assert got == want


def test_one_id_on_two_texts(spark, monkeypatch):
    rng = random.Random(4)
    a = cases.prose(rng, 60)
    rows = query(monkeypatch, spark, "op7_repeats", cases.frame(spark, [(1, a + " one"), (1, a + " two"), (2, a)])).collect()
    removed = sorted((r.doc_id, r.n_removed) for r in rows)
    assert removed[2] == (2, len(a)) and removed[0] == (1, 0) and removed[1] == (1, len(a) + 1)
