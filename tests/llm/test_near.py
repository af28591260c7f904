"""op4: exact stages against brute force, rows that share a doc_id, and what the pipeline keeps."""

import random

import numpy as np

from weftgraph.llm import op4_near, shingles

from . import cases
from .test_big_ops import near_rows, query


def test_across(spark):
    rng = np.random.default_rng(5)
    sets = []
    for group in range(12):
        base = rng.integers(0, 1 << 62, rng.integers(3, 90))
        for _ in range(12):
            own = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 62, rng.integers(0, 12))])))
    sets = [s for s in sets if len(s)]
    rows = [(i, i % 3, len(s), bytearray(s.astype(np.uint64).tobytes())) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, component long, n long, own binary")
    pairs = op4_near.across(df)
    got = {(r.a, r.b) for r in op4_near.confirm(pairs, df).collect()}
    want = set()
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(x, sets[j]))
            if i % 3 != j % 3 and 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                want.add((i, j))
    assert want and got == want
    assert pairs.count() < len(sets) ** 2 / 8  # the filter works


def test_shared_ids(spark, monkeypatch):
    rng = random.Random(4)
    a, b = cases.prose(rng, 120), cases.prose(rng, 130)
    data = [(1, a), (1, b), (2, b + " more"), (2, b + " more"), (3, "other words than these"), (9, None), (9, "")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in query(monkeypatch, spark, "op4_near", cases.frame(spark, data)).collect()}
    n = [len(x) for x in shingles.shingle_sets([a, b, b + " more"], 2)]
    assert got == {(1, n[0], 1), (1, n[1], 1), (2, n[2], 1), (3, 3, 3), (9, 0, 9)}
    kept = op4_near.first_of_each(cases.frame(spark, data), 2)
    assert kept.columns == ["doc_id", "text", *cases.CLASHES]
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(1, a), (1, b), (3, data[4][1]), (9, "")])


def test_first_of_each(spark):
    data = near_rows()
    kept = op4_near.first_of_each(cases.frame(spark, data), 2).collect()
    found = op4_near.near_duplicates(cases.frame(spark, data), 2).collect()
    heads = {r.component_id for r in found if r.component is not None}
    assert {r.doc_id for r in kept if r.doc_id is not None} == heads | {r.doc_id for r in found if r.n_shingles == 0 and r.doc_id is not None}
    assert sum(r.doc_id is None for r in kept) == sum(i is None for i, _ in data)
    assert op4_near.first_of_each(cases.empty(spark), 2).count() == 0


def test_large_isolated_group(spark):
    """A large group of near copies with members that are linked to nothing: pairs stay in proportion to members."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    data = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 12, 14])):  # the last two are too many to be linked
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
        data.append((i, " ".join(w)))
    sets = [set(x.tolist()) for x in shingles.shingle_sets([t for _, t in data], 2)]
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    df = spark.createDataFrame(data, "doc_id long, text string")
    made, confirm = [], op4_near.confirm
    op4_near.confirm = lambda pairs, sets: made.append(pairs.count()) or confirm(pairs, sets)
    try:
        got = {r.doc_id: r.component_id for r in op4_near.near_duplicates(df, 2).collect()}
    finally:
        op4_near.confirm = confirm
    assert got == {i: root(i) for i in range(len(data))}
    assert sum(made) < 400 * 12


def test_batches_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 3_000_000, 3_000_000, 9_000_000, 1, 0)] + [None])], ["text"])
    parts = [p.num_rows for p in shingles.by_bytes(batch, "text")]
    assert sum(parts) == 7 and parts == [2, 1, 1, 3]
