"""Walks, evaluation and content over whole tables, against plain Python."""

import math
import random
import struct

from weftgraph import queries
from weftgraph.operators import vector

def vectors(spark, folder, n=150):
    """More vectors than one block of the links holds in this test, with copies."""
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], i % 3) for i in range(n)]
    rows += [(n + i, rows[i][1], 0) for i in range(8)] + [(n + 8 + i, rows[0][1], 1) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    single = {i: [struct.unpack("f", struct.pack("f", x))[0] for x in e] for i, e, _ in rows}
    near = {i: sorted((round(math.dist(e, f), 9), j) for j, f in single.items()) for i, e in single.items()}
    return near, {i: label for i, _, label in rows}


def test_walks_and_evaluation_cover_all_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 40)
    near, labels = vectors(spark, tmp_path)
    calls = {(i, j) for i, found in near.items() for _, j in [x for x in found if x[1] != i][:3]}
    depth, level = {0: 0}, {0}
    impact = {}
    for step in range(1, 6):
        for a, b in calls:
            if b in level:
                impact.setdefault((f"v{a}", f"v{b}"), step)
        level = {a for a, b in calls if b in level} - set(depth)
        depth |= dict.fromkeys(level, step)
    for most in (1, 3, 5):
        got = {(r.source_name, r.target_name): r.depth for r in queries.QUERIES[f"impact_d{most}"](spark, str(tmp_path)).collect()}
        assert got == {e: n for e, n in impact.items() if n <= most}
    asked, level, chain = set(), {0}, set()
    for step in (1, 2, 3):
        chain |= {(step, f"v{a}", f"v{b}") for a, b in calls if a in level}
        asked |= level
        level = {b for a, b in calls if a in level} - asked
    assert {tuple(r) for r in queries.QUERIES["call_chain_3"](spark, str(tmp_path)).collect()} == chain
    assert any(int(x[1:]) >= 60 for e in impact for x in e)
    got = {r.query_id: r.precision for r in queries.QUERIES["eval_pk_rk_ndcg"](spark, str(tmp_path)).collect()}
    assert got == {i: sum(labels[j] == labels[i] for _, j in near[i][:10]) / 10 for i in near if i % 20 == 0}


def test_content_is_cut_by_bytes(spark, tmp_path):
    texts = ["short", None, "", "a" * 3000, "é" * 25, "é" * 24 + " " * 90, "中" * 16 + "x", "中" * 17, "　 " * 40 + "x" * 49, "\n" * 2040 + "word " * 90, "line one\n" + "word " * 600]
    texts += ["a" * n + c * 1200 for n in range(5) for c in ("é", "中", "🙂")]
    texts += ["a" * n + "🙂" for n in range(2042, 2050)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in enumerate(texts):
        cut = (t or "").encode()[:2048].decode("utf-8", "ignore")
        if len(cut.strip().encode()) >= 50:
            want[i] = (cut, "h\n" + cut.split("\n")[0])
    assert {r.doc_id: (r.content, r.compact) for r in queries.QUERIES["content_slice"](spark, str(tmp_path)).collect()} == want
