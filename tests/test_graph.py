import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import evaluate, graph, hybrid, incremental, resolve, text, vector
from weftgraph.schema import EDGES, SYMBOLS


def symbol(name, file, line, kind="function", parent=None):
    return (f"{file}:{name}:{line}", name, kind, file, line, line + 5, 0, 100, parent, None, "public", False, None)


def symbols_of(spark, *rows):
    return spark.createDataFrame([symbol(*r) for r in rows], SYMBOLS)


def edges_of(spark, *rows):
    """(source_id, target_name, kind, file)"""
    return spark.createDataFrame([(i, s, t, None, k, f, 1) for i, (s, t, k, f) in enumerate(rows)], EDGES)


def test_resolution_tiers(spark):
    s = symbols_of(spark, ("get", "a/x.py", 1), ("get", "a/y.py", 1), ("get", "b/z.py", 1), ("only", "c/q.py", 9), ("deep", "a/sub/w.py", 1), ("deep", "b/v.py", 1))
    e = edges_of(spark, ("a/x.py:get:1", "m.get", "calls", "a/y.py"), ("a/x.py:get:1", "get", "calls", "b/other.py"), ("a/x.py:get:1", "get", "calls", "root.py"), ("a/x.py:get:1", "only", "calls", "root.py"), ("a/x.py:get:1", "deep", "calls", "a/x.py"), ("a/x.py:get:1", "none", "calls", "a/x.py"))
    got = {(r.target_name, r.file_path): (r.target_id, r.tier) for r in resolve.resolve_edges(e, s).collect()}
    assert got == {
        ("m.get", "a/y.py"): ("a/y.py:get:1", 1), ("get", "b/other.py"): ("b/z.py:get:1", 2), ("get", "root.py"): (None, None), ("only", "root.py"): ("c/q.py:only:9", 3),
        ("deep", "a/x.py"): ("a/sub/w.py:deep:1", 2), ("none", "a/x.py"): (None, None),
    }
    again = resolve.resolve_edges(resolve.resolve_edges(e, s).drop("tier"), s)
    assert again.where("target_id IS NOT NULL").count() == 4 and again.where("tier IS NOT NULL").count() == 0


def test_refs_callees_hierarchy_deps(spark):
    s = symbols_of(spark, ("a", "f.py", 1), ("b", "f.py", 9), ("Base", "f.py", 20, "class"), ("Child", "f.py", 30, "class"), ("os", "f.py", 40, "import"))
    e = edges_of(spark, ("f.py:a:1", "b", "calls", "f.py"), ("f.py:b:9", "x.b", "references", "f.py"), ("f.py:Child:30", "Base", "inherits", "f.py"), ("f.py:os:40", "os", "imports", "f.py"), ("gone", "b", "calls", "g.py"))
    e = resolve.resolve_edges(e, s).drop("tier")
    assert sorted((r.source_name or "") for r in graph.refs(e, s, "b").collect()) == ["", "a", "b"]
    assert graph.refs(e, s, "b", "calls").count() == 2
    assert [r.target_name for r in graph.callees(e, s, "a").collect()] == ["b"]
    assert [tuple(r) for r in graph.hierarchy(e, s, "Base").collect()] == [("Child", "Base")]
    assert graph.file_deps(e, "f.py").count() == 1


def test_impact_is_breadth_first_and_ends_on_cycles(spark):
    s = symbols_of(spark, *((n, "f.py", i) for i, n in enumerate("abcd", 1)))
    e = edges_of(spark, ("f.py:b:2", "a", "calls", "f.py"), ("f.py:c:3", "b", "calls", "f.py"), ("f.py:a:1", "c", "calls", "f.py"), ("f.py:c:3", "a", "calls", "f.py"), ("f.py:d:4", "d", "calls", "f.py"))
    got = sorted((r.source_name, r.target_name, r.depth) for r in graph.impact(e, s, ["a"], 10).collect())
    assert got == [("a", "c", 2), ("b", "a", 1), ("c", "a", 1), ("c", "b", 2)]
    assert {r.depth for r in graph.impact(e, s, ["a"], 1).collect()} == {1}


def test_search_order_and_errors(spark):
    s = symbols_of(spark, ("token", "b.py", 1, "variable"), ("token", "a.py", 5), ("token_x", "a.py", 9, "class"), ("my_token", "a.py", 2, "method"), ("getXtoken", "a.py", 3), ("other", "a.py", 4))
    assert [(r.name, r.kind) for r in graph.search(s, "TOKEN").collect()] == [("token", "function"), ("token_x", "class"), ("getXtoken", "function"), ("my_token", "method"), ("token", "variable")]
    assert graph.search(s, "t%").count() == 0 and graph.search(s, "y_t").count() == 1
    assert graph.search(s, "token", limit=1).count() == 1 and graph.search(s, "token", kind="class").count() == 1
    for bad in ({"query": ""}, {"query": "x", "limit": 0}, {"query": "x", "kind": "nope"}):
        with pytest.raises(ValueError):
            graph.search(s, **bad)


def test_text_cascade_and_limits(spark):
    docs = spark.createDataFrame([("1", "validate_token now"), ("2", "token then validate"), ("3", "valid only"), ("4", "")], "symbol_id string, content string")
    ask = lambda q: [(r.symbol_id, r.tier) for r in text.search(docs, spark.createDataFrame([(0, q)], "query_id int, text string"), ["content"], 10).orderBy("rank").collect()]
    assert ask("validate token") == [("1", 0)]
    assert {x[0] for x in ask("then token")} == {"2"} and ask("then token")[0][1] == 1
    assert ask("valid") == [("3", 0)] and ask("nothing here") == [] and ask("  ") == []
    assert {x[0] for x in ask("valid zzz")} == {"3"} and ask("valid zzz")[0][1] == 2


def test_fusion_and_rerank(spark):
    rows = [(0, "fts", "x", 1), (0, "fts", "y", 2), (0, "vector", "y", 1), (0, "vector", "z", 2)]
    merged = hybrid.rrf_merge(spark.createDataFrame(rows, "query_id int, source string, symbol_id string, rank int"))
    got = [(r.symbol_id, r.sources) for r in merged.orderBy("rrf_rank").collect()]
    assert got == [("y", ["fts", "vector"]), ("x", ["fts"]), ("z", ["vector"])]
    scored = hybrid.rerank(merged, F.when(F.col("symbol_id") == "z", 5.0))
    assert [r.symbol_id for r in scored.orderBy("position").collect()] == ["z", "y", "x"]


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.9, 0.1])], "symbol_id string, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query array<float>")
    assert [r.symbol_id for r in vector.knn(v, q, 2).orderBy("rank").collect()] == ["a", "c"]
    assert vector.knn(v, q.limit(0), 2).count() == 0
    back = v.select(vector.to_bytes("embedding").alias("x")).select(F.length("x").alias("n"), vector.from_bytes("x").alias("y")).first()
    assert back.n == 8 and len(back.y) == 2
    e = spark.createDataFrame([("hello world",), ("",), (None,)], "t string").select(vector.embed(F.col("t")).alias("e")).collect()
    assert abs(sum(x * x for x in e[0].e) - 1) < 1e-5 and len(e[2].e) == vector.DIM


def test_nearest_in_bounded_memory(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(6000, 8)).astype(np.float32), rng.normal(size=(1500, 8)).astype(np.float32)
    v[17] = v[16] = q[5]
    df = spark.createDataFrame([], "symbol_id long, embedding array<float>")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run = vector._block_knn(df, q.tolist(), 3, "symbol_id")
    lists = pa.ListArray.from_arrays(np.arange(0, v.size + 1, 8, dtype=np.int32), pa.array(v.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), lists], ["symbol_id", "embedding"])
    tracemalloc.start()
    got = pa.Table.from_batches(run(iter([batch.slice(0, 5000), batch.slice(5000)]))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all pairs of the first batch are 60 MB
    for n in (0, 5, 700, 1499):
        distance = np.sqrt(np.square(q[n].astype(float) - v).sum(axis=1))
        assert got[got["__query"] == n].sort_values(["distance", "symbol_id"]).symbol_id.tolist() == np.lexsort((np.arange(6000), distance))[:3].tolist()


def test_a_vector_of_no_number_hides_no_other(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [float("nan"), 1.0]), ("c", [0.9, 0.1])], "symbol_id string, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query array<float>")
    assert [r.symbol_id for r in vector.knn(v, q, 2).orderBy("rank").collect()] == ["a", "c"]


def test_relevance_of_shared_wants(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (2, "b", 1), (2, "a", 3), (3, "x", 1)], "query_id int, item string, rank int")
    asked = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "query_id int, want int")
    expected = spark.createDataFrame([(7, "a", 1), (7, "b", 2), (7, "c", 3), (8, "a", 1)], "want int, item string, ideal_rank int")
    each = expected.join(asked, "want").select("query_id", "item", "ideal_rank")
    got = sorted(map(tuple, evaluate.relevance(results, expected, 2, asked).collect()))
    assert got == sorted(map(tuple, evaluate.relevance(results, each, 2).collect())) and [r[0] for r in got] == [1, 2, 3]


def test_incremental(spark):
    cur = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "3")], "path string, hash string")
    assert [r.path for r in incremental.changed_files(cur, old).collect()] == ["b"]
    assert [r.path for r in incremental.removed_files(cur, old).collect()] == ["c"]
    assert sorted(r.path for r in incremental.candidate_files(cur, old.where("path != 'a'"), [cur.where("path = 'b'")]).collect()) == ["a", "b"]
    assert {tuple(r) for r in incremental.upsert(old, cur, "path").collect()} == {("a", "1"), ("b", "2"), ("c", "3")}
