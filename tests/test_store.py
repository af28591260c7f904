"""Stores, lookups, the stored full-text index, renderers, version control's pre-filter and made-up code bases."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from weftgraph import render
from weftgraph.api import CodeGraph
from weftgraph.operators import hybrid, lookup, text, vector
from weftgraph.sources import extract, fixtures, indexer, tree
from weftgraph.sources.extract import python as python_extract
from weftgraph.sources.store import MemoryStore, Store


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, value string")


@pytest.mark.parametrize("kind", ["files", "memory"])
def test_versions(spark, tmp_path, kind):
    store = Store(spark, str(tmp_path / "s")) if kind == "files" else MemoryStore(spark)
    assert store.version() == 0 and store.read("files").count() == 0 and store.metadata("x") is None
    files = spark.createDataFrame([("a.py", 1.0, "h", "python", 3)], "path string, last_modified double, hash string, language string, num_symbols int")
    assert store.commit({"files": files}) == 1
    assert store.set_metadata("x", "1") == 2 and store.set_metadata("y", "it's") == 3 and store.set_metadata("x", "2") == 4
    assert store.metadata("x") == "2" and store.metadata("y") == "it's"
    assert [r.path for r in store.read("files").collect()] == ["a.py"]  # carried over
    assert store.read("metadata", 3).count() == 2


def test_unchanged_tables_are_not_rewritten(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit({"metadata": pairs(spark, ("a", "1"))})
    folder = store.manifest(1)["metadata"]
    store.commit({"files": spark.createDataFrame([], "path string, last_modified double, hash string, language string, num_symbols int")})
    assert store.manifest(2)["metadata"] == folder and store.versions() == [1, 2]
    for n in range(3):
        store.set_metadata("a", str(n))
    assert len(store.versions()) == 2 and not os.path.exists(f"{store.root}/{folder}")
    assert store.metadata("a") == "2"


def test_lookups(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    assert [(r.position, r.id) for r in lookup.of_list(table, ["c", "x", "a", "c"]).collect()] == [(0, "c"), (2, "a"), (3, "c")]
    assert lookup.exists(table, "id", "b") and not lookup.exists(table, "id", "x")
    assert lookup.point(table, "id", "b").first().n == 2


def test_vectors_upserted_and_cleared(spark):
    old = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "symbol_id string, embedding array<float>")
    new = spark.createDataFrame([("b", [3.0]), ("c", [4.0])], "symbol_id string, embedding array<float>")
    assert {r.symbol_id: r.embedding[0] for r in vector.upserted(old, new).collect()} == {"a": 1, "b": 3, "c": 4}
    assert vector.cleared(old).count() == 0
    assert [r.symbol_id for r in vector.cleared(old, new.select("symbol_id")).collect()] == ["a"]


def test_stored_index_equals_a_search_without_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {'rare' if i % 7 == 0 else 'common'} and word{i % 5} here", "name") for i in range(60)], "id long, body string, title string")
    queries = spark.createDataFrame([(0, "rare and"), (1, "word3 words"), (2, "nothing"), (3, "")], "query_id int, text string")
    index = text.Index.build(docs, ["title", "body"], str(tmp_path / "fts"), "id")
    one = text.search(docs, queries, ["title", "body"], 10, "id").collect()
    two = text.search(docs, queries, ["title", "body"], 10, "id", index).collect()
    key = lambda r: (r.query_id, r.rank, r.id, r.tier, round(r.score, 9))
    assert one and sorted(map(key, one)) == sorted(map(key, two))
    plan = text.scored(queries, index, "id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [In(term" in plan or "In(term" in plan


@pytest.mark.parametrize("language", sorted(fixtures.WRITERS))
def test_made_up_code(tmp_path, language):
    lines = fixtures.generate(str(tmp_path), language, 9)
    assert lines > 200 and fixtures.generate(str(tmp_path / "again"), language, 9) == lines
    found = set()
    for path in tree.walk(str(tmp_path)):
        if path.startswith("services"):
            b = extract.EXTRACTORS[language]((tmp_path / path).read_text(), path)
            found |= {e["kind"] for e in b.edges}
            assert sum(s["kind"] in ("function", "method") for s in b.symbols) >= 8
            assert any(s["kind"] == "class" for s in b.symbols)
    assert {"calls", "imports"} <= found


def test_form_feeds_and_separators_end_no_line():
    source = "import os\n\x0c\nclass A(Base):\n    def f(self, x):\n        '''A   word.'''\n        return g(x)\n"
    b = python_extract.extract(source, "a.py") if hasattr(python_extract, "extract") else extract.EXTRACTORS["python"](source, "a.py")
    f = next(s for s in b.symbols if s["name"] == "f")
    assert f["start_line"] == 4 and "x" in f["signature"]
    assert {(e["target_name"], e["kind"]) for e in b.edges} >= {("g", "calls"), ("Base", "inherits")}
    assert source.encode()[f["start_byte"] : f["end_byte"]].startswith(b"def f")


def test_version_control_names_what_is_read(spark, tmp_path, monkeypatch):
    root = tmp_path / "src"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    (root / "a.py").write_text("def one():\n    return 1\n")
    (root / "b.py").write_text("def two():\n    return one()\n")
    git("init")
    git("add", ".")
    git("commit", "-m", "first")
    g = CodeGraph(spark, str(root), str(tmp_path / "store"))
    assert g.index()["indexed"] == 2
    (root / "b.py").write_text("def two():\n    return one() + 1\n")
    (root / "c.py").write_text("def three():\n    return two()\n")
    assert indexer.candidates(spark, str(root), g.store) == ["b.py", "c.py"] or sorted(indexer.candidates(spark, str(root), g.store)) == ["b.py", "c.py"]
    seen = []
    read = tree.read_tree
    monkeypatch.setattr(tree, "read_tree", lambda s, r, only=None: seen.append(only) or read(s, r, only))
    assert g.index() | {"edges": 0} == {"indexed": 2, "skipped": 1, "removed": 0, "symbols": 3, "edges": 0, "resolved": 2}
    assert sorted(seen[0]) == ["b.py", "c.py"]
    (root / "a.py").unlink()
    assert g.index()["removed"] == 1


def test_render_and_counts(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def one(item):\n    # The first of all things that are counted here.\n    return two(item)\n\n\ndef two(item):\n    # The second of all things that are counted here.\n    return item\n")
    g = CodeGraph(spark, str(root), str(tmp_path / "store"))
    g.index()
    assert [r.text for r in render.lines("refs", g.refs("two")).collect()] == ["calls  one  a.py:3"]
    assert [r.text for r in render.lines("callees", g.callees("one")).collect()] == ["two  a.py:3"]
    assert [r.text for r in render.lines("search", g.search("one")).collect()] == ["function  one  a.py:1"]
    assert [r.text for r in render.lines("impact", g.impact("two")).collect()] == ["calls  a.py:one:1  a.py:3"]
    assert "Symbols:" in "\n".join(r.text for r in render.lines("stats", g.stats()).collect())
    assert indexer.text_index(g.store) is None
    g.rag_index()
    assert indexer.text_index(g.store) is not None
    found = g.rag_search("second things").collect()
    assert found[0].symbol["name"] == "two" and found[0].fts_count >= 1 and found[0].vector_count == 2 and found[0].merged_count == 2
    assert render.lines("rag_search", g.rag_search("second things")).first().text.startswith("1. function  two  a.py:6  score=")
    assert hybrid.COLUMNS[0] == "symbol_name"


def test_index_in_segments_of_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "SEGMENT_BYTES", 200, raising=False)
    docs = spark.createDataFrame([(i, f"the {i} of the {i % 3}", "of" if i % 2 else None) for i in range(40)] + [(99, "", None)], "id long, title string, body string")
    index = text.Index.build(docs, ["title", "body"], str(tmp_path / "fts"), "id")
    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)
    own = index.postings.select("id", part.alias("part")).distinct().collect()
    assert len(own) == 40 and len({r.part for r in own}) > 3  # a document's postings lie in one of several segments
    assert {r.id: r.len for r in index.lengths.collect()} == {99: 0} | {i: 5 + i % 2 for i in range(40)}
    assert index.postings.where("term IS NULL").count() == 0 and index.postings.count() == 220
    queries = spark.createDataFrame([("a", "the"), ("b", "of the"), ("c", "of the the")], "query_id string, text string")
    hits = {(r.query_id, r.tier, r.phrase, r.f) for r in text.phrase_hits(index.postings, text.phrases(queries), "id").where("id = 7").collect()}
    assert hits == {("a", 0, 0, 2), ("a", 2, 0, 2), ("b", 0, 0, 1), ("b", 1, 0, 2), ("b", 1, 1, 2), ("b", 2, 0, 2), ("b", 2, 1, 2), ("c", 1, 0, 2), ("c", 1, 1, 2), ("c", 1, 2, 2), ("c", 2, 0, 2), ("c", 2, 1, 2), ("c", 2, 2, 2)}
