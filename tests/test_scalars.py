import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.schema import EDGE_KINDS, SYMBOL_KINDS, VISIBILITIES, lossy, parse


def values(spark, f, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_normalize_symbol_name(spark):
    cases = {
        "validate_token": "validate token", "validateToken": "validate token", "ValidateToken": "validate token", "HTTPServer": "http server", "parseHTTPResponse": "parse http response",
        "MAX_RETRIES": "max retries", "__init__": "init", "": "", "___": "", "kebab-case": "kebab case", "oauth2Token": "oauth2 token", "v2API": "v2api", "x": "x", "getX": "get x",
    }
    assert dict(zip(cases, values(spark, S.normalize_symbol_name, cases), strict=True)) == cases


def test_paths(spark):
    assert values(spark, S.dirname, ["a/b/c.py", "c.py", "/x"]) == ["a/b", "", ""]
    assert values(spark, S.ancestors, ["a/b/c.py", "c.py"]) == [["a", "a/b"], []]
    assert values(spark, S.simple_name, ["a.b.c", "a::b", "x!"]) == ["c", "a::b", "x!"]
    assert values(spark, S.normalize_path, ["/a/./b/../c", "../a", "a/../../b"]) == ["/a/c", "a", "b"]
    assert values(spark, S.last_segment, ["a/b", "b"]) == ["b", "b"]


def test_languages_and_relevance(spark):
    assert values(spark, S.detect_language, ["a.py", "b.tsx", "c.PY", "d", ".py", "e.rs", "f.go", "g.rb", "h.mjs", "i.txt"]) == ["python", "tsx", None, None, None, "rust", "go", "ruby", "javascript", None]
    paths = ["r/a.py", "r/node_modules/a.py", "r/.git/a.py", "s/a.py", "r/a.txt", "r/x/build.py", "r/build/x.py", "ra/a.py"]
    assert values(spark, lambda c: S.is_relevant_path(c, "r"), paths) == [True, False, False, False, False, True, False, False]


def test_text(spark):
    assert values(spark, S.token_estimate, ["", "abc", "abcde", "é"]) == [0, 1, 2, 1]
    assert values(spark, S.strip_quotes, ["'a'", '"b"', "`c`", "d"]) == list("abcd")
    assert values(spark, S.clean_jsdoc, ["/** One.\n * Two.\n * @param x\n */"]) == ["One. Two."]
    assert values(spark, S.tokens, ["Élan vital_x", None]) == [["elan", "vital", "x"], []]
    assert values(spark, S.preview, ["a\nb\nc\nd"]) == ["    a\n    b\n    c"]
    assert values(spark, S.like_escape, ["a%b_c\\"]) == ["a\\%b\\_c\\\\"]
    assert values(spark, lambda c: S.compact_text(F.lit("h"), c), ["one\ntwo", "one"]) == ["h\none", "h\none"]


def test_visibility(spark):
    df = spark.createDataFrame([("__init__", "python"), ("__x", "python"), ("_x", "python"), ("X", "go"), ("x", "go"), ("#x", "javascript"), ("_x", "ruby"), ("x", "rust")], "n string, l string")
    assert [r[0] for r in df.select(S.visibility(F.col("n"), F.col("l"))).collect()] == ["public", "private", "protected", "public", "private", "private", "private", "public"]


def test_vocabularies(spark):
    assert parse("calls", EDGE_KINDS) == "calls"
    with pytest.raises(ValueError):
        parse("nope", SYMBOL_KINDS)
    assert values(spark, lambda c: lossy(c, VISIBILITIES), ["private", "x", None]) == ["private", "public", "public"]
    assert values(spark, lambda c: lossy(c, SYMBOL_KINDS), ["class", "x"]) == ["class", "variable"]
