"""Near-duplicates, URLs, repeats, lines, quality and the pipeline against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tests.llm.test_small_ops import WORD, query
from weftgraph.llm import graph, op4_near, op6_urls, op7_repeats, op10_quality, registry


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_by_hand(data, k=2):
    sets = {i: shingles(t, k) for i, t in data if i is not None}
    ids = list(sets)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, union(linked, ids)


def near_rows():
    rng = random.Random(8)
    data = [(i, t) for i, t in cases.rows() if i is not None]
    base = cases.prose(rng, 150).split()
    for i in range(60):  # one large group, whose members differ from each other in many ways
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(999)}"
        data.append((1000 + i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    return [*data, (None, "one two three"), (None, None)]


def test_near(spark, monkeypatch):
    data = near_rows()
    sets, component = near_by_hand(data)
    got = query(monkeypatch, spark, "op4_near", cases.frame(spark, data)).collect()
    assert len(got) == len(data)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), component[r.doc_id], component[r.doc_id] == r.doc_id)
    assert query(monkeypatch, spark, "op4_near", cases.empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    want = union(pairs, {x for p in pairs for x in p if p[0] != p[1]} | {x for p in pairs for x in p})
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and {x for a, b in pairs if a != b for x in (a, b)} == set(got)


URLS = ["https://a.ORG/x?y", "http://sub.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "ftp://x.com/fr/a#b", "http://com/de/", "http://evilorg/x", None, "", "no scheme", "://", "http://h?x", "http://a.net/9/8-7", "HTTP://x.COM/FR/", "a://b\nc/d"]


def test_urls(spark):
    urls = [*URLS, URLS[0], "http://long.net/" + "a/" * 20_000, *(f"http://h{i}.com/{'de' if i % 3 else 'fr'}/{i}" for i in range(60))]
    df = spark.createDataFrame([(i, u, 1, "own", 2.0) for i, u in enumerate(urls)], "page_id long, url string, score int, host string, f_length double")
    rules = dict(op6_urls.RULES)
    found = op6_urls.judge(df).collect()
    assert sorted(tuple(r.page) for r in found if r.page.url is not None) == sorted(tuple(r) for r in df.collect() if r.url is not None)
    for r in found:
        url = r.page.url or ""
        at = url.find("://")
        rest = url[at + 3 :] if at >= 0 else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({i: i + 32 for i in range(65, 91)})
        fit = [x for x in rules if (host == (h := x.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + x.partition("/")[2])]
        rule = max(fit, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == rules[rule] if rule else r.verdict in ("allow", "block")
    assert op6_urls.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in op6_urls.judge(df.where("url = 'no scheme'")).collect()} == {"allow"}


def test_url_verdicts_follow_the_trees(spark, tmp_path):
    """The registered query, with every URL's score computed again from the fitted expression in plain Python."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = [f"http://{word(5)}.com/{'de' if (bad := i % 2) else 'fr'}/{word(30 if bad else 4)}" for i in range(160)]
    rows += [f"http://{word(5)}.net/{word(30 if i % 2 else 4)}" for i in range(60)] + [None, "x"]
    spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in registry.QUERIES["op6_urls"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for r in got.values():
        assert r.verdict == (dict(op6_urls.RULES)[r.rule] if r.rule else "block" if r.score > 0 else "allow")
    right = [(got[160 + i].verdict == "block") == bool(i % 2) for i in range(60)]
    assert sum(right) >= 54  # hosts that no rule knows, judged by what the trees have learnt
    held = op6_urls.holdout(spark.read.parquet(f"{tmp_path}/pages.parquet"))
    assert held["n"] > 15 and held["accuracy"] >= 0.9 > held["constant"]


def test_suffix_statistics_leave_the_own_fold_out(spark):
    rows = [(f"h{i}.{'com' if i % 3 else 'org'}", float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "host string, y double").withColumn("k", op6_urls.fold(F.col("host")))
    stats = {(r["__suffix"], r["__fold"]): r.f_suffix for r in op6_urls.suffix_statistics(df).collect()}
    held = df.collect()
    for end in ("com", "org"):
        for k in range(-1, op6_urls.FOLDS):
            own = [r.y for r in held if r.host.endswith(end) and r.k != k]
            assert abs(stats[end, k] - (sum(own) + 1) / (len(own) + 2)) < 1e-6


def test_trees_learn(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.random((n, len(op6_urls.FEATURES)))
    y = ((x[:, 1] > 0.5) ^ (x[:, 4] > 0.4)).astype(float)
    names = [*op6_urls.FEATURES, "y"]
    df = spark.createDataFrame([tuple(map(float, [*a, b])) for a, b in zip(x, y, strict=True)], names)
    score = op6_urls.fit(df.limit(400))
    right = df.select(((score > 0).cast("double") == F.col("y")).alias("ok")).agg(F.avg(F.col("ok").cast("double"))).first()[0]
    assert right > 0.85


def repeats_by_hand(data):
    seen, out = set(), {}
    for i, t in sorted(((i, t) for i, t in data if i is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for s in range(len(b) - op7_repeats.LENGTH + 1):
            w = b[s : s + op7_repeats.LENGTH]
            if w in seen:
                mark[s : s + op7_repeats.LENGTH] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        out[i] = (len(b), int(mark.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mark])).hexdigest())
    return out


@pytest.mark.parametrize("large", [op7_repeats.LARGE, 1])
def test_repeats(spark, monkeypatch, large):
    monkeypatch.setattr(op7_repeats, "LARGE", large)
    rng = random.Random(12)
    passage = cases.prose(rng, 60)
    data = [(i, t) for i, t in cases.rows() if i is not None][:-1]
    data += [(500 + i, cases.prose(rng, 10) + passage[i : 300 + i] + cases.prose(rng, 10)) for i in range(12)]
    data += [(600, "ab" * 200), (601, "x" + "ab" * 60), (602, "é" * 120), (603, "y" + "é" * 90)]
    want = repeats_by_hand(data)
    got = query(monkeypatch, spark, "op7_repeats", cases.frame(spark, [*data, (None, "short"), (None, None)])).collect()
    assert len(got) == len(data) + 2
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:] == want[r.doc_id], r.doc_id
    assert query(monkeypatch, spark, "op7_repeats", cases.empty(spark)).count() == 0


def quality_by_hand(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, monkeypatch):
    data = [*cases.rows(), (700, "a b c d e f g h " * 9), (701, "### $$$ %% " * 12), (702, "x\x1cy\u00a0z " * 3)]
    got = query(monkeypatch, spark, "op10_quality", cases.frame(spark, data)).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == collections.Counter((i, *quality_by_hand(t)) for i, t in data)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    kept = op10_quality.keep(cases.frame(spark, data))
    assert kept.columns == cases.frame(spark).columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in got if r.kept)
    assert query(monkeypatch, spark, "op10_quality", cases.empty(spark)).count() == 0


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.85
    hit_good, hit_bad = [0.97, 0.9, 0.95, 0.92], [0.9, 0.8, 0.1, 0.85]
    votes = np.stack([np.where(good, np.where(rng.random(len(good)) < a, 1, -1), np.where(rng.random(len(good)) < b, -1, 1)) for a, b in zip(hit_good, hit_bad, strict=True)], axis=1)
    votes[rng.random(votes.shape) < 0.1] = 0
    patterns = collections.Counter(map(tuple, votes.tolist()))
    share, accuracy = op10_quality.fit(patterns)
    assert abs(share - 0.85) < 0.02 and all(abs(a - x) < 0.03 and abs(b - y) < 0.06 for (a, b), x, y in zip(accuracy, hit_good, hit_bad, strict=True))
    assert op10_quality.fit({}) [1] == []
