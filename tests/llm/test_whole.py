"""What operators once left out, against plain Python."""

import collections
import random

from pyspark.sql import functions as F

from tests.llm import cases
from tests.llm.test_small_ops import BPE, query, tiktoken_encoding  # noqa: F401
from weftgraph.llm import op1_packing, op6_urls, op8_secrets


def test_packing_counts_tokens(spark, monkeypatch, tiktoken_encoding):  # noqa: F811
    data = [*cases.rows(), (800, "中文字符" * 900)]
    need = collections.Counter()
    for i, t in data:
        n = len(tiktoken_encoding.encode_ordinary(t or ""))
        for at in range(0, max(n, 1), op1_packing.MAX_LEN):
            need[i, at, min(op1_packing.MAX_LEN, n - at)] += 1
    got = query(monkeypatch, spark, "op1_packing", cases.frame(spark, data)).collect()
    assert collections.Counter((r.doc_id, r.start, r.length) for r in got) == need
    held = collections.Counter()
    for r in got:
        assert (r.length == 0) == (r.bucket is None) == (r.batch is None)
        if r.length:
            held[r.bucket, r.batch] += r.padded_length
    assert max(held.values()) <= op1_packing.TOKEN_BUDGET


def test_url_statistics_cover_all_rows_and_a_hot_url_is_sampled_once(spark, monkeypatch):
    urls = [f"http://h{i}.com/{'de' if i % 3 else 'fr'}/{i}" for i in range(90)] + [f"http://a{i}.org/x" for i in range(20)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    hot = df.orderBy(F.xxhash64("url"), "url").first().url
    rows = [*urls, *[hot] * 80, *["http://other.net/1", "http://other.net/2"]]
    seen, fit = [], op6_urls.fit
    monkeypatch.setattr(op6_urls, "fit", lambda labelled: seen.extend(labelled.collect()) or fit(labelled))
    out = op6_urls.judge(spark.createDataFrame([(u,) for u in rows], "url string"), max_labelled=40)
    assert out.count() == len(rows)
    blocked = {u: float("/de/" in u) for u in urls}
    assert len(seen) == 40 and {r.y for r in seen} == {0.0, 1.0} and sorted(r.weight for r in seen) == [1] * 39 + [81]
    of_host = {u: u.split("/")[2] for u in urls}
    k = {r.host: r.k for r in spark.createDataFrame([(h,) for h in set(of_host.values())], "host string").withColumn("k", op6_urls.fold(F.col("host"))).collect()}
    want = set()
    for end in ("com", "org"):
        for fold in range(op6_urls.FOLDS):
            own = [blocked[u] for u in rows if u in of_host and of_host[u].endswith(end) and k[of_host[u]] != fold]
            want.add(round((sum(own) + 1) / (len(own) + 2), 6))
    assert {round(r.f_suffix, 6) for r in seen} <= want and {r.f_suffix for r in seen} != {0.5}


def test_secrets_of_one_class_and_short_ones(spark):
    rng = random.Random(6)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    low, mixed = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    keys = [make(x, n) for x in (low, low.upper()) for n in (24, 32, 40) for _ in range(20)] + [make(mixed, 16) for _ in range(20)]
    plain = ["internationalization", "INTERNATIONALIZATION", "this-is-a-long-identifier-name", "some_function_name", "=" * 40, "1234567890123456", "2024-01-15-12-30-45", "getUserNameFromSession", "d41d8cd98f00b204e9800998ecf8427e"]
    docs = cases.frame(spark, [(i, f"see {x} here") for i, x in enumerate([*keys, *plain])])
    found = {r.doc_id: "random:4:" in r.spans for r in op8_secrets.scan(docs, BPE).collect()}
    assert sum(found[i] for i in range(len(keys))) >= 0.9 * len(keys)
    assert not any(found[len(keys) + i] for i in range(len(plain)))
