"""SQL for what the operators' queries return, as far as DuckDB can say it: two whole queries, and parts of others.

The parts are registered as queries of their own; each runs its operator's whole query and keeps the columns that SQL can
state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .op2_bpe import op2_bpe
from .op3_shards import shard_documents
from .op5_audio import op5_audio
from .op6_urls import RULES, op6_urls
from .op8_secrets import op8_secrets
from .op10_quality import op10_quality

WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORDS}') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN w ELSE [] END) AS x FROM w),
n AS MATERIALIZED (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, ways.b FROM reach r JOIN ways ON ways.a = r.other),
component AS (SELECT doc_id, MIN(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN component c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

REPEATS = """WITH t AS (SELECT doc_id, encode(COALESCE(text, '')) AS d, strlen(COALESCE(text, '')) AS n FROM documents),
place AS (SELECT doc_id, unnest(range(0, n)) AS p, unnest(list_transform(range(0, n), lambda i: hex(array_slice(d, i + 1, i + 1)))) AS b, unnest(list_transform(range(0, n), lambda i: CASE WHEN i + 100 <= n THEN md5(array_slice(d, i + 1, i + 100)) END)) AS m FROM t),
again AS (SELECT doc_id, p, b, m IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY m ORDER BY doc_id, p) > 1 AS again FROM place),
marked AS (SELECT doc_id, p, b, COALESCE(p - MAX(CASE WHEN again THEN p END) OVER (PARTITION BY doc_id ORDER BY p) < 100, FALSE) AS gone FROM again),
edge AS (SELECT *, gone AND NOT COALESCE(LAG(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS opens FROM marked),
told AS (SELECT doc_id, COUNT(*) AS n, COUNT(CASE WHEN gone THEN 1 END) AS r, COUNT(CASE WHEN opens THEN 1 END) AS k, COALESCE(string_agg(CASE WHEN gone THEN NULL ELSE b END, '' ORDER BY p), '') AS left_over FROM edge GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_bytes, CAST(COALESCE(r, 0) AS BIGINT) AS n_removed, CAST(COALESCE(k, 0) AS BIGINT) AS n_spans, sha256(unhex(COALESCE(left_over, ''))) AS kept_sha256 FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id"""


def _rules() -> str:
    fits = []
    for rule, verdict in RULES:
        name, slash, rest = rule.partition("/")
        fits.append(f"SELECT page_id, '{rule}' AS rule, '{verdict}' AS verdict FROM p WHERE (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}')")
    return " UNION ALL ".join(fits)


URLS = rf"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM r),
p AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, len(host) + 1), '^[^?#]*') AS path FROM q),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY len(rule) DESC) AS k FROM ({_rules()}) x)
SELECT p.page_id, COALESCE(p.host, '') AS host, COALESCE(p.path, '') AS path, f.rule, f.verdict AS decided FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.k = 1"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = f"({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token')))}|{_either('api')}_?{_either('key')})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
SECRETS = f"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(COALESCE(text, ''), '{_ASSIGN}', 2), lambda x: len(x) >= 6)) AS BIGINT) AS n_assign,
CAST(len(list_filter(regexp_extract_all(COALESCE(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20)) AS BIGINT) AS n_access,
CAST(len(list_filter(regexp_extract_all(COALESCE(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 24)) AS BIGINT) AS n_hex FROM documents"""

QUALITY = rf"""WITH w AS (SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '{WORDS}') AS w FROM documents),
c AS (SELECT doc_id, w, len(w) AS n_words, COALESCE(list_sum(list_transform(w, lambda x: len(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines FROM w),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, CAST(n_words AS BIGINT) - 6)) AS i FROM c WHERE n_words >= 8) y),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, x) AS k FROM win) z WHERE k > 1),
cov AS (SELECT doc_id, COUNT(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + unnest(range(8)) AS j FROM rep) z GROUP BY doc_id)
SELECT c.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
CAST(COALESCE(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * COALESCE(n_repeat_words, 0) > 30 * n_words AS base_failed FROM c LEFT JOIN cov ON cov.doc_id = c.doc_id"""


def decoded_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def shards_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws of the shards: slots without gaps, bytes near equal, equal texts together."""
    found = shard_documents(store.documents(spark, sf_dir), 8)
    apart = found.groupBy("text_key").agg(F.min("shard").alias("low"), F.max("shard").alias("high")).agg(F.count_if(F.col("low") != F.col("high")).alias("apart"))
    each = found.groupBy("shard").agg(F.sum("size").alias("bytes"), (F.max("slot") + 1 == F.count_distinct("slot")).alias("gapless"), F.max("size").alias("largest"))
    whole = each.agg(F.sum("bytes").alias("total"), F.max("largest").alias("most"))
    near = F.abs(F.col("bytes") * 8 - F.col("total")) <= 8 * F.col("most")
    return each.crossJoin(whole).crossJoin(apart).select("shard", "gapless", near.alias("near_equal"), "total", "apart")  # one row each


def payload_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def rules_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_urls(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("decided"))


def secrets_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


PARTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "part_bpe_decoded": decoded_part,
    "part_shard_laws": shards_part,
    "part_audio_payload": payload_part,
    "part_url_rules": rules_part,
    "part_secret_counts": secrets_part,
    "part_quality_counts": quality_part,
}

ORACLE_SQL = {
    "op4_near": NEAR,
    "op7_repeats": REPEATS,
    "part_bpe_decoded": "SELECT doc_id, sha256(COALESCE(text, '')) AS decoded_sha256 FROM documents",
    "part_shard_laws": "SELECT CAST(r.range AS INT) AS shard, TRUE AS gapless, TRUE AS near_equal, CAST(t.total AS BIGINT) AS total, CAST(0 AS BIGINT) AS apart FROM range(8) r, (SELECT SUM(strlen(COALESCE(text, '')) + 1) AS total FROM documents) t",
    "part_audio_payload": "WITH t AS (SELECT doc_id, encode(COALESCE(text, '')) AS b, strlen(COALESCE(text, '')) AS n FROM documents) SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(greatest(64, (n + 63) // 64 * 64) AS BIGINT) AS payload_bytes, sha256(b || unhex(repeat('00', CAST(greatest(64, (n + 63) // 64 * 64) - n AS BIGINT)))) AS payload_sha256 FROM t",
    "part_url_rules": URLS,
    "part_secret_counts": SECRETS,
    "part_quality_counts": QUALITY,
}
