"""Queries over the lifted tables, each with the SQL that the oracle runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import evaluate, graph, hybrid, incremental, resolve, text, vector
from .plans import lift

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SYM, EDG, FIL = lift.SYMBOLS_CTE, lift.EDGES_CTE, lift.FILES_CTE


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _edges(spark, d):
    """Resolved; distinct, with an id from the content."""
    found = resolve.resolve_edges(lift.edges(spark, d).distinct().withColumn("target_id", F.lit(None).cast("string")), lift.symbols(spark, d))
    return found.withColumn("edge_id", F.xxhash64("source_id", "target_name", "kind", "file_path", "line"))


DIR = "regexp_extract(file_path, '^(.*)/[^/]*$', 1)"
RESOLVED = f"""{SYM}, {EDG}, need AS (SELECT DISTINCT split_part(target_name, '.', -1) AS simple, file_path FROM edges),
cand AS (
  SELECT n.simple, n.file_path, CASE WHEN s.file_path = n.file_path THEN 1 WHEN {DIR.replace('file_path', 'n.file_path')} <> '' AND starts_with(s.file_path, {DIR.replace('file_path', 'n.file_path')} || '/') THEN 2 ELSE 3 END AS tier,
         s.id, s.start_line, COUNT(*) OVER (PARTITION BY n.simple, n.file_path) AS c
  FROM need n JOIN symbols s ON s.name = n.simple),
best AS (SELECT simple, file_path, tier, id, ROW_NUMBER() OVER (PARTITION BY simple, file_path ORDER BY tier, start_line, id) AS r FROM cand WHERE tier < 3 OR c = 1),
resolved AS (SELECT DISTINCT e.source_id, e.target_name, e.kind, e.file_path, e.line, b.id AS target_id, b.tier
  FROM edges e LEFT JOIN best b ON b.simple = split_part(e.target_name, '.', -1) AND b.file_path = e.file_path AND b.r = 1)"""


@query(f"WITH {RESOLVED} SELECT r.source_id, r.target_name, r.kind, r.file_path, r.line, r.target_id, s.name AS source_name FROM resolved r LEFT JOIN symbols s ON s.id = r.source_id LEFT JOIN symbols t ON t.id = r.target_id WHERE r.target_name = 'AMERICA' OR t.name = 'AMERICA' OR r.target_name = 'red widget' OR t.name = 'red widget'")
def refs_batch(spark, d):
    """Flagship: references to several names, by text or by the resolved symbol."""
    names = spark.createDataFrame([("AMERICA",), ("red widget",)], "name string")
    found = graph.refs_batch(_edges(spark, d), lift.symbols(spark, d), names)
    return found.select("source_id", "target_name", "kind", "file_path", "line", "target_id", "source_name")


@query(f"WITH {RESOLVED} SELECT source_id, target_name, kind, file_path, line, target_id, CAST(tier AS INT) AS tier FROM resolved")
def resolve_edges(spark, d):
    return _edges(spark, d).select("source_id", "target_name", "kind", "file_path", "line", "target_id", "tier")


@query(f"WITH {RESOLVED} SELECT CAST(COALESCE(tier, 0) AS INT) AS tier, COUNT(*) AS n FROM resolved GROUP BY 1")
def resolve_stats_by_tier(spark, d):
    return _edges(spark, d).groupBy(F.coalesce("tier", F.lit(0)).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RESOLVED} SELECT r.source_id, r.target_name, r.kind, r.file_path, r.line, s.name AS source_name FROM resolved r LEFT JOIN symbols s ON s.id = r.source_id LEFT JOIN symbols t ON t.id = r.target_id WHERE r.target_name = 'EUROPE' OR t.name = 'EUROPE'")
def refs_all(spark, d):
    return graph.refs(_edges(spark, d), lift.symbols(spark, d), "EUROPE").select("source_id", "target_name", "kind", "file_path", "line", "source_name")


@query(f"WITH {RESOLVED} SELECT r.source_id, r.target_name, r.kind, r.file_path, r.line, s.name AS source_name FROM resolved r LEFT JOIN symbols s ON s.id = r.source_id LEFT JOIN symbols t ON t.id = r.target_id WHERE r.kind = 'calls' AND (r.target_name = 'red widget' OR t.name = 'red widget')")
def refs_kind(spark, d):
    return graph.refs(_edges(spark, d), lift.symbols(spark, d), "red widget", "calls").select("source_id", "target_name", "kind", "file_path", "line", "source_name")


@query(f"WITH {RESOLVED} SELECT r.source_id, r.target_name, r.line FROM resolved r JOIN symbols s ON s.id = r.source_id WHERE r.kind = 'calls' AND s.name = 'Supplier#000000001'")
def callees(spark, d):
    return graph.callees(_edges(spark, d), lift.symbols(spark, d), "Supplier#000000001").select("source_id", "target_name", "line")


@query(f"WITH {RESOLVED} SELECT s.name, r.source_id, r.target_name, r.file_path, r.line FROM resolved r JOIN symbols s ON s.id = r.source_id WHERE r.kind = 'calls' AND s.kind = 'method'")
def callees_batch(spark, d):
    symbols = lift.symbols(spark, d)
    return graph.callees_batch(_edges(spark, d), symbols, symbols.where("kind = 'method'").select("name")).select("name", "source_id", "target_name", "file_path", "line")


@query(
    """WITH v AS (SELECT vec_id, embedding FROM embeddings), pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9), b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id),
hop AS MATERIALIZED (SELECT src, dst FROM pairs WHERE r <= 3), one AS (SELECT DISTINCT 1 AS step, src, dst FROM hop WHERE src = 0),
two AS (SELECT DISTINCT 2 AS step, h.src, h.dst FROM hop h JOIN one o ON h.src = o.dst WHERE h.src <> 0),
three AS (SELECT DISTINCT 3 AS step, h.src, h.dst FROM hop h JOIN two t ON h.src = t.dst WHERE h.src <> 0 AND h.src NOT IN (SELECT dst FROM one))
SELECT step, 'v' || CAST(src AS STRING) AS caller, 'v' || CAST(dst AS STRING) AS callee FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)"""
)
def call_chain_3(spark, d):
    symbols, edges = _knn_graph(spark, d)
    return graph.call_chain(edges, symbols, ["v0"], 3)


def _knn_graph(spark, d):
    """A cyclic graph: each vector calls its three nearest. Links are written to the shared folder, where there is one, for
    walks read them at every level."""
    v = _table(spark, d, "embeddings").select("vec_id", "embedding")
    links = vector.nearest_others(v, 3, "vec_id")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        path = f"{shared.rstrip('/')}/weftgraph/links-{uuid.uuid4().hex}"
        links.write.parquet(path)
        links = spark.read.schema(links.schema).parquet(path)
    name = lambda c: F.concat(F.lit("v"), F.col(c))
    symbols = v.select(name("vec_id").alias("id"), name("vec_id").alias("name"), F.lit("function").alias("kind"), F.lit("g").alias("file_path"))
    edges = links.select(name("vec_id").alias("source_id"), name("other").alias("target_name"), F.lit("calls").alias("kind"), F.lit("g").alias("file_path"), F.col("rank").alias("line"), F.lit(None).cast("string").alias("target_id"))
    return symbols, edges.withColumn("edge_id", F.xxhash64("source_id", "target_name"))


IMPACT = """WITH RECURSIVE v AS (SELECT vec_id, embedding FROM embeddings), pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9), b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id),
hop AS MATERIALIZED (SELECT src, dst FROM pairs WHERE r <= 3),
reach AS (SELECT CAST(0 AS BIGINT) AS name, 0 AS depth UNION SELECT h.src, r.depth + 1 FROM reach r JOIN hop h ON h.dst = r.name WHERE r.depth < {0})
SELECT 'v' || CAST(h.src AS STRING) AS source_name, 'v' || CAST(h.dst AS STRING) AS target_name, MIN(r.depth + 1) AS depth FROM reach r JOIN hop h ON h.dst = r.name WHERE r.depth < {0} GROUP BY h.src, h.dst"""


def _impact(depth):
    def run(spark, d):
        symbols, edges = _knn_graph(spark, d)
        return graph.impact(edges, symbols, ["v0"], depth).select("source_name", "target_name", "depth")

    return run


for _depth in (1, 3, 5):
    QUERIES[f"impact_d{_depth}"], ORACLE_SQL[f"impact_d{_depth}"] = _impact(_depth), IMPACT.format(_depth)


@query(f"WITH {RESOLVED} SELECT s.name AS child, r.target_name AS parent FROM resolved r JOIN symbols s ON s.id = r.source_id WHERE r.kind = 'inherits' AND (s.name = 'ASIA' OR r.target_name = 'ASIA')")
def hierarchy(spark, d):
    return graph.hierarchy(_edges(spark, d), lift.symbols(spark, d), "ASIA")


@query("SELECT url AS file_path, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target_name FROM pages")
def page_deps(spark, d):
    return _table(spark, d, "pages").select(F.col("url").alias("file_path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target_name"))


@query("SELECT u.target_name FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target_name FROM pages) u WHERE page_id = 1")
def file_deps(spark, d):
    edges = _table(spark, d, "pages").select(F.col("page_id").cast("string").alias("file_path"), F.lit("imports").alias("kind"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target_name"))
    return graph.file_deps(edges, "1").select("target_name")


@query(f"WITH {SYM} SELECT id, name, kind, start_line FROM symbols WHERE file_path = 'geo/nation'")
def outline(spark, d):
    return graph.outline(lift.symbols(spark, d), "geo/nation").select("id", "name", "kind", "start_line")


@query(f"WITH {SYM} SELECT start_line, CASE WHEN parent_id IS NOT NULL THEN '  ' ELSE '' END || kind || ' ' || name || COALESCE(signature, '') || '  L' || CAST(start_line AS STRING) || '-' || CAST(start_line + 5 AS STRING) AS line FROM symbols WHERE file_path = 'geo/nation'")
def outline_render(spark, d):
    return graph.outline_lines(lift.symbols(spark, d), "geo/nation")


def _search_sql(q: str, extra: str = "", limit: int = 100) -> str:
    q = q.replace("'", "''")
    return f"""WITH {SYM}, m AS (SELECT id, name, kind, (CASE WHEN lower(name) = lower('{q}') THEN 0 WHEN starts_with(lower(name), lower('{q}')) THEN 1 ELSE 2 END) + (CASE WHEN kind IN ('function', 'method', 'class') THEN 0 WHEN kind = 'import' THEN 6 ELSE 3 END) AS score,
CASE kind WHEN 'function' THEN 0 WHEN 'method' THEN 1 WHEN 'class' THEN 2 ELSE 3 END AS ko, file_path, start_line FROM symbols WHERE contains(lower(name), lower('{q}')) {extra})
SELECT id, name, kind FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY score, ko, file_path, start_line, id) AS r FROM m) WHERE r <= {limit}"""


def _search(name, q, extra="", limit=100, **options):
    QUERIES[name] = lambda spark, d: graph.search(lift.symbols(spark, d), q, limit=limit, **options).select("id", "name", "kind")
    ORACLE_SQL[name] = _search_sql(q, extra, limit)


_search("sym_search_exact", "asia")
_search("sym_search_prefix", "customer#00000001")
_search("sym_search_substring", "WIDGET")
_search("sym_search_ranked_topk", "a", limit=30)
_search("sym_search_kind_filter", "1", "AND kind = 'method'", kind="method")
_search("sym_search_file_filter", "NATION", "AND file_path = 'geo/nation'", file="geo/nation")
_search("sym_search_literal_wildcards", "NATION_1")


@query(f"""WITH {SYM}, q AS (SELECT 'red' AS query UNION ALL SELECT 'asia' UNION ALL SELECT 'supplier#00000000'), m AS (SELECT query, id, ROW_NUMBER() OVER (PARTITION BY query ORDER BY (CASE WHEN lower(name) = lower(query) THEN 0 WHEN starts_with(lower(name), lower(query)) THEN 1 ELSE 2 END) + (CASE WHEN kind IN ('function', 'method', 'class') THEN 0 WHEN kind = 'import' THEN 6 ELSE 3 END),
CASE kind WHEN 'function' THEN 0 WHEN 'method' THEN 1 WHEN 'class' THEN 2 ELSE 3 END, file_path, start_line, id) AS rank FROM symbols, q WHERE contains(lower(name), lower(query)))
SELECT query, CAST(rank AS INT) AS rank, id FROM m WHERE rank <= 20""")
def sym_search_batch(spark, d):
    queries = spark.createDataFrame([("red",), ("asia",), ("supplier#00000000",)], "query string")
    return graph.search_batch(lift.symbols(spark, d), queries, 20).select("query", "rank", "id")


@query(f"WITH {SYM} SELECT id, lower(trim(regexp_replace(regexp_replace(regexp_replace(replace(name, '#', 'XmlHttp#'), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '([\\p{{L}}\\p{{N}}])(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS words FROM symbols")
def sym_normalize(spark, d):
    return lift.symbols(spark, d).select("id", S.normalize_symbol_name(F.replace("name", F.lit("#"), F.lit("XmlHttp#"))).alias("words"))


@query(f"WITH {EDG} SELECT DISTINCT target_name, split_part(target_name, '.', -1) AS simple FROM edges")
def simple_name(spark, d):
    return lift.edges(spark, d).select("target_name", S.simple_name(F.col("target_name")).alias("simple")).distinct()


@query(f"WITH {SYM} SELECT DISTINCT file_path, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir FROM symbols")
def dirname(spark, d):
    return lift.symbols(spark, d).select("file_path", S.dirname(F.col("file_path")).alias("dir")).distinct()


@query(f"WITH {SYM} SELECT file_path || ':' || name || ':' || CAST(start_line AS STRING) AS id, COUNT(*) AS n FROM symbols GROUP BY 1")
def symbol_id(spark, d):
    return lift.symbols(spark, d).groupBy(S.symbol_id(F.col("file_path"), F.col("name"), F.col("start_line")).alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SYM} SELECT id, '// File: ' || file_path || chr(10) || '// Type: ' || kind || chr(10) || '// Name: ' || name AS header FROM symbols")
def header(spark, d):
    return lift.symbols(spark, d).select("id", S.header(F.col("file_path"), F.col("kind"), F.col("name")).alias("header"))


@query(f"WITH {RESOLVED}, {FIL} SELECT 'files' AS metric, '' AS key, COUNT(*) AS value FROM files UNION ALL SELECT 'symbols', '', COUNT(*) FROM symbols UNION ALL SELECT 'edges', '', COUNT(*) FROM resolved UNION ALL SELECT 'edges_resolved', '', COUNT(target_id) FROM resolved UNION ALL SELECT 'language', language, COUNT(*) FROM files GROUP BY language UNION ALL SELECT 'symbol_kind', kind, COUNT(*) FROM symbols GROUP BY kind")
def stats(spark, d):
    return graph.stats(lift.symbols(spark, d), _edges(spark, d), lift.files(spark, d))


@query(f"WITH {FIL} SELECT language, COUNT(*) AS n FROM files GROUP BY language")
def stats_languages(spark, d):
    return lift.files(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language")


@query(f"WITH {SYM} SELECT kind, COUNT(*) AS n FROM symbols GROUP BY kind")
def stats_kinds(spark, d):
    return lift.symbols(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


# An older index: a seventh of the files is missing from it, a fifth has another hash, and it holds files that are gone.
def _stored(spark, d):
    docs = _table(spark, d, "documents")
    path = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    own = docs.where("doc_id % 7 != 0").select(path.alias("path"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.sha2("text", 256)).alias("hash"))
    return own.unionByName(docs.where("doc_id % 50 = 1").select(F.concat(F.lit("gone/"), path).alias("path"), F.lit("old").alias("hash")))


STORED = "stored AS (SELECT lang || '/' || source || '/' || CAST(doc_id AS STRING) AS path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'gone/' || lang || '/' || source || '/' || CAST(doc_id AS STRING), 'old' FROM documents WHERE doc_id % 50 = 1)"


@query(f"WITH {FIL}, {STORED} SELECT f.path, f.hash FROM files f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.path = f.path AND s.hash = f.hash)")
def incremental_changed(spark, d):
    return incremental.changed_files(lift.files(spark, d), _stored(spark, d)).select("path", "hash")


@query(f"WITH {FIL}, {STORED} SELECT s.path FROM stored s WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.path = s.path)")
def incremental_removed(spark, d):
    return incremental.removed_files(lift.files(spark, d), _stored(spark, d))


@query(f"WITH {FIL}, {STORED} SELECT f.path FROM files f WHERE f.language = 'en' OR f.num_symbols < 100 OR NOT EXISTS (SELECT 1 FROM stored s WHERE s.path = f.path)")
def incremental_git(spark, d):
    files = lift.files(spark, d)
    return incremental.candidate_files(files, _stored(spark, d), [files.where("language = 'en'"), files.where("num_symbols < 100")]).select("path")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_last_write_wins(spark, d):
    return incremental.last_write_wins(_table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id")


@query("SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE event_type END AS event_type FROM events")
def upsert_replace(spark, d):
    events = _table(spark, d, "events").select("event_id", "user_id", "event_type")
    return incremental.upsert(events, events.where("event_id % 3 = 0").withColumn("event_type", F.lit("new")), "event_id")


@query(f"WITH {SYM} SELECT id FROM symbols WHERE file_path NOT IN ('geo/nation', 'party/supplier')")
def clear_file_data(spark, d):
    gone = spark.createDataFrame([("geo/nation",), ("party/supplier",)], "path string")
    return incremental.clear_files(lift.symbols(spark, d), gone).select("id")


@query(f"WITH {SYM} SELECT id FROM symbols WHERE kind <> 'variable' AND start_line % 3 <> 0")
def needing_embeddings(spark, d):
    symbols = lift.symbols(spark, d)
    content = symbols.select(F.col("id").alias("symbol_id"))
    return vector.needing_embeddings(content, symbols, content.join(symbols.where("start_line % 3 = 0").select(F.col("id").alias("symbol_id")), "symbol_id")).select(F.col("symbol_id").alias("id"))


@query(f"WITH {RESOLVED} SELECT COUNT(*) AS n FROM resolved r WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.id = r.source_id)")
def edges_without_source(spark, d):
    """The integrity check: no edge comes from nowhere."""
    sources = lift.symbols(spark, d).select(F.col("id").alias("source_id"))
    return _edges(spark, d).join(sources, "source_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


KNN = """SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM (
SELECT q.vec_id AS query_id, v.vec_id, list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance, ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), v.vec_id) AS rank
FROM embeddings v, embeddings q WHERE {0}) WHERE rank <= 10"""


def _knn(condition):
    def run(spark, d):
        v = _table(spark, d, "embeddings")
        asked = v.where(condition).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        return vector.knn(v.select("vec_id", "embedding"), asked, 10, "vec_id").select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")

    return run


QUERIES["knn_l2_top10"], ORACLE_SQL["knn_l2_top10"] = _knn("vec_id = 7"), KNN.format("q.vec_id = 7")
QUERIES["knn_batch"], ORACLE_SQL["knn_batch"] = _knn("vec_id % 20 = 0"), KNN.format("q.vec_id % 20 = 0")

# Full-text queries over documents.
TEXTS = (("q1", "and the"), ("q2", "the thor of"), ("q3", "de la"), ("q4", "zzzz the"), ("q5", "ing"), ("q6", "qqqq wwww"))


def _asked(spark, texts=TEXTS):
    return spark.createDataFrame(list(texts), "query_id string, text string")


def _phrases_sql(texts=TEXTS) -> str:
    rows = []
    for q, t in texts:
        words = t.split()
        rows += [(q, 0, 0, i, w, len(words), 1) for i, w in enumerate(words)]
        for tier in (1, 2) if len(words) > 1 else (2,):
            rows += [(q, tier, p, 0, w, 1, len(words)) for p, w in enumerate(words)]
    return " UNION ALL ".join(f"SELECT '{q}' AS query_id, {t} AS tier, {p} AS phrase, {o} AS off, '{w}' AS term, {n} AS terms, {k} AS phrases" for q, t, p, o, w, n, k in rows)


def _fts_sql(body: str, texts=TEXTS) -> str:
    return f"""WITH toks AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents), post AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM toks),
dl AS (SELECT doc_id, len(t) AS len FROM toks), corpus AS (SELECT COUNT(*) AS n_docs, AVG(len) AS avgdl FROM dl), asked AS ({_phrases_sql(texts)}),
inst AS (SELECT a.query_id, a.tier, a.phrase, a.phrases, p.doc_id, p.pos - a.off AS start FROM post p JOIN asked a ON a.term = p.term GROUP BY a.query_id, a.tier, a.phrase, a.phrases, a.terms, p.doc_id, p.pos - a.off HAVING COUNT(*) = a.terms),
hits AS (SELECT query_id, tier, phrase, phrases, doc_id, COUNT(*) AS f FROM inst GROUP BY query_id, tier, phrase, phrases, doc_id),
df AS (SELECT query_id, tier, phrase, COUNT(*) AS n FROM hits GROUP BY query_id, tier, phrase),
scored AS (SELECT h.query_id, h.tier, h.doc_id, SUM(-(CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score, COUNT(*) AS has, h.phrases
  FROM hits h JOIN df ON df.query_id = h.query_id AND df.tier = h.tier AND df.phrase = h.phrase JOIN dl ON dl.doc_id = h.doc_id, corpus GROUP BY h.query_id, h.tier, h.phrases, h.doc_id HAVING h.tier <> 1 OR COUNT(*) = h.phrases)
{body}"""


_INDEXES: dict[tuple[str, str], text.Index] = {}


def _index(spark, d):
    """The stored full-text index of the documents: built by the first search of a session, read by all."""
    name = (spark.sparkContext.applicationId, d)
    if name not in _INDEXES:
        shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
        _INDEXES[name] = text.Index.build(_table(spark, d, "documents").select("doc_id", "text"), ["text"], f"{shared.rstrip('/')}/weftgraph/fulltext-{uuid.uuid4().hex}", "doc_id")
    return _INDEXES[name]


def _scored(spark, d):
    return text.scored(_asked(spark), _index(spark, d), "doc_id")


def _fts(name, tier):
    QUERIES[name] = lambda spark, d: _scored(spark, d).where(F.col("tier") == tier).select("query_id", "doc_id", F.round("score", 6).alias("score"))
    ORACLE_SQL[name] = _fts_sql(f"SELECT query_id, doc_id, round(score, 6) AS score FROM scored WHERE tier = {tier}")


_fts("fts_phrase", 0)
_fts("fts_and", 1)
_fts("fts_or", 2)


@query(_fts_sql("SELECT query_id, doc_id, CAST(tier AS INT) AS tier, CAST(r AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) AS r FROM (SELECT *, MIN(tier) OVER (PARTITION BY query_id) AS low FROM scored) x WHERE tier = low) y WHERE r <= 10"))
def fts_cascade(spark, d):
    """BM25's ten best of the lowest tier with hits."""
    return text.search(_table(spark, d, "documents"), _asked(spark), ["text"], 10, "doc_id", _index(spark, d)).select("query_id", "doc_id", "tier", "rank")


@query("SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM documents)")
def fts_tokens(spark, d):
    return text.postings(_table(spark, d, "documents"), ["text"], "doc_id").select("doc_id", "term", F.col("pos").cast("long").alias("pos"))


RRF_CTE = """lists AS (SELECT 'a' AS source, user_id AS item, ROW_NUMBER() OVER (ORDER BY SUM(value) DESC, user_id) AS rank FROM events GROUP BY user_id UNION ALL SELECT 'b', user_id, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, user_id) FROM events GROUP BY user_id),
cut AS (SELECT * FROM lists WHERE rank <= 30), merged AS (SELECT item, SUM(1.0 / (60 + rank)) AS s, array_to_string(list_sort(list(source)), ',') AS sources FROM cut GROUP BY item)"""


def _lists(spark, d):
    events = _table(spark, d, "events").groupBy(F.col("user_id").alias("item")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("c"))
    a = events.select(F.lit("a").alias("source"), "item", F.row_number().over(Window.orderBy(F.desc(F.round("v", 6)), "item")).alias("rank"))
    b = events.select(F.lit("b").alias("source"), "item", F.row_number().over(Window.orderBy(F.desc("c"), "item")).alias("rank"))
    return a.unionByName(b).where("rank <= 30").withColumn("query_id", F.lit(1))


@query(f"WITH {RRF_CTE.replace('SUM(value) DESC', 'round(SUM(value), 6) DESC')} SELECT item, round(s, 6) AS rrf_score, sources, ROW_NUMBER() OVER (ORDER BY round(s, 12) DESC, item) AS rrf_rank FROM merged")
def rrf_merge(spark, d):
    return hybrid.rrf_merge(_lists(spark, d), key="item").select("item", F.round("rrf_score", 6).alias("rrf_score"), F.array_join("sources", ",").alias("sources"), F.col("rrf_rank").cast("long").alias("rrf_rank"))


@query(f"WITH {RRF_CTE.replace('SUM(value) DESC', 'round(SUM(value), 6) DESC')}, ranked AS (SELECT item, ROW_NUMBER() OVER (ORDER BY round(s, 12) DESC, item) AS rr FROM merged), sc AS (SELECT item, rr, CASE WHEN rr <= 50 AND item % 3 <> 0 THEN CAST(item % 7 AS DOUBLE) END AS score FROM ranked) SELECT item, ROW_NUMBER() OVER (ORDER BY CASE WHEN rr <= 50 THEN 0 ELSE 1 END, CASE WHEN score IS NULL THEN 1 ELSE 0 END, score DESC, rr, item) AS position FROM sc")
def rerank_sort(spark, d):
    score = F.when(F.col("item") % 3 != 0, (F.col("item") % 7).cast("double"))
    return hybrid.rerank(hybrid.rrf_merge(_lists(spark, d), key="item"), score, "item").select("item", F.col("position").cast("long").alias("position"))


@query(_fts_sql("""SELECT query_id, doc_id, round(rrf, 6) AS rrf_score, position, fts_count, vector_count, merged_count FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, doc_id) AS position FROM (SELECT *, SUM(fts) OVER (PARTITION BY query_id)::BIGINT AS fts_count, SUM(vec) OVER (PARTITION BY query_id)::BIGINT AS vector_count, COUNT(*) OVER (PARTITION BY query_id) AS merged_count FROM (
SELECT query_id, doc_id, SUM(1.0 / (60 + r)) AS rrf, MAX(fts) AS fts, MAX(1 - fts) AS vec FROM (
  SELECT query_id, doc_id, r, 1 AS fts FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) AS r FROM (SELECT *, MIN(tier) OVER (PARTITION BY query_id) AS low FROM scored) x WHERE tier = low) y WHERE r <= 30
  UNION ALL SELECT query_id, doc_id, r, 0 FROM (SELECT a.query_id, e.vec_id AS doc_id, ROW_NUMBER() OVER (PARTITION BY a.query_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS r FROM (SELECT DISTINCT query_id FROM asked) a JOIN embeddings q ON q.vec_id = CAST(substr(a.query_id, 2) AS BIGINT), embeddings e) z WHERE r <= 30) u GROUP BY query_id, doc_id) t) c WHERE doc_id IN (SELECT doc_id FROM documents)) w
WHERE position <= 10"""))
def hybrid_search(spark, d):
    """The library's search: documents as content, and the vectors nearest to the query's, fused and hydrated."""
    key = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")  # noqa: E731  in order of numbers
    docs, v = _table(spark, d, "documents"), _table(spark, d, "embeddings")
    symbols = docs.select(key("doc_id").alias("id"), F.lit("").alias("name"), F.lit("function").alias("kind"))
    content = docs.select(key("doc_id").alias("symbol_id"), F.col("text").alias("content"), F.lit("").alias("header"), F.lit("").alias("normalized_name"))
    embeddings = v.select(key("vec_id").alias("symbol_id"), "embedding")
    asked = _asked(spark).withColumn("vec_id", F.substring("query_id", 2, 9).cast("long")).join(v, "vec_id").select("query_id", "text", F.col("embedding").alias("query"))
    own = _index(spark, d)
    index = text.Index(own.postings.withColumn("symbol_id", key("doc_id")), own.lengths.withColumn("symbol_id", key("doc_id")), own.corpus)
    found = hybrid.hybrid_search(symbols, content, embeddings, asked, 10, index=index)
    return found.select("query_id", F.col("symbol.id").cast("long").alias("doc_id"), F.round("rrf_score", 6).alias("rrf_score"), F.col("position").cast("long").alias("position"), "fts_count", "vector_count", "merged_count")


# Relevance: a label's members are what each query vector should find.
NEAR = "near AS (SELECT q.vec_id AS query_id, v.vec_id AS item, v.label, q.label AS want, ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0), expected AS (SELECT q.vec_id AS query_id, v.vec_id AS item, ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) AS ideal_rank FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.label = q.label), n AS (SELECT query_id, COUNT(*) AS n FROM expected GROUP BY query_id)"


@query(f"""WITH {NEAR}, hit AS (SELECT r.query_id, COUNT(*) AS hits, SUM((n - e.ideal_rank + 1) / log2(r.rank + 1)) AS dcg FROM near r JOIN expected e ON e.query_id = r.query_id AND e.item = r.item JOIN n ON n.query_id = r.query_id WHERE r.rank <= 10 GROUP BY r.query_id),
ideal AS (SELECT e.query_id, SUM((n - ideal_rank + 1) / log2(ideal_rank + 1)) AS idcg FROM expected e JOIN n ON n.query_id = e.query_id WHERE ideal_rank <= 10 GROUP BY e.query_id)
SELECT n.query_id, round(COALESCE(hits, 0) / 10.0, 6) AS precision, round(COALESCE(hits, 0) / CAST(n AS DOUBLE), 6) AS recall, round(COALESCE(dcg / idcg, 0), 6) AS ndcg FROM n LEFT JOIN hit ON hit.query_id = n.query_id LEFT JOIN ideal ON ideal.query_id = n.query_id""")
def eval_pk_rk_ndcg(spark, d):
    v = _table(spark, d, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("want"))
    found = vector.knn(v.select("vec_id", "embedding"), asked.select("query_id", "query"), 10, "vec_id").select("query_id", F.col("vec_id").alias("item"), "rank")
    members = v.where("label IS NOT NULL").select(F.col("label").alias("want"), F.col("vec_id").alias("item"))
    expected = members.withColumn("ideal_rank", F.row_number().over(Window.partitionBy("want").orderBy("item")))
    out = evaluate.relevance(found, expected, 10, asked.select("query_id", "want"))
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")))


@query(f"WITH {SYM} SELECT kind AS case_id, COUNT(*) AS n_expected, COUNT(CASE WHEN start_line % 2 = 0 THEN 1 END) AS n_found, round(COUNT(CASE WHEN start_line % 2 = 0 THEN 1 END) / CAST(COUNT(*) AS DOUBLE), 6) AS recall FROM symbols GROUP BY kind")
def eval_recall(spark, d):
    items = lift.symbols(spark, d).select(F.col("kind").alias("case_id"), F.col("id").alias("item"), "start_line")
    return evaluate.recall(items.where("start_line % 2 = 0"), items.select("case_id", "item")).withColumn("recall", F.round("recall", 6))


@query("SELECT doc_id, CAST(floor((strlen(text) + 3) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return _table(spark, d, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


PATHS = "SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^https?://', '') || CASE page_id % 8 WHEN 0 THEN '/a.py' WHEN 1 THEN '/node_modules/b.ts' WHEN 2 THEN '/c.tsx' WHEN 3 THEN '/.git/d.rs' WHEN 4 THEN '/e.go' WHEN 5 THEN '/f.rb' WHEN 6 THEN '/g.html' ELSE '/build' END AS path FROM pages"
PATHS_SPARK = "SELECT page_id, regexp_replace(substring_index(substring_index(url, '?', 1), '#', 1), '^https?://', '') || CASE page_id % 8 WHEN 0 THEN '/a.py' WHEN 1 THEN '/node_modules/b.ts' WHEN 2 THEN '/c.tsx' WHEN 3 THEN '/.git/d.rs' WHEN 4 THEN '/e.go' WHEN 5 THEN '/f.rb' WHEN 6 THEN '/g.html' ELSE '/build' END AS path FROM {pages}"
LANG = "CASE regexp_extract(path, '[^/]\\.([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'rb' THEN 'ruby' END"
IGNORED = "regexp_matches({0}, '(^|/)(node_modules|__pycache__|venv|env|target|dist|build|vendor|\\.[^/]*)(/|$)')"


def _paths(spark, d):
    return spark.sql(PATHS_SPARK, pages=_table(spark, d, "pages"))


@query(f"WITH p AS ({PATHS}) SELECT page_id, {IGNORED.format('path')} AS ignored FROM p")
def ignored_dirs(spark, d):
    return _paths(spark, d).select("page_id", F.exists(F.split("path", "/"), S.is_ignored_dirname).alias("ignored"))


@query(f"WITH p AS ({PATHS}) SELECT path, {LANG} AS language FROM p")
def detect_language(spark, d):
    return _paths(spark, d).select("path", S.detect_language(F.col("path")).alias("language"))


@query(f"WITH p AS (SELECT page_id, 'repo/' || path AS path FROM ({PATHS}) x) SELECT page_id, ({LANG}) IS NOT NULL AND NOT {IGNORED.format(chr(114)+'egexp_extract(substr(path, 6), ' + chr(39) + '^(.*)/[^/]*$' + chr(39) + ', 1)')} AS relevant FROM p")
def relevant_path(spark, d):
    return _paths(spark, d).select("page_id", S.is_relevant_path(F.concat(F.lit("repo/"), F.col("path")), "repo").alias("relevant"))


SESSIONS = "s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 3600 THEN 1 ELSE 0 END AS new, event_id FROM events), g AS (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM s)"


@query(f"WITH {SESSIONS} SELECT user_id, MIN(ts) AS first_ts, MAX(ts) AS last_ts, COUNT(*) AS n FROM g GROUP BY user_id, session")
def debounce_sessions(spark, d):
    """Events of a user less than an hour apart are one burst."""
    from .streaming import watch

    return watch.debounce(_table(spark, d, "events"), "1 hour", ["user_id"]).select("user_id", "first_ts", "last_ts", F.col("n"))


@query(f"WITH {SESSIONS}, q AS (SELECT user_id, MAX(ts) AS last_ts FROM g GROUP BY user_id, session) SELECT user_id, last_ts + INTERVAL 2 HOUR AS fires_at FROM (SELECT user_id, last_ts, lead(last_ts) OVER (PARTITION BY user_id ORDER BY last_ts) AS following FROM q) WHERE following IS NULL OR epoch(following) - epoch(last_ts) > 7200")
def deferred_embed_fires(spark, d):
    """The embedding timer: two hours after a re-index that none follows sooner."""
    from .streaming import watch

    bursts = watch.debounce(_table(spark, d, "events"), "1 hour", ["user_id"])
    return watch.deferred_fires(bursts, 7200, ["user_id"])


# Bytes are cut in hexadecimal, two digits each; what is left of a character that the cut splits goes.
_SPLIT = "(?:C[2-9A-F]|D.|E.|F.|E.[89AB].|F.[89AB].|F.[89AB].[89AB].)$"
_ENDS = "[\\x09-\\x0D\\x{85}\\p{Z}]+"


@query(
    f"""WITH h AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents),
cut AS (SELECT doc_id, CASE WHEN strlen(text) <= 2048 THEN text ELSE decode(unhex(regexp_replace(substr(h, 1, 4096), '^((?:..)*?){_SPLIT}', '\\1'))) END AS content FROM h)
SELECT doc_id, content, 'h' || chr(10) || split_part(content, chr(10), 1) AS compact FROM cut WHERE strlen(regexp_replace(content, '^{_ENDS}|{_ENDS}$', '', 'g')) >= 50"""
)
def content_slice(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", S.content_slice(F.col("text")).alias("content")).where("content IS NOT NULL")
    return docs.select("doc_id", "content", S.compact_text(F.lit("h"), F.col("content")).alias("compact"))


@query("SELECT doc_id, '> ' || array_to_string(string_split(text, chr(10))[1:3], chr(10) || '> ') AS preview FROM documents")
def preview(spark, d):
    return _table(spark, d, "documents").select("doc_id", S.preview(F.col("text"), 3, "> ").alias("preview"))
