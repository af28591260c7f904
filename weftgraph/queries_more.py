"""More queries over the lifted tables: lookups, batches, renderers, counters and scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import render, schema
from .functions import scalars as S
from .functions import sql
from .operators import evaluate, graph, incremental, lookup, text, vector
from .plans import lift
from .queries import EDG, FIL, ORACLE_SQL, QUERIES, RESOLVED, STORED, SYM, _asked, _edges, _fts_sql, _index, _stored, _table, query

IDS = ("geo/nation:FRANCE:7", "geo/region:ASIA:3", "no/such:thing:1", "geo/region:ASIA:3", "geo/region:EUROPE:4")


@query(f"WITH {SYM}, ids AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{x}{chr(39)})' for i, x in enumerate(IDS))}) v(position, id)) SELECT CAST(position AS INT) AS position, s.id, s.name, s.start_line FROM ids JOIN symbols s ON s.id = ids.id")
def symbols_by_ids(spark, d):
    """A list of ids, in its order; unknown ids give nothing."""
    return lookup.of_list(lift.symbols(spark, d), list(IDS)).select("position", "id", "name", "start_line")


@query(f"WITH {SYM} SELECT id, name, kind FROM symbols WHERE id = 'geo/region:ASIA:3'")
def symbol_point(spark, d):
    return lookup.point(lift.symbols(spark, d), "id", "geo/region:ASIA:3").select("id", "name", "kind")


@query("SELECT e.vec_id AS position, d.doc_id, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 20 = 0")
def content_by_ids(spark, d):
    """A table of ids against all contents."""
    ids = _table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("position"), F.col("vec_id").alias("doc_id"))
    return lookup.by_ids(_table(spark, d, "documents").select("doc_id", "text"), ids, "doc_id")


@query(f"WITH {FIL} SELECT p.path, f.path IS NOT NULL AS known FROM (SELECT lang || '/' || source || '/' || CAST(doc_id AS STRING) AS path FROM documents UNION ALL SELECT 'gone/' || CAST(doc_id AS STRING) FROM documents) p LEFT JOIN files f ON f.path = p.path")
def files_exist(spark, d):
    files = lift.files(spark, d)
    gone = _table(spark, d, "documents").select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string")).alias("path"))
    return lookup.known(files.select("path").unionByName(gone), files, "path")


@query(f"WITH {FIL} SELECT path FROM files")
def files_by_path(spark, d):
    return lookup.files_by_path(lift.files(spark, d).select("path"))


@query("SELECT CAST(vec_id AS STRING) AS symbol_id FROM embeddings")
def content_ids(spark, d):
    return lookup.content_ids(_table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("symbol_id")))


@query(f"WITH {EDG}, {SYM} SELECT DISTINCT e.source_id, s.name FROM edges e LEFT JOIN symbols s ON s.id = e.source_id")
def names_of_sources(spark, d):
    """The name of a symbol by its id."""
    return lookup.names_of(lift.symbols(spark, d), lift.edges(spark, d).select("source_id").distinct(), "source_id")


@query(_fts_sql("SELECT y.query_id, y.doc_id, CAST(r AS INT) AS rank, sha256(d.text) AS content_hash FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) AS r FROM (SELECT *, MIN(tier) OVER (PARTITION BY query_id) AS low FROM scored) x WHERE tier = low) y JOIN documents d ON d.doc_id = y.doc_id WHERE r <= 10"))
def fts_content(spark, d):
    """Hits of full text with the contents that they point to."""
    hits = text.search(_table(spark, d, "documents"), _asked(spark), ["text"], 10, "doc_id", _index(spark, d)).withColumnRenamed("doc_id", "symbol_id")
    content = _table(spark, d, "documents").select(F.col("doc_id").alias("symbol_id"), F.lit("").alias("header"), F.col("text").alias("content"))
    return lookup.content_of_hits(content, hits).select("query_id", F.col("symbol_id").alias("doc_id"), "rank", F.sha2("content", 256).alias("content_hash"))


@query("SELECT COUNT(*) AS contents, COUNT(e.vec_id) AS embedded, COUNT(*) - COUNT(e.vec_id) AS missing FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def embedding_coverage(spark, d):
    content = _table(spark, d, "documents").select(F.col("doc_id").alias("symbol_id"))
    return lookup.coverage(content, _table(spark, d, "embeddings").select(F.col("vec_id").alias("symbol_id")))


@query("SELECT vec_id AS symbol_id, CASE WHEN vec_id % 3 = 0 THEN -CAST(embedding[1] AS DOUBLE) ELSE CAST(embedding[1] AS DOUBLE) END AS first, len(embedding) AS dim FROM embeddings")
def vector_upsert(spark, d):
    own = _table(spark, d, "embeddings").select(F.col("vec_id").alias("symbol_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    new = own.where("symbol_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return vector.upserted(own, new).select("symbol_id", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.size("embedding").cast("long").alias("dim"))


@query("SELECT vec_id AS symbol_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def vector_clear(spark, d):
    ids = _table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("symbol_id"))
    return vector.cleared(_table(spark, d, "embeddings").select(F.col("vec_id").alias("symbol_id")), ids)


@query(f"WITH {FIL}, {STORED}, c AS (SELECT COUNT(*) AS n FROM files), x AS (SELECT COUNT(*) AS n FROM files f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.path = f.path AND s.hash = f.hash)), r AS (SELECT COUNT(*) AS n FROM stored s WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.path = s.path)) SELECT x.n AS indexed, c.n - x.n AS skipped, r.n AS removed FROM c, x, r")
def index_counters(spark, d):
    """What an incremental run reports."""
    files, stored = lift.files(spark, d), _stored(spark, d)
    marked = incremental.changed_files(files, stored).select("path", F.lit(1).alias("changed"))
    n = files.join(marked, "path", "left").agg(F.count("changed").alias("indexed"), F.count_if(F.col("changed").isNull()).alias("skipped"))
    return n.crossJoin(incremental.removed_files(files, stored).agg(F.count(F.lit(1)).alias("removed")))  # one row each


@query(f"WITH {SYM} SELECT file_path, CAST(ROW_NUMBER() OVER (PARTITION BY file_path ORDER BY start_line, id) AS INT) AS place, id FROM symbols WHERE file_path IN (SELECT DISTINCT file_path FROM symbols WHERE kind <> 'variable')")
def outline_batch(spark, d):
    symbols = lift.symbols(spark, d)
    return graph.outline_batch(symbols, symbols.where("kind != 'variable'").select("file_path")).select("file_path", "place", "id")


@query(f"WITH {RESOLVED}, i AS (SELECT s.name AS child, r.target_name AS parent FROM resolved r JOIN symbols s ON s.id = r.source_id WHERE r.kind = 'inherits'), n AS (SELECT DISTINCT name FROM symbols WHERE kind = 'class') SELECT n.name, i.child, i.parent FROM n JOIN i ON i.child = n.name OR i.parent = n.name")
def hierarchy_batch(spark, d):
    symbols = lift.symbols(spark, d)
    return graph.hierarchy_batch(_edges(spark, d), symbols, symbols.where("kind = 'class'").select("name"))


@query("SELECT CAST(page_id AS STRING) AS file_path, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target_name FROM pages WHERE page_id % 20 = 0")
def deps_batch(spark, d):
    pages = _table(spark, d, "pages").select(F.col("page_id").cast("string").alias("file_path"), "page_id", "html")
    edges = pages.select("file_path", F.lit("imports").alias("kind"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target_name"))
    return graph.file_deps_batch(edges, pages.where("page_id % 20 = 0").select("file_path")).select("file_path", "target_name")


@query(f"WITH {SYM} SELECT id FROM (SELECT id, ROW_NUMBER() OVER (ORDER BY CASE WHEN lower(name) = '0' THEN 0 WHEN starts_with(name, '0') THEN 1 ELSE 2 END + CASE WHEN kind IN ('function', 'method', 'class') THEN 0 ELSE 3 END, CASE kind WHEN 'function' THEN 0 WHEN 'method' THEN 1 WHEN 'class' THEN 2 ELSE 3 END, file_path, start_line, id) AS r FROM symbols WHERE contains(name, '0')) WHERE r <= 100")
def search_limit_clamped(spark, d):
    """A limit over 100 is 100."""
    return graph.search(lift.symbols(spark, d), "0", limit=5000).select("id")


@query(f"WITH {RESOLVED} SELECT concat_ws('  ', r.kind, COALESCE(s.name, r.source_id), r.file_path || ':' || CAST(r.line AS STRING)) AS text FROM resolved r LEFT JOIN symbols s ON s.id = r.source_id LEFT JOIN symbols t ON t.id = r.target_id WHERE r.target_name = 'EUROPE' OR t.name = 'EUROPE'")
def render_refs(spark, d):
    return render.lines("refs", graph.refs(_edges(spark, d), lift.symbols(spark, d), "EUROPE")).select("text")


@query(f"WITH {RESOLVED} SELECT r.target_name || '  ' || r.file_path || ':' || CAST(r.line AS STRING) AS text FROM resolved r JOIN symbols s ON s.id = r.source_id WHERE r.kind = 'calls' AND s.name = 'Supplier#000000001'")
def render_callees(spark, d):
    return render.lines("callees", graph.callees(_edges(spark, d), lift.symbols(spark, d), "Supplier#000000001")).select("text")


@query(f"WITH {RESOLVED} SELECT s.name || ' -> ' || r.target_name AS text FROM resolved r JOIN symbols s ON s.id = r.source_id WHERE r.kind = 'inherits' AND (s.name = 'ASIA' OR r.target_name = 'ASIA')")
def render_hierarchy(spark, d):
    return render.lines("hierarchy", graph.hierarchy(_edges(spark, d), lift.symbols(spark, d), "ASIA")).select("text")


@query(f"WITH {SYM} SELECT kind || '  ' || name || '  ' || file_path || ':' || CAST(start_line AS STRING) AS text FROM symbols WHERE file_path = 'geo/nation' AND contains(lower(name), 'nation')")
def render_search(spark, d):
    return render.lines("search", graph.search(lift.symbols(spark, d), "NATION", file="geo/nation")).select("text")


@query(f"WITH {SYM} SELECT '  symbol_kind ' || kind || ': ' || CAST(COUNT(*) AS STRING) AS text FROM symbols GROUP BY kind")
def render_stats(spark, d):
    symbols = lift.symbols(spark, d)
    none = symbols.select(F.lit(None).cast("string").alias("target_id")).limit(0)
    found = graph.stats(symbols, none, symbols.select(F.lit("x").alias("language")).limit(0))
    return render.lines("stats", found.where("metric = 'symbol_kind'")).select("text")


@query(f"WITH {SYM} SELECT CAST(json_object('id', id, 'name', name, 'kind', kind, 'start_line', start_line) AS STRING) AS json FROM symbols")
def json_rows(spark, d):
    """Results as JSON."""
    return lift.symbols(spark, d).select(F.to_json(F.struct("id", "name", "kind", "start_line")).alias("json"))


@query(f"WITH {SYM} SELECT id, replace(replace(replace(name || '_%\\', '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped FROM symbols")
def like_escape(spark, d):
    return lift.symbols(spark, d).select("id", S.like_escape(F.concat("name", F.lit("_%\\"))).alias("escaped"))


@query("SELECT page_id, trim(CASE page_id % 3 WHEN 0 THEN '''' || url || '''' WHEN 1 THEN '\"' || url || '\"' ELSE '`' || url || '`' END, '''\"`') AS plain FROM pages")
def strip_quotes(spark, d):
    mark = F.when(F.col("page_id") % 3 == 0, "'").when(F.col("page_id") % 3 == 1, '"').otherwise("`")
    return _table(spark, d, "pages").select("page_id", S.strip_quotes(F.concat(mark, "url", mark)).alias("plain"))


@query("SELECT page_id, split_part(url, '/', -1) AS slash, split_part(replace(url, '/', '::'), '::', -1) AS colons FROM pages")
def last_segment(spark, d):
    pages = _table(spark, d, "pages")
    return pages.select("page_id", S.last_segment(F.col("url")).alias("slash"), S.last_segment(F.replace("url", F.lit("/"), F.lit("::")), "::").alias("colons"))


@query("SELECT page_id, '/' || array_to_string(list_filter(string_split(split_part(url, '://', -1), '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM pages WHERE NOT contains(url, '..')")
def normalize_path(spark, d):
    """With a step down and up again before each segment and dots between, which have to vanish."""
    pages = _table(spark, d, "pages").where("NOT contains(url, '..')")
    path = F.concat(F.lit("/down/.././"), F.replace(F.substring_index("url", "://", -1), F.lit("/"), F.lit("/./x/../")))
    return pages.select("page_id", S.normalize_path(path).alias("path"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\\s*\\*?', ''), ' ')), lambda x: x <> '' AND NOT starts_with(x, '@')), ' ') AS doc FROM documents WHERE NOT contains(text, '*/') AND NOT contains(text, '/*')")
def clean_jsdoc(spark, d):
    docs = _table(spark, d, "documents").where("NOT contains(text, '*/') AND NOT contains(text, '/*')")
    return docs.select("doc_id", S.clean_jsdoc(F.concat(F.lit("/**\n * "), F.replace("text", F.lit("\n"), F.lit("\n * ")), F.lit("\n * @param x\n */"))).alias("doc"))


@query(f"""WITH {SYM}, n AS (SELECT DISTINCT p.mark || s.name || p.tail AS name FROM symbols s, (VALUES ('', ''), ('_', ''), ('__', ''), ('__', '__'), ('#', '')) p(mark, tail)), l AS (SELECT unnest(['python', 'go', 'typescript', 'ruby', 'rust']) AS language)
SELECT name, language, CASE language WHEN 'python' THEN CASE WHEN starts_with(name, '__') THEN CASE WHEN ends_with(name, '__') THEN 'public' ELSE 'private' END WHEN starts_with(name, '_') THEN 'protected' ELSE 'public' END
WHEN 'go' THEN CASE WHEN regexp_matches(name, '^\\p{{Lu}}') THEN 'public' ELSE 'private' END WHEN 'typescript' THEN CASE WHEN starts_with(name, '#') THEN 'private' WHEN starts_with(name, '_') THEN 'protected' ELSE 'public' END
WHEN 'ruby' THEN CASE WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END ELSE 'public' END AS visibility FROM n, l""")
def visibility_rules(spark, d):
    marks = F.explode(F.array(*(F.struct(F.lit(a).alias("mark"), F.lit(b).alias("tail")) for a, b in (("", ""), ("_", ""), ("__", ""), ("__", "__"), ("#", "")))))
    names = lift.symbols(spark, d).select("name", marks.alias("m")).select(F.concat("m.mark", "name", "m.tail").alias("name")).distinct()
    asked = names.select("name", F.explode(F.array(*(F.lit(x) for x in ("python", "go", "typescript", "ruby", "rust")))).alias("language"))
    return asked.select("name", "language", S.visibility(F.col("name"), F.col("language")).alias("visibility"))


@query("SELECT event_id, CASE WHEN event_type IN ('function', 'class', 'method', 'variable', 'import') THEN event_type ELSE 'variable' END AS kind, 'references' AS edge_kind, 'public' AS visibility FROM events")
def lossy_kinds(spark, d):
    """Unknown values are read as the vocabularies' defaults."""
    kind = F.col("event_type")
    return _table(spark, d, "events").select("event_id", schema.lossy(kind, schema.SYMBOL_KINDS).alias("kind"), schema.lossy(kind, schema.EDGE_KINDS).alias("edge_kind"), schema.lossy(kind, schema.VISIBILITIES).alias("visibility"))


@query(f"WITH {SYM} SELECT DISTINCT name, regexp_matches(name, '^\\p{{Lu}}') AS upper FROM symbols")
def starts_upper(spark, d):
    return lift.symbols(spark, d).select("name", S.starts_upper(F.col("name")).alias("upper")).distinct()


@query(f"SELECT round(AVG(precision), 6) AS precision, round(AVG(recall), 6) AS recall, round(AVG(ndcg), 6) AS ndcg FROM ({ORACLE_SQL['eval_pk_rk_ndcg']}) x")
def eval_means(spark, d):
    """Means over all queries."""
    found = evaluate.means(QUERIES["eval_pk_rk_ndcg"](spark, d))
    return found.select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")))


@query("SELECT a.vec_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def l2_distances(spark, d):
    """Distances of pairs as an expression."""
    v = _table(spark, d, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select("vec_id", F.round(S.l2_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query(f"WITH {SYM}, m AS (SELECT DISTINCT name, unnest(['pub ', 'pub(crate) ', '', 'private static ', 'protected ']) AS modifiers FROM symbols), l AS (SELECT unnest(['rust', 'typescript', 'ruby']) AS language) SELECT name, modifiers, language, CASE language WHEN 'rust' THEN CASE WHEN starts_with(modifiers, 'pub') THEN 'public' ELSE 'private' END ELSE CASE WHEN contains(modifiers, 'private') THEN 'private' WHEN contains(modifiers, 'protected') THEN 'protected' ELSE 'public' END END AS visibility FROM m, l")
def visibility_modifiers(spark, d):
    words = F.explode(F.array(*(F.lit(x) for x in ("pub ", "pub(crate) ", "", "private static ", "protected ")))).alias("modifiers")
    asked = lift.symbols(spark, d).select("name").distinct().select("name", words)
    asked = asked.select("*", F.explode(F.array(*(F.lit(x) for x in ("rust", "typescript", "ruby")))).alias("language"))
    return asked.select("name", "modifiers", "language", S.visibility(F.col("name"), F.col("language"), F.col("modifiers")).alias("visibility"))


@query(f"WITH {SYM} SELECT id, split_part(id, ':', -1) AS last, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir, file_path || ':' || name || ':' || CAST(start_line AS STRING) AS same, CASE WHEN kind IN ('function', 'method', 'class') THEN 0 ELSE 3 END AS penalty, CAST(floor((strlen(name) + 3) / 4) AS BIGINT) AS tokens FROM symbols")
def sql_functions(spark, d):
    """The scalar functions as a session's SQL has them."""
    sql.register(spark)
    text_of = "SELECT id, weft_last_segment(id, ':') AS last, weft_dirname(file_path) AS dir, weft_symbol_id(file_path, name, start_line) AS same, weft_kind_penalty(kind) AS penalty, weft_token_estimate(name) AS tokens FROM {symbols}"
    return spark.sql(text_of, symbols=lift.symbols(spark, d))
