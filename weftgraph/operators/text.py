"""Full-text search: a stored index of postings with places, phrases, and BM25 with a cascade from phrase to all terms to
any term."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
BUCKETS, MAX_TERMS, SEGMENT_BYTES = 32, 2_000, 32_000_000
PHRASE, AND, OR = 0, 1, 2


def postings(docs: DataFrame, columns: list[str], key: str = "symbol_id") -> DataFrame:
    """(key, col, pos, term), a row for each token of each column."""
    out = None
    for i, c in enumerate(columns):
        own = docs.select(key, F.lit(i).alias("col"), F.posexplode(S.tokens(F.col(c))).alias("pos", "term"))
        out = own if out is None else out.unionByName(own)
    return out


def lengths(docs: DataFrame, columns: list[str], key: str = "symbol_id") -> DataFrame:
    """(key, len): tokens over all columns; needs no shuffle."""
    total = sum((F.size(S.tokens(F.col(c))) for c in columns[1:]), F.size(S.tokens(F.col(columns[0]))))
    return docs.select(key, total.cast("long").alias("len"))


def phrases(queries: DataFrame) -> DataFrame:
    """queries(query_id, text) -> (query_id, tier, phrase, off, term, terms, phrases): the tokens of every phrase.

    The whole query is the phrase of tier 0; every word between white space is one of tiers 1 (if there are two or more)
    and 2.
    """
    words = F.split(F.btrim("text"), r"\s+")
    whole = queries.select("query_id", F.lit(PHRASE).alias("tier"), F.lit(0).alias("phrase"), S.tokens(F.col("text")).alias("t"))
    parts = queries.select("query_id", F.posexplode(words).alias("phrase", "w"), F.size(words).alias("n"))
    parts = parts.select("query_id", F.explode(F.when(F.col("n") > 1, F.array(F.lit(AND), F.lit(OR))).otherwise(F.array(F.lit(OR)))).alias("tier"), "phrase", S.tokens(F.col("w")).alias("t"))
    both = whole.unionByName(parts).where(F.size("t") > 0)
    counted = both.withColumn("phrases", F.count(F.lit(1)).over(Window.partitionBy("query_id", "tier")))
    return counted.select("query_id", "tier", "phrase", F.posexplode("t").alias("off", "term"), F.size("t").alias("terms"), "phrases")


@dataclass
class Index:
    """postings(bucket, term, key, col, pos), lengths(key, len) and corpus(n_docs, avgdl), one row."""

    postings: DataFrame
    lengths: DataFrame
    corpus: DataFrame

    @staticmethod
    def build(docs: DataFrame, columns: list[str], path: str, key: str = "symbol_id") -> Index:
        """Writes the index to path. Texts are tokenised once. They are dealt by document to segments of about
        SEGMENT_BYTES of text, so what a task sorts is bounded and only texts are shuffled. Postings of a segment lie in
        folders by a hash of the term and are in order of terms within files, so a search reads the files that may hold its
        terms; a document's length is its row in folder -1."""
        n_bytes = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in columns[1:]), F.coalesce(F.octet_length(columns[0]), F.lit(0)).cast("long"))
        segments = max(1, math.ceil((docs.agg(F.sum(n_bytes)).first()[0] or 0) / SEGMENT_BYTES))
        tokens = docs.select(key, *columns).repartition(segments, key).select(key, F.array(*(S.tokens(F.col(c)) for c in columns)).alias("cols"))
        size = sum((F.size(F.get("cols", F.lit(i))) for i in range(1, len(columns))), F.size(F.get("cols", F.lit(0))))
        each = tokens.select(key, size.alias("len"), F.posexplode("cols").alias("col", "own"))
        none = F.array(F.lit(None).cast("string"))
        each = each.select(key, "len", "col", F.posexplode(F.when(F.col("col") == 0, F.concat("own", none)).otherwise(F.col("own"))).alias("pos", "term"))
        place = F.when(F.col("term").isNull(), F.col("len")).otherwise(F.col("pos"))
        bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        dealt = each.select(bucket.alias("bucket"), "term", key, "col", place.alias("pos")).sortWithinPartitions("bucket", "term", key)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        written = docs.sparkSession.read.parquet(f"{path}/postings")
        written.where("bucket = -1").select(key, F.col("pos").cast("long").alias("len")).write.mode("overwrite").parquet(f"{path}/lengths")
        lengths = docs.sparkSession.read.parquet(f"{path}/lengths")
        lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/corpus")
        return Index.open(docs.sparkSession, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        index = Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "corpus")))
        index.postings = index.postings.where("bucket >= 0")
        return index

    def of_terms(self, asked: DataFrame) -> DataFrame:
        """Postings of asked(term). Up to MAX_TERMS terms are put into the plan, where they prune folders and row groups."""
        terms = asked.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        head = terms.limit(MAX_TERMS + 1).collect()
        if len(head) > MAX_TERMS:
            return self.postings
        if not head:
            return self.postings.limit(0)
        return self.postings.where(F.col("bucket").isin(sorted({r["bucket"] for r in head})) & F.col("term").isin(sorted(r["term"] for r in head)))


def phrase_hits(index: DataFrame, asked: DataFrame, key: str = "symbol_id") -> DataFrame:
    """(query_id, tier, phrase, phrases, key, f): how often a document has each phrase, within one column.

    Only postings of asked terms are read on. Those of a document are counted first for phrases of one token, whatever the
    number of phrases; a longer phrase stands where all its tokens agree on a start.
    """
    of = ["query_id", "tier", "phrase", "phrases", key]
    single, longer = asked.where("terms = 1"), asked.where("terms > 1")
    counted = index.join(single.select("term").distinct(), "term", "left_semi").groupBy("term", key).agg(F.count(F.lit(1)).alias("f"))
    met = index.join(longer, "term").withColumn("start", F.col("pos") - F.col("off"))
    whole = met.groupBy(*of, "terms", "col", "start").agg(F.count(F.lit(1)).alias("c")).where("c = terms")
    return counted.join(single, "term").select(*of, "f").unionByName(whole.groupBy(*of).agg(F.count(F.lit(1)).alias("f")))


def bm25(hits: DataFrame, docs_len: DataFrame, key: str = "symbol_id", corpus: DataFrame | None = None) -> DataFrame:
    """(query_id, tier, key, score): lower is better. A tier 1 row has all phrases."""
    if corpus is None:
        corpus = docs_len.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avgdl"))
    df = hits.groupBy("query_id", "tier", "phrase").agg(F.count(F.lit(1)).alias("n"))
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    wide = hits.join(df, ["query_id", "tier", "phrase"]).join(docs_len, key).join(F.broadcast(corpus))  # corpus: one row
    term = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = wide.groupBy("query_id", "tier", "phrases", key).agg(F.sum(-term).alias("score"), F.count(F.lit(1)).alias("has"))
    return scored.where((F.col("tier") != AND) | (F.col("has") == F.col("phrases"))).select("query_id", "tier", key, "score")


def scored(queries: DataFrame, index: Index, key: str = "symbol_id") -> DataFrame:
    """queries(query_id, text) -> (query_id, tier, key, score) of every tier, from a stored index."""
    asked = phrases(queries)
    return bm25(phrase_hits(index.of_terms(asked), asked, key), index.lengths, key, index.corpus)


def search(docs: DataFrame, queries: DataFrame, columns: list[str], limit: int, key: str = "symbol_id", index: Index | None = None) -> DataFrame:
    """queries(query_id, text) -> (query_id, key, tier, score, rank): the lowest tier that has any hit, best first. Without
    an index, texts are tokenised for this search alone."""
    if index is None:
        found = bm25(phrase_hits(postings(docs, columns, key), phrases(queries), key), lengths(docs, columns, key), key)
    else:
        found = scored(queries, index, key)
    lowest = found.groupBy("query_id").agg(F.min("tier").alias("tier"))
    chosen = found.join(lowest, ["query_id", "tier"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9), key))
    return chosen.withColumn("rank", rank).where(F.col("rank") <= limit)
