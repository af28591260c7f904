"""URL filter: rules first, then gradient-boosted trees on lexical features, in DataFrame operations only.

A rule names a host and a path prefix; it fits its host and all subdomains, and the longest fitting rule wins. URLs that
rules decide are the labelled ones. A bounded sample of them (max_labelled distinct URLs of lowest hash, weighted by their
rows; nothing else is sampled) trains the trees: every level of a tree is one aggregation of gradients by node, feature
and bin, and the fitted trees become one CASE expression, so that all URLs are scored in generated code. A labelled URL
trains with suffix statistics of the other folds of hosts only, so its own label isn't among its features; holdout()
measures the trees on hosts that they haven't seen.

Defined cases: a null URL or one without :// has empty host and path, fits no rule and is judged by the method; without
labelled URLs, or with one class only, the method's verdict is the prior's (ties: allow); URLs of any length are read
whole; a null page_id stays null; an empty table gives an empty result; repeated rows are judged each, alike; the whole
input row, extra columns of any name included, is kept in the struct `page`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: The rules of the contract.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
MAX_LABELLED, TREES, DEPTH, RATE, BINS, SMOOTH, FOLDS = 20_000, 8, 3, 0.4, 8, 1.0, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical(pages: DataFrame) -> DataFrame:
    """pages(url, host, path) with the numeric features f_*; needs no other row."""
    url = F.coalesce(F.col("url"), F.lit(""))
    chars = F.split(url, "")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / F.length(url)
    entropy = F.when(url == "", 0.0).otherwise(F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return pages.withColumns(
        {
            "f_length": F.length(url).cast("double"),
            "f_host_length": F.length("host").cast("double"),
            "f_path_length": F.length("path").cast("double"),
            "f_labels": _count(F.col("host"), r"\."),
            "f_depth": _count(F.col("path"), "/[^/]"),
            "f_digit_ratio": F.when(url == "", 0.0).otherwise(_count(url, "[0-9]") / F.length(url)),
            "f_host_digits": _count(F.col("host"), "[0-9]"),
            "f_hyphens": _count(F.col("host"), "-"),
            "f_entropy": F.round(entropy, 6),
            "f_params": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
            "f_fragment": F.contains(url, F.lit("#")).cast("double"),
            "f_secure": F.startswith(url, F.lit("https")).cast("double"),
        }
    )


FEATURES = ("f_length", "f_host_length", "f_path_length", "f_labels", "f_depth", "f_digit_ratio", "f_host_digits", "f_hyphens", "f_entropy", "f_params", "f_fragment", "f_secure", "f_suffix")


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """labelled(host, y) -> (__suffix, __fold, f_suffix), from all rows: the smoothed share of blocked ones among those with
    the host's last label; fold -1 has all of them, the others all but their own.

    A rule fits hosts of its own last label only, so there are at most FOLDS + 1 rows for each rule.
    """
    each = labelled.groupBy(suffix(F.col("host")).alias("__suffix"), fold(F.col("host")).alias("own")).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    whole = each.groupBy("__suffix").agg(F.sum("y").alias("all_y"), F.sum("n").alias("all_n"))
    folds = F.explode(F.array(*(F.lit(k) for k in range(-1, FOLDS)))).alias("__fold")
    asked = whole.select("__suffix", "all_y", "all_n", folds).join(each.withColumnRenamed("own", "__fold"), ["__suffix", "__fold"], "left")
    y, n = F.col("all_y") - F.coalesce("y", F.lit(0.0)), F.col("all_n") - F.coalesce("n", F.lit(0))
    return asked.select("__suffix", "__fold", F.round((y + SMOOTH) / (n + 2 * SMOOTH), 6).alias("f_suffix"))


def with_suffix_statistics(pages: DataFrame, stats: DataFrame, fold: Column | None = None) -> DataFrame:
    """pages(host) with f_suffix of the given fold (none: all labelled rows); 0.5 where no labelled host has the suffix."""
    keyed = pages.withColumns({"__suffix": suffix(F.col("host")), "__fold": F.lit(-1) if fold is None else fold})
    joined = keyed.join(F.broadcast(stats), ["__suffix", "__fold"], "left")
    return joined.withColumn("f_suffix", F.coalesce("f_suffix", F.lit(0.5))).drop("__suffix", "__fold")


def _leaf_value(g: float, h: float) -> float:
    return RATE * g / (h + SMOOTH)


def _split_at(feature: str, cut: float) -> Column:
    return F.col(feature) <= F.lit(cut)


def _grow(rows: DataFrame, cuts: dict[str, list[float]], margin: Column) -> Column:
    """One tree for the logistic loss at `margin`, as a Column of what it adds."""
    p = 1 / (1 + F.exp(-margin))
    base = rows.withColumns({"__g": F.col("weight") * (F.col("y") - p), "__h": F.col("weight") * p * (1 - p)})
    bins = F.array(*(F.struct(F.lit(f).alias("feature"), sum((F.col(f) > c).cast("int") for c in cuts[f]).alias("bin")) for f in cuts))
    tree: dict[int, tuple[str, float]] = {}  # node -> split; children 2n and 2n + 1
    values: dict[int, float] = {}
    node, level = F.lit(1), [1]
    for depth in range(DEPTH):
        told = base.withColumns({"__node": node, "__bin": F.explode(bins)}).groupBy("__node", "__bin.feature", "__bin.bin").agg(F.sum("__g").alias("g"), F.sum("__h").alias("h"))
        sums: dict[int, dict[str, list[list[float]]]] = {}
        for r in told.collect():  # 2 ** depth * features * bins rows at most
            sums.setdefault(r["__node"], {}).setdefault(r["feature"], [[0.0, 0.0] for _ in range(len(cuts[r["feature"]]) + 1)])[r["bin"]] = [round(r["g"], 9), round(r["h"], 9)]
        following = []
        for n in level:
            if n not in sums:
                continue
            by = sums[n]
            g, h = (sum(x[i] for x in by[min(by)]) for i in (0, 1))
            values[n] = _leaf_value(g, h)
            best = (1e-6, "", 0.0)
            for f in sorted(by):
                left = [0.0, 0.0]
                for cut, (bg, bh) in zip(cuts[f], by[f], strict=False):
                    left = [left[0] + bg, left[1] + bh]
                    if left[1] > 1e-3 and h - left[1] > 1e-3:
                        gain = left[0] ** 2 / (left[1] + SMOOTH) + (g - left[0]) ** 2 / (h - left[1] + SMOOTH) - g**2 / (h + SMOOTH)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
            if best[1]:
                tree[n] = best[1:]
                following += [2 * n, 2 * n + 1]
        level = following
        node = _routed(tree, 1, lambda n: F.lit(n))
        if not level:
            break
    if level:  # values of the last level
        told = base.withColumn("__node", node).groupBy("__node").agg(F.sum("__g").alias("g"), F.sum("__h").alias("h")).collect()
        values |= {r["__node"]: _leaf_value(round(r["g"], 9), round(r["h"], 9)) for r in told}
    return _routed(tree, 1, lambda n: F.lit(round(values.get(n, 0.0), 9)))


def _routed(tree: dict[int, tuple[str, float]], n: int, leaf) -> Column:
    if n not in tree:
        return leaf(n)
    return F.when(_split_at(*tree[n]), _routed(tree, 2 * n, leaf)).otherwise(_routed(tree, 2 * n + 1, leaf))


def fit(labelled: DataFrame) -> Column:
    """labelled(FEATURES, y: 1.0 for block, weight: 1 if absent), a small written table -> the log odds of block, as a
    Column over FEATURES."""
    if "weight" not in labelled.columns:
        labelled = labelled.withColumn("weight", F.lit(1).cast("long"))
    n, blocked = labelled.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum(F.col("y") * F.col("weight")), F.lit(0.0))).first()
    margin = F.lit(math.log((blocked + SMOOTH) / (n - blocked + SMOOTH)))
    if not 0 < blocked < n:
        return margin
    grid = [k / BINS for k in range(1, BINS)]
    found = labelled.agg(*(F.percentile(f, grid, F.col("weight")).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted({round(float(c), 9) for c in found[f]}) for f in FEATURES}
    for _ in range(TREES):
        margin = margin + _grow(labelled, cuts, margin)
    return margin


def named(pages: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """pages(url, ...) -> (page struct, url, host, path, rule, y): y is 1.0 where the rule blocks, null without a rule."""
    host, path = host_path(F.col("url"))
    own = pages.select(F.struct("*").alias("page"), "url").withColumns({"host": host, "path": path})
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return own.withColumn("y", F.when(F.col("rule").isNotNull(), F.col("rule").isin([rule for rule, verdict in rules if verdict == "block"]).cast("double")))


def training_rows(decided: DataFrame, stats: DataFrame, max_labelled: int) -> DataFrame:
    """decided(url, host, path, y) -> a written table (FEATURES, host, y, weight) of at most max_labelled distinct URLs."""
    distinct = decided.groupBy("url", "host", "path", "y").agg(F.count(F.lit(1)).alias("weight"))
    sample = store.written(distinct.orderBy(F.xxhash64("url"), "url").limit(max_labelled), "url-sample")
    return store.written(with_suffix_statistics(lexical(sample), stats, fold(F.col("host"))).select(*FEATURES, "host", "y", "weight"), "url-labelled")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """pages(url, ...) -> (page struct, host, path, rule, verdict, score): allow or block, and the log odds of block."""
    own = named(pages, rules)
    decided = own.where("y IS NOT NULL").select("url", "host", "path", "y")
    stats = store.written(suffix_statistics(decided), "url-suffixes")
    score = fit(training_rows(decided, stats, max_labelled))
    scored = with_suffix_statistics(lexical(own), stats).withColumn("score", F.round(score, 6))
    blocked = F.coalesce(F.col("y") > 0, F.col("score") > 0)
    return scored.select("page", "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"), "score")


def holdout(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """Distinct URLs of the first fold of hosts, judged by trees that learnt from the other folds: how many, the share
    judged as the rules do, and the share of the more frequent class, which a constant verdict would get."""
    decided = named(pages, rules).where("y IS NOT NULL").select("url", "host", "path", "y")
    learnt = decided.where(fold(F.col("host")) != 0)
    score = fit(training_rows(learnt, store.written(suffix_statistics(learnt), "url-suffixes"), max_labelled))
    asked = decided.where(fold(F.col("host")) == 0).distinct()
    judged = with_suffix_statistics(lexical(asked), suffix_statistics(learnt)).select("y", (score > 0).cast("double").alias("z"))
    n, right, blocked = judged.agg(F.count(F.lit(1)), F.avg((F.col("y") == F.col("z")).cast("double")), F.avg("y")).first()
    return {"n": n, "accuracy": right or 0.0, "constant": max(blocked, 1 - blocked) if n else 0.0}


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of pages: host, path, rule, verdict and the trees' score."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page.page_id", "host", "path", "rule", "verdict", "score")
