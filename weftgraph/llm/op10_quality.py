"""Quality rules by weak supervision, in DataFrame operations only.

Nine rules vote good (1) or bad (-1) or abstain (0). Expectation-maximisation over the counts of all vote patterns of
documents that the base rules leave open (3 ** 9 patterns at most, whatever the corpus) estimates each rule's accuracy
on good and on bad documents and the share of good ones; a document is kept if its posterior probability of being good
is one half or more. This replaces filtering by "all rules must pass". Two base rules come first: fewer than 20 words, or over 30 % of words in repeated windows.

Defined cases: a null or empty text has no words and fails; texts of any length are read whole; a null doc_id stays null; an
empty table gives an empty result; repeated rows are judged each, alike; a posterior of exactly one half keeps; extra
columns are ignored by features() and kept by keep(), whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

SPACE = r"\x20\x09-\x0D"
WINDOW = 8
ROUNDS, LEAST_GOOD, LEAST_BAD, MOST = 60, 0.6, 0.02, 0.999
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = "the of and to in a is that it for on was be with as by le la les de des et un une que en dans pour est der die und das zu den von mit ein el los las y del por con para".split()
RULES = ("length", "word_length", "symbols", "lines", "repeats", "case", "stop_words", "variety", "letters")


def features(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts of each text. Columns `keep` (all but text as default: doc_id) are carried along under their names."""
    keep = ["doc_id"] if keep is None else keep
    named = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__t"))
    trimmed = F.btrim(F.col("__t"), F.lit(" \t\n\x0b\f\r"))
    one = named.withColumns(
        {
            "__words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+", -1)),
            "__lines": F.filter(F.split("__t", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != ""),
            "__letters": F.regexp_replace("__t", r"\P{L}+", ""),
            "n_symbols": F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]+", "")),
        }
    )
    two = one.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.aggregate("__words", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.length("__letters").cast("long").alias("n_letters"),
        F.length(F.regexp_replace("__letters", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    n = F.size("__hashes")
    at = lambda i: F.xxhash64(*(F.get("__hashes", i + k) for k in range(WINDOW)))
    three = two.withColumn("__windows", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), at)).otherwise(F.array().cast("array<bigint>")))
    three = three.withColumn("n_distinct", F.size(F.array_distinct("__hashes")).cast("long")).drop("__hashes")
    repeats = F.size("__windows") > F.size(F.array_distinct("__windows"))
    pairs = F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    four = three.withColumn("__sorted", F.when(repeats, F.sort_array(pairs))).drop("__windows")
    h = lambda k: F.get("__sorted", k)["h"]
    again = lambda k: F.coalesce(h(k) == h(k - 1), F.lit(False)) | F.coalesce(h(k) == h(k + 1), F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size("__sorted") - 1), again)
    five = four.withColumn("__at", F.when(F.col("__sorted").isNotNull(), F.sort_array(F.transform(found, lambda k: F.get("__sorted", k)["i"])))).drop("__sorted")
    step = lambda acc, k: acc + F.coalesce(F.least(F.lit(WINDOW), F.get("__at", k + 1) - F.get("__at", k)), F.lit(WINDOW))
    covered = F.when(F.col("__at").isNotNull(), F.aggregate(F.sequence(F.lit(0), F.size("__at") - 1), F.lit(0), step)).otherwise(0)
    return five.withColumn("n_repeat_words", covered.cast("long")).drop("__at")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    n, lines = F.col("n_words"), F.col("n_lines")
    chars, letters = F.col("word_chars"), F.col("n_letters")
    return {
        "length": _vote(n < 20, n >= 60),
        "word_length": _vote((n > 0) & ((chars < 2 * n) | (chars > 14 * n)), (chars >= 3 * n) & (chars <= 10 * n) & (n > 0)),
        "symbols": _vote(10 * F.col("n_symbols") > n, 50 * F.col("n_symbols") <= n),
        "lines": _vote(10 * F.col("n_dup_lines") > 3 * lines, (lines >= 3) & (F.col("n_dup_lines") == 0)),
        "repeats": _vote(10 * F.col("n_repeat_words") > 2 * n, (n >= 60) & (F.col("n_repeat_words") == 0)),
        "case": _vote(2 * F.col("n_upper") > letters, (5 * F.col("n_upper") < letters)),
        "stop_words": _vote(50 * F.col("n_stop_words") < n, 10 * F.col("n_stop_words") >= n),
        "variety": _vote((n >= 20) & (10 * F.col("n_distinct") < n), (n >= 60) & (10 * F.col("n_distinct") > 3 * n)),
        "letters": _vote(10 * letters < 6 * chars, 10 * letters >= 8 * chars),
    }


def fit(patterns: dict[tuple[int, ...], int]) -> tuple[float, list[tuple[float, float]]]:
    """EM over counts of vote patterns: the share of good documents, and of each rule (accuracy on good, accuracy on bad).

    Votes are taken as independent given the class; an abstention says nothing. The accuracy on good documents stays
    over LEAST_GOOD, so the classes can't change places; on bad ones it may be low, for most bad documents break one or
    two rules and pass the others. Both are drawn to their start with the weight of one vote in a thousand.
    """
    rules = len(next(iter(patterns), ()))
    total = sum(patterns.values())
    start = (0.95, 0.4)
    good, accuracy = 0.8, [start] * rules
    for _ in range(ROUNDS if total else 0):
        all_good, right, seen = 0.0, [[0.0, 0.0] for _ in range(rules)], [[0.0, 0.0] for _ in range(rules)]
        for pattern in sorted(patterns):
            count = patterns[pattern]
            p = posterior(pattern, good, accuracy)
            all_good += count * p
            for j, v in enumerate(pattern):
                if v:
                    seen[j][0] += count * p
                    seen[j][1] += count * (1 - p)
                    if v > 0:
                        right[j][0] += count * p
                    else:
                        right[j][1] += count * (1 - p)
        prior = 1 + total / 1000
        held = lambda y, j: (right[j][y] + start[y] * prior) / (seen[j][y] + prior)  # noqa: E731, B023
        good = min(0.98, max(0.05, (all_good + 0.8) / (total + 1)))
        accuracy = [(min(MOST, max(LEAST_GOOD, held(0, j))), min(MOST, max(LEAST_BAD, held(1, j)))) for j in range(rules)]
    return good, accuracy


def weights(good: float, accuracy: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """The log odds of being good: a constant, and what a good and a bad vote of each rule add."""
    return math.log(good / (1 - good)), [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in accuracy]


def posterior(pattern: tuple[int, ...], good: float, accuracy: list[tuple[float, float]]) -> float:
    constant, by_rule = weights(good, accuracy)
    odds = constant + sum(w[0] if v > 0 else w[1] for v, w in zip(pattern, by_rule, strict=True) if v)
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """features() with votes, base_failed, log_odds, p_good and kept."""
    found = store.written(features(docs, keep).withColumns({f"vote_{k}": v.cast("int") for k, v in votes().items()}), "quality")
    names = [f"vote_{k}" for k in RULES]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    patterns = {tuple(r[:-1]): r[-1] for r in found.where(~failed).groupBy(*names).agg(F.count(F.lit(1))).collect()}  # 3 ** 9 rows at most
    constant, by_rule = weights(*fit(patterns))
    odds = F.lit(constant)
    for name, (up, down) in zip(names, by_rule, strict=False):
        odds = odds + F.when(F.col(name) > 0, up).when(F.col(name) < 0, down).otherwise(0.0)
    judged = found.withColumns({"base_failed": failed, "log_odds": odds})
    return judged.withColumns({"p_good": 1 / (1 + F.exp(-F.col("log_odds"))), "kept": ~F.col("base_failed") & (F.col("log_odds") >= 0)})


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns. The verdicts are carried by the rows, not joined back."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")  # their columns may have the features' names
    return judge(rows, ["__row"]).where("kept").select("__row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts, votes and verdict of every document."""
    judged = judge(store.documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 4).alias("p_good"))
