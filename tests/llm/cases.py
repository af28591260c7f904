"""Small documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

WORDS = "the of stone river light winter garden lantern copper window morning silver harbor engine letter market forest window thunder velvet marble candle".split()
#: Names that operators use inside.
CLASHES = ("node", "key", "kept", "n_words", "shard", "slot", "bucket", "batch", "spans", "gone", "doc", "pos", "component", "ids", "line_no", "size", "n", "__row")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(30)]
    texts = [*base, *base[:5], base[6] + " more", base[7].replace("river", "rivers", 1), None, "", " \n\t", "one", "x\n" * 50, "é ü 中文 " * 9, "a" * 3000, prose(rng, 4000)]
    texts += ["\n".join(prose(rng, 9) for _ in range(6)) for _ in range(6)]
    texts.append(texts[-1].replace("the", "teh", 1))
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, out[0], (None, base[1]), (None, None)]


def frame(spark, data=None, extra=True):
    df = spark.createDataFrame(rows() if data is None else data, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        df = df.select("doc_id", "text", *(F.lit(7).alias(c) for c in CLASHES))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
