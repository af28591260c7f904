"""Tables in the folder that the cluster shares, used to cut lineage, and helpers built on them."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WRITTEN: list[str] = []


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder serves local sessions only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and survives lost executors.

    Shuffle files of the write go as soon as it is done, so a chain of steps never holds those of more than one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() gave, once nothing that is still to run reads them."""
    for df in tables:
        _WRITTEN.remove(df._written_at)
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """For sweep(): tables that written() gives from now on."""
    return len(_WRITTEN)


def sweep(since: int, *keep: DataFrame) -> None:
    """Deletes the tables that written() has given since mark() was called, but for those that are still to be read."""
    kept = {df._written_at for df in keep}
    spark = keep[0].sparkSession
    jvm = spark.sparkContext._jvm
    for name in [p for p in _WRITTEN[since:] if p not in kept]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def gapless(df: DataFrame, group: list[str], order: list[str], out: str, rows: int, rows_per_block: int = 5_000) -> DataFrame:
    """Adds `out`: 0, 1, 2, ... within each group, whatever the group's size.

    Rows are dealt by the hash of `order` into blocks of about rows_per_block, those without its first column by their
    place in the table; the counts of (block, group) give each block its offset, so no task holds more than a block of a
    group. `rows` is df's count. Rows equal in all of `order` get neighbouring numbers in either order.
    """
    blocks = max(1, math.ceil(rows / rows_per_block))
    place = F.when(F.col(order[0]).isNull(), F.monotonically_increasing_id())
    cut = written(df.withColumn("__block", F.pmod(F.xxhash64(*order, place), F.lit(blocks))), "blocks")
    counts = cut.groupBy("__block", *group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__block", *group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__block", *group).orderBy(*order)
    numbered = cut.withColumn("__row", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["__block", *group]).withColumn(out, F.col("__before") + F.col("__row")).drop("__block", "__row", "__before")
