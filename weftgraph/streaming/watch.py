"""Freshness: bursts of file events, the deferred embedding timer, and a stream that re-indexes after each burst."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S

log = logging.getLogger(__name__)


def debounce(events: DataFrame, quiet: str = "2 seconds", keys: list[str] | None = None) -> DataFrame:
    """events(ts, ...) -> (keys..., first_ts, last_ts, n): bursts in which every event follows within `quiet`.

    The same on a stream, given a watermark: a burst is out once the watermark has passed its quiet period.
    """
    grouped = events.groupBy(*(keys or []), F.session_window("ts", quiet))
    return grouped.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("session_window")


def deferred_fires(bursts: DataFrame, delay_s: float, keys: list[str]) -> DataFrame:
    """When the embedding timer, reset by every burst, fires: (keys..., fires_at)."""
    following = F.lead("last_ts").over(Window.partitionBy(*keys).orderBy("last_ts"))
    alone = F.col("__next").isNull() | (F.unix_micros(F.col("__next").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp")) > int(delay_s * 1e6))
    return bursts.withColumn("__next", following).where(alone).select(*keys, (F.col("last_ts") + F.make_dt_interval(secs=F.lit(delay_s))).alias("fires_at"))


def relevant(events: DataFrame, root: str) -> DataFrame:
    return events.where(S.is_relevant_path(F.col("path"), root))


def file_events(spark: SparkSession, folder: str, watermark: str = "10 seconds") -> DataFrame:
    """A stream of (path, kind, ts) rows from Parquet files that land in `folder`."""
    return spark.readStream.schema("path string, kind string, ts timestamp").parquet(folder).withWatermark("ts", watermark)


class Watch:
    """Runs reindex(rows, batch) for each batch of `source` with rows, and embed(batch) once `embed_after` seconds have gone by
    without another: a timer of processing time, for an idle stream has no batches. An error in either is logged and the
    stream goes on; stop() embeds what is pending."""

    def __init__(self, source: DataFrame, checkpoint: str, reindex: Callable[[DataFrame, int], int], embed: Callable[[int], None] | None = None, embed_after: float = 30.0, available_now: bool = False, interval: str = "2 seconds", always: bool = False):
        self.reindex, self.embed, self.embed_after, self.always = reindex, embed, embed_after, always
        self.pending, self.last, self._timer, self._lock = False, -1, None, threading.RLock()
        writer = source.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(self._batch)
        self.query: StreamingQuery = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()

    def _batch(self, rows: DataFrame, batch: int) -> None:
        with self._lock:
            self.last = batch
            try:
                if (self.always or not rows.isEmpty()) and self.reindex(rows, batch):
                    self.pending = True
                    self._wait()
            except Exception:
                log.exception("batch %d", batch)

    def _wait(self) -> None:
        """The timer starts anew with each re-index."""
        if self._timer is not None:
            self._timer.cancel()
        self._timer = threading.Timer(self.embed_after, self._fire)
        self._timer.daemon = True
        self._timer.start()

    def _fire(self) -> None:
        with self._lock:
            if not self.pending:
                return
            try:
                if self.embed is not None:
                    self.embed(self.last)
                self.pending = False
            except Exception:
                log.exception("embedding after batch %d", self.last)

    def stop(self) -> None:
        self.query.stop()
        if self._timer is not None:
            self._timer.cancel()
        self._fire()


def watch_events(events: DataFrame, root: str, checkpoint: str, reindex: Callable[[DataFrame, int], int], embed: Callable[[int], None] | None = None, quiet: str = "2 seconds", **options) -> Watch:
    """A Watch over bursts of relevant file events below root."""
    # a stream's sessions need a key: the root, which every relevant path begins with
    bursts = debounce(relevant(events, root).withColumn("root", F.substring("path", 1, len(root))), quiet, ["root"])
    return Watch(bursts, checkpoint, reindex, embed, **options)


def watch_tree(graph, checkpoint: str, quiet: str = "2 seconds", embed_after: float = 30.0, available_now: bool = False) -> Watch:
    """Keeps a CodeGraph's index fresh: the tree is polled every `quiet`, so changes within it are one batch; the first
    batch catches up with what changed while nothing watched, and embedding waits for a pause of embed_after seconds."""
    from ..sources import tree

    def reindex(_: DataFrame, batch: int) -> int:
        done = graph.index()
        return done["indexed"] + done["removed"]

    return Watch(tree.stream_tree(graph.spark, graph.root), checkpoint, reindex, lambda _: graph.rag_index(), embed_after, available_now, quiet, always=True)
