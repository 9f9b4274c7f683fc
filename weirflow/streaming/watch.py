"""Watching a folder of reports: each change of its content recomputes an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.staging import shared_dir


def watch(spark: SparkSession, folder: str, recompute: Callable[[SparkSession], None], checkpoint: str | None = None, every: str = "2 seconds") -> StreamingQuery:
    """Calls ``recompute`` once for each batch of new report files; a batch counts as done only if it succeeds."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").load(folder)

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            recompute(spark)

    place = checkpoint or f"{shared_dir(spark)}/watch"
    return files.writeStream.foreachBatch(step).option("checkpointLocation", place).trigger(processingTime=every).start()


def changed(now: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows of ``now`` (key, content_hash, ...) whose content the cache (key, content_hash) does not hold."""
    return now.join(cached.select("key", "content_hash"), ["key", "content_hash"], "left_anti")


def refreshed(now: DataFrame, cached: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``compute`` gives for every row, computed anew for changed rows only; the same as without a cache.

    ``cached`` is an earlier answer (key, content_hash, ...); ``compute`` works row by row and keeps key and content_hash.
    """
    kept = cached.join(now.select("key", "content_hash"), ["key", "content_hash"], "left_semi")
    fresh = compute(changed(now, cached.select("key", F.col("content_hash"))))
    return kept.unionByName(fresh.select(kept.columns))
