"""Streaming forms of four batch operators. They have no counterpart elsewhere in the library's scope and are extras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attrition(stream: DataFrame, rule: str = "rule") -> DataFrame:
    """Running counts by rule (update or complete mode)."""
    return stream.groupBy(rule).agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, value: str, by: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def pooled(path: str, signature: str = "signature"):
    """A foreachBatch sink that refuses a batch of another signature than what is pooled already."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = {r[0] for r in batch.select(signature).distinct().take(2)}
        try:
            now |= {r[0] for r in spark.read.parquet(path).select(signature).distinct().take(2)}
        except Exception as problem:  # noqa: BLE001  nothing is pooled before the first batch
            if "PATH_NOT_FOUND" not in str(problem):
                raise
        if len(now) > 1:
            raise ValueError("shards of several experiments are not pooled")
        batch.write.mode("append").parquet(path)

    return sink
