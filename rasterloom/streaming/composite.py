"""Composites over a stream: an extension for observations that arrive late. Means and latest values can be kept incrementally; medians can't."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(stream: DataFrame, keys: Sequence[str], bands: Sequence[str], length: str = "10 days", step: str | None = None, late: str = "2 days", at: str = "acquired_at") -> DataFrame:
    """Append-mode means per event-time window; rows later than `late` are left out. NULL values take no part."""
    w = F.window(at, length, step) if step else F.window(at, length)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(*[F.avg(b).alias(b) for b in bands], F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *keys, *bands, "n")


def windowed_latest(stream: DataFrame, keys: Sequence[str], bands: Sequence[str], length: str = "10 days", late: str = "2 days", at: str = "acquired_at", tie: str = "scene_id") -> DataFrame:
    """The mosaic strategy over a stream."""
    pick = lambda b: F.max_by(F.struct(b), F.when(F.col(b).isNotNull(), F.struct(at, tie)))[b].alias(b)
    return stream.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), *keys).agg(*[pick(b) for b in bands]).select(F.col("w.start").alias("w_start"), *keys, *bands)


def append_windows(result: DataFrame, path: str, checkpoint: str):
    """Each batch's finished windows as a partition of Parquet; a batch that runs twice overwrites its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.partitionBy("epoch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)

    return result.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
