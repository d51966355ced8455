"""Tick metrics over a stream of ticks, beyond the batch form: late rows up to a watermark, one row for each window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ticks import WEIGHT, hit_value, weighted_hit


def windowed(ticks: DataFrame, keys: list[str], time: str = "ts", window: str = "10 minutes", late: str = "10 minutes", weight: float = WEIGHT) -> DataFrame:
    """keys, start, end, n, hit_rate, avg_backup, weighted_hit_rate; works on a stream or a table."""
    rows = ticks.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if ticks.isStreaming else rows
    got = rows.groupBy(*keys, F.window(time, window)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit_value()).alias("hit_rate"), F.avg(F.when(F.col("is_hit"), F.col("backup_level"))).alias("avg_backup"), F.avg(weighted_hit(weight)).alias("weighted_hit_rate")
    )
    return got.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "hit_rate", "avg_backup", "weighted_hit_rate")


def started(ticks: DataFrame, keys: list[str], name: str, checkpoint: str, **options):
    """A running query into a table in memory, finished windows only; for tests and dashboards."""
    return windowed(ticks, keys, **options).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
