"""Hit rates and backups of a real-time system's ticks, and the share of missed deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Normaliser of the weighted hit rate.
WEIGHT = 32
#: Seconds of a tick.
TICK = 1 / 6


def hit_value() -> Column:
    return F.coalesce(F.col("is_hit"), F.lit(False)).cast("double")


def weighted_hit(weight: float = WEIGHT) -> Column:
    """1 - backup / weight of a hit, 0 of a miss or where the backup is missing; negative beyond the weight."""
    return F.when(F.col("is_hit"), F.coalesce((weight - F.col("backup_level")) / weight, F.lit(0.0))).otherwise(0.0)


def mapped(ticks: DataFrame, kind: str, weight: float = WEIGHT) -> DataFrame:
    """The ticks with `value`: their hit_rate, backup_level or hit_rate_weighted."""
    value = {"hit_rate": hit_value(), "backup_level": F.col("backup_level").try_cast("double"), "hit_rate_weighted": weighted_hit(weight)}[kind]
    return ticks.withColumn("value", value)


def by_tick(ticks: DataFrame, keys: list[str], weight: float = WEIGHT) -> DataFrame:
    """keys, tick, hit_rate, avg_backup (of hits that have one), weighted_hit_rate."""
    rows = ticks.where(F.col("tick").isNotNull())
    return rows.groupBy(*keys, "tick").agg(F.avg(hit_value()).alias("hit_rate"), F.avg(F.when(F.col("is_hit"), F.col("backup_level"))).alias("avg_backup"), F.avg(weighted_hit(weight)).alias("weighted_hit_rate"))


def of_runs(ticks: DataFrame, keys: list[str], weight: float = WEIGHT) -> DataFrame:
    """keys and a run's numbers: hit rate and backup over all records, ISR_w over the ticks' means."""
    over_all = ticks.groupBy(*keys).agg(
        F.avg(hit_value()).alias("global_hit_rate"), F.avg(F.when(F.col("is_hit"), F.col("backup_level"))).alias("global_avg_backup"),
        F.count(F.lit(1)).alias("total_samples"), F.sum(hit_value()).cast("long").alias("total_hits"),
    )
    means = by_tick(ticks, keys, weight).groupBy(*keys).agg(F.avg("weighted_hit_rate").alias("ISR_w"))
    return over_all.join(means, keys, "left").withColumn("weight_const", F.lit(float(weight)))


def with_global(ticks: DataFrame, keys: list[str], weight: float = WEIGHT) -> DataFrame:
    """The ticks' rows and one row GLOBAL of each run, ticks as text."""
    rows = by_tick(ticks, keys, weight).withColumn("tick", F.col("tick").cast("string"))
    last = of_runs(ticks, keys, weight).select(*keys, F.lit("GLOBAL").alias("tick"), F.col("global_hit_rate").alias("hit_rate"), F.col("global_avg_backup").alias("avg_backup"), F.col("ISR_w").alias("weighted_hit_rate"), "total_samples", "total_hits")
    return rows.unionByName(last, allowMissingColumns=True)


def run_results(ticks: DataFrame, run: str, weight: float = WEIGHT) -> DataFrame:
    """run, records (its ticks in order), global: a run's result as system logs are summed up. A run's ticks are few."""
    numbers = ["hit_rate", "avg_backup", "weighted_hit_rate"]
    records = by_tick(ticks, [run], weight).groupBy(run).agg(F.sort_array(F.collect_list(F.struct("tick", *numbers))).alias("records"))
    own = of_runs(ticks, [run], weight)
    return own.select(run, F.struct(*[c for c in own.columns if c != run]).alias("global")).join(records, run, "left").select(run, "records", "global")


def across(runs: DataFrame) -> DataFrame:
    """One row over runs: plain means of what is a number, sums of samples and hits."""
    mean = lambda c: F.avg(F.when(~F.isnan(c), F.col(c))).alias(f"mean_{c}")
    return runs.agg(*map(mean, ("global_hit_rate", "global_avg_backup", "ISR_w")), F.sum("total_samples").alias("total_samples"), F.sum("total_hits").alias("total_hits"), F.count(F.lit(1)).alias("n_runs"))


def deadlines(timings: DataFrame, keys: list[str], tick: float = TICK, sample: int = 0, records: bool = False) -> DataFrame:
    """keys, frames, deadline, n, n_miss, dmr of timings (frames, round_trip_time, request_arrival_time, response_output_time).

    The time is round_trip_time, else output less arrival; without either the row is left out. Equal to the deadline is
    no miss. Rows without frames are left out. sample: also details_sample, so many of the times, the longest first; or, as
    records of the file's folder, the time and whether it is a miss, the first ones by path and position in the file.
    """
    rtt = F.coalesce("round_trip_time", F.col("response_output_time") - F.col("request_arrival_time"))
    rows = timings.withColumn("_rtt", rtt).where("_rtt is not null and frames is not null").withColumn("deadline", F.floor((F.col("frames") + 1) / 2) * tick)
    late = F.col("_rtt") > F.col("deadline")
    miss = late.cast("double")
    out = rows.groupBy(*keys, "frames", "deadline").agg(F.count(F.lit(1)).alias("n"), F.sum(miss).cast("long").alias("n_miss"), F.avg(miss).alias("dmr"))
    if not sample:
        return out
    order = ["path", "position"] if records else [F.desc("_rtt")]
    place = F.row_number().over(Window.partitionBy(*keys, "frames").orderBy(*order))
    kept = rows.withColumn("_n", place).where(F.col("_n") <= sample)
    folder = F.regexp_replace(F.col("path"), "/[^/]*$", "") if records else None
    one = F.struct("_n", F.struct(folder.alias("subdir"), F.col("_rtt").alias("round_trip_time"), late.alias("miss")).alias("r")) if records else F.struct("_n", F.col("_rtt").alias("r"))
    kept = kept.groupBy(*keys, "frames").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["r"]).alias("details_sample"))
    return out.join(kept, [*keys, "frames"])
