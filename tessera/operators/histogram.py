"""Note histograms in long form (keys, feature, bin, n) and their divergences.

Bins stay rows; a divergence sums over conditional shares of both sides, so a bin that one side lacks still counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-10
BINS = 64
TOP = 0.995


def pitches(notes: DataFrame, keys: list[str]) -> DataFrame:
    return notes.groupBy(*keys, F.col("pitch").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def with_numbers(notes: DataFrame, numbers: DataFrame, piece: list[str]) -> DataFrame:
    """Notes with their piece's row of numbers. A task keeps the numbers in memory and notes pass by unsorted.

    Notes are dealt to the session's number of shuffle partitions as it is: AQE would join partitions up to 64 MB of packed
    data, and what counts bins after this keeps all bins of such a task in memory.
    """
    tasks = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return notes.repartition(tasks, *piece).join(numbers.hint("shuffle_hash"), piece)


def onsets(notes: DataFrame, piece: list[str], side: str, bins: int = BINS) -> DataFrame:
    """Onsets over the piece's length (the last end on any side); the end itself falls in the last bin."""
    lengths = notes.groupBy(*piece).agg(F.max("t1").alias("_length"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("t0") / F.col("_length")))
    at = F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int")
    return with_numbers(notes, lengths, piece).where("_length > 0").groupBy(*piece, side, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def length_of() -> Column:
    return F.greatest(F.lit(0.0), F.col("t1") - F.col("t0"))


def duration_tops(notes: DataFrame, piece: list[str], top: float = TOP) -> DataFrame:
    """The upper edge for each piece: a quantile of durations of all sides together, 1e-3 at least."""
    edge = F.percentile(length_of(), F.lit(top))
    return notes.groupBy(*piece).agg(F.when(edge > 0, edge).otherwise(1e-3).alias("top"))


def durations(notes: DataFrame, piece: list[str], side: str, bins: int = BINS, top: float = TOP) -> DataFrame:
    """Durations in equal bins up to the top edge; longer ones fall in the last."""
    rows = with_numbers(notes, duration_tops(notes, piece, top), piece).withColumn("_d", length_of()).withColumn("_step", F.col("top") / bins)
    guess = F.floor(F.col("_d") / F.col("_step"))
    guess = F.when(F.col("_d") < guess * F.col("_step"), guess - 1).when(F.col("_d") >= (guess + 1) * F.col("_step"), guess + 1).otherwise(guess)
    at = F.when(F.col("_d") >= F.col("top"), bins - 1).otherwise(F.least(F.lit(bins - 1), guess)).cast("int")
    return rows.groupBy(*piece, side, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def divergence(p: Column, q: Column) -> Column:
    """The term of one bin in the Kullback-Leibler divergence (natural logarithm)."""
    return F.when(p > 0, p * F.log((p + EPS) / (q + EPS))).otherwise(0.0)


def jensen_shannon(hist: DataFrame, piece: list[str], side: str, sides: tuple[str, str]) -> DataFrame:
    """piece, jsd between both sides' histograms. One empty side gives half of ln 2."""
    of = lambda s: F.sum(F.when(F.col(side) == s, F.col("n")).otherwise(0))
    bins = hist.groupBy(*piece, "bin").agg(of(sides[0]).alias("_a"), of(sides[1]).alias("_b"))
    own = Window.partitionBy(*piece)  # a piece has as many rows as bins
    share = lambda x: F.when(F.sum(x).over(own) > 0, F.col(x) / F.sum(x).over(own)).otherwise(0.0)
    rows = bins.withColumn("_p", share("_a")).withColumn("_q", share("_b"))
    mid = (F.col("_p") + F.col("_q")) / 2
    return rows.groupBy(*piece).agg(F.sum((divergence(F.col("_p"), mid) + divergence(F.col("_q"), mid)) / 2).alias("jsd"))


def dense(hist: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """keys, histogram: the counts of all bins as an array."""
    slots = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    got = hist.groupBy(*keys).agg(slots.alias("_m"))
    return got.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0)).cast("double")).alias("histogram"))
