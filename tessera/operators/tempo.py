"""Tempo of pieces whose files don't tell it, from the times between their notes' beginnings.

Each beginning votes, with the next few of its piece, for the beats a minute that the time between them would be a beat of.
Votes for a tempo's halves, doubles and further octaves are votes for the one in OCTAVE's range, which lies in a histogram
of logarithmic bins. The fullest bin with its neighbours wins, and the weighted mean of their votes is the tempo. All is one
aggregate by piece after a window over its beginnings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Beats a minute from which on an octave of tempos is told, bins of it, and beginnings that each one is compared with.
OCTAVE, BINS, AHEAD = 80.0, 90, 4
#: Times between beginnings that count, in seconds; closer ones are one chord.
CHORD, LONGEST = 0.03, 4.0
DEFAULT = 120.0


def estimated(notes: DataFrame, keys: list[str], t0: str = "t0") -> DataFrame:
    """keys, tempo of each piece with two beginnings apart, between OCTAVE and twice as much."""
    begins = notes.where(F.col(t0).isNotNull()).groupBy(*keys, F.round(F.col(t0) / CHORD).alias("_r")).agg(F.min(t0).alias("_t"))
    order = Window.partitionBy(*keys).orderBy("_t")
    begins = begins.select(*keys, *[(F.lead("_t", k).over(order) - F.col("_t")).alias(f"_{k}") for k in range(1, AHEAD + 1)])
    later = F.array(*[F.struct(F.col(f"_{k}").alias("dt"), F.lit(1.0 / k).alias("w")) for k in range(1, AHEAD + 1)])
    votes = begins.select(*keys, F.inline(later)).where((F.col("dt") > CHORD) & (F.col("dt") <= LONGEST))
    octaves = F.log2(60.0 / F.col("dt") / OCTAVE)
    place = octaves - F.floor(octaves)  # of the tempo within its octave, 0 to 1
    bins = votes.withColumn("_p", place).groupBy(*keys, F.pmod(F.floor(F.col("_p") * BINS).cast("int"), F.lit(BINS)).alias("_b")).agg(F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("_p")).alias("_s"))
    # a bin's votes count for its neighbours too, in a circle: places beyond either end are moved by an octave
    near = F.array(*[F.struct(F.pmod(F.col("_b") + d, F.lit(BINS)).alias("at"), F.floor((F.col("_b") + d) / BINS).alias("turn")) for d in (-1, 0, 1)])
    spread = bins.select(*keys, "_b", "_w", "_s", F.inline(near))
    sums = spread.groupBy(*keys, "at").agg(F.sum("_w").alias("_all"), (F.sum(F.col("_s") - F.col("turn") * F.col("_w")) / F.sum("_w")).alias("_mean"), F.sum(F.when(F.col("_b") == F.col("at"), F.col("_w")).otherwise(0.0)).alias("_own"))
    best = sums.groupBy(*keys).agg(F.max_by("_mean", F.struct("_all", "_own", -F.col("at"))).alias("_m"))
    return best.select(*keys, (OCTAVE * F.pow(F.lit(2.0), F.col("_m"))).alias("tempo"))


def with_tempo(notes: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """notes with tempo: the known one (keys, tempo), else the estimated one, else DEFAULT."""
    given = known.where("tempo > 0").groupBy(*keys).agg(F.first("tempo").alias("_given"))
    guessed = estimated(notes, keys).withColumnRenamed("tempo", "_guess")
    return notes.join(given, keys, "left").join(guessed, keys, "left").withColumn("tempo", F.coalesce("_given", "_guess", F.lit(DEFAULT))).drop("_given", "_guess")
