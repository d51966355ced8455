"""Phrases: windows of events, rhythm density and the mean number of voices.

Windows come by arithmetic from each event (which windows it touches), not from a join with a list of windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 2.0
RESOLUTION = 1e-2
BARS = 4


def measured(met: DataFrame, keys: list[str], resolution: float = RESOLUTION) -> DataFrame:
    """keys, w0, w1, rhythm_density, voice_number of rows (keys, w0, w1, t0, t1) of events that overlap their window.
    A window with no more than a row of null times gets zeros.

    Density: distinct grid places of onsets inside, by second. Voices: the sum of sounding lengths over the time from
    the window's start to the last end, as an integral of the number of active events.
    """
    inside = (F.col("t0") >= F.col("w0")) & (F.col("t0") < F.col("w1"))
    place = F.when(inside, F.floor((F.col("t0") - F.col("w0")) / resolution + 1e-9))
    end = F.when(F.col("t1").isNotNull(), F.least("t1", "w1"))
    sounding = F.greatest(F.lit(0.0), end - F.greatest("t0", "w0"))
    # places as bits of 64 in a number: sums of fixed size, where a set would be an object for each window
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = met.groupBy(*keys, "w0", "w1", F.call_function("shiftright", place, F.lit(6)).alias("_word")).agg(F.bit_or(bit).alias("_bits"), F.sum(sounding).alias("_sounding"), F.max(end).alias("_end"))
    span = F.max("_end") - F.col("w0")
    return words.groupBy(*keys, "w0", "w1").agg(
        (F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0)) / (F.col("w1") - F.col("w0"))).alias("rhythm_density"),
        F.when(span > 0, F.sum("_sounding") / span).otherwise(0.0).alias("voice_number"),
    )


def tumbling(events: DataFrame, record: list[str], window: float = WINDOW) -> DataFrame:
    """Events (record, t0, t1) in each window they touch; windows start at the record's first onset."""
    events = events.repartition(*record)  # what follows, to the numbers of a song's windows, keeps to these partitions
    starts = events.groupBy(*record).agg(F.min("t0").alias("_begin"), F.max("t1").alias("_end"))
    rows = events.join(starts, record)
    last = F.ceil((F.col("_end") - F.col("_begin")) / window) - 1
    a = F.floor((F.col("t0") - F.col("_begin")) / window)
    b = F.least(last, F.floor((F.col("t1") - F.col("_begin")) / window))
    rows = rows.where(b >= a).withColumn("_w", F.explode(F.sequence(a, b))).withColumn("w0", F.col("_begin") + F.col("_w") * window).withColumn("w1", F.col("w0") + window)
    return rows.where((F.col("t1") > F.col("w0")) & (F.col("t0") < F.col("w1"))).select(*record, "w0", "w1", "t0", "t1")


def windows(events: DataFrame, song: list[str], record: list[str], window: float = WINDOW, resolution: float = RESOLUTION) -> DataFrame:
    """song, idx, w0, w1, rhythm_density, voice_number: windows with events, numbered on through a song's records."""
    keys = list(dict.fromkeys([*song, *record]))
    got = measured(tumbling(events, keys, window), keys, resolution)
    order = Window.partitionBy(*song).orderBy(*[c for c in record if c not in song], "w0")
    return got.withColumn("idx", F.row_number().over(order) - 1)


def bars(notes: DataFrame, boundaries: DataFrame, keys: list[str], per_phrase: int = BARS, resolution: float = RESOLUTION) -> DataFrame:
    """As windows(), in phrases of so many bars of boundaries (keys, bar_idx, t); phrases without notes stay, as zeros."""
    segments = boundaries.withColumn("_next", F.lead("t").over(Window.partitionBy(*keys).orderBy("bar_idx"))).where("_next > t")
    spans = segments.groupBy(*keys, F.floor(F.col("bar_idx") / per_phrase).cast("int").alias("idx")).agg(F.min("t").alias("w0"), F.max("_next").alias("w1"))
    from tessera.operators.overlap import overlapping

    met = overlapping(spans, notes.select(*keys, "t0", "t1"), keys, ("w0", "w1"), ("t0", "t1"), alone=True)
    return measured(met, [*keys, "idx"], resolution).na.fill(0.0, ["rhythm_density", "voice_number"])


def bar_boundaries(meta: DataFrame, downbeats: DataFrame, beats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bar_idx, t: downbeats, else every n-th beat, else bars of the tempo; with 0 first and the end last.

    meta: keys, end_time, tempo, ts_numerator.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1
    every = beats.withColumn("_n", nth).join(meta.select(*keys, "ts_numerator"), keys).where(F.col("_n") % F.coalesce("ts_numerator", F.lit(4)) == 0).select(*keys, "t")
    every = every.join(downbeats.select(*keys).distinct(), keys, "left_anti")
    known = downbeats.select(*keys, "t").unionByName(every)
    step = F.coalesce("ts_numerator", F.lit(4)) * 60.0 / F.when(F.col("tempo") > 0, F.col("tempo")).otherwise(120.0)
    made = meta.join(known.select(*keys).distinct(), keys, "left_anti").withColumn("_n", F.explode(F.sequence(F.lit(0), F.floor(F.col("end_time") / step).cast("int")))).select(*keys, (F.col("_n") * step).alias("t"))
    ends = meta.select(*keys, F.explode(F.array(F.lit(0.0), "end_time")).alias("t"))
    rows = known.unionByName(made).unionByName(ends).join(meta.select(*keys, "end_time"), keys).where("t >= 0 and t <= end_time")
    rows = rows.groupBy(*keys, F.round(F.col("t") / 1e-6).alias("_r")).agg(F.min("t").alias("t"))
    return rows.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1).alias("bar_idx"), "t")


def swept(events: DataFrame, keys: list[str]) -> DataFrame:
    """Mean voices of each window by a running count of active events; measured() gives the same in closed form."""
    rows = events.select(*keys, "w0", F.explode(F.array(F.struct(F.greatest("t0", "w0").alias("t"), F.lit(1).alias("d")), F.struct(F.least("t1", "w1").alias("t"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "w0", "e.*")
    at = Window.partitionBy(*keys, "w0").orderBy("t", "d")
    active = F.sum("d").over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_area", active * (F.lead("t").over(at) - F.col("t")))
    return rows.groupBy(*keys, "w0").agg((F.sum("_area") / F.nullif(F.max("t") - F.col("w0"), F.lit(0.0))).alias("voice_number"))
