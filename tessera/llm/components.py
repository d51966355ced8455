"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as joins of edges.

Minima are pre-aggregated in each task; every step is written to the shared folder, so lineage stays short and no edge
comes to the driver. Self-loops and nulls are left out; repeated edges are fine; no edges give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import drop_written, written


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def smallest(edges: DataFrame) -> DataFrame:
    """(u, v): each node of edges (u, v) with the smallest node of its component, the smallest itself left out."""
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = state(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        small = written(small.select("e.*").where("u != v").distinct(), "edges")
        drop_written(now)
        drop_written(large)
        now, last, seen = small, seen, state(small)
        if seen == last:
            break
    return now
