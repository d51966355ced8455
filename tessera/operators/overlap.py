"""Joins of time intervals of any length, and what stands on them: consonance and overlap lengths.

Time is a tree of buckets: level 0 has buckets of a width, each level above buckets twice as wide. An interval's own level
is the lowest whose buckets are as long as it is, so it lies in two or three of them, and in two at most of each level above.
A pair meets at the level of the longer of both, in the bucket where the later one begins: once, so nothing has to be made
distinct. An interval stands only in levels where one of the other side's has its own, so notes of a few seconds beside
others of a few seconds make a row or two each, a year among them makes three, and no bucket brings short ones together
only because some are long.

The tree is for crowded keys: where a key's rows of both sides make no more than PAIRS pairs, they are compared as they are,
and a row is sent once. Whether any key is crowded is looked up first, and for those which levels there are, in a pass over
the times that returns some tens of numbers. No side is broadcast: Spark guesses sizes from files and counts neither what a
bucket multiplies nor what Parquet packs. Times are finite numbers; an interval with a null meets nothing, one that ends before it begins is one of no length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Consonant distances of pitch classes in half tones.
CONSONANT = (0, 3, 4, 7, 8, 9)
BUCKET = 2.0
#: A key of more pairs than this goes through buckets.
PAIRS = 1 << 14


def bucketed(rows: DataFrame, t0: str, t1: str, width: float) -> DataFrame:
    first, last = F.floor(F.col(t0) / width), F.floor(F.greatest(F.col(t0), F.col(t1)) / width)
    return rows.withColumn("_bucket", F.explode(F.sequence(first, last)))


def level(t0: str, t1: str, width: float) -> Column:
    """An interval's own level."""
    size = (F.col(t1) - F.col(t0)) / width
    return F.when(size > 1, F.ceil(F.log2(size))).when(F.col(t0).isNotNull() & F.col(t1).isNotNull(), F.lit(0)).cast("int")


def levels(rows: DataFrame, t0: str, t1: str, width: float = BUCKET) -> list[int]:
    """The levels that intervals have, some tens at most."""
    own = rows.select(level(t0, t1, width).alias("_l")).where("_l is not null").groupBy("_l").count()
    return sorted(r["_l"] for r in own.collect())


def nodes(rows: DataFrame, t0: str, t1: str, width: float, others: list[int], own_sides: tuple[str, ...], finer_side: str) -> DataFrame:
    """rows in each bucket of their own level (_level, _bucket), once for each of own_sides (_longer), and of those of the
    other side's levels above it, as finer_side. _longer names the side whose own level the bucket has."""
    end = F.greatest(F.col(t0), F.col(t1))

    def at(k: Column, side: str) -> Column:
        wide = F.lit(width) * F.pow(F.lit(2.0), k)
        return F.transform(F.sequence(F.floor(F.col(t0) / wide), F.floor(end / wide)), lambda b: F.struct(k.cast("int").alias("_level"), b.alias("_bucket"), F.lit(side).alias("_longer")))

    own = level(t0, t1, width)
    above = F.filter(F.array(*[F.lit(k) for k in others]), lambda k: k > own) if others else F.array().cast("array<int>")
    parts = [at(own, side) for side in own_sides] + [F.flatten(F.transform(above, lambda k: at(k, finer_side)))]
    return rows.withColumn("_node", F.explode(F.concat(*parts))).select(*rows.columns, "_node.*")


def crowded(left: DataFrame, right: DataFrame, keys: list[str], most: int = PAIRS) -> DataFrame:
    """The keys whose rows of both sides make more than `most` pairs."""
    both = left.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(right.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return both.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).where(F.col("_a").cast("double") * F.col("_b") > most).select(*keys)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: float = BUCKET, most: int = PAIRS, alone: bool = False) -> DataFrame:
    """Pairs with a common key where left's interval a and right's b overlap strictly: b0 < a1 and b1 > a0.

    Both sides' columns must differ but for the keys. Keys of at most `most` pairs are joined without buckets. With alone,
    left's rows that meet nothing stay, with nulls for right's columns; rows of crowded keys do so whatever they meet. The
    few pairs then stand in the session's number of shuffle partitions by the keys, as histogram.with_numbers() has it, for
    what counts by key after this.
    """
    strictly = (F.col(b[1]) > F.col(a[0])) & (F.col(b[0]) < F.col(a[1]))
    large = crowded(left, right, keys, most)

    def plain(rows: DataFrame) -> DataFrame:
        if not alone:
            return rows.join(right.hint("merge"), keys).where(strictly)
        own = {k: f"_right_{k}" for k in keys}
        tasks = int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        other = right.withColumnsRenamed(own).repartition(tasks, *own.values())
        return rows.join(other.hint("merge"), [*[F.col(k) == F.col(o) for k, o in own.items()], strictly], "left").drop(*own.values())

    if large.limit(1).count() == 0:
        return plain(left)
    of = lambda rows, how: rows.join(large.hint("merge"), keys, how)
    many = of(left, "left_semi")
    met = plain(of(left, "left_anti")).unionByName(met_in_buckets(many, of(right, "left_semi"), keys, a, b, width))
    return met.unionByName(many, allowMissingColumns=True) if alone else met


def met_in_buckets(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: float = BUCKET) -> DataFrame:
    """overlapping() by the tree of buckets, whatever number of rows a key has."""
    has, other = levels(left, *a, width), levels(right, *b, width)
    begins = F.greatest(F.col(a[0]), F.col(b[0]))
    strictly = (F.col(b[1]) > F.col(a[0])) & (F.col(b[0]) < F.col(a[1]))
    if max([*has, *other], default=0) == 0:
        home = F.col("_bucket") == F.floor(begins / width)
        return bucketed(left, *a, width).join(bucketed(right, *b, width).hint("merge"), [*keys, "_bucket"]).where(home & strictly).drop("_bucket")
    # equal levels meet as left's, a longer right one where left is finer
    one, two = nodes(left, *a, width, other, ("left",), "right"), nodes(right, *b, width, has, ("left", "right"), "left")
    home = F.col("_bucket") == F.floor(begins / (F.lit(width) * F.pow(F.lit(2.0), F.col("_level"))))
    return one.join(two.hint("merge"), [*keys, "_level", "_bucket", "_longer"]).where(home & strictly).drop("_level", "_bucket", "_longer")


def length(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.least(F.col(a[1]), F.col(b[1])) - F.greatest(F.col(a[0]), F.col(b[0]))


def consonance(melody: DataFrame, accompaniment: DataFrame, keys: list[str], width: float = BUCKET, consonant: tuple[int, ...] = CONSONANT) -> DataFrame:
    """keys, consonant, dissonant and unsupported shares of melody time. Pieces that lack either side are left out.

    A melody note with any consonant overlap is consonant as a whole; without any overlap it is unsupported. Notes up to the
    bucket's width meet in buckets, pairs with a longer note by overlapping().
    """
    m = melody.select(*keys, F.col("pitch").alias("_mp"), F.col("t0").alias("_m0"), F.col("t1").alias("_m1")).where("_m1 > _m0")
    a = accompaniment.select(*keys, "pitch", "t0", "t1")
    long_melody, long_other = (max(levels(rows, *times, width), default=0) > 0 for rows, times in ((m, ("_m0", "_m1")), (a, ("t0", "t1"))))
    fitting = [c % 12 for c in consonant]
    short = lambda rows, t0, t1, some: rows.where(level(t0, t1, width) == 0) if some else rows
    own = short(m, "_m0", "_m1", long_melody)
    one = F.struct(F.pmod(F.col("pitch"), F.lit(12)).alias("c"), "t0", "t1")
    near = bucketed(short(a, "t0", "t1", long_other), "t0", "t1", width).groupBy(*keys, "_bucket").agg(F.collect_set(one).alias("_near"))  # some seconds of a piece
    # a bucket without melody only tells that the piece has accompaniment
    both = bucketed(own, "_m0", "_m1", width).join(near, [*keys, "_bucket"], "full")
    met = F.filter("_near", lambda x: (x["t1"] > F.col("_m0")) & (x["t0"] < F.col("_m1")))
    fits = F.exists("_met", lambda x: F.pmod(F.col("_mp") - x["c"], F.lit(12)).isin(*set(fitting)))
    share = 1 / (F.floor(F.col("_m1") / width) - F.floor(F.col("_m0") / width) + 1)  # of one or two buckets
    both = both.withColumn("_met", met).select(*keys, "_mp", "_m0", "_m1", F.col("_near").isNotNull().alias("_has"), F.when(F.size("_met") > 0, fits).alias("_ok"), share.alias("_times"))
    no, zero = F.lit(None).cast("boolean"), F.lit(0.0)
    if long_melody:
        both = both.unionByName(m.where(level("_m0", "_m1", width) > 0).select(*keys, "_mp", "_m0", "_m1", F.lit(False).alias("_has"), no.alias("_ok"), F.lit(1.0).alias("_times")))
        both = both.unionByName(a.select(*keys).distinct().select(*keys, *[F.lit(None).cast(kind).alias(c) for c, kind in m.dtypes if c not in keys], F.lit(True).alias("_has"), no.alias("_ok"), zero.alias("_times")))
    pairs = [overlapping(m.where(level("_m0", "_m1", width) > 0), a, keys, ("_m0", "_m1"), ("t0", "t1"), width)] * long_melody
    if long_other:
        rest = a.where(level("t0", "t1", width) > 0)
        pairs.append(overlapping(own, rest, keys, ("_m0", "_m1"), ("t0", "t1"), width))
        both = both.unionByName(rest.select(*keys).distinct().select(*keys, *[F.lit(None).cast(kind).alias(c) for c, kind in m.dtypes if c not in keys], F.lit(True).alias("_has"), no.alias("_ok"), zero.alias("_times")))
    for found in pairs:
        both = both.unionByName(found.select(*keys, "_mp", "_m0", "_m1", F.lit(True).alias("_has"), F.pmod(F.col("_mp") - F.col("pitch"), F.lit(12)).isin(*set(fitting)).alias("_ok"), zero.alias("_times")))
    # equal notes of a piece behave alike: one row with their total length
    notes = both.groupBy(*keys, "_mp", "_m0", "_m1").agg((F.sum("_times") * (F.col("_m1") - F.col("_m0"))).alias("_length"), F.max("_ok").alias("_ok"), F.max("_has").alias("_has"))
    part = lambda c: F.sum(F.when(c, F.col("_length")).otherwise(0.0)) / F.sum("_length")
    out = notes.groupBy(*keys).agg(
        part(F.coalesce("_ok", F.lit(False))).alias("consonant_ratio"), part(F.col("_m0").isNotNull() & F.col("_ok").isNull()).alias("unsupported_ratio"), F.max("_has").alias("_has"), F.count("_m0").alias("_n")
    ).where("_has and _n > 0")
    return out.withColumn("dissonant_ratio", F.greatest(F.lit(0.0), 1 - F.col("consonant_ratio") - F.col("unsupported_ratio"))).select(*keys, "consonant_ratio", "dissonant_ratio", "unsupported_ratio")
