"""Exact summaries by group: five numbers and descriptive statistics, with linear quantiles.

Quantiles of groups are the built-in exact `percentile`, which keeps counts of a group's distinct values. Those of a whole
table are found by selection(): rows are counted in ranges of values, and only the ranges that hold wanted ranks are
counted further, until few values are left. No task gets more than its rows' counts by range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that a pass divides each open range into, and values in a range that are looked at one by one.
RANGES = 2048
FEW = 20_000

#: Names of descriptive statistics, in the order of reports.
DESCRIPTIVE = ("count", "sum", "min", "max", "mean", "variance_pop", "variance_samp", "stdev_pop", "stdev_samp", "std", "p25", "p50", "p75", "iqr")


def clean(value: Column) -> Column:
    value = value.try_cast("double")
    return F.when(~F.isnan(value), value)


@dataclass(frozen=True)
class Span:
    """A range of values that holds some wanted ranks: its ends are values, with how many lie below and in it."""

    low: float
    high: float
    below: int
    inside: int
    even: bool = True  # divided by value; else by approximate quantiles, as it did not shrink


def divided(rows: DataFrame, spans: list[Span], ranges: int) -> list[list[Span]]:
    """Each span's parts that hold values, in order; one pass counts those of all."""
    x, kinds = F.col("x"), []
    inside = lambda s: (x >= F.lit(s.low)) & (x <= F.lit(s.high))
    by_value = lambda s: s.even and math.isfinite(s.low) and math.isfinite(s.high)
    skewed = [s for s in spans if not by_value(s)]
    cuts: dict[Span, list[float]] = {}
    if skewed:
        probes = F.array(*[F.lit(k / 64) for k in range(1, 64)])
        got = rows.agg(*[F.percentile_approx(F.when(inside(s), x), probes, F.lit(1000)).alias(f"q{k}") for k, s in enumerate(skewed)]).first()
        cuts = {s: sorted(set(got[k])) for k, s in enumerate(skewed)}
    for s in spans:
        if by_value(s):  # halves first: high - low may be more than a double holds; what is divided by itself is 1
            part = F.floor((x / 2 - F.lit(s.low / 2)) / F.lit(s.high / 2 - s.low / 2) * ranges)
        else:
            part = F.size(F.filter(F.array(*map(F.lit, cuts[s])), lambda c: c < x)) + F.size(F.filter(F.array(*map(F.lit, cuts[s])), lambda c: c <= x))  # a cut's own value is a part
        kinds.append(F.when(inside(s), part.cast("int")))
    which = F.coalesce(*[F.when(inside(s), F.lit(k)) for k, s in enumerate(spans)])  # spans don't meet
    counted = rows.select("x", which.alias("span"), F.coalesce(*kinds).alias("part")).where("span is not null").groupBy("span", "part")
    found = sorted(counted.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect())  # spans x ranges at most
    out: list[list[Span]] = [[] for _ in spans]
    for r in found:
        own, before = out[r["span"]], spans[r["span"]]
        below = own[-1].below + own[-1].inside if own else before.below
        own.append(Span(r["low"], r["high"], below, r["n"], before.even == (r["n"] * 4 < before.inside)))
    return out


def selection(rows: DataFrame, value: str, ranks: Sequence[int], few: int = FEW, ranges: int = RANGES) -> dict[int, float]:
    """The values of those ranks, from 0, in ascending order among the numbers of a column.

    A pass narrows the range of each rank. A range that keeps a fourth of its values or more, as it may where values differ
    by orders of magnitude, is divided at approximate quantiles next; one with a single value, however frequent, is known.
    """
    x = rows.select(clean(F.col(value)).alias("x")).where("x is not null")
    all = x.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    wanted = sorted({k for k in ranks if 0 <= k < all["n"]})
    spans, known = [Span(all["low"], all["high"], 0, all["n"])] if wanted else [], {}
    while spans:
        held = [(s, [k for k in wanted if s.below <= k < s.below + s.inside]) for s in spans]
        known |= {k: s.low for s, own in held for k in own if s.low == s.high}
        open = [s for s, own in held if own and s.low < s.high]
        small = [s for s in open if s.inside <= few]
        if small:
            near = F.lit(False)
            for s in small:
                near = near | ((F.col("x") >= F.lit(s.low)) & (F.col("x") <= F.lit(s.high)))
            values = [(r["x"], r["count"]) for r in x.where(near).groupBy("x").count().collect()]  # `few` rows for each wanted rank at most
            for s in small:
                at = s.below
                for v, n in sorted(r for r in values if s.low <= r[0] <= s.high):
                    known |= {k: v for k in wanted if at <= k < at + n}
                    at += n
        large = [s for s in open if s.inside > few]
        spans = [part for parts in divided(x, large, ranges) for part in parts] if large else []
    return known


def quantiles(rows: DataFrame, value: str, shares: Sequence[float], few: int = FEW, ranges: int = RANGES) -> list[float | None]:
    """Exact quantiles of a column with linear interpolation; nulls where it has no number."""
    n = rows.select(clean(F.col(value)).alias("x")).agg(F.count("x")).first()[0]
    if not n:
        return [None] * len(shares)
    at = [(n - 1) * q for q in shares]
    known = selection(rows, value, [k for a in at for k in (math.floor(a), math.ceil(a))], few, ranges)
    return [low if (low := known[math.floor(a)]) == (high := known[math.ceil(a)]) else low + (high - low) * (a - math.floor(a)) for a in at]


def quartiles(rows: DataFrame, keys: list[str], value: str, x: Column) -> Column:
    """An aggregate of the three quartiles: numbers already known where there are no keys."""
    if keys:
        return F.percentile(x, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return F.array(*[F.lit(q).cast("double") for q in quantiles(rows, value, (0.25, 0.5, 0.75))])


def five_number(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mean, min, q1, median, q3, max and count of the numbers in each group; nulls where there is none."""
    x = clean(F.col(value))
    q = quartiles(rows, keys, value, x)
    out = rows.groupBy(*keys).agg(F.avg(x).alias("mean"), F.min(x).alias("min"), q.alias("q"), F.max(x).alias("max"), F.count(x).alias("count"))
    return out.select(*keys, "mean", "min", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "max", "count")


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and the DESCRIPTIVE statistics. One value has sample variance 0; an empty group nulls and count 0."""
    x = clean(F.col(value))
    q = quartiles(rows, keys, value, x)
    alone = F.when(F.count(x) == 1, 0.0)
    got = rows.groupBy(*keys).agg(
        F.count(x).cast("double").alias("count"), F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
        F.var_pop(x).alias("variance_pop"), F.coalesce(alone, F.var_samp(x)).alias("variance_samp"), F.stddev_pop(x).alias("stdev_pop"),
        F.coalesce(alone, F.stddev_samp(x)).alias("stdev_samp"), q.alias("q"),
    )
    for k, name in enumerate(("p25", "p50", "p75")):
        got = got.withColumn(name, F.get("q", F.lit(k)))
    return got.withColumn("std", F.col("stdev_samp")).withColumn("iqr", F.col("p75") - F.col("p25")).select(*keys, *DESCRIPTIVE)


def summary_struct(value: Column) -> Column:
    """The five-number summary as one aggregate; a null struct where there is no number."""
    x = clean(value)
    q = F.percentile(x, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return F.when(F.count(x) > 0, F.struct(F.avg(x).alias("mean"), F.min(x).alias("min"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max(x).alias("max"), F.count(x).alias("count")))


#: Whiskers reach to the last value within so many box widths of the box, as plots draw them.
REACH = 1.5
#: Places where a density is given, and standard deviations from a bin beyond which it counts nothing.
PLACES, FAR = 128, 6.0


def boxes(rows: DataFrame, keys: list[str], value: str, reach: float = REACH) -> tuple[DataFrame, DataFrame]:
    """What box plots draw: keys, mean, q1, median, q3, whisker_low, whisker_high, outliers (how many) and count of each
    group with a number, and keys, value of the outliers, which lie beyond the whiskers."""
    five = five_number(rows, keys, value).where("count > 0").select(*keys, "mean", "q1", "median", "q3", "count")
    held = rows.select(*keys, clean(F.col(value)).alias("value")).where("value is not null")
    pair = held.join(five.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]) if keys else held.crossJoin(F.broadcast(five))  # one row without keys
    inside = F.col("value").between(F.col("q1") - reach * (F.col("q3") - F.col("q1")), F.col("q3") + reach * (F.col("q3") - F.col("q1")))
    numbers = ["mean", "q1", "median", "q3", "count"]
    ends = pair.groupBy(*keys, *numbers).agg(
        F.min(F.when(inside, F.col("value"))).alias("_low"), F.max(F.when(inside, F.col("value"))).alias("_high"), F.count(F.when(~inside, 1)).alias("outliers")
    )
    # a whisker never ends inside the box
    out = ends.select(*keys, "mean", "q1", "median", "q3", F.least("q1", "_low").alias("whisker_low"), F.greatest("q3", "_high").alias("whisker_high"), "outliers", "count")
    return out, pair.where(~inside).select(*keys, "value")


def density(rows: DataFrame, keys: list[str], value: str, places: int = PLACES) -> DataFrame:
    """What violin plots draw: keys, x, density at so many places from a group's least value to its greatest, by Gaussian
    kernels of width std * n^(-1/5). Values are counted in as many bins as there are places first, so a group of any size is
    some hundred counts; groups without two different values have none."""
    x = clean(F.col(value))
    known = rows.groupBy(*keys).agg(F.min(x).alias("_low"), F.max(x).alias("_high"), (F.stddev_samp(x) * F.pow(F.count(x), F.lit(-0.2))).alias("_h"), F.count(x).alias("_n")).where("_high > _low")
    held = rows.select(*keys, x.alias("_x")).where("_x is not null")
    both = held.join(known.withColumnsRenamed({k: f"_k_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]) if keys else held.crossJoin(F.broadcast(known))  # one row without keys
    step = (F.col("_high") - F.col("_low")) / (places - 1)
    bins = both.groupBy(*keys, "_low", "_high", "_h", "_n", F.round((F.col("_x") - F.col("_low")) / step).cast("int").alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    grouped = bins.groupBy(*keys, "_low", "_high", "_h", "_n").agg(F.sort_array(F.collect_list(F.struct("_bin", "_c"))).alias("_bins"))  # as many as places
    kernel = lambda k, b: F.exp(-F.pow((k - b["_bin"]) * step / F.col("_h"), F.lit(2)) / 2)
    at = lambda k: F.aggregate("_bins", F.lit(0.0), lambda a, b: a + F.when(F.abs((k - b["_bin"]) * step) <= FAR * F.col("_h"), b["_c"] * kernel(k, b)).otherwise(0.0))
    one = F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda k: F.struct((F.col("_low") + k * step).alias("x"), (at(k) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density")))
    return grouped.select(*keys, F.inline(one))
