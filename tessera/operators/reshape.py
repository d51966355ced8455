"""Long and wide tables for reports, their order, and relations read from printed summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import group_label, natural_key
from tessera.operators.ordering import Ordered
from tessera.operators.stats import describe


def melted(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value."""
    return rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value").where("value is not null")


def grid(rows: DataFrame, row: str, column: str, value: str, order: str, columns: list | None = None) -> DataFrame:
    """A table row x column of the last value in order; cells without a number are null."""
    kept = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    wide = kept.groupBy(row).pivot(column, columns) if columns else kept.groupBy(row).pivot(column)
    return wide.agg(F.max_by(value, order))


def axis_caps(rows: DataFrame, keys: list[str], margin: float = 0.3, least: float = 0.01) -> DataFrame:
    """keys, box_top, iqr_max, focus: the highest third quartile, the widest box, and where an axis should end."""
    out = rows.groupBy(*keys).agg(F.max("q3").alias("box_top"), F.coalesce(F.max(F.col("q3") - F.col("q1")), F.lit(0.0)).alias("iqr_max"))
    return out.withColumn("focus", F.col("box_top") + F.greatest(F.lit(least), margin * F.col("iqr_max")))


def statistics_grid(rows: DataFrame, key: str, kind: str, kinds: list[str], value: str, stats=("mean", "stdev_samp")) -> DataFrame:
    """One row a key with columns `<kind>-<statistic>`."""
    got = describe(rows.where(F.col(kind).isin(kinds)), [key, kind], value)
    wide = got.groupBy(key).pivot(kind, kinds).agg(*[F.first(s).alias(s) for s in stats])
    of = lambda k, s: k if len(stats) == 1 else f"{k}_{s}"
    return wide.select(key, *[F.col(f"`{of(k, s)}`").alias(f"{k}-{s}") for k in kinds for s in stats])


def text_grid(rows: DataFrame, row: str, label: str, labels: list[str], text: str) -> DataFrame:
    """Texts by row and label, '' where missing; rows in numeric order, then by text."""
    wide = rows.groupBy(row).pivot(label, labels).agg(F.first(text)).na.fill("", labels)
    return wide.orderBy(F.expr(f"try_cast({row} as int)").asc_nulls_last(), row)


def boundaries(rows: DataFrame, name: str) -> DataFrame:
    """name, group, member, place and last_of_group in natural order, of all different names."""
    out = rows.select(name).distinct().withColumn("_g", group_label(F.col(name)))
    found = Ordered(out, [natural_key(F.col(name)), F.col(name)]).with_next(F.col("_g.group"), "_next")
    return found.select(name, "_g.group", "_g.member", "place", (F.col("_next").isNull() | (F.col("_next") != F.col("_g.group"))).alias("last_of_group"))


def natural_order(rows: DataFrame, name: str) -> DataFrame:
    """name, place: all different names in natural order, numbered from 0."""
    return Ordered(rows.select(name).distinct(), [natural_key(F.col(name)), F.col(name)]).numbered()


def ranked_by(rows: DataFrame, value: str, label: str, descending: bool = True, threshold: float | None = None) -> DataFrame:
    """Rows over the threshold (nulls only without one) in order of value, nulls last."""
    kept = rows if threshold is None else rows.where(F.col(value) > threshold)
    return kept.orderBy(F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last(), label)


def lines(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line_no, line, indent."""
    rows = docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    return rows.withColumn("indent", F.length("line") - F.length(F.ltrim("line")))


def sectioned(rows: DataFrame, keys: list[str], header: Column, name: str = "section") -> DataFrame:
    """lines() with the last header above each line; header is the header's text, null elsewhere."""
    at = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_h", header).withColumn(name, F.last("_h", ignorenulls=True).over(at)).withColumn("is_header", F.col("_h").isNotNull()).drop("_h")


PAIR = r"^\s*([A-Za-z0-9_ ]+):\s*(-?[0-9.eE+-]+|n/a)\s*$"


def divergence_blocks(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, metric, min, q1, median, q3, max of blocks under lines that end in `JSD:`; only complete ones."""
    rows = lines(docs, keys, text)
    title = F.when(F.trim("line").endswith("JSD:"), F.regexp_extract(F.trim("line"), "^(.*):$", 1)).when((F.col("indent") < 4) & (F.trim("line") != ""), F.lit(""))
    rows = sectioned(rows, keys, title, "metric").where("metric != '' and not is_header and indent >= 4")
    rows = rows.select(*keys, "metric", F.lower(F.trim(F.regexp_extract("line", PAIR, 1))).alias("k"), F.regexp_extract("line", PAIR, 2).try_cast("double").alias("v"))
    five = ["min", "q1", "median", "q3", "max"]
    return rows.groupBy(*keys, "metric").pivot("k", five).agg(F.first("v")).dropna(subset=five)


def frechet_line(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, frechet: of the first line `Frechet Music Distance:`; null for n/a."""
    return docs.select(*keys, F.regexp_extract(F.col(text), r"(?m)^\s*Frechet Music Distance:\s*(\S+)", 1).try_cast("double").alias("frechet"))


def section_means(docs: DataFrame, keys: list[str], text: str, sections: dict[str, str], under: str) -> DataFrame:
    """keys, section, mean: the first `mean:` below the line `<under>:` of each section, sections renamed as told."""
    rows = lines(docs, keys, text)
    names = F.create_map(*[F.lit(x) for pair in sections.items() for x in pair])
    title = F.when((F.col("indent") <= 2) & F.trim("line").endswith(":"), F.regexp_extract(F.trim("line"), "^(.*):$", 1))
    rows = sectioned(rows, keys, title, "section").withColumn("section", F.try_element_at(names, F.col("section"))).where("section is not null")
    inner = F.when((F.col("indent") > 2) & F.trim("line").endswith(":"), F.regexp_extract(F.trim("line"), "^(.*):$", 1)).when(F.col("is_header"), F.lit(""))
    rows = rows.drop("is_header")
    rows = sectioned(rows.withColumn("is_header", F.col("indent") <= 2), keys, inner, "part").where(F.col("part") == under)
    means = rows.where(F.trim("line").startswith("mean:")).select(*keys, "section", "line_no", F.regexp_extract("line", PAIR, 2).try_cast("double").alias("mean"))
    return means.groupBy(*keys, "section").agg(F.min_by("mean", "line_no").alias("mean"))


def ratio_means(docs: DataFrame, keys: list[str], text: str, section: str = "Harmonicity") -> DataFrame:
    """keys, ratio, mean of the `*ratio:` blocks of a section, which ends at the next header indented by 2 or less."""
    rows = lines(docs, keys, text)
    title = F.when((F.col("indent") <= 2) & (F.trim("line") != ""), F.regexp_extract(F.trim("line"), "^(.*?):?$", 1))
    rows = sectioned(rows, keys, title, "section").where((F.col("section") == section) & ~F.col("is_header")).drop("is_header")
    ratio = F.when(F.trim("line").rlike("ratio:$"), F.regexp_extract(F.trim("line"), "^(.*):$", 1))
    rows = sectioned(rows, keys, ratio, "ratio").where(F.col("ratio").isNotNull() & F.trim("line").startswith("mean:"))
    return rows.groupBy(*keys, "ratio").agg(F.min_by(F.regexp_extract("line", PAIR, 2).try_cast("double"), "line_no").alias("mean"))
