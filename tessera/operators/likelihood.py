"""Negative log-likelihood records: one shape for all inputs, and the means that reports need.

Means differ in what they do with partial records, so each has its own name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import nonzero
from tessera.operators.stats import describe


def records(docs: DataFrame, keys: list[str], doc: str = "doc", aliases: bool = False) -> DataFrame:
    """keys, file, avg_nll, total_nll, total_tokens, error of JSON documents (VARIANT): a map by file, a list, a list
    under entries or results, a summary, or one record. aliases: the numbers under any of their names, zeros as missing."""
    v = F.col(doc)
    has = lambda p: F.try_variant_get(v, p, "variant").isNotNull()
    single = has("$.avg_nll") | has("$.total_nll") | has("$.total_tokens")
    body = F.when(has("$.summary"), F.try_variant_get(v, "$.summary", "variant")).when(has("$.entries"), F.try_variant_get(v, "$.entries", "variant")).when(has("$.results"), F.try_variant_get(v, "$.results", "variant")).otherwise(v)
    one = docs.select(*keys, body.alias("_body"), (single | has("$.summary")).alias("_single"))
    exploded = one.sparkSession.tvf.variant_explode(F.col("_body").outer())
    many = one.where("not _single").lateralJoin(exploded).select(*keys, F.col("key").alias("file"), F.col("value").alias("_r"))
    alone = one.where("_single").select(*keys, F.lit(None).cast("string").alias("file"), F.col("_body").alias("_r"))
    rows = many.unionByName(alone)
    get = lambda p, kind="double": F.try_variant_get("_r", f"$.{p}", kind)
    name = F.coalesce("file", get("file", "string"), get("filename", "string"))
    if aliases:
        own = aliased(F.col("_r"))
        return rows.select(*keys, name.alias("file"), own["avg_nll"].alias("avg_nll"), own["total_nll"].alias("total_nll"), own["total_tokens"].cast("long").alias("total_tokens"), get("error", "string").alias("error"))
    return rows.select(*keys, name.alias("file"), get("avg_nll").alias("avg_nll"), get("total_nll").alias("total_nll"), get("total_tokens").cast("long").alias("total_tokens"), get("error", "string").alias("error"))


def aliased(record: Column) -> Column:
    """avg, total and tokens of a record (VARIANT) under their other names; a zero counts as missing."""
    get = lambda *names: F.coalesce(*[nonzero(F.try_variant_get(record, f"$.{n}", "double")) for n in names])
    return F.struct(get("avg_nll", "avg_loss", "mean_nll").alias("avg_nll"), get("total_nll", "total_loss", "sum_nll").alias("total_nll"), get("total_tokens", "tokens", "num_tokens", "n_tokens").alias("total_tokens"))


def values(rows: DataFrame, weighted: bool = False) -> DataFrame:
    """rows with `value` (avg_nll, else total by token), and for weighted ones (total, or avg by tokens) and `weight`."""
    tokens = nonzero(F.col("total_tokens").cast("double"))
    if not weighted:
        return rows.withColumn("value", F.coalesce("avg_nll", F.col("total_nll") / tokens))
    return rows.withColumn("value", F.coalesce("total_nll", F.col("avg_nll") * tokens)).withColumn("weight", tokens).where("weight is not null and value is not null")


def run_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ave_nll, weighted_ave_nll, n: totals without tokens still add to the weighted mean's upper part."""
    return rows.groupBy(*keys).agg(F.avg("avg_nll").alias("ave_nll"), (F.sum("total_nll") / nonzero(F.sum("total_tokens").cast("double"))).alias("weighted_ave_nll"), F.count(F.lit(1)).alias("n"))


def dataset(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_files (all), n_valid, weighted_nll and statistics of avg_nll over records that have all three numbers."""
    complete = F.col("avg_nll").isNotNull() & F.col("total_nll").isNotNull() & F.col("total_tokens").isNotNull()
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"), F.count(F.when(complete, 1)).alias("n_valid"),
        (F.sum(F.when(complete, F.col("total_nll"))) / nonzero(F.sum(F.when(complete, F.col("total_tokens"))).cast("double"))).alias("weighted_nll"),
    )
    stats = describe(rows.where(complete), keys, "avg_nll")
    return counts.join(stats.select(*keys, *[F.col(c).alias(f"avg_{c}") for c in ("mean", "stdev_samp", "min", "p50", "max")]), keys, "left")


def scalar(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, avg_mean, weighted_avg and weighted_total; without weights the weighted ones are the plain mean."""
    tokens = F.col("total_tokens").cast("double")
    have = F.col("avg_nll").isNotNull() & tokens.isNotNull()
    total = F.coalesce("total_nll", F.col("avg_nll") * tokens)
    weights = lambda c: nonzero(F.sum(F.when(c, tokens)))
    mean = F.avg("avg_nll")
    return rows.groupBy(*keys).agg(
        mean.alias("avg_mean"),
        F.coalesce(F.sum(F.when(have, F.col("avg_nll") * tokens)) / weights(have), mean).alias("weighted_avg"),
        F.coalesce(F.sum(F.when(tokens.isNotNull(), total)) / weights(tokens.isNotNull() & total.isNotNull()), mean).alias("weighted_total"),
    )


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last in order."""
    at = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")
