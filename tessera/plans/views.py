"""The supplied tables seen as notes, ticks, timings, likelihood records and names; each with the same view in SQL.

Times lie on a dyadic grid, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENERATED, TRUTH = "generated", "ground_truth"
#: Orders that make a piece, so that pieces grow in number with the data, not in length.
ORDERS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    guitar = F.col("l_returnflag") == "A"
    t0 = F.col("l_quantity") * 0.25 + F.col("l_linenumber") * 0.0625
    return li.select(
        F.expr(f"l_orderkey div {ORDERS}").alias("piece_id"), F.when(F.col("l_linenumber") % 2 == 1, GENERATED).otherwise(TRUTH).alias("side"), F.col("l_linenumber").cast("long").alias("track_idx"),
        F.when(guitar, "Guitar").otherwise(" piano").alias("name"), F.when(guitar, 25).otherwise(0).alias("program"), (F.col("l_suppkey") % 16 == 0).alias("is_drum"),
        (F.col("l_partkey") % 128).alias("pitch"), t0.alias("t0"), (t0 + (1 + F.round(F.col("l_tax") * 100)) * 0.125).alias("t1"),
    )


NOTES = f"""notes AS (SELECT l_orderkey // {ORDERS} AS piece_id, CASE WHEN l_linenumber % 2 = 1 THEN '{GENERATED}' ELSE '{TRUTH}' END AS side,
  CAST(l_linenumber AS BIGINT) AS track_idx, CASE WHEN l_returnflag = 'A' THEN 'Guitar' ELSE ' piano' END AS name, CASE WHEN l_returnflag = 'A' THEN 25 ELSE 0 END AS program,
  l_suppkey % 16 = 0 AS is_drum, l_partkey % 128 AS pitch, l_quantity * 0.25 + l_linenumber * 0.0625 AS t0,
  l_quantity * 0.25 + l_linenumber * 0.0625 + (1 + round(l_tax * 100)) * 0.125 AS t1 FROM lineitem)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of all lengths, from none to months: of a piece's orders, in two sides."""
    o = table(spark, sf_dir, "orders")
    t0 = (F.col("o_orderkey") % 8192) * 0.5
    length = F.when(F.col("o_custkey") % 8 > 0, (F.col("o_custkey") % 9) * 0.25).otherwise(F.pow(F.lit(2.0), F.floor(F.col("o_custkey") / 8) % 25))
    return o.select(
        F.expr(f"o_orderkey div {4 * ORDERS}").alias("piece_id"), F.when(F.col("o_orderkey") % 2 == 1, GENERATED).otherwise(TRUTH).alias("side"), F.col("o_orderkey").alias("note"),
        (F.col("o_custkey") % 128).alias("pitch"), t0.alias("t0"), (t0 + length).alias("t1"),
    )


SPANS = f"""spans AS (SELECT o_orderkey // {4 * ORDERS} AS piece_id, CASE WHEN o_orderkey % 2 = 1 THEN '{GENERATED}' ELSE '{TRUTH}' END AS side, o_orderkey AS note, o_custkey % 128 AS pitch,
  (o_orderkey % 8192) * 0.5::DOUBLE AS t0, (o_orderkey % 8192) * 0.5::DOUBLE + CASE WHEN o_custkey % 8 > 0 THEN (o_custkey % 9) * 0.25::DOUBLE ELSE 2.0::DOUBLE ** ((o_custkey // 8) % 25) END AS t1 FROM orders)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 20).alias("run"), F.when(F.col("event_type") == "view", None).otherwise(F.col("event_id") % 96).alias("tick"),
        (F.col("event_type") != "error").alias("is_hit"), F.when(F.col("event_id") % 7 == 0, None).otherwise((F.col("event_id") % 37).cast("double")).alias("backup_level"),
    )


TICKS = """ticks AS (SELECT user_id % 20 AS run, CASE WHEN event_type = 'view' THEN NULL ELSE event_id % 96 END AS tick, event_type <> 'error' AS is_hit,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 37 AS DOUBLE) END AS backup_level FROM events)"""


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    late = (F.col("event_id") % 128) / 64
    return e.select(
        (F.col("user_id") % 20).alias("run"), F.when(F.col("user_id") % 20 < 19, 3 + F.col("user_id") % 7).alias("frames"), "event_id",
        F.when(F.col("event_type") != "click", late).alias("round_trip_time"), F.when(F.col("event_id") % 3 > 0, F.lit(100.0)).alias("request_arrival_time"), (100.0 + late / 2).alias("response_output_time"),
    )


TIMINGS = """timings AS (SELECT user_id % 20 AS run, CASE WHEN user_id % 20 < 19 THEN 3 + user_id % 7 END AS frames, event_id,
  CASE WHEN event_type <> 'click' THEN (event_id % 128) / 64.0::DOUBLE END AS round_trip_time, CASE WHEN event_id % 3 > 0 THEN 100.0::DOUBLE END AS request_arrival_time,
  100.0::DOUBLE + (event_id % 128) / 64.0::DOUBLE / 2 AS response_output_time FROM events)"""


def likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    tokens = F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 11 == 0, 0).otherwise(F.col("o_custkey") % 512)
    return o.select(
        F.col("o_orderpriority").alias("run"), (F.col("o_custkey") % 40).alias("interval"), (F.col("o_orderkey") % 4).alias("gen_frame"), F.concat(F.lit("f"), (F.col("o_orderkey") % 300).cast("string")).alias("file"), F.col("o_orderkey").alias("source"),
        F.when(F.col("o_orderkey") % 7 == 0, None).otherwise((F.col("o_custkey") % 64) / 16).alias("avg_nll"), F.when(F.col("o_orderkey") % 3 == 0, None).otherwise((F.col("o_orderkey") % 1000) / 4).alias("total_nll"), tokens.cast("long").alias("total_tokens"),
    )


LIKELIHOODS = """nll AS (SELECT o_orderpriority AS run, o_custkey % 40 AS interval, o_orderkey % 4 AS gen_frame, 'f' || (o_orderkey % 300)::VARCHAR AS file, o_orderkey AS source,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_custkey % 64) / 16.0::DOUBLE END AS avg_nll, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 1000) / 4.0::DOUBLE END AS total_nll,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_custkey % 512 END::BIGINT AS total_tokens FROM orders)"""


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names like those of runs' folders and files."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    interval, gen = (F.col("k") % 12).cast("string"), (F.col("k") % 9).cast("string")
    name = (
        F.when(F.col("k") % 6 == 0, F.concat(F.lit("Run_interval_"), interval, F.lit("_gen_frame_"), gen))
        .when(F.col("k") % 6 == 1, F.concat(F.lit("gen3_interval"), interval, F.lit("-gen"), gen))
        .when(F.col("k") % 6 == 2, F.concat(F.lit("interval"), interval))
        .when(F.col("k") % 6 == 3, F.concat(F.lit("gen_"), gen, F.lit("..x__y")))
        .when(F.col("k") % 6 == 4, F.concat(F.lit("a/interval_"), interval, F.lit("_gen_frame_"), gen, F.lit("/prompt_"), gen, F.lit("_gen_"), interval, F.lit("/out.mid.mid")))
        .otherwise(F.concat(F.lit("offline_"), gen, F.lit(".MIDI")))
    )
    return c.select("k", name.alias("name"))


RUN_NAMES = """names AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'Run_interval_' || (c_custkey % 12)::VARCHAR || '_gen_frame_' || (c_custkey % 9)::VARCHAR
  WHEN 1 THEN 'gen3_interval' || (c_custkey % 12)::VARCHAR || '-gen' || (c_custkey % 9)::VARCHAR WHEN 2 THEN 'interval' || (c_custkey % 12)::VARCHAR
  WHEN 3 THEN 'gen_' || (c_custkey % 9)::VARCHAR || '..x__y'
  WHEN 4 THEN 'a/interval_' || (c_custkey % 12)::VARCHAR || '_gen_frame_' || (c_custkey % 9)::VARCHAR || '/prompt_' || (c_custkey % 9)::VARCHAR || '_gen_' || (c_custkey % 12)::VARCHAR || '/out.mid.mid'
  ELSE 'offline_' || (c_custkey % 9)::VARCHAR || '.MIDI' END AS name FROM customer)"""


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries as a run prints them, with numbers of suppliers."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), (F.col("s_suppkey") % 64 / 64).alias("x"))
    number = lambda c: F.format_string("%.4f", c)
    x = F.col("x")
    five = [F.concat(F.lit(f"    {k}: "), number(v)) for k, v in (("mean", x), ("min", x / 4), ("q1", x / 2), ("median", x), ("q3", x + 1), ("max", x + 2))]
    frechet = F.when(F.col("run") % 5 == 0, "n/a").otherwise(number(x * 8))
    ratios = [y for k, v in (("consonant", x / 2), ("unsupported", x / 8)) for y in (F.lit(f"    {k} ratio:"), F.concat(F.lit("      mean: "), number(v)))]
    text = F.concat_ws(
        "\n", F.lit("Accompaniment:"), F.lit("  Pitch JSD:"), *five, F.lit("  Onset JSD:"), F.lit("    min: n/a"), F.concat(F.lit("  Frechet Music Distance: "), frechet), F.lit("  Harmonicity:"), *ratios,
        F.lit("  Chord Accuracy:"), F.lit("      mean: 9.0"), F.lit("  Prompt Latents:"), F.lit("    txt mean distance:"), F.concat(F.lit("      mean: "), number(x + 3)), F.lit("      max: 9"), F.lit("    chd mean distance:"), F.lit("      mean: 1"),
    )
    return s.select("run", text.alias("text"))


PRINTED = "printed AS (SELECT s_suppkey AS run, s_suppkey % 64 / 64.0::DOUBLE AS x FROM supplier)"
