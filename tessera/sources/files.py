"""Readers of annotations, logs and results, and path listings. All paths go through Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import at_path, first_key, last_parts, nearest_frames, number, report_id

CHORDS = "s0 double, s1 double, label string"
PHRASES = "accompaniment_path string, events array<struct<time: double, duration: double>>"
TICKS = "array<struct<tick: int, is_hit: boolean, backup_level: double>>"
TIMINGS = "array<struct<response: struct<timings: struct<round_trip_time: double, request_arrival_time: double, response_output_time: double>>>>"


def listing(spark: SparkSession, path: str | list[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length of files; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", "length")


def texts(spark: SparkSession, path: str, pattern: str = "*.json", recursive: bool = True) -> DataFrame:
    """path, text of whole files."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def results(spark: SparkSession, root: str) -> DataFrame:
    """path, name, doc (VARIANT) of JSON results: files of any case, and folders *.json as an evaluation writes them."""
    found = texts(spark, root, "*.{json,JSON,Json,txt}").where(F.col("path").rlike(r"(?i)[^/]+\.json(?:/result)?(?:/part-[^/]*\.txt)?$"))
    name = F.regexp_extract("path", r"(?i)/(?:file=)?([^/]*)\.json(?:/result)?(?:/part-[^/]*)?$", 1)
    return documents(found.where(~F.col("path").contains("/details/"))).withColumn("name", name)


def experiments(spark: SparkSession, root: str) -> DataFrame:
    """path, name, doc of likelihood files named experiments*.json."""
    return documents(texts(spark, root, "experiments*.json")).withColumn("name", F.regexp_extract("path", r"([^/]*)\.json$", 1))


def likelihood_files(spark: SparkSession, root: str) -> DataFrame:
    """path, name, doc of *.nll.json files, but for those that sum others up."""
    found = texts(spark, root, "*.nll.json").where(~F.col("path").rlike(r"/(?:combined|summary)_nll\.json$"))
    return documents(found).withColumn("name", F.regexp_extract("path", r"([^/]*)\.nll\.json$", 1))


def generated_folders(listed: DataFrame, path: str = "path") -> DataFrame:
    """folder: all folders named `generated` that hold files, at any depth."""
    return listed.select(F.regexp_extract(path, r"^(.*/generated)/", 1).alias("folder")).where("folder != ''").distinct()


def documents(files: DataFrame) -> DataFrame:
    """path, doc (VARIANT) of those files that hold JSON."""
    return files.withColumn("doc", F.try_parse_json("text")).where("doc is not null").drop("text")


def chords(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, seg_idx, s0, s1, label; blank lines skipped, a line without three fields raises."""
    whole = texts(spark, path, options.get("pattern", "*.txt"))
    rows = whole.select("path", F.posexplode(F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")).alias("seg_idx", "line")).withColumn("p", F.split("line", "\t", -1))
    bad = F.raise_error(F.concat(F.lit("three fields expected: "), F.col("line")))
    part = lambda k: F.when(F.size("p") == 3, F.get("p", F.lit(k))).otherwise(bad)
    return rows.select("path", "seg_idx", part(0).cast("double").alias("s0"), part(1).cast("double").alias("s1"), F.trim(part(2)).alias("label"))


def phrase_events(spark: SparkSession, path: str) -> DataFrame:
    """song, record, t0, t1 of phrase JSON lines; records without events are skipped."""
    rows = spark.read.schema(PHRASES).json(path).where(F.size("events") > 0)
    base = F.regexp_replace(F.regexp_extract("accompaniment_path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    rows = rows.select(F.coalesce(F.nullif(base, F.lit("")), F.lit("unknown")).alias("song"), F.monotonically_increasing_id().alias("record"), F.inline("events"))
    return rows.select("song", "record", F.col("time").alias("t0"), (F.col("time") + F.coalesce("duration", F.lit(0.0))).alias("t1"))


def run_files(spark: SparkSession, root: str, name: str, direct: bool = True) -> DataFrame:
    """path, run, text of files of that name in folders below `batch_run`: its children only, or at any depth."""
    below = r"/batch_run/[^/]+/" if direct else r"/batch_run/(?:.*/)?"
    found = texts(spark, root, name).where(F.col("path").rlike(below + name.replace(".", r"\.") + "$"))
    return found.withColumn("run", last_parts(F.regexp_extract("path", r"^(.*)/batch_run/", 1)))


def ticks(spark: SparkSession, root: str, direct: bool = True) -> DataFrame:
    """run, path, tick, is_hit, backup_level; unreadable files are skipped."""
    rows = run_files(spark, root, "tick_history.json", direct).withColumn("t", F.from_json("text", TICKS))
    return rows.select("run", "path", F.inline("t"))


def timings(spark: SparkSession, root: str, name: str = "inferences.json") -> DataFrame:
    """run, path, position in the file, frames and the three times of each response."""
    rows = run_files(spark, root, name).select("run", "path", F.posexplode(F.from_json("text", TIMINGS)).alias("position", "t"))
    return rows.select("run", "path", "position", nearest_frames(F.col("path")).alias("frames"), "t.response.timings.*")


def system_globals(spark: SparkSession, root: str, folder: str = "final-sys-results") -> DataFrame:
    """name, global_hit_rate, global_avg_backup, ISR_w, total_samples, total_hits of runs; of equal names the last path."""
    docs = results(spark, root).where(F.col("path").contains(f"/{folder}/"))
    get = lambda k, kind="double": at_path(F.col("doc"), f"global.{k}", kind).alias(k)
    rows = docs.where(F.try_variant_get("doc", "$.global", "variant").isNotNull())
    rows = rows.select("name", "path", get("global_hit_rate"), get("global_avg_backup"), get("ISR_w"), get("total_samples", "long"), get("total_hits", "long"))
    return rows.groupBy("name").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("name", "path")]), "path").alias("g")).select("name", "g.*")


def result_items(docs: DataFrame, keys: list[str], kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """keys, item and a number for each kind of every item in details (or results, or items); an item that is no record
    gives nulls. kinds: name to paths, of which the first present decides."""
    v = F.col("doc")
    body = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in ("details", "results", "items")])
    held = docs.select(*keys, body.alias("_b")).where("_b is not null")
    rows = held.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("_b").outer()))
    return rows.select(*keys, F.col("pos").alias("item"), *[first_key(F.col("value"), *paths).alias(name) for name, paths in kinds.items()])


def details(spark: SparkSession, root: str, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """name and a number for each kind of every item of the results below root: of the lines that an evaluation wrote beside
    a result, however many, else of the items in the result's text."""
    lines = spark.read.option("pathGlobFilter", "part-*.json*").option("recursiveFileLookup", "true").text(root).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))
    name = F.regexp_extract("path", r"(?i)/([^/]*)\.json/details/[^/]*$", 1), F.regexp_extract("path", r"(?i)/details/file=([^/]*)\.json/[^/]*$", 1)
    lines = lines.withColumn("name", F.coalesce(*[F.nullif(n, F.lit("")) for n in name])).where("name is not null and doc is not null")
    own = lines.select("name", *[first_key(F.col("doc"), *paths).alias(k) for k, paths in kinds.items()])
    rest = results(spark, root).join(lines.select("name").distinct(), "name", "left_anti")
    return own.unionByName(result_items(rest, ["name"], kinds).drop("item"))


def manifest(docs: DataFrame) -> DataFrame:
    """root_key, root, dir of manifests; roots that are no record or have an error are left out."""
    tvf = docs.sparkSession.tvf
    roots = docs.select("doc").lateralJoin(tvf.variant_explode(F.col("doc").outer())).select(F.col("key").alias("root_key"), F.col("value").alias("v"))
    good = roots.where(F.try_variant_get("v", "$.root", "string").isNotNull() & F.try_variant_get("v", "$.error", "variant").isNull())
    dirs = good.select("root_key", F.try_variant_get("v", "$.root", "string").alias("root"), F.try_variant_get("v", "$.dirs", "variant").alias("d")).where("d is not null")
    return dirs.lateralJoin(tvf.variant_explode(F.col("d").outer())).select("root_key", "root", F.col("key").alias("dir"))


def run_config(spark: SparkSession, path: str) -> DataFrame:
    """label, path of lines `label:/path`; blank lines, comments and malformed lines are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("line")).where("line != '' and not startswith(line, '#') and contains(line, ':')")
    parts = F.split("line", ":", 2)
    return rows.select(F.trim(F.get(parts, F.lit(0))).alias("label"), F.trim(F.get(parts, F.lit(1))).alias("path")).where("label != '' and path != ''")


def child_folders(listed: DataFrame, root: str, path: str = "path") -> DataFrame:
    """name of the folders right below root that hold files, without those that start with `offline`."""
    tail = F.regexp_extract(path, r"^(?:file:/*)?/*\Q" + root.strip("/") + r"\E/([^/]+)/", 1)
    return listed.select(tail.alias("name")).where("name != '' and not startswith(name, 'offline')").distinct().orderBy("name")


def prompt_folders(listed: DataFrame, inner: tuple[str, str], path: str = "path") -> DataFrame:
    """folder, prompt of folders promptN that hold files in both inner folders."""
    rows = listed.select(F.regexp_extract(path, r"^(.*/prompt[0-9]+)/[^/]+/", 1).alias("folder"), F.regexp_extract(path, r"/prompt[0-9]+/([^/]+)/", 1).alias("inner"))
    sides = [rows.where(F.col("inner") == x).select("folder").distinct() for x in inner]
    both = sides[0].join(sides[1], "folder", "left_semi")
    return both.select("folder", F.regexp_extract("folder", r"/prompt([0-9]+)$", 1).cast("int").alias("prompt"))


def collected(docs: DataFrame) -> DataFrame:
    """id, filename and the three numbers of each entry of `collected`, null where missing."""
    body = docs.select(F.try_variant_get("doc", "$.collected", "variant").alias("b")).where("b is not null")
    rows = body.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("b").outer()))
    name = at_path(F.col("value"), "filename", "string")
    return rows.select(report_id(name).alias("id"), name.alias("filename"), *[number(at_path(F.col("value"), k)).alias(k) for k in ("global_hit_rate", "global_avg_backup", "ISR_w")])


def report(spark: SparkSession, path: str) -> DataFrame:
    """A report's CSV: header row, all texts."""
    return spark.read.option("header", True).csv(path)
