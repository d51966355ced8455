"""Matching of names: files to files, report rows to runs by ranked rules, prompts beside their ground truth.

Ranked matches never compare all with all: every rule is a join by equality. Containment is one too: hashes of a text's
windows, of the lengths that candidates' ends have, are joined with these ends', and what is found is compared as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import cut_at, interval_gen, stem

#: Rules in order of priority for runs of a system and for likelihood files.
SYSTEM_RULES = ("numeric", "containment", "plain_within")
LIKELIHOOD_RULES = ("exact", "containment", "numeric", "plain_either")


def file_pairs(generated: DataFrame, truth: DataFrame, path: str = "path", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, key, generated, ground_truth: files with equal stems; of equal truths the first path, all generated ones."""
    gen = generated.select(*keys, stem(F.col(path)).alias("key"), F.col(path).alias("generated"))
    gt = truth.groupBy(*keys, stem(F.col(path)).alias("key")).agg(F.min(path).alias("ground_truth"))
    return gen.join(gt, [*keys, "key"])


def unmatched(generated: DataFrame, truth: DataFrame, path: str = "path") -> DataFrame:
    gt = truth.select(stem(F.col(path)).alias("key"))
    return generated.withColumn("key", stem(F.col(path))).join(gt, "key", "left_anti")


#: Longest end of a name, in bytes, by which it is looked up in others; names may be any longer.
ANCHOR = 64
#: Bits of the filter by which windows of a text are left out that no name ends with.
FILTER_BITS = 22
#: Bytes of a text whose windows are hashed at a time.
STRETCH = 1 << 20
#: Factor of the rolling hash, which is taken modulo 2^64; odd, so that it has an inverse there.
FACTOR = 0x9E3779B97F4A7C15


class Rolling:
    """Hashes of a text's windows: differences of its running hash, brought to the same power."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = (np.full(len(data), f, np.uint64).cumprod(dtype=np.uint64) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))
        self.upto = np.concatenate([np.zeros(1, np.uint64), ((data.astype(np.uint64) + np.uint64(1)) * powers).cumsum(dtype=np.uint64)])

    def windows(self, n: int) -> np.ndarray:
        hashes = (self.upto[n:] - self.upto[:-n]) * self.inverse[: max(0, len(self.upto) - n)] + np.uint64(n)  # windows of another length are others
        return (hashes ^ (hashes >> np.uint64(31))) * np.uint64(FACTOR)


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, piece): the hash of each text's last bytes, as many as the largest power of two that it has."""
    for batch in batches:
        out = []
        for text in batch.column(1):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            n = min(ANCHOR, 1 << (len(data).bit_length() - 1))
            out.append(int(Rolling(data[-n:]).windows(n).view(np.int64)[0]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["_i", "_piece"])


def met_anchors(wanted: np.ndarray, sizes: list[int]):
    """A function from batches of (id, text) to (id, piece): different hashes of windows that the filter `wanted` lets in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for begin in range(0, max(len(data), 1), STRETCH):
                    rolling = Rolling(data[begin : begin + STRETCH + ANCHOR - 1])
                    found = [h[wanted[h >> np.uint64(64 - FILTER_BITS)]] for n in sizes for h in [rolling.windows(n)]]
                    pieces = np.unique(np.concatenate(found)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pieces), key.as_py(), np.int64)), pa.array(pieces)], ["_o", "_piece"])

    return run


def within(inner: DataFrame, outer: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of inner x outer where inner's text a (not empty) lies in outer's text b.

    A text's windows of the lengths of names' ends are hashed as they roll along, and those that a filter of a fixed size
    lets in become rows, joined with the ends' hashes. What meets is compared as a whole, so neither the filter nor hashes
    decide, and neither a long text nor many names make a large row.
    """
    inner, outer = inner.where(F.length(a) > 0).withColumn("_i", F.xxhash64(a)), outer.where(F.col(b).isNotNull()).withColumn("_o", F.xxhash64(b))
    held = inner.select("_i", a).mapInArrow(anchors, "_i long, _piece long")
    words = held.groupBy(F.expr(f"shiftrightunsigned(_piece, {64 - FILTER_BITS}) div 64").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_piece, {64 - FILTER_BITS}) % 64 as int))")).alias("bits")).toArrow()  # 2^16 rows at most
    sizes = sorted({min(ANCHOR, 1 << r[0]) for r in inner.select(F.floor(F.log2(F.octet_length(a))).cast("int").alias("n")).distinct().collect()})  # a number for each power of two
    wanted = np.zeros(1 << FILTER_BITS, bool)
    if len(words):
        bits = words.column("bits").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
        wanted.reshape(-1, 64)[words.column("word").to_numpy()] = np.unpackbits(bits, axis=1, bitorder="little").astype(bool)
    if not sizes:
        return inner.drop("_i").crossJoin(outer.drop("_o")).limit(0)
    hits = outer.select("_o", b).mapInArrow(met_anchors(wanted, sizes), "_o long, _piece long").join(held, "_piece").select("_i", "_o").distinct()
    return inner.join(hits, "_i").join(outer, "_o").where(F.contains(F.col(b), F.col(a))).drop("_i", "_o")


def ranked(rows: DataFrame, candidates: DataFrame, name: str = "name", candidate: str = "candidate", rules=SYSTEM_RULES) -> DataFrame:
    """rows with the candidate of the best rule that fits, and the rule; of several the first name. Null without one.

    exact: equal names in lower case; containment: one within the other; numeric: equal interval and gen_frame;
    plain_within: the row's name without _ within the candidate's; plain_either: either way.
    """
    plain = lambda c: F.replace(F.lower(F.col(c)), F.lit("_"), F.lit(""))
    r = rows.select(name).distinct().withColumn("_rl", F.lower(name)).withColumn("_rp", plain(name)).withColumn("_rk", interval_gen(F.col(name)))
    c = candidates.select(candidate).distinct().withColumn("_cl", F.lower(candidate)).withColumn("_cp", plain(candidate)).withColumn("_ck", interval_gen(F.col(candidate)))
    r, c = (x.withColumn(f"_{s}i", F.col(f"_{s}k.interval")).withColumn(f"_{s}g", F.col(f"_{s}k.gen_frame")).drop(f"_{s}k") for x, s in ((r, "r"), (c, "c")))
    made = {
        "exact": lambda: [r.join(c, F.col("_rl") == F.col("_cl"))],
        "containment": lambda: [within(r, c, "_rl", "_cl"), within(c, r, "_cl", "_rl")],
        "numeric": lambda: [r.join(c, (F.col("_ri") == F.col("_ci")) & (F.col("_rg") == F.col("_cg")))],
        "plain_within": lambda: [within(r, c, "_rp", "_cp")],
        "plain_either": lambda: [within(r, c, "_rp", "_cp"), within(c, r, "_cp", "_rp")],
    }
    found = None
    for k, rule in enumerate(rules):
        for pairs in made[rule]():
            one = pairs.select(name, candidate, F.lit(k).alias("_k"), F.lit(rule).alias("rule"))
            found = one if found is None else found.unionByName(one)
    best = found.groupBy(name).agg(F.min(F.struct("_k", candidate, "rule")).alias("_b")).select(name, f"_b.{candidate}", "_b.rule")
    return rows.join(best, name, "left")


def prompt_files(truth: DataFrame, listing: DataFrame, path: str = "path", ancestors: int = 3) -> DataFrame:
    """path, prompt: the prompt file of a ground truth under a folder promptN, nearest folder and root first.

    Tried names: the file's, its stem, its stem without further .mid, each with _promptlenN.mid, in the folder promptN and
    so many folders above it.
    """
    parts = F.split(path, "/")
    depth = F.size("_parts")
    level = truth.select(path).withColumn("_parts", parts).withColumn("_d", F.explode(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1)))))
    number = F.regexp_extract(F.get("_parts", F.col("_d") - 1), r"(?i)^prompt(?:len)?[_-]?(\d+)", 1)
    level = level.withColumn("_n", number).where("_n != ''").withColumn("_near", depth - F.col("_d"))
    base = F.element_at("_parts", -1)
    own = F.regexp_replace(base, r"\.[^.]*$", "")
    names = F.array_distinct(F.array(base, own, F.regexp_replace(own, r"(?:\.mid)+$", "")))
    level = level.select(path, "_parts", "_d", "_n", "_near", F.posexplode(names).alias("_v", "_name"))
    level = level.withColumn("_up", F.explode(F.sequence(F.lit(0), F.least(F.lit(ancestors), F.col("_d") - 1))))
    folder = F.array_join(F.slice("_parts", F.lit(1), F.col("_d") - F.col("_up")), "/")
    tried = level.withColumn("prompt", F.concat_ws("/", folder, F.concat("_name", F.lit("_promptlen"), "_n", F.lit(".mid"))))
    there = tried.join(listing.select(F.col(path).alias("prompt")).distinct(), "prompt")
    return there.groupBy(path).agg(F.min(F.struct("_near", "_up", "_v", "prompt")).alias("b")).select(path, "b.prompt")


def resolved(keys: DataFrame, listing: DataFrame, key: str = "key", path: str = "path") -> DataFrame:
    """key, path: the first listed path that contains the key; a key of offline runs the first of runs without prompt."""
    wanted = F.when(F.col(key).contains("offline"), "generated_without_prompt").otherwise(F.col(key))
    pairs = within(keys.select(key, wanted.alias("_w")), listing.select(path), "_w", path)
    return pairs.groupBy(key).agg(F.min(path).alias(path))


#: Fixed names of metrics by where their files lie: results of runs, raw logs, likelihoods; and the folders' defaults.
METRICS = {
    "result": ("pitch_jsd", "onset_jsd", "duration_jsd", "consonant_ratio", "unsupported_ratio", "prompt_generated_txt_mean_distance", "frechet_music_distance", "chord_accuracy"),
    "raw": ("hit_rate", "hit_rate_weighted", "backup_level"),
    "nll": ("nll", "nll_weighted"),
}
BASES = {"result": "result", "raw": "records", "nll": "records"}


def metric_paths(keys: DataFrame, metric: str, base: str | None = None, listed: DataFrame | None = None, key: str = "key", path: str = "path") -> DataFrame:
    """key, path, error: where the file or folder of a metric lies for each key.

    A result lies under its key; raw logs under the interval's folder and the rest of the key; a likelihood file is the first
    listed below nll_runs whose name contains the key's folder name, or is that of runs without a prompt for offline keys.
    error tells why there is no path: a key of too few parts, or no such file. listed: paths, for likelihoods only.
    """
    family = next((f for f, names in METRICS.items() if metric in names), None)
    if family is None:
        raise ValueError(f"{metric}: not one of {', '.join(m for names in METRICS.values() for m in names)}")
    base = (BASES[family] if base is None else base).rstrip("/")
    if family == "result":
        return keys.select(key, F.concat(F.lit(f"{base}/"), key, F.lit(".json")).alias(path), F.lit(None).cast("string").alias("error"))
    parts = cut_at(F.col(key), 2)
    folder = F.replace(F.replace(parts["head"], F.lit("_gen"), F.lit("_gen_frame_")), F.lit("interval"), F.lit("interval_"))
    few = F.concat(F.lit("too few parts: "), key)
    if family == "raw":
        found = F.concat(F.lit(f"{base}/raw/realtime/baseline/"), folder, F.lit("/"), parts["tail"], F.lit("/batch_run"))
        return keys.select(key, found.alias(path), F.when(found.isNull(), few).alias("error"))
    if listed is None:
        raise ValueError("likelihood files need a list of paths")
    offline = F.col(key).contains("offline")
    rows = keys.select(key, F.when(offline, "generated_without_prompt").otherwise(F.concat(folder, F.lit("_"), parts["tail"])).alias("_w"))
    names = listed.select(F.col(path).alias("_path"), F.regexp_extract(path, r"(?:^|/)nll_runs/([^/]+)", 1).alias("_name")).where("_name != ''")
    names = names.where(F.col("_path").startswith(base)) if base else names
    held = within(rows.where("_w is not null").select("_w").distinct(), names.select("_name").distinct(), "_w", "_name").groupBy("_w").agg(F.min("_name").alias("_name"))
    out = rows.join(held, "_w", "left")
    missing = F.when(F.col("_w").isNull(), few).when(F.col("_name").isNull(), F.concat(F.lit("no file for "), "_w"))
    return out.select(key, F.when(missing.isNull(), F.concat(F.lit(f"{base}/nll_runs/"), "_name")).alias(path), missing.alias("error"))


def first_ranked(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")
