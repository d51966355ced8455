"""Commands over folders of files; each writes tables or text folders, as Spark writes.

evaluate GENERATED TRUTH OUT   one run: divergences, consonance, and what the options ask for, by piece and summed up
batch CONFIG OUT               evaluations of all runs of a file of `label:/path` lines, by prompt, and a table of them; the
                               pairs may also be given themselves: batch base:/runs/a tuned:/runs/b OUT
folders ROOT TRUTH OUT         evaluations of all folders `generated` below ROOT
system ROOT OUT                tick metrics by run with a GLOBAL row, and a JSON result of each run
globals ROOT OUT               means over the runs' final numbers
deadlines ROOT OUT             deadline-miss ratio by run, with a sample of its responses
nll ROOT OUT                   likelihood means by file
grid ROOT OUT                  likelihood by interval and gen_frame
report RESULTS SYSTEMS OUT     one row a run: summary metrics, system numbers, likelihoods
merge REPORT NLL OUT           a report's CSV with likelihood means
stats ROOT OUT                 statistics of per-piece metrics by run
rename IN OLD NEW OUT          tracks of MIDI files under another name: a table of notes, or with --midi files in OUT (IN
                               stays as it is), or with --dry-run a list of what would change

An OUT named <run>.json is a result that report and stats read; batch and folders evaluate all runs in one plan and write
their results to OUT/results/file=<run>.json, with the pieces as lines in OUT/details/file=<run>.json.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import header, run_name, strict_interval_gen
from tessera.operators import likelihood, matching, reshape, roles, ticks, vectors
from tessera.plans import evaluation
from tessera.sources import files, midi, midi_sink, sinks

def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, *places: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        for p in places:
            one.add_argument(p.rstrip("+"), nargs="+" if p.endswith("+") else None)
        return one

    o = evaluation.Options()
    for one in (add("evaluate", "generated", "truth", "out"), add("folders", "root", "truth", "out"), add("batch", "config+", "out")):
        one.add_argument("--melody-name", action="append", default=[])
        one.add_argument("--melody-program", action="append", type=int, default=[])
        one.add_argument("--melody-index", action="append", type=int, default=[])
        one.add_argument("--keep-melody", action="store_true")
        one.add_argument("--include-drums", action="store_true")
        one.add_argument("--consonant", action="append", type=int, help="half tones that are consonant")
        one.add_argument("--onset-bins", type=int, default=o.onset_bins)
        one.add_argument("--duration-bins", type=int, default=o.duration_bins)
        one.add_argument("--duration-top", type=float, default=o.duration_top, help="quantile at which the last bin ends")
        one.add_argument("--chords", help="folders named after pieces, with chord_midi.txt")
        one.add_argument("--phrases", help="JSON lines of validation phrases")
        one.add_argument("--random-pairs", type=int, default=o.random_pairs)
        one.add_argument("--window", type=float, default=o.window)
        one.add_argument("--resolution", type=float, default=o.resolution)
        one.add_argument("--auto-phrases", action="store_true")
        one.add_argument("--bars", type=int, default=o.bars)
        one.add_argument("--prompts", help="folder of prompt files; notes after each prompt go to OUT/continuations")
        one.add_argument("--latents", help="Parquet table piece, kind, part, a, b of encodings")
        one.add_argument("--embeddings", help="Parquet table side, embedding for the Frechet distance")
        one.add_argument("--estimator", choices=(*vectors.ESTIMATORS, vectors.RESAMPLED), default="mle")
        one.add_argument("--histograms", action="store_true")
        one.add_argument("--midi", action="store_true", help="write the notes compared as MIDI files, OUT/midi/<run>/<side>/<stem>.mid")
        one.add_argument("--strict", action="store_true", help="fail on files that can't be read; else they are listed in OUT/errors")
        if one.prog.endswith("folders"):
            one.add_argument("--names", choices=("parameters", "folders"), default="parameters", help="what results are named after")
        if one.prog.endswith("batch"):
            one.add_argument("--generated", default="generated")
            one.add_argument("--truth", default="groundtruth")
    one = add("system", "root", "out")
    one.add_argument("--weight", type=float, default=ticks.WEIGHT)
    one.add_argument("--aggregated", action="store_true", help="also write all ticks of all runs, OUT/aggregated")
    add("globals", "root", "out")
    one = add("deadlines", "root", "out")
    one.add_argument("--time-per-tick", type=float, default=ticks.TICK)
    one.add_argument("--sample", type=int, default=100, help="responses of a run that are kept beside its ratio")
    one.add_argument("--records", action="store_true", help="keep the first ones with folder and miss, not the longest times")
    one.add_argument("--by-run", action="store_true", help="write a folder <run>.json for each run")
    add("merge", "report", "nll", "out")
    add("nll", "root", "out")
    add("grid", "root", "out")
    add("report", "results", "systems", "out").add_argument("--nll")
    add("stats", "root", "out").add_argument("--stat", action="append", default=[])
    one = add("rename", "path", "old", "new", "out")
    one.add_argument("--contains", action="store_true")
    one.add_argument("--midi", action="store_true", help="write the changed files")
    one.add_argument("--dry-run", action="store_true", help="list the files that would change, with their tracks' names")
    return out


def evaluated(spark: SparkSession, a: argparse.Namespace, runs: list[tuple[str, str, str]], out: str) -> tuple[DataFrame, DataFrame]:
    """Details and summaries, both by run, of runs (name, folder of generated files, folder of the truth): one plan for all.

    What is read several times is written once below out: errors, pieces and, with prompts, continuations.
    """
    o = evaluation.Options(
        a.keep_melody, a.include_drums, tuple(a.consonant or evaluation.Options().consonant), a.onset_bins, a.duration_bins, a.duration_top, a.window, a.resolution, a.bars, a.random_pairs
    )
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^[a-z0-9]+:/*", "/"), "/+$", "")
    folder, names = plain(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), ["run", "piece"]

    def side(k: int) -> DataFrame:
        """The files of one side of each run; a folder that several runs share is decoded once."""
        places = spark.createDataFrame([(r[0], r[k]) for r in runs], "run string, _folder string").withColumn("_folder", plain(F.col("_folder")))
        found = midi.files(spark, sorted({r[k] for r in runs})).withColumn("_folder", folder)
        return found.join(F.broadcast(places), "_folder").drop("_folder")  # a row for each run that was asked for

    gen, real = side(1), side(2)
    bad = gen.unionByName(real).where("error is not null").select("run", "path", "error")
    if a.strict and (first := bad.first()):
        raise ValueError(f"{first.path}: {first.error}")
    bad.write.mode("overwrite").json(f"{out}/errors")
    pairs = matching.file_pairs(gen, real, keys=("run",))
    own = gen.join(pairs.select("run", F.col("generated").alias("path"), "key"), ["run", "path"])
    # a generated file is a piece; of files with one name each is a piece of its own
    made = own.select(F.col("path").alias("piece"), F.lit(evaluation.SIDES[0]).alias("side"), *[c for c in own.columns if c != "key"])
    other = real.join(pairs.select("run", F.col("ground_truth").alias("path"), F.col("generated").alias("piece")), ["run", "path"])
    files_ = made.unionByName(other.withColumn("side", F.lit(evaluation.SIDES[1])))
    notes = files_.where("error is null").select(*names, "side", F.inline("notes"))
    meta = files_.where("error is null and end_time > 0").select(*names, "side", "end_time", "tempo", "ts_numerator", "beats", "downbeats")
    melody = roles.is_melody(a.melody_name, a.melody_program, a.melody_index)
    windows = evaluation.phrase_windows(evaluation.sides(notes, names, melody, o), meta, names, o) if a.auto_phrases else None
    segments = None
    if a.chords:
        marks = files.chords(spark, a.chords, pattern="chord_midi.txt").withColumn("key", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1))
        segments = marks.join(pairs.select("run", "key", F.col("generated").alias("piece")), "key").select(*names, "seg_idx", "s0", "s1", "label")
    latents = spark.read.parquet(a.latents).join(pairs.select("run", F.col("generated").alias("piece")), "piece") if a.latents else None
    if a.midi:
        kept = evaluation.sides(notes, names, melody, o)
        note = [c for c in kept.columns if c not in (*names, "side")]
        lists = kept.join(pairs.select("run", "key", F.col("generated").alias("piece")), names).groupBy(*names, "key", "side").agg(F.collect_list(F.struct(*note)).alias("notes"))  # of one file
        midi_sink.write_files(midi_sink.encoded(lists.select(F.concat_ws("/", "run", "side", F.concat("key", F.lit(".mid"))).alias("name"), "notes")), f"{out}/midi")
    rows = evaluation.details(notes, names, melody, o, windows, segments, latents, a.histograms)
    prompt = F.lit(None).cast("string")
    if a.prompts:
        found = matching.prompt_files(pairs.select(F.col("ground_truth").alias("path")), files.listing(spark, a.prompts, "*.mid"))
        ends = found.join(midi.files(spark, a.prompts, recursive=True).select(F.col("path").alias("prompt"), F.col("end_time").alias("prompt_end")), "prompt").select(F.col("path").alias("ground_truth"), "prompt", "prompt_end")
        pairs = pairs.join(ends, "ground_truth", "left")
        prompt = F.col("prompt")
        timed = evaluation.sides(notes, names, melody, o).join(pairs.select("run", F.col("generated").alias("piece"), "prompt_end"), names, "left")
        roles.continuation(timed, F.col("prompt_end")).drop("prompt_end").write.mode("overwrite").parquet(f"{out}/continuations")
    named = pairs.select("run", F.col("generated").alias("piece"), F.struct(F.col("key").alias("piece"), F.col("generated").alias("generated_path"), F.col("ground_truth").alias("groundtruth_path"), prompt.alias("prompt_path")).alias("_n"))
    rows = rows.join(named, names).select("run", "_n.*", *[c for c in rows.columns if c not in names])
    rows.write.mode("overwrite").parquet(f"{out}/pieces")  # read by the summary and both forms of details
    rows = spark.read.parquet(f"{out}/pieces")
    validation = evaluation.validation_pairs(files.phrase_events(spark, a.phrases), o) if a.phrases else None
    score = None
    if a.embeddings:
        e = spark.read.parquet(a.embeddings)
        real_e, gen_e = (e.where(F.col("side") == s) for s in reversed(evaluation.SIDES))
        score = vectors.frechet(real_e, gen_e, "embedding", estimator=a.estimator)
    return rows, evaluation.run_summary(rows, names, windows, validation, score, ("run",))


def evaluate(spark: SparkSession, a: argparse.Namespace, generated: str, truth: str, out: str) -> None:
    rows, summary = (x.drop("run") for x in evaluated(spark, a, [("run", generated, truth)], out))
    sinks.json_payload(rows, summary, out)
    sinks.printed_summary(summary, rows.count()).coalesce(1).write.mode("overwrite").text(f"{out}/printed")


def evaluate_all(spark: SparkSession, a: argparse.Namespace, runs: list[tuple[str, str, str]], out: str) -> DataFrame:
    """Many runs as one: results and details by run, and (run, value) of their printed summaries, also written."""
    names = [r[0] for r in runs]
    if again := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"several runs have the name {', '.join(again)}")
    rows, summary = evaluated(spark, a, runs, out)
    sinks.json_by_run(rows, summary, "run", out)
    counted = summary.join(rows.groupBy("run").agg(F.count(F.lit(1)).alias("_n")), "run")
    sinks.printed_summary(counted, F.col("_n"), ("run",)).write.mode("overwrite").parquet(f"{out}/printed")
    return spark.read.parquet(f"{out}/printed")


def batch(spark: SparkSession, a: argparse.Namespace) -> None:
    """Every prompt folder of every run with both folders, and the printed summaries as a table of prompts and labels."""
    given = [tuple(x.split(":", 1)) for x in a.config if ":" in x and not x.startswith(("/", "."))] if len(a.config) > 1 or ":/" in a.config[0] else [(r.label, r.path) for r in files.run_config(spark, a.config[0]).collect()]
    given = [(label.strip(), path.strip()) for label, path in given]  # the lines of a configuration
    if not given:
        raise ValueError("no runs are given")
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^[a-z0-9]+:/*", "/"), "/+$", "")
    places = spark.createDataFrame(given, "label string, root string").withColumn("root", F.concat(plain(F.col("root")), F.lit("/")))  # as short as a configuration
    found = files.prompt_folders(files.listing(spark, sorted({path for _, path in given})), (a.generated, a.truth))
    found = found.join(F.broadcast(places), F.startswith(plain(F.col("folder")), F.col("root")))
    done = [(r.label, r.prompt, r.folder) for r in found.select("label", "prompt", "folder").distinct().orderBy("label", "prompt", "folder").collect()]  # runs that were asked for
    if not done:
        raise ValueError("no prompt folders with both folders")
    printed = evaluate_all(spark, a, [(f"{label}_prompt{prompt}", f"{folder}/{a.generated}", f"{folder}/{a.truth}") for label, prompt, folder in done], a.out)
    keys = spark.createDataFrame([(f"{label}_prompt{prompt}", str(prompt), label) for label, prompt, _ in done], "run string, prompt string, label string")
    rows = printed.join(F.broadcast(keys), "run").select("prompt", "label", F.col("value").alias("text"))
    sinks.csv(reshape.text_grid(rows, "prompt", "label", [label for label, _ in given], "text").coalesce(1), f"{a.out}/table")


def folders(spark: SparkSession, a: argparse.Namespace) -> None:
    """All folders `generated` below a root, under the names of their parameters or of their folders."""
    found = files.generated_folders(files.listing(spark, a.root, "*.mid*"))
    name = run_name(F.col("folder")) if a.names == "parameters" else F.regexp_extract("folder", r"((?:[^/]+/){0,2}[^/]+)/generated$", 1)
    runs = [(r.name.replace("/", "_") or "run", r.folder, a.truth) for r in found.select("folder", name.alias("name")).orderBy("folder").collect()]  # a row a run
    if not runs:
        raise ValueError("no folders named generated")
    evaluate_all(spark, a, runs, a.out)


def likelihood_means(spark: SparkSession, root: str) -> DataFrame:
    return likelihood.run_means(likelihood.records(files.likelihood_files(spark, root), ["name"]), ["name"]).drop("n").withColumnRenamed("name", "candidate")


def experiment_means(spark: SparkSession, root: str) -> DataFrame:
    """As likelihood_means(), of experiments*.json with all names that their numbers go by."""
    docs = files.experiments(spark, root)
    rows = likelihood.records(docs, ["name"], aliases=True)
    return likelihood.run_means(rows, ["name"]).drop("n").withColumnRenamed("name", "candidate")


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    if a.command == "evaluate":
        evaluate(spark, a, a.generated, a.truth, a.out)
    elif a.command == "batch":
        batch(spark, a)
    elif a.command == "folders":
        folders(spark, a)
    elif a.command == "system":
        rows = files.ticks(spark, a.root)
        sinks.csv(ticks.with_global(rows, ["run"], a.weight), f"{a.out}/rows")
        sinks.json_by_name(ticks.run_results(rows, "run", a.weight), "run", f"{a.out}/final-sys-results")
        if a.aggregated:
            sinks.json_rows(rows, f"{a.out}/aggregated")
    elif a.command == "globals":
        sinks.json_rows(ticks.across(files.system_globals(spark, a.root)), a.out)
    elif a.command == "deadlines":
        rows = ticks.deadlines(files.timings(spark, a.root), ["run"], a.time_per_tick, a.sample, a.records)
        if a.by_run:
            sinks.json_by_name(rows, "run", a.out)
        else:
            sinks.json_rows(rows, a.out)
    elif a.command == "nll":
        sinks.csv(likelihood.run_means(likelihood.records(files.likelihood_files(spark, a.root), ["name"]), ["name"]), a.out, digits=6)
    elif a.command == "grid":
        docs = files.likelihood_files(spark, a.root).withColumn("k", strict_interval_gen(F.col("name"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)))
        rows = likelihood.scalar(likelihood.records(docs, ["name", "k"]), ["name", "k"]).select("name", "k.*", F.col("weighted_total").alias("value")).where("interval is not null")
        sinks.csv(reshape.grid(rows, "interval", "gen_frame", "value", "name").orderBy("interval"), a.out, digits=6)
    elif a.command == "report":
        systems = files.system_globals(spark, a.systems).withColumnRenamed("name", "candidate")
        rows = evaluation.report(files.results(spark, a.results), systems, likelihood_means(spark, a.nll) if a.nll else None)
        sinks.csv(rows.orderBy("name").withColumnRenamed("name", "filename"), a.out)
    elif a.command == "merge":
        rows = files.report(spark, a.report)
        key = header(rows.columns, "filename") or rows.columns[0]
        sinks.csv(evaluation.with_likelihoods(rows, experiment_means(spark, a.nll), key).select(*[c for c in rows.columns if c not in ("ave_nll", "weighted_ave_nll")], "ave_nll", "weighted_ave_nll"), a.out)
    elif a.command == "stats":
        docs = files.results(spark, a.root)
        long = reshape.melted(files.details(spark, a.root, evaluation.ITEM_METRICS), ["name"], list(evaluation.ITEM_METRICS))
        found = reshape.statistics_grid(long, "name", "metric", list(evaluation.ITEM_METRICS), "value", tuple(a.stat) or ("mean", "stdev_samp"))
        sinks.csv(docs.select("name").distinct().join(found, "name", "left"), a.out)  # a run without items stays, as an empty row
    else:
        if a.midi or a.dry_run:
            found = midi_sink.renamed(midi.contents(spark, a.path, recursive=True), a.old, a.new, a.contains)
            if a.dry_run:
                sinks.json_rows(found.select("path", "changed", F.lit(a.new).alias("new")), a.out)
            else:
                midi_sink.write_files(found, a.out)
        else:
            tracks = midi.notes(midi.files(spark, a.path, recursive=True))
            sinks.json_rows(roles.renamed(tracks, a.old, a.new, a.contains), a.out)
    return 0
