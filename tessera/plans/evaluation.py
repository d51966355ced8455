"""A whole evaluation: from notes of both sides to details by piece and the run's summary; and report tables of runs.

A run's result is one row of details a piece and one row of summary; both have the same names in JSON, so that a report
reads what an evaluation wrote. What isn't asked for, or has no value in any piece, is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import at_path
from tessera.operators import chords, histogram, matching, overlap, pairs, phrases, reshape, roles, stats, vectors
from tessera.operators.ordering import Ordered

SIDES = ("generated", "ground_truth")
FEATURES = ("pitch", "onset", "duration")
RATIOS = ("consonant_ratio", "dissonant_ratio", "unsupported_ratio")
VALUES = ("rhythm_density", "voice_number")
#: Fixed keys of latent distances: what is compared with the prompt, and the parts of an encoding.
LATENTS = ("prompt_polydis", "prompt_generated_continuation_polydis", "prompt_groundtruth_continuation_polydis")
PARTS = ("txt", "chd")
#: Fixed columns of a report, and their paths in a run's summary, of which the first that holds a number counts.
REPORT = {
    "pitch_jsd": ("accompaniment_vs_groundtruth.pitch_jsd.mean",),
    "onset_jsd": ("accompaniment_vs_groundtruth.onset_jsd.mean",),
    "duration_jsd": ("accompaniment_vs_groundtruth.duration_jsd.mean",),
    "prompt_groundtruth_txt_mean_distance": ("accompaniment_vs_groundtruth.prompt_groundtruth_continuation_polydis.txt_mean_distance.mean",),
    "prompt_groundtruth_chd_mean_distance": ("accompaniment_vs_groundtruth.prompt_groundtruth_continuation_polydis.chd_mean_distance.mean",),
    "prompt_generated_txt_mean_distance": ("accompaniment_vs_groundtruth.prompt_generated_continuation_polydis.txt_mean_distance.mean",),
    "prompt_generated_chd_mean_distance": ("accompaniment_vs_groundtruth.prompt_generated_continuation_polydis.chd_mean_distance.mean",),
    "frechet_music_distance": ("accompaniment_vs_groundtruth.frechet_music_distance", "accompaniment_vs_groundtruth.frechet_music_distance.mean"),
    "rd": ("inter_track_continuity.auto_phrase_pairs.rd.mean",),
    "vn": ("inter_track_continuity.auto_phrase_pairs.vn.mean",),
    "consonant_ratio": ("melody_relationship.harmonicity.consonant_ratio.mean",),
    "dissonant_ratio": ("melody_relationship.harmonicity.dissonant_ratio.mean",),
    "unsupported_ratio": ("melody_relationship.harmonicity.unsupported_ratio.mean",),
}
#: Per-piece metrics of a result's item, and where they stand, the first present deciding.
ITEM_METRICS = {
    "pitch_jsd": ("pitch_jsd",), "onset_jsd": ("onset_jsd",), "duration_jsd": ("duration_jsd",), "chord_accuracy": ("chord_accuracy",),
    "consonant_ratio": ("consonant_ratio", "harmonicity.consonant_ratio"), "unsupported_ratio": ("unsupported_ratio", "harmonicity.unsupported_ratio"),
    "prompt_generated_txt_mean_distance": ("prompt_generated_txt_mean_distance", "prompt_generated_continuation_polydis.txt_mean_distance", "prompt_polydis.txt_mean_distance"),
}


@dataclass(frozen=True)
class Options:
    keep_melody: bool = False
    include_drums: bool = False
    consonant: tuple[int, ...] = overlap.CONSONANT
    onset_bins: int = histogram.BINS
    duration_bins: int = histogram.BINS
    duration_top: float = histogram.TOP
    window: float = phrases.WINDOW
    resolution: float = phrases.RESOLUTION
    bars: int = phrases.BARS
    random_pairs: int = 1000


def sides(notes: DataFrame, piece: list[str], melody: Column, o: Options = Options()) -> DataFrame:
    """The notes compared: generated accompaniment, and the truth's piano tracks (or all)."""
    gen = roles.accompaniment(notes.where(F.col("side") == SIDES[0]), melody, o.keep_melody, o.include_drums)
    return gen.unionByName(roles.ground_truth(notes.where(F.col("side") == SIDES[1]), piece))


def phrase_windows(both: DataFrame, meta: DataFrame, piece: list[str], o: Options = Options()) -> DataFrame:
    """piece, side, idx, w0, w1 and VALUES in phrases of so many bars. meta: piece, side, end_time, tempo, ts_numerator, beats, downbeats."""
    keys = [*piece, "side"]
    at = lambda c: meta.select(*keys, F.explode(c).alias("t"))
    return phrases.bars(both, phrases.bar_boundaries(meta, at("downbeats"), at("beats"), keys), keys, o.bars, o.resolution)


def chord_accuracy(both: DataFrame, segments: DataFrame, piece: list[str]) -> DataFrame:
    """piece, accuracy of the generated side's chords. segments: piece, seg_idx, s0, s1, label."""
    candidates = chords.first_seen(segments, piece).join(chords.parsed(segments), "label")
    gen = both.where(F.col("side") == SIDES[0])
    return chords.accuracy(segments, chords.picked(segments, gen, candidates, piece), gen, piece)


def latent_distances(latents: DataFrame, piece: list[str]) -> DataFrame:
    """piece and a struct of each kind of LATENTS. latents: piece, kind, part (PARTS), a, b: encodings of a window's two sides."""
    d = vectors.l2(F.col("a"), F.col("b"))
    of = lambda f, kind, part: f(F.when((F.col("kind") == kind) & (F.col("part") == part), d))
    made = []
    for kind in LATENTS:
        numbers = [x for p in PARTS for x in (of(F.avg, kind, p).alias(f"{p}_mean_distance"), of(F.stddev_pop, kind, p).alias(f"{p}_std_distance"))]
        windows = of(F.count, kind, PARTS[0])
        made.append(F.when(windows > 0, F.struct(*numbers, windows.alias("segments"))).alias(kind))
    return latents.groupBy(*piece).agg(*made)


def histograms(made: dict[str, DataFrame], piece: list[str], o: Options) -> DataFrame:
    """piece, histograms: counts of all bins of each feature and side."""
    out = None
    for name, bins in zip(FEATURES, (128, o.onset_bins, o.duration_bins)):
        dense = histogram.dense(made[name], [*piece, "side"], bins)
        one = dense.groupBy(*piece).agg(*[F.max(F.when(F.col("side") == s, F.col("histogram"))).alias(f"{name}_{s}") for s in SIDES])
        out = one if out is None else out.join(one, piece, "full")
    return out.select(*piece, F.struct(*[f"{n}_{s}" for n in FEATURES for s in SIDES]).alias("histograms"))


def details(notes: DataFrame, piece: list[str], melody: Column, o: Options = Options(), windows: DataFrame | None = None, segments: DataFrame | None = None, latents: DataFrame | None = None, with_histograms: bool = False) -> DataFrame:
    """One row a piece: note counts, three divergences, harmonicity (null without both roles), chord accuracy, latent
    distances, the phrases of windows, and histograms, as far as asked for."""
    both = sides(notes, piece, melody, o)
    counts = both.groupBy(*piece).pivot("side", list(SIDES)).count().na.fill(0, list(SIDES))
    out = counts.select(*piece, F.struct(*SIDES).alias("note_counts"))
    made = {
        "pitch": histogram.pitches(both, [*piece, "side"]), "onset": histogram.onsets(both, piece, "side", o.onset_bins),
        "duration": histogram.durations(both, piece, "side", o.duration_bins, o.duration_top),
    }
    for name in FEATURES:
        out = out.join(histogram.jensen_shannon(made[name], piece, "side", SIDES).withColumnRenamed("jsd", f"{name}_jsd"), piece, "left")
    gen = notes.where(F.col("side") == SIDES[0])
    harmony = overlap.consonance(roles.melody_notes(gen, melody), roles.accompaniment(gen, melody), piece, consonant=o.consonant)
    out = out.join(harmony.select(*piece, F.struct(*RATIOS).alias("harmonicity")), piece, "left")
    if segments is not None:
        out = out.join(chord_accuracy(both, segments, piece).withColumnRenamed("accuracy", "chord_accuracy"), piece, "left")
    if latents is not None:
        out = out.join(latent_distances(latents, piece), piece, "left")
    if windows is not None:  # a piece's phrases are few
        one = F.struct("idx", "w0", "w1", *VALUES)
        lists = [F.sort_array(F.collect_list(F.when(F.col("side") == s, one))).alias(s) for s in SIDES]
        out = out.join(windows.groupBy(*piece).agg(F.struct(*lists).alias("auto_phrase_metrics")), piece, "left")
    return out.join(histograms(made, piece, o), piece, "left") if with_histograms else out


def differences_struct(rows: DataFrame, kinds: list[str] | None = None) -> Column:
    """One aggregate of rows with diff_<value> columns: count, rd and vn; by kind where kinds are told."""
    of = lambda c, keep: F.when(keep, F.col(c)) if keep is not None else F.col(c)

    def one(keep: Column | None) -> Column:
        n = F.count(of("diff_rhythm_density", keep))
        return F.when(n > 0, F.struct(n.alias("count"), stats.summary_struct(of("diff_rhythm_density", keep)).alias("rd"), stats.summary_struct(of("diff_voice_number", keep)).alias("vn")))

    return one(None) if kinds is None else F.struct(*[one(F.col("kind") == k).alias(k) for k in kinds])


def validation_pairs(events: DataFrame, o: Options = Options()) -> DataFrame:
    """One row: random, same_song and adjacent pairs of phrases. events: song, record, t0, t1."""
    rows = phrases.windows(events, ["song"], ["song", "record"], o.window, o.resolution).select("song", "idx", *VALUES)
    numbered = Ordered(rows, [F.col("song"), F.col("idx")]).numbered("_n")
    kinds = {"random": pairs.at_random(numbered, "_n", list(VALUES), o.random_pairs), "same_song": pairs.same_group(rows, ["song"], "idx", list(VALUES)), "adjacent": pairs.adjacent(rows, ["song"], "idx", list(VALUES))}
    long = None
    for kind, found in kinds.items():
        one = found.select(F.lit(kind).alias("kind"), *[f"diff_{v}" for v in VALUES])
        long = one if long is None else long.unionByName(one)
    return long.agg(differences_struct(long, list(kinds)).alias("validation_pairs"))


def run_summary(rows: DataFrame, piece: list[str], windows: DataFrame | None = None, validation: DataFrame | None = None, frechet: float | None = None, run: tuple[str, ...] = ()) -> DataFrame:
    """One row of a run's details, or of each run's: accompaniment_vs_groundtruth, inter_track_continuity,
    melody_relationship. Validation pairs and the Frechet distance are those of all runs."""
    five = lambda c: stats.summary_struct(F.col(c))
    none = F.lit(None).cast("double")
    against = [five(f"{f}_jsd").alias(f"{f}_jsd") for f in FEATURES]
    for kind in LATENTS:
        if kind in rows.columns:
            against.append(F.when(F.count(kind) > 0, F.struct(*[five(f"{kind}.{c}").alias(c) for c in (*[f"{p}_mean_distance" for p in PARTS], "segments")])).alias(kind))
        else:
            against.append(none.alias(kind))
    against.append(F.lit(frechet).cast("double").alias("frechet_music_distance"))
    harmony = F.when(F.count("harmonicity") > 0, F.struct(*[five(f"harmonicity.{r}").alias(r) for r in RATIOS]))
    chord = five("chord_accuracy") if "chord_accuracy" in rows.columns else none
    out = rows.groupBy(*run).agg(F.struct(*against).alias("accompaniment_vs_groundtruth"), F.struct(harmony.alias("harmonicity"), chord.alias("chord_accuracy")).alias("melody_relationship"))
    if windows is not None:
        found = pairs.by_place(windows, piece, "idx", "side", SIDES, list(VALUES))
        found = found.groupBy(*run).agg(differences_struct(found).alias("auto_phrase_pairs"))
        out = out.join(found, list(run), "left") if run else out.crossJoin(F.broadcast(found))  # one row each
    else:
        out = out.withColumn("auto_phrase_pairs", none)
    out = out.crossJoin(F.broadcast(validation)) if validation is not None else out.withColumn("validation_pairs", none)
    return out.select(*run, "accompaniment_vs_groundtruth", F.struct("validation_pairs", "auto_phrase_pairs").alias("inter_track_continuity"), "melody_relationship")


def piece_phrase_means(windows: DataFrame, piece: list[str]) -> DataFrame:
    """piece, metric (RD, VN), value: the mean difference of each piece's phrases, where a plot takes pieces and not pairs."""
    found = pairs.by_place(windows, piece, "idx", "side", SIDES, list(VALUES))
    means = found.groupBy(*piece).agg(F.avg("diff_rhythm_density").alias("RD"), F.avg("diff_voice_number").alias("VN"))
    return reshape.melted(means, piece, ["RD", "VN"])


def report(results: DataFrame, systems: DataFrame, likelihoods: DataFrame | None = None, name: str = "name") -> DataFrame:
    """name, the REPORT columns, then ISR, Staleness and ISR_w of the best matching system run, and likelihood means.

    results: name, doc (VARIANT); systems: candidate, global_hit_rate, global_avg_backup, ISR_w; likelihoods: candidate,
    ave_nll, weighted_ave_nll.
    """
    held = F.try_variant_get("doc", "$.summary", "variant")
    rows = results.where(held.isNotNull()).select(name, *[F.coalesce(*[at_path(held, p) for p in paths]).alias(k) for k, paths in REPORT.items()])
    runs = matching.ranked(rows.select(name), systems.select("candidate"), name).select(name, F.col("candidate").alias("_c"))
    system = systems.select(F.col("candidate").alias("_c"), F.col("global_hit_rate").alias("ISR"), F.col("global_avg_backup").alias("Staleness"), "ISR_w")
    out = rows.join(runs.join(system, "_c").drop("_c"), name, "left")
    return out if likelihoods is None else with_likelihoods(out, likelihoods, name)


def with_likelihoods(rows: DataFrame, likelihoods: DataFrame, name: str = "name") -> DataFrame:
    """A report's rows with ave_nll and weighted_ave_nll of the best matching file; columns of these names are replaced."""
    rows = rows.drop("ave_nll", "weighted_ave_nll")
    found = matching.ranked(rows.select(name), likelihoods.select("candidate"), name, rules=matching.LIKELIHOOD_RULES).select(name, F.col("candidate").alias("_c"))
    return rows.join(found.join(likelihoods.select(F.col("candidate").alias("_c"), "ave_nll", "weighted_ave_nll"), "_c").drop("_c"), name, "left")


def plot_rows(rows: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """model, metric, value: what box, violin and bar plots take."""
    return reshape.melted(rows, [model], metrics)
