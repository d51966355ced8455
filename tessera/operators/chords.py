"""Chord labels of annotated segments from the notes that sound in them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.overlap import length, overlapping

NO_CHORD = "N"


@dataclass(frozen=True)
class Scoring:
    """Least sounding time, weight of notes outside, of the root, and least share inside."""

    min_time: float = 0.05
    min_share: float = 0.2
    outside: float = 0.5
    root: float = 0.3


#: Fixed values of chord notation: half tones of note letters, and of the shorthands' notes above the root.
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SHORTHANDS = {
    "": (0, 4, 7), "maj": (0, 4, 7), "min": (0, 3, 7), "dim": (0, 3, 6), "aug": (0, 4, 8), "1": (0,), "5": (0, 7),
    "maj7": (0, 4, 7, 11), "min7": (0, 3, 7, 10), "7": (0, 4, 7, 10), "dim7": (0, 3, 6, 9), "hdim7": (0, 3, 6, 10), "minmaj7": (0, 3, 7, 11),
    "maj6": (0, 4, 7, 9), "min6": (0, 3, 7, 9), "9": (0, 4, 7, 10, 2), "maj9": (0, 4, 7, 11, 2), "min9": (0, 3, 7, 10, 2),
    "11": (0, 4, 7, 10, 2, 5), "maj11": (0, 4, 7, 11, 2, 5), "min11": (0, 3, 7, 10, 2, 5), "13": (0, 4, 7, 10, 2, 5, 9), "maj13": (0, 4, 7, 11, 2, 5, 9), "min13": (0, 3, 7, 10, 2, 5, 9),
    "sus2": (0, 2, 7), "sus4": (0, 5, 7),
}
#: Half tones of the degrees of a scale, by number.
DEGREES = (0, 2, 4, 5, 7, 9, 11)


def degree(text: str) -> int:
    number = int(text.lstrip("#b")) - 1
    return (DEGREES[number % 7] + text.count("#") - text.count("b")) % 12


def pitch_classes(label: str) -> tuple[int, tuple[int, ...]] | None:
    """Root and pitch classes of `root[:shorthand][(degrees)][/bass]`; null for no chord and unknown labels."""
    head = label.split("/")[0]
    name, _, quality = head.partition(":")
    quality, _, extra = quality.partition("(")
    if not name or name[0] not in LETTERS or quality not in SHORTHANDS or name[1:].strip("#b"):
        return None
    root = (LETTERS[name[0]] + name.count("#") - name.count("b")) % 12
    notes = set(SHORTHANDS[quality]) if quality or not extra else {0}
    try:
        for d in filter(None, extra.rstrip(")").split(",")):
            notes = notes - {degree(d[1:])} if d.startswith("*") else notes | {degree(d)}
    except ValueError:
        return None
    return root, tuple(sorted((root + n) % 12 for n in notes))


def vocabulary(spark: SparkSession, labels: list[str]) -> DataFrame:
    """(label, root, classes) of the labels that can be read. Labels are a bounded vocabulary, not data rows."""
    rows = [(x, *got) for x in labels if (got := pitch_classes(x))]
    return spark.createDataFrame([(a, b, list(c)) for a, b, c in rows], "label string, root int, classes array<int>")


def parsed(labels: DataFrame) -> DataFrame:
    """(label, root, classes) of the different labels of a table that can be read, however many: tasks read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, *got) for x in batch.column(0).to_pylist() if (got := pitch_classes(x))]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.list_(pa.int32())))], ["label", "root", "classes"])

    different = labels.where(F.col("label").isNotNull() & (F.col("label") != NO_CHORD)).select("label").distinct()
    return different.mapInArrow(run, "label string, root int, classes array<int>")


def class_durations(segments: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seg_idx, pc, w: seconds of each pitch class in each segment (seg_idx, s0, s1)."""
    met = overlapping(segments.select(*keys, "seg_idx", "s0", "s1"), notes.select(*keys, F.pmod("pitch", F.lit(12)).alias("pc"), "t0", "t1"), keys, ("s0", "s1"), ("t0", "t1"))
    return met.groupBy(*keys, "seg_idx", "pc").agg(F.sum(length(("s0", "s1"), ("t0", "t1"))).alias("w"))


def picked(segments: DataFrame, notes: DataFrame, candidates: DataFrame, keys: list[str], scoring: Scoring = Scoring()) -> DataFrame:
    """keys, seg_idx, label: the best candidate (label, root, classes, rank, and any of keys) of each segment, else N.

    Ties go to the smaller rank. A segment has 12 pitch classes at most, so weights fit in one row.
    """
    own = [c for c in keys if c in candidates.columns]
    met = overlapping(segments.select(*keys, "seg_idx", "s0", "s1"), notes.select(*keys, F.pmod("pitch", F.lit(12)).cast("int").alias("pc"), "t0", "t1"), keys, ("s0", "s1"), ("t0", "t1"))
    rows = met.select(*keys, "seg_idx", "pc", length(("s0", "s1"), ("t0", "t1")).alias("w"))
    rows = rows.unionByName(segments.select(*keys, "seg_idx", F.lit(None).cast("int").alias("pc"), F.lit(0.0).alias("w")))  # segments without notes stay
    weights = rows.groupBy(*keys, "seg_idx").agg(F.array(*[F.sum(F.when(F.col("pc") == k, F.col("w")).otherwise(0.0)) for k in range(12)]).alias("m"), F.sum("w").alias("total"))
    one = F.collect_list(F.struct("label", "root", "classes", "rank"))
    if own:
        pairs = weights.join(candidates.groupBy(*own).agg(one.alias("_c")), own, "left")
    else:  # a stated vocabulary
        pairs = weights.crossJoin(F.broadcast(candidates.agg(one.alias("_c"))))
    weight = lambda pc: F.element_at("m", pc.cast("int") + 1)

    def scored(c: Column) -> Column:
        inside = F.aggregate(c["classes"], F.lit(0.0), lambda a, pc: a + weight(pc))
        score = inside - scoring.outside * (F.col("total") - inside) + scoring.root * weight(c["root"])
        return F.struct((inside / F.col("total") >= scoring.min_share).alias("ok"), score.alias("s"), (-c["rank"]).alias("r"), c["label"].alias("label"))

    best = F.array_max(F.filter(F.transform("_c", scored), lambda x: x["ok"]))["label"]
    return pairs.select(*keys, "seg_idx", F.coalesce(F.when(F.col("total") >= scoring.min_time, best), F.lit(NO_CHORD)).alias("label"))


def first_seen(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, rank: labels in order of their first segment, N left out."""
    seen = segments.where(F.col("label") != NO_CHORD).groupBy(*keys, "label").agg(F.min("seg_idx").alias("_at"))
    return seen.select(*keys, "label", (F.row_number().over(Window.partitionBy(*keys).orderBy("_at")) - 1).alias("rank"))


def accuracy(segments: DataFrame, found: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, accuracy: the share of annotated segments, begun before the last note's end, with the same label."""
    ends = notes.groupBy(*keys).agg(F.max("t1").alias("_end"))
    rows = segments.join(ends, keys).where(F.col("s0") < F.col("_end") + 1e-3)
    both = rows.join(found.select(*keys, "seg_idx", F.col("label").alias("_found")), [*keys, "seg_idx"])
    return both.groupBy(*keys).agg(F.avg((F.col("label") == F.col("_found")).cast("double")).alias("accuracy"))
