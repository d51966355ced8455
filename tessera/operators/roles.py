"""Which notes are melody, accompaniment or ground truth, and notes after a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIANO = "piano"


def is_melody(names=(), programs=(), indices=()) -> Column:
    """A track named so (any case, trimmed; an empty name never), of such a program, or at such a place."""
    own = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    wanted = [n.strip().lower() for n in names]
    return ((own != "") & own.isin(wanted)) | F.col("program").isin(list(programs)) | F.col("track_idx").isin(list(indices))


def accompaniment(notes: DataFrame, melody: Column, keep_melody: bool = False, include_drums: bool = False) -> DataFrame:
    out = notes if include_drums else notes.where(~F.coalesce("is_drum", F.lit(False)))
    return out if keep_melody else out.where(~F.coalesce(melody, F.lit(False)))


def melody_notes(notes: DataFrame, melody: Column) -> DataFrame:
    return notes.where(~F.coalesce("is_drum", F.lit(False)) & F.coalesce(melody, F.lit(False)))


def ground_truth(notes: DataFrame, piece: list[str], name: str = PIANO) -> DataFrame:
    """Tracks named so if a piece has any, else all of the piece's. One row a piece decides; notes aren't sorted."""
    usable = notes.where(~F.coalesce("is_drum", F.lit(False)))
    own = F.lower(F.trim(F.coalesce("name", F.lit("")))) == name
    flags = usable.groupBy(*piece).agg(F.max(own).alias("_any"))
    return usable.join(flags, piece).where(own | ~F.col("_any")).drop("_any")


def continuation(notes: DataFrame, prompt_end: Column) -> DataFrame:
    """Notes that sound after the prompt, cut at its end, not moved. A null or non-positive end keeps all."""
    active = F.coalesce(prompt_end > 0, F.lit(False))
    kept = notes.where(~active | (F.col("t1") > prompt_end))
    return kept.withColumn("t0", F.when(active, F.greatest("t0", prompt_end)).otherwise(F.col("t0")))


def renamed(tracks: DataFrame, old: str, new: str, contains: bool = False) -> DataFrame:
    """Tracks of that name (any case, trimmed; or containing it) under the new one."""
    own = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    hit = own.contains(old.strip().lower()) if contains else own == old.strip().lower()
    return tracks.withColumn("name", F.when(hit, new).otherwise(F.col("name")))
