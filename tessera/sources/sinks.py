"""Writers of results: JSON payloads, CSV tables, printed summaries. One folder of part files each, as Spark writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import file_name, fixed


#: Pieces up to which a run's details also stand in one JSON text with its summary, for other readers: files.details() reads
#: the lines, which hold the pieces of runs of any size.
MOST_PIECES = 10_000


def json_payload(details: DataFrame, summary: DataFrame, path: str, most: int = MOST_PIECES) -> None:
    """A run's result below path: result, one JSON text {meta, summary, details}, and details, a JSON line a piece.

    With more pieces than `most` the text goes without details. Lines are compressed, so that who looks for JSON texts
    doesn't take them for some."""
    details.write.mode("overwrite").option("compression", "gzip").json(f"{path}/details")
    held = details.sparkSession.read.schema(details.schema).json(f"{path}/details")
    n = held.count()
    meta = F.struct(F.lit(n).alias("pairs")).alias("meta")
    one = summary.select(F.struct("*").alias("summary"))
    if n <= most:
        one = one.crossJoin(F.broadcast(held.agg(F.collect_list(F.struct("*")).alias("details"))))
    one.select(F.to_json(F.struct(meta, *one.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/result")


def json_by_name(rows: DataFrame, name: str, path: str) -> None:
    """A folder <name>.json for each row, with the other columns as one JSON text. Rows are runs, so folders are few."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c != name])).alias("value")
    rows.select(F.concat(file_name(F.col(name)), F.lit(".json")).alias("file"), body).write.mode("overwrite").partitionBy("file").text(path)


def json_by_run(details: DataFrame, summary: DataFrame, run: str, path: str) -> None:
    """The results of many runs below path: results, a folder <run>.json of one text {meta, summary} each, and details, a
    folder <run>.json of lines each. Each of both is one write, however many runs there are."""
    file = F.concat(F.col(run), F.lit(".json")).alias("file")
    details.select(file, *[c for c in details.columns if c != run]).write.mode("overwrite").option("compression", "gzip").partitionBy("file").json(f"{path}/details")
    pairs = details.groupBy(run).agg(F.struct(F.count(F.lit(1)).alias("pairs")).alias("meta"))
    body = F.to_json(F.struct("meta", F.struct(*[c for c in summary.columns if c != run]).alias("summary"))).alias("value")
    summary.join(pairs, run).select(file, body).write.mode("overwrite").partitionBy("file").text(f"{path}/results")


def json_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def csv(rows: DataFrame, path: str, digits: int | None = None) -> None:
    """With a header, '' for null, and so many decimals of doubles if told; nested columns as JSON texts."""
    out = []
    for name, kind in rows.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double" and digits is not None:
            c = F.when(c.isNotNull() & ~F.isnan(c), F.format_string(f"%.{digits}f", c))
        elif kind.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        out.append(c.alias(name))
    rows.select(*out).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def by_run(rows: DataFrame, run: str, path: str) -> None:
    """One folder for each run, under a name fit for files."""
    rows.withColumn("run_file", file_name(F.col(run))).write.mode("overwrite").partitionBy("run_file").option("header", True).csv(path)


def labelled_block(label: str, value: Column, kind, indent: int = 2) -> Column:
    """A summary's part as printed: a number, five numbers with their count, or parts of these; n/a for null."""
    from pyspark.sql import types as T

    pad = " " * indent
    if not isinstance(kind, T.StructType):
        return F.concat(F.lit(f"{pad}{label}: "), fixed(value) if isinstance(kind, T.DoubleType) else F.coalesce(value.cast("string"), F.lit("n/a")))
    if {"mean", "min", "q1", "median", "q3", "max"} <= set(kind.names):
        parts = [F.concat(F.lit(f"{pad}  count: "), value["count"].cast("string")), *[F.concat(F.lit(f"{pad}  {k}: "), fixed(value[k])) for k in ("mean", "min", "q1", "median", "q3", "max")]]
    else:
        parts = [labelled_block(f.name.replace("_", " "), value[f.name], f.dataType, indent + 2) for f in kind.fields]
    return F.when(value.isNull(), F.lit(f"{pad}{label}: n/a")).otherwise(F.concat_ws("\n", F.lit(f"{pad}{label}:"), *parts))


#: Fixed headings of a printed run, and the labels of its parts.
PRINTED = {
    "accompaniment_vs_groundtruth": ("Accompaniment vs Ground Truth:", {
        "pitch_jsd": "Pitch JSD", "onset_jsd": "Onset JSD", "duration_jsd": "Duration JSD", "frechet_music_distance": "Frechet Music Distance", "prompt_polydis": "PolyDis (prompt)",
        "prompt_generated_continuation_polydis": "PolyDis (prompt vs generated continuation)", "prompt_groundtruth_continuation_polydis": "PolyDis (prompt vs ground truth continuation)",
    }),
    "inter_track_continuity": ("Accompaniment Inter-Track Continuity:", {"validation_pairs": "Validation", "auto_phrase_pairs": "Auto phrase (gen vs gt)"}),
    "melody_relationship": ("Accompaniment ↔ Melody:", {"harmonicity": "Harmonicity", "chord_accuracy": "Chord Accuracy"}),
}


def printed_summary(summary: DataFrame, pairs: int | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, value: a run's summary as printed, one text."""
    kinds = {f.name: f.dataType for f in summary.schema.fields}
    texts = [F.concat(F.lit("Pairs evaluated: "), (pairs if isinstance(pairs, Column) else F.lit(pairs)).cast("string"))]
    for k, (group, (heading, labels)) in enumerate(PRINTED.items()):
        texts += [F.lit("")] * (k > 0) + [F.lit(heading)] + [labelled_block(label, F.col(f"{group}.{part}"), kinds[group][part].dataType) for part, label in labels.items()]
    return summary.select(*keys, F.concat_ws("\n", *texts).alias("value"))


def summary_text(rows: DataFrame, title: str) -> DataFrame:
    """name, block: five-number summaries as printed, four decimals and n/a."""
    entries = [F.concat(F.lit(f"    {k}: "), fixed(F.col(k))) for k in ("mean", "min", "q1", "median", "q3", "max")]
    count = F.concat(F.lit("    count: "), F.coalesce(F.col("count").cast("string"), F.lit("n/a")))
    return rows.select(F.col(title).alias("name"), F.concat_ws("\n", F.concat(F.lit("  "), F.col(title), F.lit(":")), *entries, count).alias("block"))
