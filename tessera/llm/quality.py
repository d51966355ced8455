"""Quality rules: base rules in a text, and cross-document line frequency per host.

Each text gives its base counts and the hashes of its normalised lines (lower-cased A-Z, digits as 0, white space
dropped between words). Lines are counted over distinct texts of a host, so exact copies of a page don't make their own
lines frequent. A line in more texts than the host's limit (the larger of MIN_TEXTS and SHARE of its texts) is removed,
and a document that loses more than DEPLETED of its words is rejected. The removed lines come out by number; where the
text is kept, it also comes out without them.

The limit is absolute for large hosts: a line of MOST_TEXTS different texts is boilerplate however large the host. Small
hosts have a lower one, SHARE of their texts, but MIN_TEXTS at least.

Counting pre-aggregates in each task, so a hot host or line is one row from each task. Frequent lines are joined by
broadcast below a checked size, else by a shuffled join that AQE splits where skewed. Hashes and counts are written to
the shared folder once, texts never.

Nulls: a null text has no words and fails; a null host is a host of its own. Empty texts likewise have no words; texts
of any length are whole. Ties: a line at the limit stays, and a text that loses just DEPLETED of its words. Repeated rows
are rows of their own but count once for their lines. Empty tables give empty results. Columns in `keep` whose names are
those of added columns, or _row and _host, are left out of the result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.shared import appended, small_side, table, written

MIN_WORDS = 50
#: A host's limit of texts with a line: SHARE of its texts, but MIN_TEXTS at least and MOST_TEXTS at most.
MIN_TEXTS = 10
SHARE = 0.02
MOST_TEXTS = 1000
DEPLETED = 0.5
#: Frequent lines up to which tasks look them up by themselves; of more, a join finds those of each text.
FEW = 500_000

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
NORMAL = W.LOWER.copy()
NORMAL[0x30:0x3A] = 0x30

ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, lines array<long>, line_words array<long>, line_numbers array<long>"

CLEANED = ADDED[: ADDED.index(", text_hash")] + ", removed_lines array<long>, removed_words long, clean_text string"


def repeats(keys: np.ndarray) -> np.ndarray:
    """True where a value occurs at least twice."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))


def measured(texts: pa.Array, _rows=None) -> list[pa.Array]:
    data, offsets = W.buffers(texts)
    starts, ends, before = W.spans(data, offsets, W.SPACED)
    n = len(texts)
    sizes = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sizes[1:])
    word_chars = W.sums_by(sizes[ends] - sizes[starts], before)
    symbols = W.sums_by(SYMBOL[data].astype(np.int64), offsets)

    hashes = W.span_hashes(data, starts, ends)
    place = W.within(before, 3)
    owner = np.searchsorted(before, place, "right").astype(W.U)
    window = W.windows(hashes, 3)[place] if len(place) else np.zeros(0, W.U)
    twice = place[repeats(W.mix(window + owner * W.STEP))]
    cover = np.zeros(len(starts) + 3, bool)
    for k in range(3):
        cover[twice + k] = True
    n_repeat = W.sums_by(cover[: len(starts)].astype(np.int64), before)

    # lines: cut at \n, without lines across texts
    line_start, line_end, line_before = W.spans(data, offsets, np.arange(256) != 0x0A)  # an empty line has no word
    first, last = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    real = last > first
    line_owner = W.owners(line_before)[real]
    raw = W.span_hashes(data, line_start[real], line_end[real])
    first, last = first[real], last[real]
    key = W.mix(raw + line_owner.astype(W.U) * W.STEP)
    _, seen = np.unique(key, return_index=True)
    again = np.ones(len(key), np.int64)
    again[seen] = 0
    edges = np.searchsorted(line_owner, np.arange(n + 1))
    n_dup = W.sums_by(again, edges)

    nth = np.arange(len(starts)) - np.repeat(first, last - first) if len(first) else np.zeros(0, np.int64)
    word = W.span_hashes(data, starts, ends, NORMAL) * W.mix(nth.astype(W.U) + W.U(1))
    line = W.mix(W.sums_by(word, np.concatenate([first, [len(starts)]]))) if len(first) else np.zeros(0, W.U)
    nth_word = first - before[line_owner]
    text_hash = W.mix(W.sums_by(W.mix(raw) * W.mix(nth_word.astype(W.U) + W.U(1)), edges))
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0x0A, out=breaks[1:])
    number = breaks[line_start[real]] - breaks[offsets[line_owner]]
    return [
        pa.array(np.diff(before)), pa.array(word_chars), pa.array(symbols), pa.array(n_dup), pa.array(n_repeat),
        pa.array(text_hash.view(np.int64)), lists(line.view(np.int64), edges), lists(last - first, edges), lists(number, edges),
    ]


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return appended(docs, keep, text, lambda: measured, ADDED)


def frequent_lines(rows: DataFrame, host: str, min_texts: int, share: float, most_texts: int) -> DataFrame:
    """(host, line) of the lines in more distinct texts of the host than its limit."""
    texts = rows.groupBy(host, "text_hash").agg(F.first("lines").alias("lines"))
    counts = texts.select(host, F.explode(F.array_distinct("lines")).alias("line")).groupBy(host, "line").agg(F.count(F.lit(1)).alias("texts"))
    counts = counts.where(F.col("texts") > min_texts)
    limits = texts.groupBy(host).agg(F.least(F.greatest(F.lit(min_texts), F.count(F.lit(1)) * share), F.lit(most_texts)).alias("limit"))
    same = counts[host].eqNullSafe(limits[host])
    return counts.join(limits, same).where("texts > limit").select(counts[host], "line")


def without_lines(texts: pa.Array, rows: pa.RecordBatch) -> list[pa.Array]:
    """The texts without the lines whose numbers are in removed_lines."""
    out = texts.to_pylist()
    for k, removed in enumerate(rows.column("removed_lines").to_pylist()):
        if removed:
            gone = set(removed)
            out[k] = "\n".join(line for n, line in enumerate(out[k].split("\n")) if n not in gone)
    return [pa.array(out, pa.string())]


def cleaned(often: dict[str | None, np.ndarray]):
    """The base counts of texts, and their lines that are frequent in their host (_host)."""
    none = np.zeros(0, np.int64)

    def one(texts: pa.Array, rows: pa.RecordBatch) -> list[pa.Array]:
        *counts, _, lines, words, numbers = measured(texts)
        edges = lines.offsets.to_numpy()
        line, n_of, number = (x.values.to_numpy() for x in (lines, words, numbers))
        removed, lost = [], []
        for k, host in enumerate(rows.column("_host").to_pylist()):
            own = slice(edges[k], edges[k + 1])
            hit = np.isin(line[own], often[host]) if host in often else None
            removed.append(none if hit is None else number[own][hit])
            lost.append(0 if hit is None else int(n_of[own][hit].sum()))
        gone = pa.array(removed, pa.list_(pa.int64()))
        text = without_lines(texts, pa.RecordBatch.from_arrays([gone], ["removed_lines"]))
        return [*counts, gone, pa.array(lost, pa.int64()), *text]

    return one


def judge(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text", min_words: int = MIN_WORDS, min_texts: int = MIN_TEXTS, share: float = SHARE, most_texts: int = MOST_TEXTS, depleted: float = DEPLETED) -> DataFrame:
    """keep, with the base counts, removed_lines (numbers, from 0, of the text's frequent lines), removed_words, base_failed and kept; with the text in keep also clean_text, the text without them."""
    keep = [c for c in keep if c not in ("_row", "_host", "base_failed", "kept", "removed_lines", "removed_words", "clean_text")]
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = ~F.col("base_failed") & (F.col("removed_words") <= depleted * F.col("n_words"))
    docs = docs.withColumn("_host", F.col(host))
    if text in keep:  # texts are neither written nor shuffled where the frequent lines are few: a second reading removes them
        often = written(frequent_lines(written(measure(docs, ["_host"], text), "quality"), "_host", min_texts, share, most_texts), "lines")
        few = often.limit(FEW + 1).collect()
        if len(few) <= FEW:
            own: dict[str | None, list[int]] = {}
            for r in few:
                own.setdefault(r[0], []).append(r[1])
            held = {h: np.array(x, np.int64) for h, x in own.items()}
            out = appended(docs, [*keep, "_host"], text, lambda: cleaned(held), CLEANED).drop("_host")
            return out.withColumn("base_failed", failed).withColumn("kept", passed)
    rows = measure(docs, [*keep, "_host"], text).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "quality")
    often = written(frequent_lines(rows, "_host", min_texts, share, most_texts), "lines")
    lines = rows.select("_row", F.col("_host").alias("h"), F.explode(F.arrays_zip("lines", "line_words", "line_numbers")).alias("l")).select("_row", "h", F.col("l.lines").alias("l"), F.col("l.line_words").alias("n"), F.col("l.line_numbers").alias("k"))
    often = small_side(often, 64)
    lost = lines.join(often, lines.h.eqNullSafe(often._host) & (lines.l == often.line)).groupBy("_row").agg(F.sum("n").alias("removed_words"), F.sort_array(F.collect_list("k")).alias("removed_lines"))
    out = rows.drop("lines", "line_words", "line_numbers", "text_hash", "_host").join(lost, "_row", "left").drop("_row")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")).withColumn("base_failed", failed)
    out = out.withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<long>")))
    out = out.withColumn("kept", passed)
    return appended(out, out.columns, text, lambda: without_lines, "clean_text string") if text in keep else out


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op9_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), ["doc_id", "text"]).select("doc_id", "kept", "removed_lines", "clean_text")


QUERIES = {"op9_line_frequency": op9_line_frequency, "op9_clean_text": op9_clean_text}

SQL: dict[str, str] = {
    "op9_line_frequency": rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT id, k, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) > 2)),
rep AS (SELECT id, count(DISTINCT k) AS n FROM (SELECT id, unnest(range(k, k + 3)) AS k FROM win WHERE true QUALIFY count(*) OVER (PARTITION BY id, g) > 1) GROUP BY 1),
l AS (SELECT id, source, array_to_string(lines, chr(10)) AS body, unnest(lines) AS line FROM d),
n AS (SELECT id, source, body, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[^\x20\x09-\x0D]+'), ' ') AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
hosts AS (SELECT source, least(greatest({MIN_TEXTS}, count(DISTINCT array_to_string(lines, chr(10))) * {SHARE}::DOUBLE), {MOST_TEXTS}) AS most FROM d GROUP BY 1),
often AS (SELECT n.source, line FROM n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source GROUP BY n.source, line, most HAVING count(DISTINCT body) > most),
lost AS (SELECT id, sum(words)::BIGINT AS removed FROM n JOIN often o ON n.source IS NOT DISTINCT FROM o.source AND n.line = o.line GROUP BY 1),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(removed, 0) AS removed_words FROM d LEFT JOIN rep USING (id) LEFT JOIN lost USING (id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= {DEPLETED}::DOUBLE * n_words AS kept FROM b"""
}
