"""Fill-in-middle transformation over run-length classes of characters.

A text is stored as its maximal runs of one character class (white space or not), each with the code points and the units
before it. A cut after k units is found by binary search over the cumulative units: it gives the run, and the offset inside
the run follows by arithmetic, as a run's units are of one size. Units are `tokens` (white space with the word after it, or
white space at a text's end: a run of other characters is one unit, white space before it none) or `characters` (a run of n
code points is n units). All texts of a batch lie in one array of runs, so all cuts are one search.

Where a document is cut, whether it is transformed and in which order depend on a seed and its id alone: the first four
groups of eight hexadecimal digits of sha256(`<seed>:<id>`). Prefix, suffix and middle are marked; a text that holds a mark,
an empty one and those not chosen stay plain, so restore() gives every text back.

Nulls: a null text is an empty one, a null id hashes as an empty one. Repeated rows are transformed alike, ties of both cuts
leave the middle empty, texts of any length are whole, and nothing is shuffled. Columns that are kept may have any names
but those that are added, which replace them. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import appended, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Documents of a hundred that are transformed, and of these the ones with the suffix first.
SHARE, SUFFIX_FIRST = 50, 80
UNITS = ("tokens", "characters")


class Runs:
    """The runs of all texts: where each begins in bytes and code points, and the units before it; bounds by text."""

    def __init__(self, texts: pa.Array, unit: str = "tokens"):
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.ends = ends - ends[0]
        blank = (self.data == 0x20) | (self.data >= 0x09) & (self.data <= 0x0D)
        starts = (self.data & 0xC0) != 0x80
        begins = np.zeros(len(self.data), bool)
        begins[1:] = blank[1:] != blank[:-1]
        begins[self.ends[:-1][np.diff(self.ends) > 0]] = True
        self.at = np.flatnonzero(begins)
        self.first = np.searchsorted(self.at, self.ends)  # run of each text
        self.width = np.diff(np.append(self.at, len(self.data)))  # bytes
        self.size = np.add.reduceat(starts, self.at, dtype=np.int64) if len(self.at) else np.zeros(0, np.int64)  # code points
        if unit == "characters":
            self.units = self.size
        else:
            last = np.zeros(len(self.at), bool)
            last[self.first[1:][np.diff(self.first) > 0] - 1] = True
            self.units = (~blank[self.at] | last).astype(np.int64)
        self.points = np.concatenate([[0], np.cumsum(self.size)])
        self.before = np.concatenate([[0], np.cumsum(self.units)])
        self.starts = starts
        self.n = np.diff(self.before[self.first])

    def cut(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes (from the batch's first) and code points (from the text's) before the cut after k units of each text."""
        wanted = self.before[self.first[:-1]] + k
        run = np.searchsorted(self.before, wanted, side="left") - 1  # the run that holds the unit before the cut
        some = k > 0
        inside = np.zeros(len(k), np.int64)
        r = run[some]
        inside[some] = (wanted[some] - self.before[r]) * (self.size[r] // self.units[r])
        points = np.where(some, self.points[run] + inside - self.points[self.first[:-1]], 0)
        return self.byte_of(points), points

    def byte_of(self, points: np.ndarray) -> np.ndarray:
        """Bytes before so many code points of each text: of the run that holds them, and of the rest inside it."""
        wanted = self.points[self.first[:-1]] + points
        run = np.searchsorted(self.points, wanted, side="right") - 1
        at = np.append(self.at, len(self.data))[run]
        rest = wanted - self.points[run]
        narrow = np.append(self.width == self.size, True)[run]
        at = at + rest
        for k in np.flatnonzero(~narrow & (rest > 0)):  # a run with wide characters: its code points' places
            begin = self.at[run[k]]
            at[k] = begin + (np.flatnonzero(self.starts[begin : begin + self.width[run[k]]])[rest[k]] if rest[k] < self.size[run[k]] else self.width[run[k]])
        return at


def draws(seed: int, keys: list) -> np.ndarray:
    """Four numbers of 32 bits for each id."""
    hashes = [hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).digest()[:16] for k in keys]
    return np.frombuffer(b"".join(hashes), ">u4").reshape(len(keys), 4).astype(np.int64)


def transform(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", unit: str = "tokens", seed: int = SEED, share: int = SHARE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """The columns `keep` and n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    if unit not in UNITS:
        raise ValueError(f"the unit must be one of {UNITS}")
    if any(x in y for x in marks for y in marks if x is not y) or not all(marks):
        raise ValueError("no mark may be empty or hold another")
    p, s, m = (x.encode() for x in marks)

    def make() -> Callable[[pa.Array, pa.RecordBatch], list[pa.Array]]:
        def one(texts: pa.Array, rows: pa.RecordBatch) -> list[pa.Array]:
            texts = texts.cast(pa.large_string()).fill_null("")
            runs, h = Runs(texts, unit), draws(seed, rows.column("_key").to_pylist())
            a, b = h[:, 0] % (runs.n + 1), h[:, 1] % (runs.n + 1)
            (one_byte, one_point), (two_byte, two_point) = runs.cut(np.minimum(a, b)), runs.cut(np.maximum(a, b))
            marked = np.zeros(len(texts), bool)
            for mark in marks:
                marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
            plain = marked | (np.diff(runs.ends) == 0) | (h[:, 2] % 100 >= share)
            first = h[:, 3] % 100 < suffix_first
            data, out = memoryview(runs.data), []
            for k in range(len(texts)):
                begin, end = runs.ends[k], runs.ends[k + 1]
                if plain[k]:
                    out.append(bytes(data[begin:end]))
                    continue
                prefix, middle, suffix = data[begin : one_byte[k]], data[one_byte[k] : two_byte[k]], data[two_byte[k] : end]
                out.append(b"".join((s, suffix, p, prefix, m, middle) if first[k] else (p, prefix, s, suffix, m, middle)))
            form = np.where(plain, "plain", np.where(first, "spm", "psm"))
            return [pa.array(runs.n), pa.array(form.tolist(), pa.string()), pa.array(one_point, mask=plain), pa.array(two_point - one_point, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]

        return one

    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "_key"], F.col(f"`{key}`").cast("string").alias("_key"))
    added = "n long, form string, prefix_chars long, middle_chars long, output string"
    return appended(keyed, [*keep, "_key"], text, make, added).drop("_key")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that output was made of; a transformed one holds each mark once."""
    p, s, m = marks
    after = lambda c, mark: F.substring_index(c, mark, -1)
    before = lambda c, mark: F.substring_index(c, mark, 1)
    psm = F.concat(after(before(output, s), p), after(output, m), after(before(output, m), s))
    spm = F.concat(after(before(output, m), p), after(output, m), after(before(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(found: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(transform(table(spark, sf_dir, "documents"), ["doc_id"]))


QUERIES = {"op11_infilling": op11_infilling}

SQL = {
    "op11_infilling": f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS tokens
  FROM documents),
drawn AS (
  SELECT *, len(tokens) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(tokens) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(tokens) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= {SHARE} THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
cut AS (
  SELECT *, coalesce(array_to_string(tokens[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(tokens[least(a, b) + 1:greatest(a, b)], ''), '') AS m, coalesce(array_to_string(tokens[greatest(a, b) + 1:], ''), '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut""",
}
