"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of the code splits the languages in two, and a binary classifier over letter
3-grams tells its side. Up to EXHAUSTIVE languages the code has every split once, beyond that well-separated random
words. Each classifier is naive Bayes with languages weighted equally on either side; as its counts are sums of the
languages' counts, all bits are trained by one pass over ALL training texts that sums a table of fixed size
(languages x BINS) in every task. A text gets the codeword with the least loss, ln(1 + exp(-bit x margin)) summed with
each bit's weight, its share of separated pairs. The best language's softmax share is the score; a small lead over the
second is flagged as ambiguous.

Nulls: a null or empty text, or one without a letter, is `und` with score 0; rows without a language don't train. Texts
of any length are whole. Without any training row everything is `und`. Repeated rows are rows of their own. Empty tables
give empty results; columns that clash with the added ones are replaced, others are not read. Ties go to the language that
sorts first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.shared import appended, slices, table

BINS = 1 << 13
EXHAUSTIVE = 5
#: Pseudo-count of each bin; grams a text needs for full margin; the lead below which a prediction is ambiguous.
SMOOTH = 0.5
SCALE = 12.0
LEAD = 0.5
#: Share of the best language below which a pipeline turns a text away, besides `und`.
REJECT = 0.35

LETTER = np.full(256, 0x20, np.uint8)
LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTER[0x80:] = np.arange(0x80, 0x100)

ADDED = "lang_pred string, score double, ambiguous boolean"


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1."""
    if n <= 1:
        return np.ones((n, 1), int)
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 1 << (n - 1))
        return np.array([[1 if r and b >> (r - 1) & 1 else -1 for b in bits] for r in range(n)])
    rng, best, apart = np.random.default_rng(0), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        if (least := min((code[a] != code[b]).sum() for a in range(n) for b in range(a))) > apart:
            best, apart = code, least
    return best


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 3-gram bins and the grams of each text. Runs of other bytes than letters count as one blank."""
    data, offsets = W.buffers(texts)
    data = LETTER[data]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    data, owner = data[keep].astype(np.uint32), owner[keep]
    same = owner[2:] == owner[:-2]
    code = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:])[same] * np.uint32(2654435761)
    bins = (code >> np.uint32(32 - BINS.bit_length() + 1)).astype(np.int64)
    owner = owner[2:][same]
    counts = np.bincount(owner * BINS + bins, minlength=len(texts) * BINS).reshape(len(texts), BINS)
    return counts, np.bincount(owner, minlength=len(texts))


def in_parts(texts: pa.Array, rows: int = 128) -> Iterator[pa.Array]:
    for k in range(0, len(texts), rows):
        yield texts.slice(k, rows)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language of a task, its counts over all rows, as bytes."""
    total: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text"):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for k, part in enumerate(in_parts(batch.column("text"))):
            counts, own = grams(part)[0], langs[k * 128 : (k + 1) * 128]
            for lang in set(own):
                total[lang] = total.get(lang, 0) + counts[own == lang].sum(axis=0)
    names = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x].astype(np.int64).tolist() for x in names], pa.list_(pa.int64()))], ["lang", "counts"])


def class_counts(rows: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Gram counts of each language over all rows; tasks send one table of fixed size, added up by language and bin."""
    have = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sums = have.mapInArrow(summed, "lang string, counts array<long>").select("lang", F.posexplode("counts").alias("bin", "n"))
    by_lang = sums.groupBy("lang", "bin").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("c"))
    got = sorted((r.lang, [x.n for x in r.c]) for r in by_lang.collect())  # languages x BINS numbers
    return [x for x, _ in got], np.array([c for _, c in got], float).reshape(len(got), BINS)


class Code:
    """Codewords of the languages and the weights of each bit's classifier."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.words = langs, codewords(len(langs))
        share = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True) if len(langs) else counts
        sides = [(share[bit > 0].mean(axis=0), share[bit < 0].mean(axis=0)) for bit in self.words.T] if len(langs) > 1 else []
        self.weights = np.array([np.log(a) - np.log(b) for a, b in sides]).reshape(-1, BINS)
        apart = np.array([(bit > 0).sum() * (bit < 0).sum() for bit in self.words.T], float) if sides else np.ones(0)
        self.bit_weights = apart / apart.sum() * len(apart) if len(apart) else apart

    def decide(self, counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword of each row, its share, and whether the lead is small."""
        if len(self.langs) < 2:
            one = np.ones(len(n))
            return np.zeros(len(n), int), one, one < 0
        margins = SCALE * (counts @ self.weights.T) / np.maximum(n, 1)[:, None]
        loss = np.logaddexp(0, -margins[:, None, :] * self.words[None]) @ self.bit_weights
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        two = np.sort(loss, axis=1)[:, :2]
        return loss.argmin(axis=1), share.max(axis=1), two[:, 1] - two[:, 0] < LEAD


def lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets = W.buffers(texts)
    ascii_letter = (LETTER[data] != 0x20) & (data < 0x80)
    has = W.sums_by(ascii_letter.astype(np.int64), offsets) > 0
    for k in np.flatnonzero(~has):
        has[k] = any(map(str.isalpha, texts[int(k)].as_py() or ""))
    return has


def predictor(code: Code) -> Callable:
    def predict(texts: pa.Array, _rows=None) -> list[pa.Array]:
        names, scores, doubts = [], [], []
        for part in in_parts(texts):
            counts, n = grams(part)
            which, share, doubt = code.decide(counts.astype(float), n)
            known = lettered(part) & bool(code.langs)
            names += [code.langs[w] if k else "und" for w, k in zip(which, known)]
            scores += np.where(known, share, 0.0).tolist()
            doubts += (doubt | ~known).tolist()
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())]

    return predict


def train(rows: DataFrame, lang: str = "lang", text: str = "text") -> Code:
    return Code(*class_counts(rows, lang, text))


def identify(docs: DataFrame, code: Code, keep: list[str], text: str = "text") -> DataFrame:
    """keep, with lang_pred, score and ambiguous."""
    return appended(docs, keep, text, lambda: predictor(code), ADDED)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def op4_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    code = train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = identify(docs, code, ["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op4_ecoc_language": op4_ecoc_language}
SQL: dict[str, str] = {}
