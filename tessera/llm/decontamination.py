"""Benchmark decontamination by Wu-Manber search over words.

A symbol is a word (its 64-bit hash). Items give windows of `size` words, shorter items one window of their own
length; each window length is one pattern set. For a set of length m with blocks of B words:

* SHIFT, a hashed table over blocks, has how far a window may move when its last block is this one: m - B + 1 for
  blocks in no pattern, so that most words are never looked at again;
* at shift 0 the block's hash picks the bucket of patterns that end with it;
* the bucket's patterns are compared word by word, and at last byte by byte.

Cursors of many stretches of text advance together, so the search runs in numpy. Long texts are cut into overlapping
stretches; nothing is left out. The items are the stated query set: they go to every task, in parts of at most PART_BYTES
(by a hash of the item). Each part is a scan of its own, which adds to the hits of those before it: between two, the
documents are written with what is found so far, so neither the driver nor a task ever holds more than one part, however
many items there are. With one part, as most sets of items are, documents are only scanned once. Nothing is shuffled.

Nulls: a null text has no words and no hits; a null item text has no windows; a null item id stands as ''. Empty texts
have no words. Texts of any length are whole. An empty table on either side gives an empty result, or no hits. Repeated
rows are rows of their own; repeated items are fine: ids count once. Ties don't arise: all occurrences count. Columns in
`keep` whose names are those of added columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.shared import appended, drop_written, table, written

SIZE = 10
#: Bytes of items that one scan looks for; their windows take some fifty times as much on the driver.
PART_BYTES = 4 << 20
#: Window places in a stretch that one cursor goes through.
STRETCH = 256

ADDED = "n_words long, n_hit long, hits array<struct<start: long, end: long>>, items array<string>"


@dataclass
class Patterns:
    """Windows of one length, with their tables."""

    length: int
    block: int
    words: np.ndarray  # a row of word hashes for each pattern, sorted by the hash of the last block
    suffixes: np.ndarray
    shift: np.ndarray
    raw: list[bytes] = field(default_factory=list)
    items: list[list[str]] = field(default_factory=list)


def block_hash(hashes: np.ndarray, last: np.ndarray, block: int) -> np.ndarray:
    """Hash of the block that ends with the word at `last`."""
    out = hashes[last - (block - 1)]
    for k in range(block - 2, -1, -1):
        out = out * W.STEP + hashes[last - k]
    return W.mix(out)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, words before each text, word hashes."""
    data, offsets = W.buffers(texts)
    data = W.LOWER[data]
    starts, ends, before = W.spans(data, offsets, W.ALNUM)
    return data, starts, ends, before, W.span_hashes(data, starts, ends)


def compiled(items: list[tuple[str, str]], size: int = SIZE) -> list[Patterns]:
    """The pattern sets of items (id, text), one for each window length."""
    if not items:
        return []
    data, starts, ends, before, hashes = tokens(pa.array([t for _, t in items], pa.large_string()))
    found: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = {}
    for k, (name, _) in enumerate(items):
        n = int(before[k + 1] - before[k])
        m = min(n, size)
        for at in range(before[k], before[k + 1] - m + 1) if m else ():
            raw = b" ".join(data[s:e].tobytes() for s, e in zip(starts[at : at + m], ends[at : at + m]))
            found.setdefault(m, {}).setdefault(raw, (hashes[at : at + m], set()))[1].add(name)
    out = []
    for m, by_raw in sorted(found.items()):
        block = min(2, m)
        rows = np.stack([h for h, _ in by_raw.values()])
        flat, n = rows.reshape(-1), len(rows)
        suffix = block_hash(flat, np.arange(n) * m + m - 1, block)
        order = np.argsort(suffix, kind="stable")
        bits = max(12, int(n * m).bit_length() + 2)
        shift = np.full(1 << bits, m - block + 1, np.int64)
        for end in range(block, m + 1):
            slots = (block_hash(flat, np.arange(n) * m + end - 1, block) & W.U((1 << bits) - 1)).astype(np.int64)
            np.minimum.at(shift, slots, m - end)
        raws, names = list(by_raw), [sorted(s) for _, s in by_raw.values()]
        out.append(Patterns(m, block, rows[order], suffix[order], shift, [raws[k] for k in order], [names[k] for k in order]))
    return out


def occurrences(p: Patterns, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and pattern of every occurrence in the texts."""
    m = p.length
    places = np.maximum(np.diff(before) - m + 1, 0)
    pieces = -(-places // STRETCH)
    owner = np.repeat(np.arange(len(places)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = before[owner] + nth * STRETCH
    stop = np.minimum(at + STRETCH, before[owner] + places[owner])
    mask, hits, hit_hash = W.U(len(p.shift) - 1), [], []
    while len(at):
        h = block_hash(hashes, at + m - 1, p.block)
        move = p.shift[(h & mask).astype(np.int64)]
        zero = move == 0
        hits.append(at[zero])
        hit_hash.append(h[zero])
        at = at + np.maximum(move, 1)
        go = at < stop
        at, stop = at[go], stop[go]
    pos, h = np.concatenate([*hits, np.zeros(0, np.int64)]), np.concatenate([*hit_hash, np.zeros(0, W.U)])
    low, high = np.searchsorted(p.suffixes, h, "left"), np.searchsorted(p.suffixes, h, "right")
    n = high - low
    pos, pattern = np.repeat(pos, n), np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    for k in range(m):
        same = hashes[pos + k] == p.words[pattern, k]
        pos, pattern = pos[same], pattern[same]
    real = [b" ".join(data[s:e].tobytes() for s, e in zip(starts[a : a + m], ends[a : a + m])) == p.raw[k] for a, k in zip(pos.tolist(), pattern.tolist())]
    real = np.array(real, bool)
    return pos[real], pattern[real]


def finder(sets: list[Patterns], more: bool = False) -> Callable:
    """more: the rows have hits and items from a scan for other items, which are added to."""

    def find(texts: pa.Array, rows: pa.RecordBatch | None = None) -> list[pa.Array]:
        data, starts, ends, before, hashes = tokens(texts)
        n = len(texts)
        edge = np.zeros(len(starts) + 1, np.int64)
        names: list[set[str]] = [set() for _ in range(n)]
        if more:
            for doc, (spans, items) in enumerate(zip(rows.column("_hits").to_pylist(), rows.column("_items").to_pylist())):
                names[doc].update(items)
                for x in spans:
                    edge[before[doc] + x["start"]] += 1
                    edge[before[doc] + x["end"]] -= 1
        for p in sets:
            pos, pattern = occurrences(p, data, starts, ends, before, hashes)
            np.add.at(edge, pos, 1)
            np.add.at(edge, pos + p.length, -1)
            pairs = np.unique(np.stack([np.searchsorted(before, pos, "right") - 1, pattern]), axis=1)
            for doc, k in pairs.T.tolist():
                names[doc].update(p.items[k])
        hit = np.cumsum(edge[:-1]) > 0
        n_hit = W.sums_by(hit.astype(np.int64), before)
        spans: list[list[dict]] = [[] for _ in range(n)]
        for doc in np.flatnonzero(n_hit).tolist():
            own = np.concatenate([[False], hit[before[doc] : before[doc + 1]], [False]])
            turns = np.flatnonzero(own[1:] != own[:-1]).tolist()
            spans[doc] = [{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2])]
        return [
            pa.array(np.diff(before)), pa.array(n_hit),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            pa.array([sorted(s) for s in names], pa.list_(pa.string())),
        ]

    return find


def scan(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """keep, with n_words, n_hit (words inside an occurrence), hits (their spans by word, merged) and items (ids found)."""
    stated = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("t")).where("t is not null")
    parts = max(1, -(-int(stated.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0) // PART_BYTES))
    keep = [c for c in keep if c not in ("n_words", "n_hit", "hits", "items", "_hits", "_items")]
    held = [f"_{k}" for k in range(len(keep))]  # names that any file can have
    out = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(keep, held)], F.col(f"`{text}`").alias("_t"))
    for k in range(parts):
        part = stated.where(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == k).distinct().sort("id", "t").collect()  # PART_BYTES, about
        sets = compiled([tuple(r) for r in part], size)
        if k:
            own = written(out, "hits")
            if k > 1:
                drop_written(earlier)
            earlier, out = own, own.drop("n_words", "n_hit").withColumnsRenamed({"hits": "_hits", "items": "_items"})
        last = k == parts - 1
        out = appended(out, [*held, *([] if last else ["_t"]), *(["_hits", "_items"] if k else [])], "_t", lambda sets=sets, k=k: finder(sets, k > 0), ADDED)
        out = out.drop("_hits", "_items")
    return out.select(*[F.col(h).alias(c) for c, h in zip(keep, held)], "n_words", "n_hit", "hits", "items")


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    names = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op7_wu_manber": op7_wu_manber}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL: dict[str, str] = {
    "op7_wu_manber": f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, m, array_to_string(w[k:k + m - 1], ' ') AS win FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT id, k, m, array_to_string(w[k:k + m - 1], ' ') AS win FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hit AS (SELECT id, k, m, item FROM dw JOIN iw USING (m, win)),
words AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(k, k + m)) AS k FROM hit) GROUP BY 1),
found AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (id) LEFT JOIN found USING (id)"""
}
