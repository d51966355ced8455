"""Language-model scores by stupid backoff, from n-gram counts over the whole corpus.

Every document is scored by all others: its own n-grams are taken out of the counts first. With c' such counts, a word
after its context scores c'(context word) / c'(context) for the longest context up to `order` - 1 words whose n-gram
is seen, times BACKOFF for each step down from the longest that the text allows; a single word scores c'(word) / N',
an unseen one UNSEEN / N'.

Relationally: (1) the documents of a block are exploded to n-grams, counted in their task and sent, sorted by 64-bit
hash, to the hash ranges of the count table; (2) each range adds up its n-grams over all blocks and joins every block's
n-grams to their sums; (3) the sums go back in the order in which the block sent its n-grams, so without the hashes, and
meet the block's documents, which are exploded once more, joined to the sums by place and summed up by document. An
n-gram is at most one entry for each block, however common it is, so no key is hot. A row carries the n-grams of one
block and range at once, packed; what moves grows with the input, as blocks and ranges grow with the root of it.

A block is a run of rows, and a text of more than LONG_BYTES one by itself, so it holds a bounded number of bytes, or one
text. A range is read by one task in parts of PART n-grams.

Nulls: a null text has no words and a null score. Empty texts likewise; texts of any length are whole. Repeated rows are
rows of their own, and count. Empty tables give empty results; columns of docs that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.shared import partitions, slices, table, written

ORDER = 3
BACKOFF = 0.4
UNSEEN = 0.5
#: Rows of a block and of input for each range, at least; entries of a block and range that they grow for, up to 16
#: times as many.
BLOCK_ROWS = 1024
RANGE_ROWS = 4096
ENTRIES = 256
#: N-grams of a row, about, by which sizes are planned. A longer text is a block of its own.
ROW_GRAMS = 1000
LONG_BYTES = 1 << 16
#: N-grams that a task holds before it sends them on, and that a range adds up at a time.
HELD = 6 << 20
PART = 1 << 20


def packed(numbers: np.ndarray) -> bytes:
    """Sorted or small unsigned numbers: differences, by byte planes, compressed."""
    steps = np.diff(numbers, prepend=numbers.dtype.type(0))
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=W.U)


def grams(texts: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words before each text; for each length the hashes of n-grams by last word, and those last words."""
    data, offsets = W.buffers(texts)
    data = W.LOWER[data]
    starts, ends, before = W.spans(data, offsets, W.SPACED)
    one = W.span_hashes(data, starts, ends)
    hashes, lasts = [W.mix(one)], [np.arange(len(one))]
    for k in range(2, order + 1):
        place = W.within(before, k)
        hashes.append(W.windows(one, k)[place] + W.U(k) if len(place) else np.zeros(0, W.U))
        lasts.append(place + k - 1)
    return before, hashes, lasts


def split(block: int, tokens: np.ndarray, counts: np.ndarray, shift: int) -> list[tuple]:
    """Rows of a block's sorted n-grams by hash range."""
    ranges = (tokens >> W.U(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if len(tokens) else []
    ends = np.append(cuts[1:], len(tokens)) if len(tokens) else []
    return [(int(ranges[a]), block, packed(tokens[a:b]), packed(np.cumsum(counts[a:b]).astype(W.U)), 0) for a, b in zip(cuts, ends)]


def plain(numbers: np.ndarray) -> bytes:
    """Unsigned numbers, mostly small, by byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def from_plain(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


#: n is the number of words of a task, in a row of range -1.
COUNTED = "part long, block long, tokens binary, counts binary, n long"


def as_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["part", "block", "tokens", "counts", "n"])


def keys_of(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers that repartition(n) by their column deals to as many different partitions."""
    own: dict[int, int] = {}
    low, step = 0, 20 * n + 100
    while len(own) < n:
        for slot, key in spark.range(low, low + step).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("slot")).agg(F.min("id")).collect():  # n rows
            own.setdefault(slot, key)
        low += step
    return np.array([own[k] for k in range(n)], np.int64)


def counter(order: int, shift: int, keys: np.ndarray):
    def keyed(rows: list[tuple]) -> pa.RecordBatch:
        batch = as_rows(rows)
        return batch.append_column("slot", pa.array(keys[batch.column("part").to_numpy() % len(keys)]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        words = size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                tokens = np.concatenate(parts)
                tokens.sort()
                at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
                rows = split(block, tokens[at], np.diff(np.append(at, len(tokens))), shift)
                for k in range(0, len(rows), 256):
                    yield keyed(rows[k : k + 256])
            held.clear()

        for batch in slices(batches, "text"):
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            before, hashes, lasts = grams(batch.column("text"), order)
            owner = W.owners(before)
            words += len(owner)
            for h, last in zip(hashes, lasts):
                size += len(h)
                own = blocks[owner[last]]
                if len(own) and (own == own[0]).all():
                    held.setdefault(int(own[0]), []).append(h)
                    continue
                for block in np.unique(own):
                    held.setdefault(int(block), []).append(h[own == block])
            if size >= HELD:
                yield from sent()
                size = 0
        yield from sent()
        yield keyed([(-1, 0, b"", b"", words)])

    return count


def united(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams of a block and range, and their counts, from the parts in which they were sent."""
    tokens = [unpacked(r[2]) for r in rows]
    counts = [np.diff(unpacked(r[3]), prepend=W.U(0)) for r in rows]
    if len(rows) == 1:
        return tokens[0], counts[0]
    every, where = np.unique(np.concatenate(tokens), return_inverse=True)
    return every, np.bincount(where, weights=np.concatenate(counts).astype(float), minlength=len(every)).astype(W.U)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and block: for each block's n-grams of a range, in order, their counts in all blocks."""
    part, rows = None, []

    def answered() -> Iterator[pa.RecordBatch]:
        if part == -1:
            yield as_rows([(-1, 0, b"", b"", sum(r[4] for r in rows))])
            return
        blocks, own = [], []
        for r in rows:
            if not blocks or blocks[-1] != r[1]:
                blocks.append(r[1])
                own.append([])
            own[-1].append(r)
        sent = [united(x) for x in own]
        rows.clear()
        totals: list[list[np.ndarray]] = [[] for _ in blocks]
        todo = sum(len(t) for t, _ in sent)
        low, high = min(t[0] for t, _ in sent), max(t[-1] for t, _ in sent)
        steps = max(1, -(-todo // PART))
        cuts = [low + (high - low) // W.U(steps) * W.U(k) for k in range(1, steps)]  # hashes lie evenly
        edges = [np.concatenate([[0], np.searchsorted(t, np.array(cuts, W.U)), [len(t)]]) for t, _ in sent]
        for k in range(steps):
            tokens = np.concatenate([t[e[k] : e[k + 1]] for (t, _), e in zip(sent, edges)])
            counts = np.concatenate([c[e[k] : e[k + 1]] for (_, c), e in zip(sent, edges)])
            order = np.argsort(tokens)
            ranked = tokens[order]
            begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
            total = np.empty(len(tokens), W.U)
            if len(begin):
                total[order] = np.repeat(np.add.reduceat(counts[order], begin), np.diff(np.append(begin, len(ranked))))
            at = 0
            for x, e in zip(totals, edges):
                x.append(total[at : at + e[k + 1] - e[k]])
                at += e[k + 1] - e[k]
        for k in range(0, len(blocks), 256):
            yield as_rows([(part, block, b"", plain(np.concatenate(x)), 0) for block, x in zip(blocks[k : k + 256], totals[k : k + 256])])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "tokens", "counts", "n"))):
            if row[0] != part:
                if rows:
                    yield from answered()
                part, rows = row[0], []
            rows.append(row)
    if rows:
        yield from answered()


def score(texts: pa.Array, sums: list[np.ndarray], order: int, corpus: int) -> list[pa.Array]:
    """Scores of a block's texts by the counts of its n-grams, sorted by hash."""
    before, hashes, lasts = grams(texts, order)
    owner, n = W.owners(before), np.diff(before)
    flat, last = np.concatenate(hashes), np.concatenate(lasts)
    length = np.repeat(np.arange(order), [len(h) for h in hashes])
    ranked = np.lexsort((owner[last], flat))
    h, of = flat[ranked], owner[last][ranked]
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    totals = np.concatenate([np.zeros(0, W.U), *sums]).astype(float)
    if int(new.sum()) != len(totals):
        raise ValueError("a block's rows differ between readings; pass a block that is the same whenever a row is read")
    own = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)])
    times = np.diff(np.append(own, len(h)))
    left = np.maximum(totals[np.cumsum(new) - 1] - np.repeat(times, times), 0) if len(h) else np.zeros(0)
    rest = np.maximum(corpus - n, 1)[owner].astype(float)
    seen = np.zeros((order, len(owner)))
    seen[length[ranked], last[ranked]] = left
    place = np.arange(len(owner)) - before[owner] if len(owner) else owner
    longest = np.minimum(place + 1, order)
    value = np.where(seen[0] > 0, seen[0], UNSEEN) / rest
    used = np.ones(len(owner), np.int64)
    for k in range(2, order + 1):
        c = seen[k - 1]
        context = np.concatenate([[0.0], seen[k - 2][:-1]])
        ok = (c > 0) & (context > 0)
        value = np.where(ok, c / np.where(ok, context, 1), value)
        used = np.where(ok, k, used)
    logs = np.log(value) + (longest - used) * np.log(BACKOFF) if len(owner) else value
    sums = np.array([logs[a:b].sum() for a, b in zip(before[:-1], before[1:])])
    return [pa.array(n), pa.array(sums, mask=n == 0), pa.array(W.sums_by((used < longest).astype(np.int64), before))]


HELD_DOCS = "block long, second boolean, part long, data binary"


def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a block in compressed bundles, as less goes through the shuffle so."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in slices(batches, "text"):
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.append(True, blocks[order][1:] != blocks[order][:-1])).tolist()
        for low, high in zip(cuts, [*cuts[1:], len(blocks)]):
            own = batch.take(pa.array(order[low:high])) if len(cuts) > 1 else batch
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=options) as out:
                out.write_batch(own)
            data = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(blocks[order[low]])]), pa.array([True]), pa.array([0]), pa.array([data], pa.binary())], ["block", "second", "part", "data"]
            )


def scorer(keep: list[str], order: int, corpus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block: first its sums by range, then its documents."""
        block, sums, docs = None, [], []

        def scored() -> Iterator[pa.RecordBatch]:
            texts = pa.concat_arrays([d.column("text").cast(pa.large_string()) for d in docs])
            found, at = score(texts, sums, order, corpus), 0
            for d in docs:
                yield pa.RecordBatch.from_arrays([*[d.column(c) for c in keep], *[x.slice(at, d.num_rows) for x in found]], [*keep, "n_words", "log_score", "n_backoff"])
                at += d.num_rows

        for batch in batches:
            for now, second, data in zip(*(batch.column(c) for c in ("block", "second", "data"))):
                if now.as_py() != block:
                    if docs:
                        yield from scored()
                    block, sums, docs = now.as_py(), [], []
                if second.as_py():
                    docs += pa.ipc.open_stream(data.as_buffer())
                else:
                    sums.append(from_plain(data.as_py()))
        if docs:
            yield from scored()

    return run


def sizes(rows: int) -> tuple[int, int]:
    """Rows of a block and of a range: both grow alike where a block and range would share fewer than ENTRIES n-grams."""
    few = max(1.0, rows * ENTRIES / (BLOCK_ROWS * RANGE_ROWS * ROW_GRAMS))
    return int(BLOCK_ROWS * min(16, few**0.5)), int(RANGE_ROWS * min(16, few**0.5))


def blocks(run: Column, place: Column, text: str) -> Column:
    """The run of rows that a row is in, or for a long text its own place there: a number that no order of tasks changes."""
    return F.when(F.octet_length(F.col(f"`{text}`")) > LONG_BYTES, F.xxhash64(run, place, F.lit("long"))).otherwise(F.xxhash64(run))


def stupid_backoff(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", block: Column | None = None, order: int = ORDER, rows: int | None = None) -> DataFrame:
    """keep, with n_words, log_score (natural, summed over words) and n_backoff (words scored by a shorter context).

    block: a number for each row that is the same whenever the row is read; rows of a block should lie together, and have
    a bounded number of bytes or be one text (see blocks() and sizes()). By default a hash of key and text.
    """
    spark = docs.sparkSession
    keep = [c for c in keep if c not in ("n_words", "log_score", "n_backoff")]
    rows = docs.count() if rows is None else rows
    block_rows, range_rows = sizes(rows)
    if block is None:
        place = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
        block = blocks(F.pmod(place, F.lit(max(1, rows // block_rows))), place, text)
    held = [f"_{k}" for k in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(keep, held)], F.col(f"`{text}`").alias("text"), block.cast("long").alias("block"))
    bits = max(3, int(np.ceil(np.log2(max(1, rows / range_rows)))))
    n = partitions(spark, 1 << bits, 1)
    asked = source.select("text", "block").mapInArrow(counter(order, 64 - bits, keys_of(spark, n)), f"{COUNTED}, slot long")
    answers = written(asked.repartition(n, "slot").sortWithinPartitions("part", "block").mapInArrow(summed, COUNTED), "answers", large=True)
    corpus = answers.where("part = -1").agg(F.sum("n")).first()[0] or 0
    first = answers.where("part >= 0").select("block", F.lit(False).alias("second"), "part", F.col("counts").alias("data"))
    both = source.mapInArrow(bundled, HELD_DOCS).union(first)
    schema = source.select(*held).schema.add("n_words", "long").add("log_score", "double").add("n_backoff", "long")
    n = partitions(spark, rows, 8 * block_rows)
    out = both.repartition(n, "block").sortWithinPartitions("block", "second", "part").mapInArrow(scorer(held, order, corpus), schema)
    return out.select(*[F.col(h).alias(c) for c, h in zip(keep, held)], "n_words", "log_score", "n_backoff")


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.count()
    run = F.struct("_metadata.file_path", F.floor(F.col("_metadata.row_index") / sizes(rows)[0]))
    block = blocks(run, F.col("_metadata.row_index"), "text")
    return stupid_backoff(docs, ["doc_id"], block=block, rows=rows).withColumn("log_score", F.round("log_score", 4))


QUERIES = {"op8_stupid_backoff": op8_stupid_backoff}

SQL: dict[str, str] = {
    "op8_stupid_backoff": rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT id, k, w[k] AS g1, CASE WHEN k > 1 THEN w[k - 1] || ' ' || w[k] END AS g2, CASE WHEN k > 2 THEN w[k - 2] || ' ' || w[k - 1] || ' ' || w[k] END AS g3, CASE WHEN k > 1 THEN w[k - 1] END AS c2, CASE WHEN k > 2 THEN w[k - 2] || ' ' || w[k - 1] END AS c3
  FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
own AS (SELECT id, g, count(*) AS n FROM (SELECT id, g1 AS g FROM t UNION ALL SELECT id, g2 FROM t WHERE g2 IS NOT NULL UNION ALL SELECT id, g3 FROM t WHERE g3 IS NOT NULL) GROUP BY 1, 2),
total AS (SELECT g, sum(n) AS n FROM own GROUP BY 1), rest AS (SELECT own.id, own.g, total.n - own.n AS n FROM own JOIN total USING (g) WHERE total.n > own.n),
lens AS (SELECT id, len(w) AS n, (SELECT count(*) FROM t) AS corpus FROM d),
s AS (SELECT t.id, k, greatest(corpus - lens.n, 1) AS others, coalesce(r1.n, 0) AS n1, coalesce(r2.n, 0) AS n2, coalesce(r3.n, 0) AS n3, coalesce(x2.n, 0) AS m2, coalesce(x3.n, 0) AS m3 FROM t JOIN lens ON lens.id = t.id
  LEFT JOIN rest r1 ON r1.id = t.id AND r1.g = g1 LEFT JOIN rest r2 ON r2.id = t.id AND r2.g = g2 LEFT JOIN rest r3 ON r3.id = t.id AND r3.g = g3 LEFT JOIN rest x2 ON x2.id = t.id AND x2.g = c2 LEFT JOIN rest x3 ON x3.id = t.id AND x3.g = c3),
v AS (SELECT id, least(k, 3) AS longest, CASE WHEN n3 > 0 AND m3 > 0 THEN 3 WHEN n2 > 0 AND m2 > 0 THEN 2 ELSE 1 END AS used, CASE WHEN n3 > 0 AND m3 > 0 THEN n3 / m3 WHEN n2 > 0 AND m2 > 0 THEN n2 / m2 ELSE (CASE WHEN n1 > 0 THEN n1 ELSE {UNSEEN} END)::DOUBLE / others END AS x FROM s)
SELECT doc_id, len(w)::BIGINT AS n_words, round(sum(ln(x) + (longest - used) * ln({BACKOFF}::DOUBLE)), 4) AS log_score, coalesce(sum((used < longest)::INT), 0)::BIGINT AS n_backoff FROM d LEFT JOIN v USING (id) GROUP BY id, doc_id, w"""
}
