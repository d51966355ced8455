"""Cross-tokenizer alignment: B tokens as a static index of byte intervals, stabbed by bisection for every A token.

Both tokenizers' tokens are byte intervals of a space and the text. Bisection over the ends and the starts of the B tokens
gives the run of B tokens that an A token overlaps: its links. The gap after an A token that no B token spans closes a
group. How many documents hold an id pair linked is counted over all documents, and each document's links are then weighed
by these counts: how many are the best of their A id, and the sum.

Texts are cut into units where an ASCII graphic character is followed by a space. No token of either tokenizer crosses such
a place (of A by its pattern, of B if no piece holds a space after another character, else a text is one unit), so tokens,
groups and links of a text are those of its units, which are aligned once and kept in a bounded cache.

Counting: a task takes documents in blocks of a bounded number of (document, pair) entries. A block sends each of its pairs
once, with the number of its documents, however common the pair is; the pair's count comes back once a block, and a block's
documents and counts meet in one bounded group. The encoded documents are written once, so nothing is encoded twice.

Nulls: a null or empty text, or one whose tokens don't give its bytes back, has no tokens: zeros and ''. Documents with a
null id count like others. Repeated rows are documents of their own, ties for the best all count, texts of any length are
whole, and only the id and text columns are read, so clashing names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import slices, table, written

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text that is aligned at a time.
TEXT_BYTES = 2 << 20
#: Units, and bytes of units, that a worker keeps between batches.
CACHE_UNITS, CACHE_BYTES = 200_000, 8 << 20
#: (document, pair) entries of a block; a document's entries stay together.
BLOCK_ENTRIES = 1_500_000
#: Pairs of a block that travel in one row.
ROW_PAIRS = 50_000
#: Stands before a unit that is encoded by B, which puts a space before it.
HEAD = "a"


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte, added = byte_characters(), {k: t.content for k, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = added[k].encode() if k in added else bytes(byte[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in y]) for y in (self.a_bytes, self.b_bytes))
        self.head = self.b.encode(HEAD)
        kind = json.loads(self.a.to_str())
        by_pattern = kind["normalizer"] is None and kind["pre_tokenizer"]["type"] == "ByteLevel" and kind["pre_tokenizer"]["use_regex"]
        self.local = by_pattern and len(self.head) == 1 and not any("▁" in p.lstrip("▁") for p in pieces)
        ids = [str(k).encode() for k in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.width = max(map(len, ids))
        self.digits = np.frombuffer(b"".join(x.ljust(self.width + 1) for x in ids), np.uint8).reshape(len(ids), -1)
        self.n_digits = np.array([len(x) for x in ids])

    def ids(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        if self.local:
            b = [x[1:] if x[:1] == self.head else [] for x in self.b.encode([HEAD + u for u in units], num_threads=1)]
        else:
            b = self.b.encode([u[1:] for u in units], num_threads=1)
        return a, b


class Aligned:
    """Units and what is known of each: tokens, groups, links as id pairs, and the groups' text; bad units have none."""

    def __init__(self, pair: Pair, units: pa.Array):
        texts = units.to_pylist()
        a, b = pair.ids(texts)
        self.units, self.bytes = units, sum(map(len, texts))
        self.good = np.array([b"".join(map(pair.a_bytes.__getitem__, x)) == b"".join(map(pair.b_bytes.__getitem__, y)) == t.encode() for t, x, y in zip(texts, a, b)], bool)
        a, b = ([x if ok else [] for x, ok in zip(y, self.good)] for y in (a, b))
        self.n_a, self.n_b = (np.array([len(x) for x in y], np.int64) for y in (a, b))
        a_ids, b_ids = (np.array([k for x in y for k in x], np.int64) for y in (a, b))
        a_end, b_end = np.cumsum(pair.a_size[a_ids]), np.cumsum(pair.b_size[b_ids])
        first = np.searchsorted(b_end, a_end - pair.a_size[a_ids], side="right")
        links = np.searchsorted(b_end - pair.b_size[b_ids], a_end, side="left") - first
        which = np.repeat(np.arange(len(a_ids)), links)
        at = np.arange(len(which)) + np.repeat(first - (np.cumsum(links) - links), links)
        self.pairs = a_ids[which] * len(pair.b_bytes) + b_ids[at]
        a_unit, b_unit = (np.repeat(np.arange(len(texts)), n) for n in (self.n_a, self.n_b))
        self.n_links = np.bincount(a_unit, links, len(texts)).astype(np.int64)
        stabbed = np.searchsorted(b_end, a_end, side="left")
        closes = b_end[stabbed] == a_end if len(a_ids) else np.zeros(0, bool)
        self.n_groups = np.bincount(a_unit[closes], minlength=len(texts)).astype(np.int64)
        self.text = self.written(pair, a_ids, b_ids, closes, stabbed[closes], b_unit)

    def written(self, pair: Pair, a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_ends: np.ndarray, b_unit: np.ndarray) -> pa.Array:
        """The units' groups as `a1,a2|b1;a3|b2,b3`."""
        b_last = np.zeros(len(b_ids), bool)
        b_last[b_ends] = True
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        groups = int(a_last.sum())
        b_before, a_upto = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=groups))]) for g in (b_group, a_group))
        n = len(a_ids) + len(b_ids)
        ids, mark, size = np.empty(n, np.int64), np.empty(n, np.uint8), np.empty(n, np.int64)
        at_a, at_b = np.arange(len(a_ids)) + b_before[a_group], np.arange(len(b_ids)) + a_upto[b_group + 1]
        ids[at_a], ids[at_b] = a_ids, b_ids
        mark[at_a], mark[at_b] = np.where(a_last, ord("|"), ord(",")), np.where(b_last, ord(";"), ord(","))
        size[:] = pair.n_digits[ids] + 1
        ends = at_b[np.flatnonzero(np.diff(b_unit, append=-1))]  # nothing follows a unit's last token
        cells = pair.digits[ids]
        cells[np.arange(n), pair.n_digits[ids]] = mark
        size[ends] -= 1
        flat = cells[np.arange(pair.width + 1) < size[:, None]]
        tokens = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        offsets = np.concatenate([[0], np.cumsum(size)])[tokens]
        return pa.Array.from_buffers(pa.large_string(), len(self.n_a), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])

    def add(self, other: Aligned) -> None:
        self.units, self.text = pa.concat_arrays([self.units, other.units]), pa.concat_arrays([self.text, other.text])
        self.bytes += other.bytes
        for k in ("good", "n_a", "n_b", "pairs", "n_links", "n_groups"):
            setattr(self, k, np.concatenate([getattr(self, k), getattr(other, k)]))


class Known:
    """The worker's cache of aligned units."""

    def __init__(self, a_path: str, b_path: str):
        self.pair, self.all = Pair(a_path, b_path), None

    def of(self, units: pa.Array) -> np.ndarray:
        """Places of the (different) units in self.all."""
        if self.all is not None and (len(self.all.units) > CACHE_UNITS or self.all.bytes > CACHE_BYTES):
            self.all = None
        if self.all is None:
            self.all = Aligned(self.pair, units)
            return np.arange(len(units))
        found = pc.index_in(units, self.all.units)
        missing = units.filter(pc.is_null(found))
        places = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(missing):
            places[pc.is_null(found).to_numpy(zero_copy_only=False)] = len(self.all.units) + np.arange(len(missing))
            self.all.add(Aligned(self.pair, missing))
        return places


def known(a_path: str, b_path: str) -> Known:
    """The worker's own Known, in a module of its own, as tasks of one worker share nothing else."""
    store = sys.modules.setdefault("_tessera_aligned", types.ModuleType("_tessera_aligned"))
    if getattr(store, "paths", None) != (a_path, b_path):
        store.paths, store.known = (a_path, b_path), Known(a_path, b_path)
    return store.known


def units_of(texts: pa.Array, local: bool) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts with a space before each, one after another, and where each text's begin."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    ends = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    begins = np.zeros(len(data), bool)
    if local:
        begins[1:] = (data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)
    begins[ends[:-1]] = True
    cuts = np.append(np.flatnonzero(begins), len(data))
    units = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return units, np.searchsorted(cuts, ends)


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[edges])


class Batch:
    """What the texts of one run have: numbers, the groups' texts, and the links' id pairs by text."""

    def __init__(self, texts: pa.Array, cache: Known):
        self.all_pairs = len(cache.pair.a_bytes) * len(cache.pair.b_bytes)
        texts = texts.cast(pa.large_string())
        has = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        at = np.flatnonzero(has.to_numpy(zero_copy_only=False))
        units, edges = units_of(texts.filter(has), cache.pair.local)
        coded = units.dictionary_encode()
        places = cache.of(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(units) else np.zeros(0, np.int64)
        all = cache.all
        good = sums(~all.good[places], edges) == 0 if len(units) else np.zeros(0, bool)
        bad_units = np.repeat(~good, np.diff(edges))
        places, edges = places[~bad_units], np.concatenate([[0], np.cumsum(np.where(good, np.diff(edges), 0))])
        self.numbers = {}
        for name in ("n_a", "n_b", "n_groups", "n_links"):
            self.numbers[name] = np.zeros(len(texts), np.int64)
            if len(at):
                self.numbers[name][at] = sums(getattr(all, name)[places], edges)
        n = all.n_links[places] if len(places) else np.zeros(0, np.int64)
        begins = (np.cumsum(all.n_links) - all.n_links)[places] if len(places) else n
        link = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.pairs = all.pairs[link] if len(link) else link
        self.edges = np.concatenate([[0], np.cumsum(self.numbers["n_links"])])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), all.text.take(pa.array(places))), pa.scalar(";", pa.large_string())) if len(at) else pa.array([], pa.large_string())
        back = np.full(len(texts), -1)
        back[at[good]] = np.flatnonzero(good)
        self.groups = joined.take(pa.array(back, mask=back < 0)).fill_null("") if len(at) else pa.array([""] * len(texts), pa.large_string())

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's different pairs in ascending order, how often each is linked, and how many a text has."""
        docs = np.diff(self.edges)
        key = np.sort(self.pairs + np.repeat(np.arange(len(docs)), docs) * self.all_pairs)
        new = np.flatnonzero(np.diff(key, prepend=-1))
        return key[new] % self.all_pairs, np.diff(np.append(new, len(key))), np.bincount(key[new] // self.all_pairs, minlength=len(docs))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def tokenizer_paths(a: str | None, b: str | None) -> tuple[str, str]:
    import public_tokenizers

    return a or public_tokenizers.path(A_FILE), b or public_tokenizers.path(B_FILE)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """Per document its numbers of tokens, groups and links, and the groups' ids as `a1,a2|b1;a3|b2,b3`."""
    paths = tokenizer_paths(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = known(*paths)
        for batch in slices(batches, "_text", TEXT_BYTES):
            one = Batch(batch.column("_text"), cache)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, one.numbers.values()), one.groups.cast(pa.string())], ["doc_id", *one.numbers, "groups"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[key]}, n_a long, n_b long, n_groups long, n_links long, groups string")


class Block:
    """Documents of one task until their entries make a block."""

    SCHEMA = "block long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary, first_code long, pairs array<long>, documents array<long>"

    def __init__(self, number: int):
        self.number, self.rows, self.entries, self.size = number, [], [], 0

    def add(self, ids: pa.Array, one: Batch) -> None:
        text = one.groups
        hashes = [hashlib.sha256(t.as_buffer()).hexdigest() if n else "" for t, n in zip(text, one.numbers["n_a"])]
        self.rows.append((ids, one.numbers, hashes))
        self.entries.append(one.entries())
        self.size += len(self.entries[-1][0])

    def close(self) -> Iterator[pa.RecordBatch]:
        """The documents, each with its pairs as numbers of the block's pairs, and the block's pairs with their documents."""
        from zstandard import ZstdCompressor

        squeeze = ZstdCompressor(level=1).compress
        pairs, code = np.unique(np.concatenate([e[0] for e in self.entries]), return_inverse=True)
        documents, at = np.bincount(code, minlength=len(pairs)), 0
        names = [c.split()[0] for c in self.SCHEMA.split(", ")]
        nothing = lambda n, kind: pa.nulls(n, kind)
        longs = pa.list_(pa.int64())
        for (ids, numbers, hashes), (_, times, sizes) in zip(self.rows, self.entries):
            ends = np.cumsum(sizes)
            codes, times = code[at : at + len(times)].astype(np.uint32), times.astype(np.uint32)
            at += len(times)
            parts = [binary([squeeze(x[e - n : e].tobytes()) for e, n in zip(ends, sizes)]) for x in (codes, times)]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number)), ids, *map(pa.array, numbers.values()), pa.array(hashes, pa.string()), *parts, nothing(n, pa.int64()), nothing(n, longs), nothing(n, longs)], names)
        kind = self.rows[0][0].type
        for k in range(0, len(pairs), ROW_PAIRS):
            lists = [pa.array([x[k : k + ROW_PAIRS]], longs) for x in (pairs, documents)]
            yield pa.RecordBatch.from_arrays([pa.array([self.number]), nothing(1, kind), *[nothing(1, pa.int64())] * 4, nothing(1, pa.string()), *[nothing(1, pa.binary())] * 2, pa.array([k]), *lists], names)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Written: rows of documents with their entries, and (pairs not null) rows of the blocks' pairs."""
    paths = tokenizer_paths(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, block = known(*paths), Block(TaskContext.get().partitionId() << 32)
        for batch in slices(batches, "_text", TEXT_BYTES):
            block.add(batch.column("doc_id"), Batch(batch.column("_text"), cache))
            if block.size >= block_entries:
                yield from block.close()
                block = Block(block.number + 1)
        if block.rows:
            yield from block.close()

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    return written(rows.mapInArrow(run, Block.SCHEMA.format(dict(docs.dtypes)[key])), "aligned")


def block_pairs(rows: DataFrame) -> DataFrame:
    listed = rows.where("pairs is not null")
    return listed.select("block", "first_code", F.posexplode(F.arrays_zip("pairs", "documents"))).selectExpr("block", "first_code + pos as code", "col.pairs as pair", "col.documents as documents")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair (A id times B's vocabulary size, plus B id) and documents that hold it linked, over all blocks."""
    return block_pairs(rows).groupBy("pair").agg(F.sum("documents").alias("count"))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Per document: numbers of tokens, groups and links, best links, sum of counts, and the hash of its groups."""
    from sentencepiece import SentencePieceProcessor

    paths = tokenizer_paths(a, b)
    size = SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    rows = encoded(docs, key, text, *paths, block_entries)
    counts = written(pair_counts(rows).withColumn("a", F.expr(f"pair div {size}")), "pair-counts")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    judged = counts.join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))  # best: a row for each A id at most
    back = block_pairs(rows).join(judged, "pair").select(F.col("block").alias("for_block"), "code", "count", "is_best")
    numbers = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def weigh(own: pa.Table, counted: pa.Table) -> pa.Table:
        from zstandard import ZstdDecompressor

        wide = ZstdDecompressor().decompress
        count, is_best = np.zeros(len(counted), np.int64), np.zeros(len(counted), np.int64)
        code = counted.column("code").to_numpy()
        count[code], is_best[code] = counted.column("count").to_numpy(), counted.column("is_best").to_numpy()
        n_best, total = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for k, (codes, times) in enumerate(zip(own.column("codes"), own.column("times"))):
            codes, times = (np.frombuffer(wide(x.as_buffer()), np.uint32) for x in (codes, times))
            n_best[k], total[k] = times @ is_best[codes], times @ count[codes]
        return pa.table([*(own.column(c) for c in numbers), pa.array(n_best), pa.array(total), own.column("groups_sha256")], [*numbers, "n_best", "count_sum", "groups_sha256"])

    own = rows.where("pairs is null").select("block", *numbers, "groups_sha256", "codes", "times")
    schema = f"doc_id {dict(docs.dtypes)[key]}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("block").cogroup(back.groupBy("for_block")).applyInArrow(weigh, schema)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op13_cross_tokenizer": op13_cross_tokenizer}
SQL: dict[str, str] = {}
