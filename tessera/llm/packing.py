"""Packing by power-of-two decomposition: binary-length pieces, equal lengths in one bucket.

A document of L tokens (its end token included) becomes floor(L / limit) pieces of `limit` tokens and one piece for
each binary digit of the rest, long ones first. Each piece is a sequence by itself: none crosses documents and none is
padded. Equal lengths make a bucket: bucket_slot numbers the pieces of each, write_buckets() gives each a folder of its
own, and a batch is drawn from one bucket at a time. Nothing is shuffled; long documents only give more pieces of their
own partition's rows.

Tokens come from a public tokenizer file. Words are encoded once for each batch and kept in a bounded cache: the
tokenizer drops white space and treats what lies between ASCII white space alone, so ids are those of the whole text.

Nulls and texts without tokens: the end token alone, one piece of length 1. Repeated rows give pieces each. An empty
table gives no pieces. Only the id and text columns are read, so clashing names don't matter.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import slices, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
LIMIT = 2048
#: Words that a worker keeps between batches.
CACHE_WORDS = 800_000
#: Text that is split and encoded at a time.
TEXT_BYTES = 4 << 20
#: Stands between words that are encoded in one go; words that hold it are encoded alone.
MARK = "\x00"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Ids of words by a tokenizer that treats them one by one; keeps those seen, up to CACHE_WORDS, in flat arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.one = Tokenizer.from_file(path)
        self.mark = self.encode(MARK)
        self.known = pa.array([], pa.large_string())
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def keep(self, places: np.ndarray) -> None:
        """Forgets all words but those at the places."""
        n = self.sizes[places]
        begins = np.cumsum(n) - n
        self.ids = self.ids[np.repeat(self.starts[places] - begins, n) + np.arange(int(n.sum()))]
        self.known, self.starts, self.sizes = self.known.take(pa.array(places)), begins, n

    def encode(self, text: str) -> list[int]:
        return self.one.encode(text, add_special_tokens=False).ids

    def learn(self, words: pa.Array) -> None:
        """Adds the words: those without the mark encoded in one go, cut at the mark's id; others alone."""
        marked = pc.match_substring(words, MARK)
        plain, rest = words.filter(pc.invert(marked)).to_pylist(), words.filter(marked).to_pylist()
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if plain and len(self.mark) == 1:
            got = np.array(self.encode(f" {MARK} ".join(plain)), np.uint32)
            real = got != self.mark[0]
            cuts = np.flatnonzero(~real)
            if len(cuts) == len(plain) - 1:  # else the mark's id stood for something else too
                ids.append(got[real])
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(got)]])) - 1)
                words, plain = pa.array(plain + rest, pa.large_string()), []
        alone = [self.encode(w) for w in (plain + rest)]
        ids += [np.array(x, np.uint32) for x in alone]
        sizes.append(np.array([len(x) for x in alone], np.int64))
        if plain:
            words = pa.array(plain + rest, pa.large_string())
        new = np.concatenate(sizes)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(new) - new])
        self.sizes = np.concatenate([self.sizes, new])
        self.ids = np.concatenate([self.ids, *ids])
        self.known = pa.concat_arrays([self.known, words])

    def of(self, words: pa.Array) -> np.ndarray:
        """Places of the words among the known ones."""
        found = pc.index_in(words, self.known)
        known, places = pc.is_valid(found).to_numpy(zero_copy_only=False), found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(~known)
        if len(self.known) + len(missing) > CACHE_WORDS:
            self.keep(places[known])
            places[known] = np.arange(len(self.known))
        new = words.take(pa.array(missing))
        order = np.argsort(pc.match_substring(new, MARK).to_numpy(zero_copy_only=False), kind="stable")  # as learn() takes them
        places[missing[order]] = len(self.known) + np.arange(len(missing))
        new = new.take(pa.array(order))
        for k in range(0, len(new), 8_000):
            self.learn(new.slice(k, 8_000))
        return places


def kept_words(path: str) -> Words:
    """The worker's own Words; kept in a module of its own, as tasks of one worker share nothing else."""
    store = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker"))
    if getattr(store, "path", None) != path:
        store.path, store.words = path, Words(path)
    return store.words


def token_ids(texts: pa.Array, words: Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, each ended by end_id, and the tokens of each text."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    coded = split.flatten().dictionary_encode()
    places = words.of(coded.dictionary)
    flat = np.concatenate([words.ids, [end_id]]).astype(np.uint32)
    begins, sizes = np.append(words.starts[places], len(words.ids)), np.append(words.sizes[places], 1)
    edges = split.offsets.to_numpy() - split.offsets[0].as_py()
    which = np.insert(coded.indices.to_numpy(zero_copy_only=False), edges[1:], len(places))
    n = sizes[which]
    at = np.repeat(begins[which] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    ids = flat[at]
    total = np.concatenate([[0], np.cumsum(n)])
    ends = edges[1:] + np.arange(1, len(edges))
    return ids, np.diff(np.concatenate([[0], total[ends]]))


def binary_lengths(tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and length of each piece, in order: whole limits, then the binary digits of the rest from the highest."""
    bits = [1 << b for b in range(limit.bit_length() - 2, -1, -1)]
    times = np.stack([tokens // limit, *[(tokens % limit) // b % 2 for b in bits]], axis=1)
    lengths = np.tile(np.array([limit, *bits]), len(tokens))
    doc = np.repeat(np.arange(len(tokens)), len(bits) + 1)
    flat = times.reshape(-1)
    return np.repeat(doc, flat), np.repeat(lengths, flat)


def cutter(key: str, text: str, path: str, end_id: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = kept_words(path), TaskContext.get().partitionId() << 36
        slots = np.full(limit.bit_length(), number)  # of the bucket of each binary length
        for batch in slices(batches, text, TEXT_BYTES):
            ids, tokens = token_ids(batch.column(text), words, end_id)
            doc, length = binary_lengths(tokens, limit)
            ends = np.cumsum(length)
            starts = ends - length - (np.cumsum(tokens) - tokens)[doc]
            packed = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            bucket = np.log2(length).astype(np.int64)
            slot = np.empty(len(doc), np.int64)
            order = np.argsort(bucket, kind="stable")
            n = np.bincount(bucket, minlength=len(slots))
            slot[order] = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(slots, n)
            slots = slots + n
            rows = pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(doc)), pa.array(starts), pa.array(length), packed.cast(pa.binary()), pa.array(tokens[doc]), pa.array(number + np.arange(len(doc))), pa.array(np.zeros(len(doc), np.int64)), pa.array(slot)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket_slot"],
            )
            number += len(doc)
            yield rows

    return cut


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, limit: int = LIMIT) -> DataFrame:
    """Pieces with their ids as little-endian unsigned 32-bit numbers; `length` is the bucket, a power of two.

    sequence_id is unique, and bucket_slot in its bucket; both are the same when a task runs again, as they count from the
    input's partition.
    """
    if limit & (limit - 1):
        raise ValueError("the limit must be a power of two")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket_slot long"
    rows = docs.select(F.col(key).cast("long").alias(key), text)
    return rows.mapInArrow(cutter(key, text, tokenizer or tokenizer_path(), end_id, limit), schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces as Parquet, a folder length=<n> for each bucket."""
    pieces.write.partitionBy("length").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket_slot")


def op2_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


QUERIES = {"op2_binary_packing": op2_binary_packing}
SQL: dict[str, str] = {}
