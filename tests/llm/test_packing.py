import struct
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from tessera.llm import packing


def rebuilt(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        out[r.doc_id] += struct.unpack(f"<{r.length}I", r.ids)
    return out


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_pieces_give_the_tokens_back(which, request):
    df = request.getfixturevalue(which).dropDuplicates(["doc_id"])
    one = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(df).collect()
    got = rebuilt(rows)
    for r in df.collect():
        assert got[r.doc_id] == one.encode(r.text or "", add_special_tokens=False).ids + [1]
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 for r in rows)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        assert r.doc_tokens == len(got[r.doc_id])


def test_small_limit_repeats_and_empty(odd_docs, no_docs):
    rows = packing.pack(odd_docs, limit=8).collect()
    assert sum(r.doc_id == 0 and r.start == 0 for r in rows) == 2
    assert max(r.length for r in rows) == 8
    assert packing.pack(no_docs).count() == 0
    assert packing.pack(odd_docs.where("doc_id = 2")).select("length", "doc_tokens").collect() == [(1, 1)]


def test_digest(docs):
    pieces = packing.pack(docs)
    want = {(r.doc_id, r.start): zlib.crc32(r.ids) for r in pieces.collect()}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in packing.digest(pieces).collect()} == want


def test_buckets(spark, docs, odd_docs, tmp_path):
    """Every bucket holds pieces of one length, numbered without repeats, and all buckets together hold every id."""
    for k, df in enumerate((docs, odd_docs)):
        pieces = packing.pack(df.repartition(3))
        packing.write_buckets(pieces, str(tmp_path / str(k)))
        want = sorted((r.doc_id, r.start, bytes(r.ids)) for r in pieces.collect())
        found = []
        for folder in (tmp_path / str(k)).glob("length=*"):
            rows = spark.read.parquet(str(folder)).collect()
            assert {len(r.ids) // 4 for r in rows} == {int(folder.name.split("=")[1])}
            assert len({r.bucket_slot for r in rows}) == len(rows)
            found += [(r.doc_id, r.start, bytes(r.ids)) for r in rows]
        assert sorted(found) == want


def test_null_keys_clashing_names_and_ties(spark, odd_docs):
    """Rows without an id and with columns named like the result's; equal documents give equal pieces, long texts whole ones."""
    df = odd_docs.withColumns({"length": packing.F.lit("x"), "start": packing.F.lit(1), "ids": packing.F.lit(2)}).unionByName(
        odd_docs.where("doc_id = 5").withColumns({"doc_id": packing.F.lit(None).cast("long"), "length": packing.F.lit("y"), "start": packing.F.lit(1), "ids": packing.F.lit(2)})
    )
    rows = packing.pack(df).collect()
    alone = [r for r in rows if r.doc_id is None]
    assert [r.ids for r in alone] == [r.ids for r in rows if r.doc_id == 5] and len(alone) == 1 + (alone[0].doc_tokens > alone[0].length)
    twice = sorted((r.start, r.length, bytes(r.ids)) for r in rows if r.doc_id == 0)
    assert twice[::2] == twice[1::2]
    long = [r for r in rows if r.doc_id == 9]
    assert sum(r.length for r in long) == long[0].doc_tokens > 15_000 and max(r.length for r in long) == packing.LIMIT
