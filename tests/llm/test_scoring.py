import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import scoring as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, order):
    own = [WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    counts = [Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in own]
    total = sum(counts, Counter())
    out = []
    for w, c in zip(own, counts):
        logs, back = 0.0, 0
        n = max(sum(map(len, own)) - len(w), 1)
        left = lambda g: total[g] - c[g]
        for i in range(len(w)):
            longest = min(i + 1, order)
            for k in range(longest, 0, -1):
                gram = tuple(w[i - k + 1 : i + 1])
                if k == 1:
                    value = (left(gram) or S.UNSEEN) / n
                elif left(gram) and left(gram[:-1]):
                    value = left(gram) / left(gram[:-1])
                else:
                    continue
                logs += math.log(value) + (longest - k) * math.log(S.BACKOFF)
                back += k < longest
                break
        out.append((len(w), logs, back))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(docs, odd_docs, order, monkeypatch):
    for name, value in (("BLOCK_ROWS", 8), ("RANGE_ROWS", 4), ("PART", 500), ("HELD", 3000), ("LONG_BYTES", 9000)):  # many blocks, sent in parts; long texts alone
        monkeypatch.setattr(S, name, value)
    for df in (docs.limit(80), odd_docs):
        rows = df.collect()
        want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], order)))
        got = S.stupid_backoff(df.sparkSession.createDataFrame(rows, df.schema), ["doc_id"], order=order).collect()
        assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
        for r in got:
            n, logs, back = want[r.doc_id]
            assert (r.n_words, r.n_backoff) == (n, back)
            assert r.log_score is None if n == 0 else math.isclose(r.log_score, logs, rel_tol=1e-9, abs_tol=1e-9)


def test_packing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        x = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (S.unpacked(S.packed(x)) == x).all()
        assert (S.from_plain(S.plain(x)) == x).all()


def test_keys(spark):
    for n in (1, 7, 64):
        rows = spark.createDataFrame([(int(k),) for k in S.keys_of(spark, n)], "k long").repartition(n, "k")
        assert rows.select(S.F.spark_partition_id()).distinct().count() == n


def test_sizes():
    """Entries of a block and range stay above a bound, as both grow with the root of the input."""
    for rows in (0, 1000, 256_000, 15_000_000, 10**9):
        block, part = S.sizes(rows)
        assert S.BLOCK_ROWS <= block <= 16 * S.BLOCK_ROWS and S.RANGE_ROWS <= part <= 8 * S.RANGE_ROWS
        assert rows > 4 * 10**9 or block * part * S.ROW_GRAMS >= 0.99 * S.ENTRIES * rows


def test_odd(odd_docs, no_docs):
    assert S.stupid_backoff(no_docs, ["doc_id"]).count() == 0
    clash = odd_docs.withColumn("n_words", S.F.lit("x")).withColumn("block", S.F.lit(1))
    out = S.stupid_backoff(clash, ["doc_id", "n_words", "block"])
    assert out.columns == ["doc_id", "block", "n_words", "log_score", "n_backoff"] and dict(out.dtypes)["n_words"] == "bigint"
    assert out.count() == odd_docs.count()


def test_blocks_that_change():
    """A block with other rows than at the first reading gives an error, not wrong scores."""
    texts = pa.array(["a b c", "a b"])
    assert S.score(texts, [np.array([2, 2, 1, 2, 1, 1], np.uint64)], 3, 5)[0].to_pylist() == [3, 2]
    with pytest.raises(ValueError, match="differ between readings"):
        S.score(texts, [np.array([2, 2, 1], np.uint64)], 3, 5)


def test_query_uses_all_rows(spark, sf_dir, docs):
    got = {r.doc_id: r for r in S.op8_stupid_backoff(spark, sf_dir).collect()}
    rows = docs.collect()
    want = brute([r.text for r in rows], S.ORDER)
    assert len(got) == len(rows)
    for r, (n, logs, back) in zip(rows, want):
        assert (got[r.doc_id].n_words, got[r.doc_id].n_backoff) == (n, back) and math.isclose(got[r.doc_id].log_score, logs, rel_tol=1e-9, abs_tol=1e-4)
