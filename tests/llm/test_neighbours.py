import math

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import neighbours

ASKED = "vec_id % 100 = 0"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, k=10):
    """{query: [(id, distance)]} by comparing every query with every row."""
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and usable(v)]
    if not rows:
        return {}
    lengths = [len(v) for _, v in rows]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    rows = [(i, v) for i, v in rows if len(v) == dim]
    asked = {}
    for i, v in sorted(((i, tuple(v)) for i, v in rows if i % 100 == 0), reverse=True):
        asked[i] = np.array(v)
    return {q: sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, x in rows if i != q)[:k] for q, v in asked.items()}


def found(df, vectors="embedding", visits=None, **more):
    index = neighbours.build(df, vector=vectors, **more)
    out = {}
    for r in neighbours.search(index, neighbours.queries_of(index, ASKED), visits=visits, cell_rows=40, cell_queries=3).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return index, out


def same(got, want):
    assert got.keys() == {q for q, w in want.items() if w}
    for q, own in got.items():
        assert [i for _, i in own] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in own], [d for d, _ in want[q]], rtol=1e-14, atol=1e-14)


def test_recall_and_exact_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows)
    index, got = found(df, leaf_rows=8)
    assert index.tree.leaves > 20 and index.sizes.sum() == len(rows)
    met = sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items())
    assert met >= 0.9 * sum(map(len, want.values())) and got.keys() == want.keys()
    place = {i: np.array(v, float) for i, v in rows}
    for q, own in got.items():
        assert own == sorted(own) and all(math.isclose(d, np.linalg.norm(place[q] - place[i]), rel_tol=1e-12) for d, i in own)
    same(found(df, leaf_rows=8, visits=10**9)[1], want)


def test_clusters_are_found_in_few_visits(spark):
    random = np.random.default_rng(3)
    centres = random.normal(size=(40, 16)) * 10
    rows = [(k, (centres[k % 40] + random.normal(size=16) * 0.1).tolist()) for k in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, got = found(df, leaf_rows=50)
    visits = neighbours.calibrate(index, neighbours.queries_of(index, ASKED))
    assert visits <= index.tree.leaves / 8
    want = brute(rows)
    assert sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_odd_rows_ties_and_repeats(spark):
    """A third of all rows with one vector, ties, repeated rows and ids, and rows that take no part."""
    random = np.random.default_rng(5)
    rows = [(k, random.integers(-2, 3, 4).tolist()) for k in range(400)] + [(1000 + k, [1, 1, 1, 1]) for k in range(300)]
    rows += [(5, [1, 1, 1, 1])] * 3 + [(100, [2, 2, 2, 2]), (100, [1, 1, 1, 1]), (200, None), (500, []), (None, [1, 2, 3, 4]), (600, [1, 2, 3]), (700, [0, 0, 0, 0]), (800, [1, None, 2, 3]), (900, [1, math.nan, 2, 3]), (900, [1, -math.inf, 2, 3])]
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 as leaf", "2 as vector", "3 as i").repartition(5)
    _, got = found(df, leaf_rows=20, visits=10**9)
    same(got, brute(rows))
    _, some = found(df, leaf_rows=20)
    assert all(len(x) == 10 for x in some.values())


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_few_rows(spark, n):
    rows = [(100 * k, [1.0 + k, 2.0]) for k in range(n)]
    _, got = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf_rows=2)
    same(got, brute(rows))


def test_rounding_of_the_product_loses_nothing():
    """Distances far below the rounding of the product's terms still come in the right order."""
    random = np.random.default_rng(9)
    rows = 1e6 + random.normal(size=(500, 8)) * 1e-4
    ids = random.permutation(500)
    for q, at, score in neighbours.nearest(rows[:20], ids[:20], rows, ids, 10):
        exact = np.sqrt(((rows - rows[q]) ** 2).sum(1))
        exact[q] = np.inf
        assert ids[at].tolist() == ids[np.lexsort((ids, exact))[:10]].tolist()


def test_equal_vectors_and_matrix():
    tree = neighbours.fit(np.ones((100, 3)), 10)
    assert tree.leaves == 1
    assert neighbours.matrix(pa.chunked_array([pa.array([[1.0, 2.0]]), pa.array([[3.0, 4.0]])])).tolist() == [[1, 2], [3, 4]]
