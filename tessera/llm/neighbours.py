"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

fit() clusters a bounded sample of the vectors by k-means, and each cluster again, until a leaf would hold few of them.
Every row goes down the tree to the nearest centre at each level: its leaf. A search keeps the nodes that it has seen in a
priority queue by the distance of their centres, takes the nearest, and either adds its children or visits its rows.

How many leaves are visited is calibrated: the true neighbours of a bounded sample of queries are found among all rows by
comparing them all, which gives each true neighbour's leaf, and the visits are widened until the wanted share of them is
met. A search also goes on until its leaves hold as many rows as are wanted, so no answer is short while there are more.

Rows and queries meet in cells: neighbouring leaves make bundles of a bounded number of rows, and a bundle's rows and the
queries that visit it are dealt by hash into as many parts as their numbers need, so neither a leaf of equal vectors nor one
that all visit makes a large task. A query is compared with the leaves it visits only, and a cell gives its k nearest. In a cell a matrix product with a bound of its
rounding error leaves out what can't be among the nearest; the rest is measured exactly, in double precision.

Nulls and odd rows: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without an id or of another length than most (the longer of two that are as frequent). Rows with a query's id are its own,
never its candidates; a query id that is repeated is searched once, with its smallest vector. Other repeated rows are
candidates each. Ties go to the smaller id. Only the id and vector columns are read, so clashing names don't matter. An
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import partitions, table, written

NEAREST = 10
#: Rows (and bytes) of the sample that the tree is fitted on, and the bytes of all its centres.
SAMPLE, SAMPLE_BYTES, TREE_BYTES = 131_072, 32 << 20, 16 << 20
#: Children of a node; rows of the sample, and rows of the table, that a leaf holds at least on average.
BRANCH, LEAF_SAMPLE, LEAF_ROWS = 16, 8, 200
ROUNDS = 12
#: Queries of the calibration and the share of their true neighbours that must be met. The contract's 0.9 is passed by a margin.
PROBES, RECALL = 200, 0.95
#: Rows and queries of a cell.
CELL_ROWS, CELL_QUERIES = 2_000, 2_000
#: Distances that are held at a time.
BLOCK = 1 << 20


class Tree:
    """Centres and children of the nodes; a node without children is a leaf, numbered in `leaf`."""

    def __init__(self, centres: np.ndarray, children: list[list[int]]):
        self.centres, self.children = centres, [np.array(c, np.int64) for c in children]
        self.norms = (centres**2).sum(1)
        leaves = [k for k, c in enumerate(children) if not c]
        self.leaf = np.full(len(children), -1)
        self.leaf[leaves] = np.arange(len(leaves))
        self.leaves = len(leaves)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector; of equally near centres the first."""
        out, todo = np.zeros(len(vectors), np.int64), [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            own = self.children[node]
            if not len(own):
                out[rows] = self.leaf[node]
                continue
            near = np.argmin(self.norms[own] - 2 * (vectors[rows] @ self.centres[own].T), axis=1)
            todo += [(int(own[k]), part) for k in range(len(own)) if len(part := rows[near == k])]
        return out

    def visit(self, vector: np.ndarray, visits: int, sizes: np.ndarray, rows: int) -> list[int]:
        """Leaves in the order of a best-bin-first search: so many that hold rows, and until they hold `rows` rows."""
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < visits or held < rows):
            _, node = heapq.heappop(queue)
            own = self.children[node]
            if len(own):
                for d, k in zip((self.norms[own] - 2 * (self.centres[own] @ vector)).tolist(), own.tolist()):
                    heapq.heappush(queue, (d, k))
            elif sizes[self.leaf[node]]:
                found.append(int(self.leaf[node]))
                held += int(sizes[found[-1]])
        return found


def k_means(vectors: np.ndarray, k: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres, and the nearest centre of each vector; centres without vectors are left out."""
    centres = vectors[random.choice(len(vectors), k, replace=False)]
    for _ in range(ROUNDS):
        near = np.argmin((centres**2).sum(1) - 2 * (vectors @ centres.T), axis=1)
        n = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        own = n > 0
        centres = np.add.reduceat(vectors[order], (np.cumsum(n) - n)[own]) / n[own][:, None]
    return centres, np.argmin((centres**2).sum(1) - 2 * (vectors @ centres.T), axis=1)


def fit(vectors: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    """A tree of about so many leaves: a cluster is split while it holds more than its share of the sample, unless all equal."""
    random, most = np.random.default_rng(seed), max(LEAF_SAMPLE, len(vectors) / max(leaves, 1))
    centres, children, todo = [vectors.mean(0) if len(vectors) else np.zeros(vectors.shape[1])], [[]], [(0, vectors)]
    while todo:
        node, own = todo.pop()
        k = min(BRANCH, math.ceil(len(own) / most))
        if k < 2 or leaves < 2 or (own == own[0]).all():
            continue
        found, near = k_means(own, k, random)
        parts = [own[near == j] for j in range(len(found))]
        if max(map(len, parts)) == len(own):
            continue
        for centre, part in zip(found, parts):
            if len(part):
                children[node].append(len(centres))
                todo.append((len(centres), part))
                centres.append(centre)
                children.append([])
    return Tree(np.array(centres), children)


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def matrix(vectors: pa.Array) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1 if len(vectors) else 1)


def nearest(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query its place, and places and distances of the rows that may be among its k nearest with ties by id.

    The product's distances are wrong by less than `slack`; all rows within it of the k-th are measured exactly.
    """
    row_norms, norms = (rows**2).sum(1), (queries**2).sum(1)
    step = max(1, BLOCK // max(len(rows), 1))
    for begin in range(0, len(queries), step):
        part = slice(begin, begin + step)
        near = row_norms - 2 * (queries[part] @ rows.T) + norms[part][:, None]
        near[ids[None, :] == own[part][:, None]] = np.inf
        for q in range(len(near)):
            others = int(np.isfinite(near[q]).sum())
            if not others:
                continue
            slack = 8e-16 * (rows.shape[1] + 8) * (norms[begin + q] + row_norms.max())
            kth = np.partition(near[q], min(k, others) - 1)[min(k, others) - 1]
            at = np.flatnonzero(near[q] <= kth + 2 * slack)
            at = at[np.isfinite(near[q][at])]
            exact = np.sqrt(((rows[at] - queries[begin + q]) ** 2).sum(1))
            order = np.lexsort((ids[at], exact))[:k]
            yield begin + q, at[order], exact[order]


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


FOUND = "query_id long, vec_id long, score double, leaf long"


def all_neighbours(rows: DataFrame, probes: pa.Table, k: int) -> DataFrame:
    """The true k nearest of a bounded number of queries among all rows of (vec_id, leaf, vector), with their leaves."""
    queries, own = matrix(probes.column("vector")), probes.column("vec_id").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaf = (batch.column(c).to_numpy() for c in ("vec_id", "leaf"))
            for q, at, score in nearest(queries, own, matrix(batch.column("vector")), ids, k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), own[q])), pa.array(ids[at]), pa.array(score), pa.array(leaf[at])], ["query_id", "vec_id", "score", "leaf"])

    return ranked(rows.select("vec_id", "leaf", "vector").mapInArrow(run, FOUND), k)


class Index:
    """A fitted tree, all rows with their leaves (written), and the rows of each leaf."""

    def __init__(self, tree: Tree, rows: DataFrame, sizes: np.ndarray):
        self.tree, self.rows, self.sizes = tree, rows, sizes


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> Index:
    own = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = own.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    dim, n = (lengths[0]["length"], lengths[0]["count"]) if lengths else (1, 0)
    own = own.where(F.size("vector") == dim)
    most = max(1, min(sample, SAMPLE_BYTES // (4 * dim)))
    drawn = own.where(F.xxhash64("vec_id", F.lit(1)) % 1_000_000 < F.lit(min(1_000_000, math.ceil(2e6 * most / max(n, 1))))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most)
    fitted_on = matrix(drawn.select("vector").toArrow().column("vector")) if n else np.zeros((0, dim))
    leaves = min(n // leaf_rows, len(fitted_on) // LEAF_SAMPLE, TREE_BYTES // (8 * dim))
    tree = fit(fitted_on, leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(tree.assign(matrix(batch.column("vector")))), batch.column("vector")], ["vec_id", "leaf", "vector"])

    rows = written(own.mapInArrow(run, f"vec_id long, leaf long, vector {dict(vectors.dtypes)[vector]}"), "leaves")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in rows.groupBy("leaf").count().collect():  # a row for each leaf of the bounded tree
        sizes[r["leaf"]] = r["count"]
    return Index(tree, rows, sizes)


def queries_of(index: Index, which: Column | str) -> DataFrame:
    """(vec_id, vector, own rows) of the queries, each id once."""
    return index.rows.where(which).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.count(F.lit(1)).alias("own"))


def calibrate(index: Index, queries: DataFrame, k: int = NEAREST, probes: int = PROBES, recall: float = RECALL) -> int:
    """The visits that meet the wanted share of the true neighbours of a sample of the queries."""
    drawn = queries.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(probes).toArrow()
    true = all_neighbours(index.rows, drawn, k).groupBy("query_id").agg(F.collect_list("leaf").alias("leaves")).collect()  # k leaves for each of the probes
    vectors = dict(zip(drawn.column("vec_id").to_pylist(), matrix(drawn.column("vector")))) if len(drawn) else {}
    needed = []
    for r in true:
        place = {leaf: v + 1 for v, leaf in enumerate(index.tree.visit(vectors[r["query_id"]], index.tree.leaves, index.sizes, 0))}
        needed += [place[leaf] for leaf in r["leaves"]]
    return int(np.sort(needed)[max(0, math.ceil(recall * len(needed)) - 1)]) if needed else 1


def bundles(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each leaf its bundle, neighbouring leaves of `most` rows together, and the rows of each bundle: a larger leaf is one."""
    bundle, rows = np.zeros(len(sizes), np.int64), [0]
    for leaf, n in enumerate(sizes.tolist()):
        if rows[-1] and rows[-1] + n > most:
            rows.append(0)
        bundle[leaf] = len(rows) - 1
        rows[-1] += n
    return bundle, np.array(rows)


def search(index: Index, queries: DataFrame, k: int = NEAREST, visits: int | None = None, cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """The k nearest rows found of each query of (vec_id, vector, own): query_id, rank, vec_id, score."""
    spark, tree, sizes = index.rows.sparkSession, index.tree, index.sizes
    queries = written(queries, "queries")
    visits = visits or calibrate(index, queries, k)
    bundle, held = bundles(sizes, cell_rows)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and bundle, with the leaves that are visited there."""
        for batch in batches:
            at, into, leaves = [], [], []
            for q, (vector, own) in enumerate(zip(matrix(batch.column("vector")), batch.column("own").to_pylist())):
                found = np.array(tree.visit(vector, visits, sizes, k + own), np.int64)
                for b in np.unique(bundle[found]):
                    at.append(q)
                    into.append(b)
                    leaves.append(found[bundle[found] == b])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows), pa.array(into, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), batch.column("vector").take(rows)], ["query_id", "bundle", "leaves", "query"])

    kind = dict(queries.dtypes)["vector"]
    walked = written(queries.mapInArrow(walk, f"query_id long, bundle long, leaves array<long>, query {kind}"), "visits")
    asked = {r["bundle"]: r["count"] for r in walked.groupBy("bundle").count().collect()}  # no more rows than leaves
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = {b: (-(-int(held[b]) // cell_rows), -(-n // cell_queries)) for b, n in asked.items()}
    of_leaf = spark.createDataFrame([(leaf, int(b), *parts[b]) for leaf, b in enumerate(bundle.tolist()) if b in parts], "leaf long, bundle long, row_parts int, query_parts int")
    of_bundle = spark.createDataFrame([(b, *x) for b, x in parts.items()], "bundle long, row_parts int, query_parts int")
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1L)"))
    # both are as small as the tree
    rows = index.rows.join(F.broadcast(of_leaf), "leaf").select("bundle", F.expr("pmod(xxhash64(vec_id), row_parts)").alias("i"), every("query_parts").alias("j"), "leaf", "vec_id", "vector")
    asks = walked.join(F.broadcast(of_bundle), "bundle").select("bundle", every("row_parts").alias("i"), F.expr("pmod(xxhash64(query_id), query_parts)").alias("j"), "query_id", "leaves", "query")
    n = partitions(spark, sum(a * b for a, b in parts.values()), 50)

    def meet(own: pa.Table, asking: pa.Table) -> pa.Table:
        """The nearest of a cell's rows for each of its queries, over all leaves that it visits."""
        ids, leaf, query_ids = (t.column(c).to_numpy() for t, c in ((own, "vec_id"), (own, "leaf"), (asking, "query_id")))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(ids) and len(query_ids):
            rows, vectors, lists = matrix(own.column("vector")), matrix(asking.column("query")), asking.column("leaves").combine_chunks()
            visited, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            for x in np.unique(leaf):
                here, qs = np.flatnonzero(leaf == x), who[visited == x]
                out += [(np.full(len(at), qs[q]), ids[here][at], score) for q, at, score in nearest(vectors[qs], query_ids[qs], rows[here], ids[here], k)]
        q, found, score = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((found, score, q))
        q, found, score = q[order], found[order], score[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < k
        return pa.table([pa.array(query_ids[q[keep]]), pa.array(found[keep]), pa.array(score[keep])], ["query_id", "vec_id", "score"])

    cell = ("bundle", "i", "j")
    met = rows.repartition(n, *cell).groupBy(*cell).cogroup(asks.repartition(n, *cell).groupBy(*cell)).applyInArrow(meet, "query_id long, vec_id long, score double")
    return ranked(met, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "embeddings"))
    return search(index, queries_of(index, F.col("vec_id") % 100 == 0))


QUERIES = {"op12_kmeans_tree": op12_kmeans_tree}
SQL: dict[str, str] = {}
