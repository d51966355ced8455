"""Distances of embeddings, the Frechet distance of two sets, and window features of notes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.overlap import overlapping

STEPS = 32
STEPS_A_BEAT = 4
#: Gaussian estimators of a set's covariance: plain, with a fixed share of its mean variance, and two that choose the share;
#: and one that is the mean over resampled sets.
ESTIMATORS = ("mle", "shrinkage", "ledoit_wolf", "oas")
RESAMPLED = "bootstrap"
SHRINKAGE = 0.1
#: Resampled sets, of which a task holds the sums of so many bytes at a time; and the draws' seed.
REPLICAS, REPLICA_BYTES, SEED = 100, 64 << 20, 11
#: A row is in a resampled set 0, 1, 2 ... times with these cumulated chances: of the Poisson distribution with mean 1.
TIMES = np.cumsum([1 / (math.e * math.factorial(k)) for k in range(18)])


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def paired_distance(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, mean and std (of the population) of the distances of pairs."""
    d = l2(F.col(a), F.col(b))
    return pairs.groupBy(*keys).agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.count(d).alias("n"))


def means(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, dim, mean."""
    return rows.select(*keys, F.posexplode(vector).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


MOMENTS = "i int, j int, n long, si double, sj double, sij double"


def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's vectors and of their products, by number of dimensions."""
    held: dict[int, list] = {}
    for batch in batches:
        lists = batch.column(0).cast(pa.large_list(pa.float64()))
        lengths = np.diff(lists.offsets.to_numpy())
        for d in np.unique(lengths).tolist():
            rows = lists.filter(pa.array(lengths == d)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            have = held.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
            have[0] += len(rows)
            have[1] += rows.sum(axis=0)
            have[2] += rows.T @ rows
    for d, (n, total, products) in held.items():
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), n)), pa.array(total[i]), pa.array(total[j]), pa.array(products[i, j])], ["i", "j", "n", "si", "sj", "sij"])


def drawn(hashes: np.ndarray, replica: int, seed: int) -> np.ndarray:
    """How often each row is in a resampled set: by its hash, so that any partitioning draws the same."""
    mixed = lambda x, k: (x ^ (x >> np.uint64(k))) * np.uint64(0xD6E8FEB86659FD93)
    at = mixed(mixed(hashes.view(np.uint64) ^ mixed(np.full(len(hashes), (seed << 32) + replica + 1, np.uint64), 29), 32), 29)
    return np.searchsorted(TIMES, (at >> np.uint64(11)) / 2.0**53, side="right").astype(float)


def resampled_moments(rows: DataFrame, vector: str, replicas: int = REPLICAS, seed: int = SEED, key: str | None = None) -> DataFrame:
    """replica, i, j, n, si, sj, sij of resampled sets of the vectors, all in one pass over the rows.

    A task holds the sums of all sets, REPLICA_BYTES at most: fewer sets are asked of long vectors. Each row is in each set as often as a Poisson number says that its hash draws: of key, or else of the vector, so that
    equal vectors are drawn together then.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            lists = batch.column("v")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            if not len(x):
                continue
            hashes, d = batch.column("h").to_numpy(), x.shape[1]
            if not held:
                held = {r: [np.zeros(1), np.zeros(d), np.zeros((d, d))] for r in range(replicas)}
            for r, have in held.items():
                w = drawn(hashes, r, seed)
                have[0] += w.sum()
                have[1] += w @ x
                have[2] += (x * w[:, None]).T @ x
        for r, (n, total, products) in held.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), r, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), n[0])), pa.array(total[i]), pa.array(total[j]), pa.array(products[i, j])], ["replica", "i", "j", "n", "si", "sj", "sij"])

    dim = rows.where(F.col(vector).isNotNull()).agg(F.max(F.size(vector))).first()[0] or 1
    replicas = max(1, min(replicas, REPLICA_BYTES // (8 * dim * dim)))
    own = rows.where(F.size(vector) == dim).select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(F.col(key or vector)).alias("h"))
    got = own.mapInArrow(sums, "replica int, i int, j int, n double, si double, sj double, sij double")
    return got.groupBy("replica", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])


def bootstrap(rows: DataFrame, vector: str, replicas: int = REPLICAS, seed: int = SEED, key: str | None = None, ddof: int = 1) -> tuple[np.ndarray, np.ndarray] | None:
    """Means over resampled sets of their mean and covariance; sets of too few rows are left out. Null without any.

    Only sums over the sets come to the driver: a number for each pair of dimensions.
    """
    one = resampled_moments(rows, vector, replicas, seed, key).where(F.col("n") > ddof)
    means = [(F.col(c) / F.col("n")).alias(c) for c in ("si", "sj")]
    cov = ((F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - ddof)).alias("sij")
    got = one.select("i", "j", *means, cov).groupBy("i", "j").agg(*[F.avg(c).alias(c) for c in ("si", "sj", "sij")]).toArrow()
    if not len(got):
        return None
    i, j, si, sj, sij = (got.column(c).to_numpy() for c in ("i", "j", "si", "sj", "sij"))
    d = int(j.max()) + 1
    mean, out = np.zeros(d), np.zeros((d, d))
    mean[i] = si
    mean[j] = sj
    out[i, j] = out[j, i] = sij
    return mean, out


def moments(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, i, j, n, si, sj, sij of all pairs of dimensions: sums that tasks add up for themselves.

    Without keys a task sends its sums once, however many vectors it has; vectors hold no nulls then.
    """
    if not keys:
        sums = rows.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInArrow(gram, MOMENTS)
        return sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])
    own = rows.select(*keys, F.col(vector).alias("_v")).where("_v is not null")
    pairs = own.select(*keys, "_v", F.posexplode("_v").alias("i", "x")).select(*keys, "i", "x", F.posexplode("_v").alias("j", "y")).where("i <= j")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return pairs.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("si"), F.sum(y).alias("sj"), F.sum(x * y).alias("sij"))


def shrunk(cov: np.ndarray, share: float) -> np.ndarray:
    return (1 - share) * cov + share * np.trace(cov) / len(cov) * np.eye(len(cov))


def gaussian(rows: DataFrame, vector: str, ddof: int = 1, estimator: str = "mle") -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and covariance of a set; null with too few rows. The others of ESTIMATORS start from the covariance by n."""
    if estimator not in (*ESTIMATORS, RESAMPLED):
        raise ValueError(f"{estimator}: not one of {', '.join((*ESTIMATORS, RESAMPLED))}")
    if estimator == RESAMPLED:
        return bootstrap(rows, vector, ddof=ddof)
    got = moments(rows, [], vector).toArrow()  # dimensions squared, which the result has too
    ddof = ddof if estimator == "mle" else 0
    if not len(got) or got.column("n")[0].as_py() <= ddof:
        return None
    i, j, n, si, sj, sij = (got.column(c).to_numpy() for c in ("i", "j", "n", "si", "sj", "sij"))
    d = int(j.max()) + 1
    mean, cov = np.zeros(d), np.zeros((d, d))
    mean[i] = si / n
    cov[i, j] = cov[j, i] = (sij - si * sj / n) / (n - ddof)
    if estimator == "shrinkage":
        return mean, shrunk(cov, SHRINKAGE)
    square, n = float((cov**2).sum()), int(n[0])
    if estimator == "ledoit_wolf":
        gap = F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, mean.tolist())), lambda x, m: (x - m) * (x - m))
        fourth = rows.where(F.col(vector).isNotNull()).agg(F.sum(F.pow(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x), F.lit(2)))).first()[0]
        spread = square - np.trace(cov) ** 2 / d
        return mean, shrunk(cov, min(1.0, max(0.0, (fourth / n - square) / n / spread)) if spread > 0 else 1.0)
    if estimator == "oas":
        trace = float(np.trace(cov)) ** 2
        below = (n + 1 - 2 / d) * (square - trace / d)
        return mean, shrunk(cov, min(1.0, ((1 - 2 / d) * square + trace) / below) if below > 0 else 1.0)
    return mean, cov


def frechet(a: DataFrame, b: DataFrame, vector: str, ddof: int = 1, estimator: str = "mle") -> float | None:
    """|m1 - m2|^2 + trace(S1 + S2 - 2 (S1 S2)^(1/2)) of two sets' moments."""
    one, two = gaussian(a, vector, ddof, estimator), gaussian(b, vector, ddof, estimator)
    if one is None or two is None:
        return None
    (m1, s1), (m2, s2) = one, two
    values, axes = np.linalg.eigh(s1)
    root = axes * np.sqrt(np.clip(values, 0, None)) @ axes.T
    inner = np.sqrt(np.clip(np.linalg.eigvalsh(root @ s2 @ root), 0, None)).sum()
    return float(((m1 - m2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * inner)


def roll(notes: DataFrame, keys: list[str], tempo: Column, steps: int = STEPS) -> DataFrame:
    """keys, win, step, pitch, dur: notes on a grid of sixteenths in windows of `steps`; a cell keeps the longest."""
    step = 15.0 / tempo
    first = F.floor(F.col("t0") / step)
    last = F.greatest(first + 1, F.ceil(F.col("t1") / step))
    rows = notes.withColumn("_a", first).withColumn("_b", last)
    rows = rows.withColumn("win", F.explode(F.sequence(F.floor(F.col("_a") / steps), F.floor((F.col("_b") - 1) / steps))))
    at = F.greatest(F.lit(0), F.col("_a") - F.col("win") * steps)
    end = F.least(F.lit(steps), F.col("_b") - F.col("win") * steps)
    return rows.groupBy(*keys, "win", at.cast("int").alias("step"), "pitch").agg(F.max(end - at).cast("int").alias("dur"))


def beat_chords(notes: DataFrame, beats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, beat, root (the pitch class that sounds longest, the lower on ties), chroma (12 flags), bass (lowest pitch).

    beats: keys, beat, b0, b1.
    """
    met = overlapping(beats.select(*keys, "beat", "b0", "b1"), notes.select(*keys, "pitch", "t0", "t1"), keys, ("b0", "b1"), ("t0", "t1"))
    pc = F.pmod("pitch", F.lit(12)).cast("int")
    by_class = met.groupBy(*keys, "beat", pc.alias("pc")).agg(F.sum(F.least("b1", "t1") - F.greatest("b0", "t0")).alias("w"), F.min("pitch").alias("low"))
    out = by_class.groupBy(*keys, "beat").agg(F.max_by("pc", F.struct("w", -F.col("pc"))).alias("root"), F.collect_set("pc").alias("_s"), F.min("low").alias("bass"))
    return out.select(*keys, "beat", "root", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.array_contains("_s", k).cast("int")).alias("chroma"), "bass")
