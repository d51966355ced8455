"""Golden cases of the operators' semantics, and randomised ones against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import chords, histogram, likelihood, matching, overlap, pairs, phrases, reshape, roles, stats, ticks, vectors


def notes(spark, rows):
    return spark.createDataFrame(rows, "p long, side string, pitch long, t0 double, t1 double")


def test_divergence_of_empty_sides(spark):
    h = spark.createDataFrame([(1, "a", 3, 5), (2, "a", 1, 2), (2, "b", 1, 4), (3, "a", 1, 1), (3, "b", 2, 1)], "p long, side string, bin int, n long")
    got = {r.p: r.jsd for r in histogram.jensen_shannon(h, ["p"], "side", ("a", "b")).collect()}
    assert got[1] == pytest.approx(0.5 * math.log(2), abs=1e-6) and got[2] == pytest.approx(0, abs=1e-9) and got[3] == pytest.approx(math.log(2), abs=1e-6)


def test_last_bins_are_closed(spark):
    df = notes(spark, [(1, "a", 0, 0.0, 1.0), (1, "a", 0, 4.0, 4.0), (1, "b", 0, 3.9, 4.0)])
    assert {(r.side, r.bin) for r in histogram.onsets(df, ["p"], "side", bins=4).collect()} == {("a", 0), ("a", 3), ("b", 3)}
    rows = {(r.side, r.bin): r.n for r in histogram.durations(df, ["p"], "side", bins=4).collect()}
    assert rows[("a", 3)] == 1 and rows[("a", 0)] == 1 and sum(rows.values()) == 3


def test_numpy_quantiles_and_single_values(spark):
    rng = random.Random(0)
    rows = [(k % 3, rng.random()) for k in range(100)] + [(7, 2.5), (8, float("nan")), (8, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r.k: r for r in stats.describe(df, ["k"], "v").collect()}
    for k in range(3):
        x = [v for g, v in rows if g == k]
        assert (got[k].p25, got[k].p50, got[k].p75) == pytest.approx(tuple(np.quantile(x, (0.25, 0.5, 0.75))))
        assert got[k].stdev_samp == pytest.approx(np.std(x, ddof=1))
    assert (got[7].variance_samp, got[7].std, got[7].stdev_pop, got[7].iqr) == (0, 0, 0, 0)
    assert got[8]["count"] == 0 and got[8].mean is None
    five = {r.k: r for r in stats.five_number(df, ["k"], "v").collect()}
    assert five[7].q1 == five[7].max == 2.5 and five[8].median is None
    assert df.where("k = 8").agg(stats.summary_struct(F.col("v")).alias("s")).first().s is None


def test_quantiles_of_a_whole_column(spark):
    """Selection against numpy: ties, values of all magnitudes, infinite ones, few and many, small ranges and limits."""
    rng = random.Random(8)
    columns = {
        "even": [rng.random() for _ in range(3000)], "ties": [float(rng.randrange(4)) for _ in range(3000)], "hot": [7.0] * 2000 + [rng.gauss(0, 1) for _ in range(1000)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(2000)], "ends": [-1.7e308, 1.7e308, 0.0, -0.0, 5e-324] * 20, "one": [3.0], "two": [1.0, 2.0], "none": [],
    }
    for name, x in columns.items():
        df = spark.createDataFrame([(v,) for v in x] + [(None,), (math.nan,)], "v double").repartition(3)
        for few, ranges in ((10, 8), (5000, 2048)):
            got = stats.quantiles(df, "v", (0, 0.25, 0.5, 0.75, 0.9, 1), few, ranges)
            if not x:
                assert got == [None] * 6
                continue
            s = sorted(x)
            want = [s[math.floor(a)] + ((s[math.ceil(a)] - s[math.floor(a)]) * (a - math.floor(a)) if s[math.floor(a)] != s[math.ceil(a)] else 0) for q in (0, 0.25, 0.5, 0.75, 0.9, 1) for a in [(len(s) - 1) * q]]
            assert got == want, name
    df = spark.createDataFrame([(v,) for v in columns["hot"] + [math.inf, -math.inf]], "v double")
    assert stats.selection(df, "v", [0, 1, 1500, 3001], 10, 8) == dict(zip([0, 1, 1500, 3001], [(s := sorted(columns["hot"] + [math.inf, -math.inf]))[k] for k in (0, 1, 1500, 3001)]))
    ends = [math.inf] * 900 + [float(k) for k in range(40)] + [-math.inf] * 5
    assert stats.selection(spark.createDataFrame([(v,) for v in ends], "v double"), "v", [2, 20, 44, 45, 944], 3, 4) == {2: -math.inf, 20: 15.0, 44: 39.0, 45: math.inf, 944: math.inf}
    five, whole = stats.five_number(df, [], "v").first(), stats.describe(df.where("v between -9 and 9"), [], "v").first()
    assert (five.q1, five.median, five.q3) == tuple(np.quantile(sorted(columns["hot"]), (0.25, 0.5, 0.75), method="linear")) or five.median == 7.0
    assert whole.p50 == 7.0 and whole["count"] == 3000


def test_boxes_and_densities(spark):
    rng = random.Random(10)
    groups = {"a": [rng.gauss(0, 1) for _ in range(400)] + [9.0, -8.0, 9.0], "b": [1.0, 1.0, 1.0, 5.0], "c": [2.0], "d": [], None: [1.0, 2.0, 3.0, 100.0]}
    df = spark.createDataFrame([(g, x) for g, own in groups.items() for x in own] + [("d", None), ("a", math.nan)], "g string, x double")
    for keys, wanted in ((["g"], {g: x for g, x in groups.items() if x}), ([], {(): [x for own in groups.values() for x in own]})):
        out, far = stats.boxes(df, keys, "x")
        got = {(r.g if keys else ()): r for r in out.collect()}
        assert got.keys() == wanted.keys()
        lost = sorted(r.value for r in far.collect())
        for g, x in wanted.items():
            q1, q2, q3 = np.quantile(x, (0.25, 0.5, 0.75))
            inside = [v for v in x if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
            r = got[g]
            assert (r.q1, r.median, r.q3) == pytest.approx((q1, q2, q3)) and (r.whisker_low, r.whisker_high) == pytest.approx((min(q1, min(inside)), max(q3, max(inside))))
            assert (r.outliers, r["count"]) == (len(x) - len(inside), len(x))
        assert len(lost) == sum(r.outliers for r in got.values())
    rows = {}
    for r in stats.density(df, ["g"], "x", places=200).collect():
        rows.setdefault(r.g, []).append((r.x, r.density))
    assert rows.keys() == {"a", "b", None}
    x, at = np.array(groups["a"]), sorted(rows["a"])
    h = x.std(ddof=1) * len(x) ** -0.2
    want = [np.exp(-(((p - x) / h) ** 2) / 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)) for p, _ in at]
    assert np.allclose([d for _, d in at], want, atol=0.01 * max(want))


def test_bootstrap(spark):
    """All replicas in one pass: the same on any partitioning, as numpy's with the same draws, near the plain estimate."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]]) + [1, 2, 3]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "k long, v array<double>")
    one, two = (vectors.bootstrap(df.repartition(n), "v", 40, 5, "k") for n in (1, 7))
    assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])
    hashes = np.array([r[0] for r in df.where("v is not null").orderBy("k").select(F.xxhash64("k")).collect()], np.int64)
    weights = [vectors.drawn(hashes, r, 5) for r in range(40)]
    assert abs(np.mean(weights) - 1) < 0.05 and abs(np.var(weights) - 1) < 0.1
    means = [np.average(x, axis=0, weights=w) for w in weights]
    covs = [np.cov(x.T, fweights=w.astype(int)) for w in weights]
    assert np.allclose(one[0], np.mean(means, axis=0)) and np.allclose(one[1], np.mean(covs, axis=0))
    assert np.allclose(one[1], np.cov(x.T), rtol=0.2, atol=0.1) and not np.allclose(one[1], vectors.bootstrap(df, "v", 40, 6, "k")[1])
    assert vectors.bootstrap(df.limit(0), "v") is None
    score = vectors.frechet(df.where("k < 150"), df.where("k >= 150"), "v", estimator="bootstrap")
    assert abs(score - vectors.frechet(df.where("k < 150"), df.where("k >= 150"), "v")) < 0.2


def test_tempo(spark):
    """Known tempos, with halves and swing and chords, come back within 2 % up to octaves; a told tempo stays."""
    from tessera.operators import tempo

    rng, rows, want = random.Random(11), [], {}
    for k, bpm in enumerate((81, 90, 99.5, 112, 120, 127.3, 140, 158, 60, 65, 185)):
        t = rng.random()
        for _ in range(120):
            step = rng.choice([1, 1, 1, 0.5, 0.5, 2])
            for pitch in range(rng.choice([1, 3])):
                rows.append((k, 60 + pitch, t + rng.uniform(-0.004, 0.004)))
            t += 60 / bpm * step
        want[k] = bpm
    rows += [(50, 60, 1.0), (51, 60, 0.0), (51, 60, 0.01), (52, 60, None)]
    df = spark.createDataFrame(rows, "p long, pitch long, t0 double")
    got = {r.p: r.tempo for r in tempo.estimated(df, ["p"]).collect()}
    assert got.keys() == want.keys()
    for k, bpm in want.items():
        octaves = math.log2(got[k] / bpm)
        assert abs(octaves - round(octaves)) < math.log2(1.02), (bpm, got[k])
    known = spark.createDataFrame([(0, 75.0), (1, 0.0)], "p long, tempo double")
    told = {r.p: r.tempo for r in tempo.with_tempo(df, known, ["p"]).select("p", "tempo").distinct().collect()}
    assert told[0] == 75.0 and told[1] == got[1] and told[50] == tempo.DEFAULT


def test_consonance(spark):
    rng = random.Random(1)
    m, a = ([(p, rng.randrange(30, 90), t, t + rng.choice([0, 1, 2, 5]) * 0.25) for p in range(4) for t in [rng.randrange(64) * 0.25 for _ in range(20)]] for _ in range(2))
    schema = "p long, pitch long, t0 double, t1 double"
    for width in (0.5, 2.0, 100.0):
        got = {r.p: r for r in overlap.consonance(spark.createDataFrame(m, schema), spark.createDataFrame(a, schema), ["p"], width).collect()}
        for p in range(4):
            total = ok = none = 0.0
            for _, x, s, e in (r for r in m if r[0] == p and r[3] > r[2]):
                met = [y for q, y, s2, e2 in a if q == p and e2 > s and s2 < e]
                total += e - s
                none += 0 if met else e - s
                ok += e - s if any((x - y) % 12 in (0, 3, 4, 7, 8, 9) for y in met) else 0
            assert (got[p].consonant_ratio, got[p].unsupported_ratio) == pytest.approx((ok / total, none / total))
    # a piece without accompaniment has no row; a zero-length accompaniment note strictly inside counts
    alone = overlap.consonance(spark.createDataFrame([(1, 60, 0.0, 1.0), (2, 60, 0.0, 1.0)], schema), spark.createDataFrame([(2, 49, 0.5, 0.5)], schema), ["p"]).collect()
    assert [(r.p, r.dissonant_ratio) for r in alone] == [(2, 1.0)]


def test_overlap_pairs_come_once(spark):
    rng = random.Random(2)
    rows = [(k % 3, k, s, s + rng.choice([0, 0.5, 3, 9])) for k in range(60) for s in [rng.random() * 20 - 5]]
    a = spark.createDataFrame(rows, "p long, i long, a0 double, a1 double")
    b = spark.createDataFrame(rows, "p long, j long, b0 double, b1 double")
    got = sorted((r.i, r.j) for r in overlap.overlapping(a, b, ["p"], ("a0", "a1"), ("b0", "b1"), 1.5).collect())
    assert got == sorted((x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and y[3] > x[2] and y[2] < x[3])


YEAR = 365 * 86400.0


def spans(rng, n, pieces=3):
    """Intervals without length, of a few seconds, of an hour, of days and of a year, some nested, some at edges of buckets."""
    return [(k % pieces, k, t, t + rng.choice([0, 0, 0.5, 2, 2.0001, 4, 64, 3600, 86400 * 3.7, YEAR])) for k in range(n) for t in [rng.choice([rng.random() * 50 - 20, rng.randrange(-4, 9) * 2.0, rng.random() * YEAR])]]


@pytest.mark.parametrize("width", [0.7, 2.0])
def test_intervals_of_any_length(spark, width):
    rng = random.Random(12)
    a, b = spans(rng, 150), spans(rng, 150)
    left, right = spark.createDataFrame([*a, (0, -1, None, 5.0)], "p long, i long, a0 double, a1 double"), spark.createDataFrame([*b, (0, -1, 0.0, None)], "p long, j long, b0 double, b1 double")
    for x, y, one, two in ((left, right, a, b), (left.where("a1 - a0 < 3"), right, [r for r in a if r[3] - r[2] < 3], b), (left, right.where("b1 - b0 < 3"), a, [r for r in b if r[3] - r[2] < 3])):
        got = sorted((r.i, r.j) for r in overlap.overlapping(x, y, ["p"], ("a0", "a1"), ("b0", "b1"), width).collect())
        assert got == sorted((x[1], y[1]) for x in one for y in two if x[0] == y[0] and y[3] > x[2] and y[2] < x[3])
    assert overlap.overlapping(left.limit(0), right, ["p"], ("a0", "a1"), ("b0", "b1"), width).count() == 0


@pytest.mark.parametrize("feature", [histogram.onsets, histogram.durations])
def test_histograms_do_not_sort_notes(spark, feature):
    """A task keeps a number for each piece and the counts of its bins; notes pass by, whatever number a piece has."""
    df = spark.createDataFrame([(k % 3, "ab"[k % 2], 0.5 * k, 0.5 * k + k % 5) for k in range(300)] + [(None, "a", 0.0, 1.0), (7, "a", 0.0, 0.0)], "p long, side string, t0 double, t1 double")
    got = feature(df, ["p"], "side")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan and "Broadcast" not in plan
    assert sorted(((r.p, r.side), r.n) for r in got.groupBy("p", "side").agg(F.sum("n").alias("n")).collect() if r.p < 3) == [((p, s), 50) for p in range(3) for s in "ab"]


def test_bars_send_a_note_once(spark):
    """Notes of a piece of few phrases are compared with them as they are, not dealt to buckets of each level."""
    notes = spark.createDataFrame([(p, 0.5 * k, 0.5 * k + 0.25) for p in range(3) for k in range(40)], "p long, t0 double, t1 double")
    lines = spark.createDataFrame([(p, k, 1.5 * k) for p in range(4) for k in range(11)], "p long, bar_idx int, t double")
    got = phrases.bars(notes, lines, ["p"])
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.p, r.idx, r.w0, r.w1, round(r.rhythm_density, 6)) for r in got.collect()) == [(p, k, 6.0 * k, min(6.0 * k + 6, 15.0), 2.0 * (p < 3)) for p in range(4) for k in range(3)]


def test_bars_count_places_without_sets(spark):
    """Places are bits in sums of fixed size and phrases take part in one join, with crowded pieces, silent phrases and places by the hundred."""
    few = [(0, 0.37 * k, 0.37 * k + 1.5 * (k % 9)) for k in range(41)] + [(0, 0.37, 0.5), (0, -2.0, 0.25), (0, 5.999, 6.0), (1, 0.005, 0.01), (1, 0.0125, 90.0)]
    many = [(2, 3.0 * (k % 40) + 0.01 * k, 3.0 * (k % 40) + 0.01 * k + 1) for k in range(800)]  # 21 phrases of 800 notes: crowded
    lines = [(p, k, 1.5 * k) for p in (0, 1, 3) for k in range(11)] + [(2, k, 6.0 * k) for k in range(82)]
    notes, bars = spark.createDataFrame([*few, *many], "p long, t0 double, t1 double"), spark.createDataFrame(lines, "p long, bar_idx int, t double")
    for chosen in ([0, 1, 3], [0, 1, 2, 3]):
        got = phrases.bars(notes.where(F.col("p").isin(chosen)), bars.where(F.col("p").isin(chosen)), ["p"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "collect_set" not in plan and "ObjectHashAggregate" not in plan
        assert plan.count("SortMergeJoin") == 1 or 2 in chosen
        expected = []
        for p in chosen:
            ts = [t for q, _, t in lines if q == p]
            for idx in range((len(ts) - 2) // 4 + 1):
                w0, w1 = ts[4 * idx], ts[min(4 * idx + 4, len(ts) - 1)]
                met = [(a, b) for q, a, b in [*few, *many] if q == p and b > w0 and a < w1]
                places = {math.floor((a - w0) / 0.01 + 1e-9) for a, _ in met if w0 <= a}
                sounding = sum(min(b, w1) - max(a, w0) for a, b in met)
                expected.append((p, idx, w0, w1, len(places) / (w1 - w0), sounding / (max(min(b, w1) for _, b in met) - w0) if met else 0.0))
        rows = sorted(tuple(r) for r in got.collect())
        assert [r[:4] for r in rows] == [e[:4] for e in expected]
        assert all(r[4:] == pytest.approx(e[4:], abs=1e-9) for r, e in zip(rows, expected))


@pytest.mark.parametrize("most", [0, 1500, 10**6])
def test_crowded_keys_meet_in_buckets(spark, most):
    """All keys crowded, one of three, none: the same pairs, and no side is broadcast however small it looks."""
    rng = random.Random(21)
    a, b = [r for r in spans(rng, 150) if r[0] < 2 or r[1] % 5 == 0], spans(rng, 150)
    left, right = spark.createDataFrame([*a, (0, -1, None, 5.0), (None, -2, 0.0, 5.0)], "p long, i long, a0 double, a1 double"), spark.createDataFrame([*b, (0, -1, 0.0, None), (None, -2, 0.0, 5.0)], "p long, j long, b0 double, b1 double")
    assert overlap.crowded(left, right, ["p"], most).count() == {0: 4, 1500: 2, 10**6: 0}[most]
    met = overlap.overlapping(left, right, ["p"], ("a0", "a1"), ("b0", "b1"), most=most)
    assert sorted((r.i, r.j) for r in met.collect()) == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[3] > x[2] and y[2] < x[3])
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_long_intervals_make_few_rows(spark):
    """A year among notes: tens of rows for it, and two more at most for each note."""
    notes = spark.createDataFrame([(1, k, k * 0.5, k * 0.5 + 1) for k in range(2000)], "p long, i long, a0 double, a1 double")
    year = spark.createDataFrame([(1, 0, 10.0, 10.0 + YEAR), (1, 1, 5.0, 3605.0)], "p long, j long, b0 double, b1 double")
    has, other = overlap.levels(notes, "a0", "a1"), overlap.levels(year, "b0", "b1")
    assert has == [0] and other == [11, 24]
    assert overlap.nodes(year, "b0", "b1", 2.0, has, ("left", "right"), "left").count() <= 12
    assert overlap.nodes(notes, "a0", "a1", 2.0, other, ("left",), "right").count() <= 2 * 3 * 2000
    assert overlap.overlapping(notes, year, ["p"], ("a0", "a1"), ("b0", "b1")).count() == sum(k * 0.5 + 1 > 10 for k in range(2000)) + sum(k * 0.5 + 1 > 5 for k in range(2000))


@pytest.mark.parametrize("kinds", ["both", "melody", "other"])
def test_consonance_with_long_notes(spark, kinds):
    rng = random.Random(4)
    m, a = ([(p, rng.randrange(30, 90), t, e) for p, _, t, e in spans(rng, 80, 8) if long or e - t < 2] for long in (kinds != "other", kinds != "melody"))
    a = [r for r in a if r[0] != 5]
    m, schema = m + m[:7], "p long, pitch long, t0 double, t1 double"
    got = {r.p: r for r in overlap.consonance(spark.createDataFrame(m, schema), spark.createDataFrame(a, schema), ["p"]).collect()}
    assert set(got) == {r[0] for r in m if r[3] > r[2]} - {5}
    for p in got:
        own = [r for r in m if r[0] == p and r[3] > r[2]]
        met = [[(x - y) % 12 in (0, 3, 4, 7, 8, 9) for q, y, s2, e2 in a if q == p and e2 > s and s2 < e] for _, x, s, e in own]
        total = sum(e - s for *_, s, e in own)
        share = lambda f: sum(r[3] - r[2] for r, x in zip(own, met) if f(x)) / total
        assert (got[p].consonant_ratio, got[p].unsupported_ratio) == pytest.approx((share(any), share(lambda x: not x)))


def test_voices_by_sweep_and_in_closed_form(spark):
    rng = random.Random(3)
    events = [(k % 5, s, s + rng.random() * 3) for k in range(80) for s in [rng.random() * 20]]
    df = spark.createDataFrame(events, "p long, t0 double, t1 double")
    met = phrases.tumbling(df, ["p"])
    a = {(r.p, r.w0): r.voice_number for r in phrases.measured(met, ["p"]).collect()}
    b = {(r.p, r.w0): r.voice_number for r in phrases.swept(met, ["p"]).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_bars(spark):
    meta = spark.createDataFrame([(1, 8.0, 120.0, 4), (2, 4.0, 60.0, 2), (3, 4.0, 0.0, None)], "p long, end_time double, tempo double, ts_numerator int")
    downs = spark.createDataFrame([(1, 2.0), (1, 4.0)], "p long, t double")
    beats = spark.createDataFrame([(2, 0.0), (2, 1.0), (2, 2.0), (2, 3.0), (1, 9.0)], "p long, t double")
    got = {}
    for r in sorted(phrases.bar_boundaries(meta, downs, beats, ["p"]).collect(), key=lambda r: (r.p, r.bar_idx)):
        got.setdefault(r.p, []).append(r.t)
    assert got == {1: [0, 2, 4, 8], 2: [0, 2, 4], 3: [0, 2, 4]}


def test_chords(spark):
    assert chords.pitch_classes("C:maj") == (0, (0, 4, 7)) and chords.pitch_classes("Bb:min7") == (10, (1, 5, 8, 10))
    assert chords.pitch_classes("F#:sus4(9)/5") == (6, (1, 6, 8, 11)) and chords.pitch_classes("N") is None and chords.pitch_classes("H:maj") is None
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, "C:maj"), (1, 1, 1.0, 2.0, "N"), (1, 2, 9.0, 10.0, "C:maj")], "p long, seg_idx int, s0 double, s1 double, label string")
    ns = notes(spark, [(1, "a", 60, 0.0, 1.0), (1, "a", 64, 0.0, 1.0), (1, "a", 67, 0.0, 1.0), (1, "a", 61, 1.0, 1.01)])
    vocab = chords.vocabulary(spark, ["C:maj", "A:min"]).join(spark.createDataFrame([("C:maj", 0), ("A:min", 1)], "label string, rank int"), "label")
    found = chords.picked(seg, ns, vocab, ["p"])
    assert {r.seg_idx: r.label for r in found.collect()} == {0: "C:maj", 1: "N", 2: "N"}
    assert chords.accuracy(seg, found, ns, ["p"]).collect() == [(1, 1.0)]


def test_labels_are_read_by_tasks(spark):
    labels = ["C:maj", "C:maj", "N", None, "Bb:min7", "what", "", "F#:sus4(9)/5"] + [f"{n}:{q}" for n in chords.LETTERS for q in chords.SHORTHANDS]
    got = {r.label: (r.root, tuple(r.classes)) for r in chords.parsed(spark.createDataFrame([(x,) for x in labels], "label string").repartition(3)).collect()}
    assert got == {x: chords.pitch_classes(x) for x in labels if x and x != "N" and chords.pitch_classes(x)} and len(got) > 100


def test_ticks(spark):
    df = spark.createDataFrame([("r", 0, True, 40.0), ("r", 0, True, None), ("r", 0, False, 8.0), ("r", 1, True, 16.0), ("r", None, False, None)], "run string, tick int, is_hit boolean, backup_level double")
    got = {r.tick: r for r in ticks.by_tick(df, ["run"]).collect()}
    assert got[0].avg_backup == 40 and got[0].weighted_hit_rate == pytest.approx(-0.25 / 3) and got[1].weighted_hit_rate == 0.5
    g = ticks.of_runs(df, ["run"]).first()
    assert (g.total_samples, g.total_hits, g.global_hit_rate, g.global_avg_backup) == (5, 3, 0.6, 28) and g.ISR_w == pytest.approx((0.5 - 0.25 / 3) / 2)
    t = spark.createDataFrame([("r", 3, 2 / 6, None, None), ("r", 3, None, 1.0, 2.0), ("r", 3, None, None, 2.0), ("r", None, 9.0, None, None)], "run string, frames int, round_trip_time double, request_arrival_time double, response_output_time double")
    d = ticks.deadlines(t, ["run"]).first()
    assert (d.n, d.n_miss, d.dmr) == (2, 1, 0.5)


def test_likelihood_shapes(spark):
    texts = ['{"a.mid": {"avg_nll": 2.0, "total_nll": 8, "total_tokens": 4}, "b.mid": {"error": "x"}}', '[{"file": "c", "avg_nll": 1.5}]', '{"entries": [{"file": "d", "total_nll": 6, "total_tokens": 3}]}', '{"results": [{"file": "e", "avg_nll": 1}]}', '{"summary": {"avg_nll": 4.0}}', '{"avg_nll": 5.0, "total_tokens": 0}']
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "run long, text string").withColumn("doc", F.try_parse_json("text"))
    rows = likelihood.records(docs, ["run"])
    got = sorted((r.run, r.file or "", r.avg_nll, r.total_nll, r.total_tokens, r.error) for r in rows.collect())
    assert got == [(0, "a.mid", 2.0, 8.0, 4, None), (0, "b.mid", None, None, None, "x"), (1, "c", 1.5, None, None, None), (2, "d", None, 6.0, 3, None), (3, "e", 1.0, None, None, None), (4, "", 4.0, None, None, None), (5, "", 5.0, None, 0, None)]
    assert {r.run: r.value for r in likelihood.values(rows).where("run in (2, 5)").collect()} == {2: 2.0, 5: 5.0}
    one = docs.limit(1).select(likelihood.aliased(F.try_parse_json(F.lit('{"avg_nll": 0, "mean_nll": 3, "sum_nll": 6, "tokens": 2}'))).alias("x")).first().x
    assert tuple(one) == (3.0, 6.0, 2.0)


def test_names(spark):
    names = ["interval_2_gen_frame_5", "gen7_interval3_gen4", "Interval-9", "gen_8", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r.x) for r in df.select(S.interval_gen(F.col("n")).alias("x")).collect()]
    assert got == [(2, 5), (3, 4), (None, None), (None, 8), (None, None)]
    key = lambda *v: [tuple(r) for r in spark.createDataFrame([(x,) for x in v], "n string").orderBy(S.natural_key(F.col("n"))).collect()]
    assert [x for (x,) in key("m10", "m2", "M1", "a-b", "a1")] == ["a1", "a-b", "M1", "m2", "m10"]
    stems = spark.createDataFrame([(x,) for x in ("x.mid.mid", "a/X.MID", "y.tar.gz", "z")], "n string").select(S.stem(F.col("n"))).collect()
    assert [r[0] for r in stems] == ["x", "X", "y.tar", "z"]
    assert S.header(["Prompt", "ISR_w"], "isr w") == "ISR_w" and S.header(["abc"], "x") is None
    frames = df.limit(1).select(S.nearest_frames(F.lit("a/gen_frame_3/b_gen-frame-5/c"))).first()[0]
    assert frames == 5
    folders = df.limit(1).select(S.run_folder(F.lit("interval2_gen5_prompt1_x")).alias("a"), S.run_folder(F.lit("offline_1")).alias("b")).first()
    assert tuple(folders) == ("interval_2_gen_frame_5/prompt1_x", "offline_1")
    assert df.limit(1).select(S.report_id(F.lit("a_b_c_prompt3_x"))).first()[0] == "a_b_c"


def test_ranked_rules(spark):
    rows = spark.createDataFrame([("interval_1_gen_2",), ("abc",), ("a_bc",), ("",)], "name string")
    cands = spark.createDataFrame([("interval1gen_frame2",), ("x_interval_1_gen_2",), ("zz_abc",), ("ABC",)], "candidate string")
    got = {r.name: (r.candidate, r.rule) for r in matching.ranked(rows, cands).collect()}
    assert got == {"interval_1_gen_2": ("interval1gen_frame2", "numeric"), "abc": ("ABC", "containment"), "a_bc": ("ABC", "plain_within"), "": (None, None)}
    got = {r.name: (r.candidate, r.rule) for r in matching.ranked(rows, cands, rules=matching.LIKELIHOOD_RULES).collect()}
    assert got["interval_1_gen_2"] == ("x_interval_1_gen_2", "containment") and got["abc"] == ("ABC", "exact")


def test_containment_in_texts_of_any_length(spark):
    """Names within texts, against `in`: short and long names, other alphabets, texts that end in a name, 10 MB."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé日") for _ in range(rng.randrange(0, 400))) for _ in range(60)] + ["", "x", "日", None]
    names = [t[k : k + n] for t in texts if t for k in [rng.randrange(len(t))] for n in [rng.choice([1, 2, 3, 7, 64, 65, 130, 400])]] + ["", None, "zz", "日", "x"]
    a, b = spark.createDataFrame([(n,) for n in names] * 2, "a string"), spark.createDataFrame([(t,) for t in texts], "b string")
    got = sorted((r.a, r.b) for r in matching.within(a, b, "a", "b").collect())
    assert got == sorted((n, t) for n in names * 2 for t in texts if n and t is not None and n in t)
    stretch = matching.STRETCH
    long = "".join(rng.choices("abcdefgh ", k=10_000_000))
    wanted = [long[k : k + n] for k in (0, stretch - 40, stretch, 3 * stretch - 1, len(long) - 200) for n in (33, 64, 200)]
    a, b = spark.createDataFrame([(n,) for n in wanted + ["not there at all, I hope"]], "a string"), spark.createDataFrame([(long,), ("short",)], "b string")
    assert sorted(r.a for r in matching.within(a, b, "a", "b").select("a").collect()) == sorted(wanted)
    assert matching.within(a.limit(0), b, "a", "b").count() == 0


def test_prompts_and_files(spark):
    truth = spark.createDataFrame([("/d/prompt8/gt/x.mid.mid",), ("/d/other/y.mid",)], "path string")
    listing = spark.createDataFrame([("/d/x_promptlen8.mid",), ("/d/prompt8/x.mid_promptlen8.mid",), ("/d/y_promptlen8.mid",)], "path string")
    assert matching.prompt_files(truth, listing).collect() == [("/d/prompt8/gt/x.mid.mid", "/d/prompt8/x.mid_promptlen8.mid")]
    keys = spark.createDataFrame([("k1",), ("offline_1",), ("none",)], "key string")
    paths = spark.createDataFrame([("a/k1/x",), ("a/k1/b",), ("q/generated_without_prompt/z",)], "path string")
    assert {tuple(r) for r in matching.resolved(keys, paths).collect()} == {("k1", "a/k1/b"), ("offline_1", "q/generated_without_prompt/z")}


def test_order_of_a_whole_table(spark):
    """Numbers and next rows against sorted lists: many and few partitions, nulls, ties told apart, none and one row."""
    from tessera.operators.ordering import Ordered

    rng = random.Random(9)
    rows = [(rng.choice(["b10", "b9", "a", None, "Zz", "z"]), k, rng.random()) for k in range(500)]
    for n, parts in ((500, 1), (500, 13), (3, 13), (1, 2), (0, 2)):
        df = spark.createDataFrame(rows[:n], "s string, k long, v double").repartition(parts)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts + 2))
        try:
            got = Ordered(df, [F.col("s"), F.col("k")])
            want = sorted(rows[:n], key=lambda r: (r[0] is not None, r[0] or "", r[1]))
            assert sorted((r.n, r.s, r.k, r.v) for r in got.numbered("n").collect()) == [(k, *r) for k, r in enumerate(want)]
            after = [*[r[2] for r in want[1:]], None][:n]
            assert [r.after for r in sorted(got.with_next(F.col("v"), "after").collect(), key=lambda r: r.place)] == after
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    plan = Ordered(spark.range(100), [F.col("id")]).with_next(F.col("id"), "x")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_pairs_of_a_hot_group(spark):
    """One group of many blocks among small ones: each pair once, and no task gets more than two blocks of it."""
    rows = [("hot", k, float(k % 7)) for k in range(300)] + [(f"s{k % 20}", k, k / 2) for k in range(60)] + [(None, 1, 0.0)]
    df = spark.createDataFrame(rows, "g string, idx long, v double")
    got = pairs.same_group(df, ["g"], "idx", ["v"], block=16)
    want = sorted((x[0], x[1], y[1], abs(x[2] - y[2])) for x in rows for y in rows if x[0] is not None and x[0] == y[0] and x[1] < y[1])
    assert sorted(tuple(r) for r in got.collect()) == want
    wide = df.where("g = 'hot'").join(df.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / 16).alias("k")), "g").withColumn("own", F.pmod(F.xxhash64("idx"), F.col("k")))
    assert wide.groupBy("own").count().agg(F.max("count")).first()[0] <= 40


def test_paths_of_metrics(spark):
    import tessera

    keys = spark.createDataFrame([("interval2_gen5_prompt_1_gen_2",), ("offline_x_y",), ("short_key",), ("interval9_gen9_z",)], "key string")
    listed = spark.createDataFrame([("file:/r/nll_runs/b_interval_2_gen_frame_5_prompt_1_gen_2.json",), ("records/nll_runs/a_interval_2_gen_frame_5_prompt_1_gen_2",), ("records/nll_runs/c_interval_2_gen_frame_5_prompt_1_gen_2",), ("records/nll_runs/generated_without_prompt",), ("records/other/interval_9_gen_frame_9_z",)], "path string")
    of = lambda *a, **b: {r.key: (r.path, r.error) for r in tessera.metric_paths(keys, *a, **b).collect()}
    assert of("pitch_jsd", "r/")["offline_x_y"] == ("r/offline_x_y.json", None)
    raw = of("hit_rate")
    assert raw["interval2_gen5_prompt_1_gen_2"] == ("records/raw/realtime/baseline/interval_2_gen_frame_5/prompt_1_gen_2/batch_run", None) and raw["short_key"] == (None, "too few parts: short_key")
    assert of("nll", listed=listed) == {
        "interval2_gen5_prompt_1_gen_2": ("records/nll_runs/a_interval_2_gen_frame_5_prompt_1_gen_2", None), "offline_x_y": ("records/nll_runs/generated_without_prompt", None),
        "short_key": (None, "too few parts: short_key"), "interval9_gen9_z": (None, "no file for interval_9_gen_frame_9_z"),
    }
    with pytest.raises(ValueError):
        tessera.metric_paths(keys, "other")


def test_random_pairs(spark):
    df = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("v"))
    every = pairs.at_random(df, "k", ["v"], 780).collect()
    assert {(r.first, r.second) for r in every} == {(a, b) for b in range(40) for a in range(b)}
    some = pairs.at_random(df, "k", ["v"], 50).collect()
    assert len({(r.first, r.second) for r in some}) == 50 and all(r.diff_v == r.second - r.first for r in some)


def test_all_pairs_come_from_blocks(spark):
    """Pairs are made by the join that writes them; nothing has a row for each pair before it, and nothing is broadcast."""
    for n in (0, 1, 16, 50):
        df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("v"))
        got = pairs.every(df, "k", ["v"], n, block=16)
        assert sorted((r.first, r.second, r.diff_v) for r in got.collect()) == [(a, b, b - a) for a in range(n) for b in range(a + 1, n)]
    plan = pairs.at_random(df, "k", ["v"], 2**63 - 1)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Join") == 1


@pytest.mark.parametrize("n", [3, 40, 41])
def test_a_sample_of_pairs_is_not_sorted(spark, n):
    """Numbers of pairs in random order, each once; their sample neither sorts nor gathers them in one task."""
    total = n * (n - 1) // 2
    assert sorted(r._k for r in pairs.shuffled(spark, n, total, 42).collect()) == list(range(total))
    plan = pairs.shuffled(spark, n, total - 1, 42)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "TakeOrdered", "Sort", "Limit"))
    if n > 3:
        half = [r._k for r in pairs.shuffled(spark, n, total // 2, 42).collect()]
        assert total * 0.4 < sum(half) / len(half) < total * 0.6 and half != [r._k for r in pairs.shuffled(spark, n, total // 2, 43).collect()]


def rows_sent(df, exchange: str = "BroadcastExchange", metric: str = "numOutputRows") -> list[int]:
    """Rows of each broadcast or other exchange of a plan, which this runs."""

    def of(node):
        kind = node.nodeName()
        below = [node.executedPlan()] if kind.startswith("AdaptiveSparkPlan") else [node.plan()] if kind.endswith("QueryStage") else [node.children().apply(k) for k in range(node.children().size())]
        return ([node.metrics().apply(metric).value()] if kind == exchange else []) + [x for b in below for x in of(b)]

    df.collect()
    return of(df._jdf.queryExecution().executedPlan())


def test_all_pairs_send_as_much_as_the_table_has(spark):
    """Blocks grow with the table: a row is sent 31 times at most, where it was sent once for each block of a size."""
    df = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("v"))
    got = pairs.every(df, "k", ["v"], 90, block=1)
    assert sum(rows_sent(got, "Exchange", "shuffleRecordsWritten")) == 90 * 31
    assert sorted((r.first, r.second, r.diff_v) for r in got.collect()) == [(a, b, b - a) for a in range(90) for b in range(a + 1, 90)]


def test_rounded_as_round_does(spark):
    rng = np.random.default_rng(1)
    odd = [0.0, -0.0, 5e-7, -5e-7, 1.5e-6, 2.5e-6, 1.0000005, 1.0000015, -1.0000025, 1e-7, -1e-7, 0.1 + 0.2, 2.0**43 / 1e6, 9e6, 1e9, 1e22, 1e300, float("inf"), float("-inf"), float("nan"), None]
    values = odd + [float(x) for m in (1, 100, 1e4, 1e7) for x in rng.normal(0, m, 1000)] + [float(x) / 2e6 for x in rng.integers(-(10**9), 10**9, 1000)]
    df = spark.createDataFrame([(x,) for x in values], "x double").select("x", F.round("x", 6).alias("a"), S.rounded(F.col("x"), 6).alias("b"))
    assert [r for r in df.collect() if repr(r.a) != repr(r.b)] == []


@pytest.mark.parametrize("sent", [50, 49])
def test_a_sample_of_pairs_is_light_on_the_driver(spark, tmp_path, monkeypatch, sent):
    """Its plan doesn't write out all rounds of the shuffling in conditions, and rows are never broadcast, picks where they are few."""
    monkeypatch.setattr(pairs, "SENT", sent)
    spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("v")).write.parquet(str(tmp_path / "rows"))
    got = pairs.at_random(spark.read.parquet(str(tmp_path / "rows")), "k", ["v"], 50)
    assert len({(r.first, r.second) for r in got.collect()}) == 50 and all(r.diff_v == r.second - r.first > 0 for r in got.collect())
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert rows_sent(got) == [50, 50] * (sent == 50)


def test_drawn_pairs_broadcast_no_table(spark, sf_dir):
    from tessera.plans import bindings

    df = bindings.QUERIES["random_pairs_drawn"](spark, sf_dir)
    assert df.collect() == [(500, 500, 0)] and max(rows_sent(df)) <= 500
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 50_000


def test_pairs_of_large_numbers(spark):
    """Beyond 2^53, where doubles skip whole numbers."""
    want = {j * (j - 1) // 2 + i: (i, j) for j in (1, 2, 3, 40, 2**26 + 1, 10**8 + 7, 2**28 + 3, 2**30 + 1, 3 * 10**9) for i in (0, j // 2, j - 1)}
    i, j = pairs.pair_of(F.col("k"))
    assert {r.k: (r.i, r.j) for r in spark.createDataFrame([(k,) for k in want], "k long").select("k", i.alias("i"), j.alias("j")).collect()} == want


TEXT = """Accompaniment:
  Pitch JSD:
    mean: 0.2
    min: 0.1
    q1: 0.15
    median: 0.2
    q3: 0.3
    max: 0.4
  Onset JSD:
    min: n/a
  Frechet Music Distance: 12.5
  Harmonicity:
    consonant ratio:
      mean: 0.5
    unsupported ratio:
      mean: 0.25
  Chord Accuracy:
      mean: 0.75
  Prompt Latents:
    txt mean distance:
      mean: 3.5
      max: 9
    chd mean distance:
      mean: 1.5
"""


def test_printed_summaries(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "Frechet Music Distance: n/a"), (3, None)], "p long, t string")
    blocks = reshape.divergence_blocks(df, ["p"], "t").collect()
    assert [(r.p, r.metric, r.q1, r.max) for r in blocks] == [(1, "Pitch JSD", 0.15, 0.4)]
    assert {r.p: r.frechet for r in reshape.frechet_line(df, ["p"], "t").collect()} == {1: 12.5, 2: None, 3: None}
    assert {r.ratio: r.mean for r in reshape.ratio_means(df, ["p"], "t").collect()} == {"consonant ratio": 0.5, "unsupported ratio": 0.25}
    got = reshape.section_means(df, ["p"], "t", {"Prompt Latents": "continuation"}, "txt mean distance").collect()
    assert [(r.p, r.section, r.mean) for r in got] == [(1, "continuation", 3.5)]


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 3)), rng.normal(1, 2, size=(50, 3))
    a, b = (spark.createDataFrame([(v.tolist(),) for v in m], "e array<double>") for m in (x, y))
    s1, s2 = np.cov(x.T), np.cov(y.T)
    values = np.linalg.eigvals(s1 @ s2)
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * np.sqrt(values.real.clip(0)).sum()
    assert vectors.frechet(a, b, "e") == pytest.approx(want, rel=1e-6) and vectors.frechet(a, a, "e") == pytest.approx(0, abs=1e-6)
    assert vectors.frechet(a, b.limit(0), "e") is None
    for name in vectors.ESTIMATORS:  # the shrunk ones keep the mean variance
        mean, cov = vectors.gaussian(a, "e", estimator=name)
        x = np.array([r.e for r in a.collect()])
        n, d = x.shape
        s = np.cov(x.T, ddof=1 if name == "mle" else 0)
        if name == "ledoit_wolf":
            c = x - x.mean(axis=0)
            delta = ((s - np.trace(s) / d * np.eye(d)) ** 2).sum()
            share = min(1, sum(((np.outer(v, v) - s) ** 2).sum() for v in c) / n**2 / delta)
        elif name == "oas":
            share = min(1, ((1 - 2 / d) * (s**2).sum() + np.trace(s) ** 2) / ((n + 1 - 2 / d) * ((s**2).sum() - np.trace(s) ** 2 / d)))
        else:
            share = {"mle": 0, "shrinkage": vectors.SHRINKAGE}[name]
        assert np.allclose(cov, (1 - share) * s + share * np.trace(s) / d * np.eye(d)) and np.allclose(mean, x.mean(axis=0))


def test_roles(spark):
    rows = [(1, " Guitar", 25, 0, False), (1, "", 0, 1, False), (1, "drums", 0, 2, True), (1, "Piano ", 0, 3, False), (2, None, 5, 0, False)]
    df = spark.createDataFrame(rows, "p long, name string, program int, track_idx int, is_drum boolean").withColumn("t0", F.lit(0.0)).withColumn("t1", F.lit(1.0))
    m = roles.is_melody(names=["guitar", ""], programs=[7], indices=[9])
    assert roles.melody_notes(df, m).count() == 1 and roles.accompaniment(df, m).count() == 3 and roles.accompaniment(df, m, keep_melody=True, include_drums=True).count() == 5
    assert sorted((r.p, r.track_idx) for r in roles.ground_truth(df, ["p"]).collect()) == [(1, 3), (2, 0)]
    assert roles.continuation(df, F.lit(0.5)).first().t0 == 0.5 and roles.continuation(df, F.lit(None).cast("double")).count() == 5
    assert roles.renamed(df, "guit", "G", contains=True).where("name = 'G'").count() == 1


def test_boundaries(spark):
    df = spark.createDataFrame([(x,) for x in ("interval10_gen1", "interval2_gen1", "interval2_gen3", "offline")], "m string")
    got = reshape.boundaries(df, "m").orderBy("place").collect()
    assert [(r.group, r.member, r.last_of_group) for r in got] == [("interval2", "gen1", False), ("interval2", "gen3", True), ("interval10", "gen1", True), ("offline", "", True)]
