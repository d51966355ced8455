"""Queries of the driver contract, bound to the supplied tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import chords, histogram, likelihood, matching, overlap, pairs, phrases, reshape, roles, stats, ticks, vectors
from tessera.operators.ordering import Ordered
from tessera.plans import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
SIDES = (V.GENERATED, V.TRUTH)


def query(sql: str | None = None, *views: str):
    """Registers a function of (spark, sf_dir) with its SQL over the views, under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {', '.join(views)} " if views else "") + sql
        return f

    return add


def rounded(df, digits: int = 6):
    """Doubles rounded, so that the order of sums doesn't show; numbers of 32 bits as 64."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append(F.round(c, digits).alias(name) if kind == "double" else c.cast("long").alias(name) if kind == "int" else c)
    return df.select(*out)


def melody():
    return roles.is_melody(names=["guitar"])


JSD = """h AS (SELECT piece_id, bin, sum(CASE WHEN side = 'generated' THEN n ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN side = 'ground_truth' THEN n ELSE 0 END)::DOUBLE AS b FROM hist GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN sum(a) OVER w > 0 THEN a / sum(a) OVER w ELSE 0 END AS p, CASE WHEN sum(b) OVER w > 0 THEN b / sum(b) OVER w ELSE 0 END AS q FROM h WINDOW w AS (PARTITION BY piece_id)),
jsd AS (SELECT piece_id, sum((CASE WHEN p > 0 THEN p * ln((p + 1e-10) / ((p + q) / 2 + 1e-10)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln((q + 1e-10) / ((p + q) / 2 + 1e-10)) ELSE 0 END) / 2) AS jsd FROM s GROUP BY 1)"""
PITCH = "hist AS (SELECT piece_id, side, pitch AS bin, count(*) AS n FROM notes GROUP BY 1, 2, 3)"
ONSET = """len AS (SELECT piece_id, max(t1) AS length FROM notes GROUP BY 1),
hist AS (SELECT piece_id, side, least(63, floor(greatest(0, least(1, t0 / length)) * 64))::BIGINT AS bin, count(*) AS n FROM notes JOIN len USING (piece_id) WHERE length > 0 GROUP BY 1, 2, 3)"""
DURATION = """tops AS (SELECT piece_id, quantile_cont(greatest(0, t1 - t0), 0.995) AS q FROM notes GROUP BY 1),
d AS (SELECT piece_id, side, greatest(0, t1 - t0) AS d, CASE WHEN q > 0 THEN q ELSE 1e-3 END AS top, (CASE WHEN q > 0 THEN q ELSE 1e-3 END) / 64 AS step FROM notes JOIN tops USING (piece_id)),
g AS (SELECT *, floor(d / step) AS g FROM d),
hist AS (SELECT piece_id, side, (CASE WHEN d >= top THEN 63 ELSE least(63, CASE WHEN d < g * step THEN g - 1 WHEN d >= (g + 1) * step THEN g + 1 ELSE g END) END)::BIGINT AS bin, count(*) AS n FROM g GROUP BY 1, 2, 3)"""


def hist_of(feature: str, notes):
    keys = ["piece_id"]
    made = {"pitch": lambda: histogram.pitches(notes, [*keys, "side"]), "onset": lambda: histogram.onsets(notes, keys, "side"), "duration": lambda: histogram.durations(notes, keys, "side")}
    return made[feature]()


def jsd_of(feature: str, notes):
    return histogram.jensen_shannon(hist_of(feature, notes), ["piece_id"], "side", SIDES)


@query("SELECT piece_id, round(jsd, 6) AS jsd FROM jsd", V.NOTES, PITCH, JSD)
def pitch_jsd(spark, d):
    return rounded(jsd_of("pitch", V.notes(spark, d)))


@query("SELECT piece_id, round(jsd, 6) AS jsd FROM jsd", V.NOTES, ONSET, JSD)
def onset_jsd(spark, d):
    return rounded(jsd_of("onset", V.notes(spark, d)))


@query("SELECT piece_id, round(jsd, 6) AS jsd FROM jsd", V.NOTES, DURATION, JSD)
def duration_jsd(spark, d):
    return rounded(jsd_of("duration", V.notes(spark, d)))


@query("SELECT piece_id, side, bin, n FROM hist", V.NOTES, PITCH)
def pitch_histogram(spark, d):
    return rounded(hist_of("pitch", V.notes(spark, d)))


@query("SELECT piece_id, side, bin, n FROM hist", V.NOTES, ONSET)
def onset_histogram(spark, d):
    return rounded(hist_of("onset", V.notes(spark, d)))


@query("SELECT piece_id, side, bin, n FROM hist", V.NOTES, DURATION)
def duration_histogram(spark, d):
    return rounded(hist_of("duration", V.notes(spark, d)))


FIVE = "round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max, count(x) AS count"


@query(f"SELECT {FIVE} FROM (SELECT jsd AS x FROM jsd)", V.NOTES, PITCH, JSD)
def pitch_jsd_summary(spark, d):
    return rounded(stats.five_number(jsd_of("pitch", V.notes(spark, d)), [], "jsd"))


@query("SELECT piece_id, side, count(*) AS n, sum(pitch)::BIGINT AS pitches FROM notes WHERE NOT is_drum AND lower(trim(name)) <> 'guitar' GROUP BY 1, 2", V.NOTES)
def accompaniment_notes(spark, d):
    return roles.accompaniment(V.notes(spark, d), melody()).groupBy("piece_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("pitch").alias("pitches"))


@query("SELECT piece_id, side, count(*) AS n, sum(pitch)::BIGINT AS pitches FROM notes WHERE NOT is_drum AND lower(trim(name)) = 'guitar' GROUP BY 1, 2", V.NOTES)
def melody_notes(spark, d):
    return roles.melody_notes(V.notes(spark, d), melody()).groupBy("piece_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("pitch").alias("pitches"))


@query(
    "SELECT piece_id, track_idx, count(*) AS n FROM u WHERE is_piano OR NOT any_piano GROUP BY 1, 2",
    V.NOTES,
    "u AS (SELECT *, lower(trim(name)) = 'piano' AS is_piano, bool_or(lower(trim(name)) = 'piano') OVER (PARTITION BY piece_id, track_idx) AS any_piano FROM notes WHERE NOT is_drum)",
)
def track_role_fallback(spark, d):
    return roles.ground_truth(V.notes(spark, d), ["piece_id", "track_idx"]).groupBy("piece_id", "track_idx").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT piece_id, count(*) AS n, sum(greatest(t0, 4.5)) AS starts FROM notes WHERE t1 > 4.5 GROUP BY 1", V.NOTES)
def continuation_clip(spark, d):
    return roles.continuation(V.notes(spark, d), F.lit(4.5)).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"), F.sum("t0").alias("starts"))


@query("SELECT CASE WHEN lower(trim(name)) = 'guitar' THEN 'Lead' ELSE name END AS name, count(*) AS n FROM notes GROUP BY 1", V.NOTES)
def track_rename(spark, d):
    return roles.renamed(V.notes(spark, d), "Guitar ", "Lead").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


CONSONANCE = """m AS (SELECT row_number() OVER () AS id, piece_id, pitch, t0, t1 FROM notes WHERE NOT is_drum AND side = 'generated' AND lower(trim(name)) = 'guitar' AND t1 > t0),
a AS (SELECT piece_id, pitch, t0, t1 FROM notes WHERE NOT is_drum AND side = 'generated' AND lower(trim(name)) <> 'guitar'),
f AS (SELECT m.id, bool_or((((m.pitch - a.pitch) % 12) + 12) % 12 IN (0, 3, 4, 7, 8, 9)) AS ok FROM m JOIN a ON m.piece_id = a.piece_id AND a.t1 > m.t0 AND a.t0 < m.t1 GROUP BY 1),
r AS (SELECT piece_id, sum(CASE WHEN ok THEN t1 - t0 ELSE 0 END) / sum(t1 - t0) AS c, sum(CASE WHEN ok IS NULL THEN t1 - t0 ELSE 0 END) / sum(t1 - t0) AS u
  FROM m LEFT JOIN f USING (id) WHERE piece_id IN (SELECT piece_id FROM a) GROUP BY 1)"""


def consonance_of(spark, d):
    notes = V.notes(spark, d).where(F.col("side") == V.GENERATED)
    return overlap.consonance(roles.melody_notes(notes, melody()), roles.accompaniment(notes, melody()), ["piece_id"])


@query("SELECT piece_id, round(c, 6) AS consonant_ratio, round(greatest(0, 1 - c - u), 6) AS dissonant_ratio, round(u, 6) AS unsupported_ratio FROM r", V.NOTES, CONSONANCE)
def harmonic_consonance(spark, d):
    return rounded(consonance_of(spark, d))


@query("SELECT a.piece_id, count(*) AS n, count(DISTINCT a.note) AS generated, count(DISTINCT b.note) AS ground_truth, round(sum(least(a.t1, b.t1) - greatest(a.t0, b.t0)), 6) AS seconds FROM spans a JOIN spans b ON a.piece_id = b.piece_id AND b.t1 > a.t0 AND b.t0 < a.t1 WHERE a.side = 'generated' AND b.side = 'ground_truth' GROUP BY 1", V.SPANS)
def long_overlaps(spark, d):
    """Pairs of notes of both sides that sound together, of any lengths."""
    rows = V.spans(spark, d)
    a, b = (rows.where(F.col("side") == side).select("piece_id", F.col("note").alias(f"{p}_note"), F.col("t0").alias(f"{p}0"), F.col("t1").alias(f"{p}1")) for side, p in zip(SIDES, "ab"))
    met = overlap.overlapping(a, b, ["piece_id"], ("a0", "a1"), ("b0", "b1"))
    # a pair counts for its generated note and for its true one; a task sums by note, so that pairs are never told apart
    ends = F.array(F.struct(F.lit(True).alias("own"), F.col("a_note").alias("note"), overlap.length(("a0", "a1"), ("b0", "b1")).alias("s")), F.struct(F.lit(False).alias("own"), F.col("b_note").alias("note"), F.lit(0.0).alias("s")))
    notes = met.select("piece_id", F.explode(ends).alias("e")).groupBy("piece_id", "e.own", "e.note").agg(F.count(F.lit(1)).alias("n"), F.sum("e.s").alias("s"))
    return rounded(notes.groupBy("piece_id").agg(
        F.sum(F.when(F.col("own"), F.col("n"))).alias("n"), F.count(F.when(F.col("own"), F.col("note"))).alias("generated"), F.count(F.when(~F.col("own"), F.col("note"))).alias("ground_truth"), F.sum("s").alias("seconds")
    ))


@query(
    "SELECT piece_id, round(c, 6) AS consonant_ratio, round(greatest(0, 1 - c - u), 6) AS dissonant_ratio, round(u, 6) AS unsupported_ratio FROM r", V.SPANS,
    "notes AS (SELECT *, false AS is_drum, CASE WHEN note % 4 = 1 THEN 'guitar' ELSE 'piano' END AS name FROM spans)", CONSONANCE,
)
def long_consonance(spark, d):
    rows = V.spans(spark, d).where(F.col("side") == V.GENERATED)
    return rounded(overlap.consonance(rows.where("note % 4 = 1"), rows.where("note % 4 != 1"), ["piece_id"]))


@query(f"SELECT ratio, {FIVE} FROM (SELECT 'consonant_ratio' AS ratio, c AS x FROM r UNION ALL SELECT 'dissonant_ratio', greatest(0, 1 - c - u) FROM r UNION ALL SELECT 'unsupported_ratio', u FROM r) GROUP BY 1", V.NOTES, CONSONANCE)
def consonance_summary(spark, d):
    long = consonance_of(spark, d).unpivot(["piece_id"], ["consonant_ratio", "dissonant_ratio", "unsupported_ratio"], "ratio", "x")
    return rounded(stats.five_number(long, ["ratio"], "x"))


#: Four candidate chords (label, root, pitch classes, rank) for the supplied notes.
CANDIDATES = (("C:maj", 0, [0, 4, 7], 0), ("A:min", 9, [9, 0, 4], 1), ("F:maj", 5, [5, 9, 0], 2), ("G:7", 7, [7, 11, 2, 5], 3))
CHORDS = """seg AS (SELECT DISTINCT piece_id, s AS seg_idx, s * 4.0::DOUBLE AS s0, s * 4.0::DOUBLE + 4 AS s1, ['C:maj', 'A:min', 'N', 'G:7'][1 + (piece_id + s) % 4] AS label FROM notes, range(4) AS r(s)),
w AS (SELECT n.piece_id, seg_idx, (pitch % 12)::INT AS pc, sum(least(t1, s1) - greatest(t0, s0)) AS w FROM notes n JOIN seg g ON n.piece_id = g.piece_id AND t1 > s0 AND t0 < s1 GROUP BY 1, 2, 3),
tot AS (SELECT piece_id, seg_idx, sum(w) AS total FROM w GROUP BY 1, 2),
cand AS (SELECT * FROM (VALUES ('C:maj', 0, [0, 4, 7], 0), ('A:min', 9, [9, 0, 4], 1), ('F:maj', 5, [5, 9, 0], 2), ('G:7', 7, [7, 11, 2, 5], 3)) AS c(label, root, classes, rank)),
sc AS (SELECT t.piece_id, t.seg_idx, total, c.label, c.rank, coalesce(sum(w) FILTER (list_contains(classes, pc)), 0) AS cov, coalesce(sum(w) FILTER (pc = root), 0) AS wr FROM tot t CROSS JOIN cand c JOIN w USING (piece_id, seg_idx) GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT piece_id, seg_idx, label AS found, row_number() OVER (PARTITION BY piece_id, seg_idx ORDER BY cov - 0.5 * (total - cov) + 0.3 * wr DESC, rank) AS k FROM sc WHERE total >= 0.05 AND cov / total >= 0.2),
pick AS (SELECT s.piece_id, s.seg_idx, s.s0, s.label, coalesce(found, 'N') AS found FROM seg s LEFT JOIN best b ON s.piece_id = b.piece_id AND s.seg_idx = b.seg_idx AND k = 1)"""


def segments_of(spark, d):
    pieces = V.notes(spark, d).select("piece_id").distinct().withColumn("seg_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    label = F.element_at(F.array(*map(F.lit, ("C:maj", "A:min", "N", "G:7"))), (1 + (F.col("piece_id") + F.col("seg_idx")) % 4).cast("int"))
    return pieces.select("piece_id", "seg_idx", (F.col("seg_idx") * 4.0).alias("s0"), (F.col("seg_idx") * 4.0 + 4).alias("s1"), label.alias("label"))


def chords_of(spark, d):
    candidates = spark.createDataFrame(CANDIDATES, "label string, root int, classes array<int>, rank int")
    return chords.picked(segments_of(spark, d), V.notes(spark, d), candidates, ["piece_id"])


@query("SELECT piece_id, seg_idx, found AS label FROM pick", V.NOTES, CHORDS)
def chord_pick(spark, d):
    return chords_of(spark, d)


@query("SELECT piece_id, round(avg((label = found)::INT), 6) AS accuracy FROM pick JOIN (SELECT piece_id, max(t1) AS e FROM notes GROUP BY 1) USING (piece_id) WHERE s0 < e + 1e-3 GROUP BY 1", V.NOTES, CHORDS)
def chord_accuracy(spark, d):
    return rounded(chords.accuracy(segments_of(spark, d), chords_of(spark, d), V.notes(spark, d), ["piece_id"]))


@query("SELECT piece_id, seg_idx, pc::BIGINT AS pc, w FROM w", V.NOTES, CHORDS)
def chord_class_durations(spark, d):
    return rounded(chords.class_durations(segments_of(spark, d), V.notes(spark, d), ["piece_id"]))


@query("SELECT piece_id, label, row_number() OVER (PARTITION BY piece_id ORDER BY min(seg_idx)) - 1 AS rank FROM seg WHERE label <> 'N' GROUP BY piece_id, label", V.NOTES, CHORDS)
def chord_vocabulary_rank(spark, d):
    return rounded(chords.first_seen(segments_of(spark, d), ["piece_id"]))


PHRASES = """b AS (SELECT piece_id, side, min(t0) AS s, max(t1) AS e FROM notes GROUP BY 1, 2),
sp AS (SELECT piece_id, side, s + k * 2.0::DOUBLE AS w0, s + k * 2.0::DOUBLE + 2 AS w1 FROM (SELECT *, unnest(range(ceil((e - s) / 2)::BIGINT)) AS k FROM b)),
met AS MATERIALIZED (SELECT n.piece_id, n.side, w0, w1, t0, t1 FROM sp JOIN notes n ON n.piece_id = sp.piece_id AND n.side = sp.side AND t1 > w0 AND t0 < w1),
ph AS (SELECT piece_id, side, w0, w1, count(DISTINCT floor((t0 - w0) / 0.01 + 1e-9)) FILTER (t0 >= w0 AND t0 < w1) / (w1 - w0) AS rd,
  CASE WHEN max(least(t1, w1)) > w0 THEN sum(greatest(0, least(t1, w1) - greatest(t0, w0))) / (max(least(t1, w1)) - w0) ELSE 0 END AS vn FROM met GROUP BY 1, 2, 3, 4),
phrases AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY piece_id, side ORDER BY w0) - 1 AS idx FROM ph)"""


def phrases_of(spark, d):
    return phrases.windows(V.notes(spark, d).select("piece_id", "side", "t0", "t1"), ["piece_id", "side"], ["piece_id", "side"])


@query("SELECT piece_id, side, idx, w0, w1, round(rd, 6) AS rhythm_density, round(vn, 6) AS voice_number FROM phrases", V.NOTES, PHRASES)
def phrase_windows(spark, d):
    return rounded(phrases_of(spark, d))


@query("SELECT piece_id, side, w0, round(vn, 6) AS voice_number FROM ph", V.NOTES, PHRASES)
def voice_number_sweep(spark, d):
    met = phrases.tumbling(V.notes(spark, d).select("piece_id", "side", "t0", "t1"), ["piece_id", "side"])
    return rounded(phrases.swept(met, ["piece_id", "side"]))


BARS = """bars AS (SELECT DISTINCT piece_id, k AS bar_idx, k * 1.5::DOUBLE AS t FROM notes, range(11) AS r(k)),
bs AS (SELECT *, lead(t) OVER (PARTITION BY piece_id ORDER BY bar_idx) AS n FROM bars),
sp AS (SELECT piece_id, (bar_idx // 4)::BIGINT AS idx, min(t) AS w0, max(n) AS w1 FROM bs WHERE n > t GROUP BY 1, 2),
met AS (SELECT sp.piece_id, idx, w0, w1, t0, t1 FROM sp JOIN notes n ON n.piece_id = sp.piece_id AND t1 > w0 AND t0 < w1),
ph AS (SELECT piece_id, idx, count(DISTINCT floor((t0 - w0) / 0.01 + 1e-9)) FILTER (t0 >= w0 AND t0 < w1) / (max(w1) - max(w0)) AS rd,
  sum(greatest(0, least(t1, w1) - greatest(t0, w0))) / (max(least(t1, w1)) - max(w0)) AS vn FROM met GROUP BY 1, 2)"""


@query("SELECT piece_id, idx, w0, w1, round(coalesce(rd, 0), 6) AS rhythm_density, round(coalesce(vn, 0), 6) AS voice_number FROM sp LEFT JOIN ph USING (piece_id, idx)", V.NOTES, BARS)
def bar_phrases(spark, d):
    notes = V.notes(spark, d)
    lines = notes.select("piece_id").distinct().withColumn("bar_idx", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("t", F.col("bar_idx") * 1.5)
    return rounded(phrases.bars(notes, lines, ["piece_id"]))


@query("SELECT piece_id, side, idx, round(abs(lead(rd) OVER w - rd), 6) AS diff_rhythm_density, round(abs(lead(vn) OVER w - vn), 6) AS diff_voice_number FROM phrases WINDOW w AS (PARTITION BY piece_id, side ORDER BY idx) QUALIFY lead(idx) OVER w IS NOT NULL", V.NOTES, PHRASES)
def adjacent_rhythm_diff(spark, d):
    return rounded(pairs.adjacent(phrases_of(spark, d), ["piece_id", "side"], "idx", ["rhythm_density", "voice_number"]))


@query("SELECT a.piece_id, a.side, a.idx AS a_idx, b.idx AS b_idx, round(abs(a.rd - b.rd), 6) AS diff_rhythm_density FROM phrases a JOIN phrases b ON a.piece_id = b.piece_id AND a.side = b.side AND a.idx < b.idx", V.NOTES, PHRASES)
def same_song_pairs(spark, d):
    return rounded(pairs.same_group(phrases_of(spark, d), ["piece_id", "side"], "idx", ["rhythm_density"]))


@query(
    "SELECT a.k AS first, b.k AS second, round(abs(a.v - b.v), 6) AS diff_v FROM s a JOIN s b ON a.k < b.k", "s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS k, s_acctbal AS v FROM supplier)"
)
def random_pairs(spark, d):
    """All pairs of suppliers, as a sample of more pairs than there are."""
    rows = Ordered(V.table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v")), [F.col("s_suppkey")]).numbered("k")
    return pairs.at_random(rows, "k", ["v"], 2**63 - 1).select("first", "second", S.rounded(F.col("diff_v"), 6).alias("diff_v"))


@query("SELECT 500::BIGINT AS n, 500::BIGINT AS different, 0::BIGINT AS wrong FROM (SELECT count(*) AS k FROM customer) WHERE k * (k - 1) / 2 > 500")
def random_pairs_drawn(spark, d):
    """A sample of the pairs of all customers: so many, all different, each in order and with its own difference."""
    c = V.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("v"))
    first = c.agg(F.min("c_custkey")).first()[0]
    rows = c.select((F.col("c_custkey") - first).alias("k"), "v")
    drawn = pairs.at_random(rows, "k", ["v"], 500)
    a, b = (rows.select(F.col("k").alias(s), F.col("v").alias(f"v_{s}")).hint("merge") for s in ("first", "second"))
    wrong = (F.col("first") >= F.col("second")) | F.coalesce(F.col("diff_v") != F.abs(F.col("v_first") - F.col("v_second")), F.lit(True))
    checked = drawn.join(a, "first", "left").join(b, "second", "left")
    return rounded(checked.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("first", "second").cast("int").alias("different"), F.sum(wrong.cast("int")).cast("int").alias("wrong")))


@query(
    f"SELECT pair_kind, measure, {FIVE} FROM (SELECT 'adjacent' AS pair_kind, 'diff_rd' AS measure, abs(lead(rd) OVER w - rd) AS x FROM phrases WINDOW w AS (PARTITION BY piece_id, side ORDER BY idx) QUALIFY lead(idx) OVER w IS NOT NULL "
    "UNION ALL SELECT 'same_song', 'diff_rd', abs(a.rd - b.rd) FROM phrases a JOIN phrases b ON a.piece_id = b.piece_id AND a.side = b.side AND a.idx < b.idx) GROUP BY 1, 2",
    V.NOTES,
    PHRASES,
)
def pair_differences(spark, d):
    rows = phrases_of(spark, d).withColumnRenamed("rhythm_density", "rd")
    kinds = {"adjacent": pairs.adjacent(rows, ["piece_id", "side"], "idx", ["rd"]), "same_song": pairs.same_group(rows, ["piece_id", "side"], "idx", ["rd"])}
    return rounded(pairs.differences(kinds, ["rd"]))


@query(f"SELECT side_a AS side, {FIVE} FROM (SELECT 'both' AS side_a, abs(a.rd - b.rd) AS x FROM phrases a JOIN phrases b ON a.piece_id = b.piece_id AND a.idx = b.idx AND a.side = 'generated' AND b.side = 'ground_truth') GROUP BY 1", V.NOTES, PHRASES)
def phrase_ordinal_summary(spark, d):
    both = pairs.by_place(phrases_of(spark, d), ["piece_id"], "idx", "side", SIDES, ["rhythm_density"])
    return rounded(stats.five_number(both.select(F.lit("both").alias("side"), F.col("diff_rhythm_density").alias("x")), ["side"], "x"))


@query("SELECT a.piece_id, round(avg(abs(a.rd - b.rd)), 6) AS \"RD\", round(avg(abs(a.vn - b.vn)), 6) AS \"VN\" FROM phrases a JOIN phrases b ON a.piece_id = b.piece_id AND a.idx = b.idx AND a.side = 'generated' AND b.side = 'ground_truth' GROUP BY 1", V.NOTES, PHRASES)
def piece_phrase_means(spark, d):
    from tessera.plans import evaluation

    return rounded(evaluation.piece_phrase_means(phrases_of(spark, d), ["piece_id"]).groupBy("piece_id").pivot("metric", ["RD", "VN"]).agg(F.first("value")))


HIT = "CASE WHEN is_hit THEN coalesce((32 - backup_level) / 32, 0) ELSE 0 END"
BY_TICK = f"bt AS (SELECT run, tick, avg(is_hit::INT) AS hit_rate, avg(backup_level) FILTER (is_hit) AS avg_backup, avg({HIT}) AS weighted_hit_rate FROM ticks WHERE tick IS NOT NULL GROUP BY 1, 2)"
OF_RUN = "g AS (SELECT run, avg(is_hit::INT) AS global_hit_rate, avg(backup_level) FILTER (is_hit) AS global_avg_backup, count(*) AS total_samples, sum(is_hit::INT)::BIGINT AS total_hits, (SELECT avg(weighted_hit_rate) FROM bt WHERE bt.run = ticks.run) AS isr FROM ticks GROUP BY 1)"


@query("SELECT run, tick, round(hit_rate, 6) AS hit_rate, round(avg_backup, 6) AS avg_backup, round(weighted_hit_rate, 6) AS weighted_hit_rate FROM bt", V.TICKS, BY_TICK)
def tick_metrics(spark, d):
    return rounded(ticks.by_tick(V.ticks(spark, d), ["run"]))


@query('SELECT run, round(global_hit_rate, 6) AS global_hit_rate, round(global_avg_backup, 6) AS global_avg_backup, total_samples, total_hits, round(isr, 6) AS "ISR_w", 32.0::DOUBLE AS weight_const FROM g', V.TICKS, BY_TICK, OF_RUN)
def system_globals(spark, d):
    return rounded(ticks.of_runs(V.ticks(spark, d), ["run"]))


@query("SELECT run, tick::VARCHAR AS tick, round(hit_rate, 6) AS hit_rate, round(avg_backup, 6) AS avg_backup, round(weighted_hit_rate, 6) AS weighted_hit_rate, NULL::BIGINT AS total_samples, NULL::BIGINT AS total_hits FROM bt UNION ALL SELECT run, 'GLOBAL', round(global_hit_rate, 6), round(global_avg_backup, 6), round(isr, 6), total_samples, total_hits FROM g", V.TICKS, BY_TICK, OF_RUN)
def tick_rows_with_global(spark, d):
    return rounded(ticks.with_global(V.ticks(spark, d), ["run"]))


@query('SELECT round(avg(global_hit_rate), 6) AS mean_global_hit_rate, round(avg(global_avg_backup), 6) AS mean_global_avg_backup, round(avg(isr), 6) AS "mean_ISR_w", sum(total_samples)::BIGINT AS total_samples, sum(total_hits)::BIGINT AS total_hits, count(*) AS n_runs FROM g', V.TICKS, BY_TICK, OF_RUN)
def globals_across_runs(spark, d):
    return rounded(ticks.across(ticks.of_runs(V.ticks(spark, d), ["run"])))


@query(f"SELECT run, round(avg(is_hit::INT), 6) AS hit_rate, round(avg(backup_level), 6) AS backup_level, round(avg({HIT}), 6) AS hit_rate_weighted FROM ticks GROUP BY 1", V.TICKS)
def tick_value_map(spark, d):
    rows = V.ticks(spark, d)
    out = None
    for kind in ("hit_rate", "backup_level", "hit_rate_weighted"):
        one = ticks.mapped(rows, kind).groupBy("run").agg(F.avg("value").alias(kind))
        out = one if out is None else out.join(one, "run")
    return rounded(out)


DMR = "r AS (SELECT run, frames, event_id, coalesce(round_trip_time, response_output_time - request_arrival_time) AS rtt, floor((frames + 1) / 2) * (1.0::DOUBLE / 6) AS deadline FROM timings WHERE frames IS NOT NULL)"


@query("SELECT run, frames, round(deadline, 6) AS deadline, count(*) AS n, sum((rtt > deadline)::INT)::BIGINT AS n_miss, round(avg((rtt > deadline)::INT), 6) AS dmr FROM r WHERE rtt IS NOT NULL GROUP BY run, frames, deadline", V.TIMINGS, DMR)
def deadline_misses(spark, d):
    return rounded(ticks.deadlines(V.timings(spark, d), ["run"]))


@query("SELECT run, event_id FROM timings QUALIFY row_number() OVER (PARTITION BY run ORDER BY event_id) <= 100", V.TIMINGS)
def details_sample(spark, d):
    from pyspark.sql import Window

    rows = V.timings(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy("event_id")))
    return rows.where("n <= 100").select("run", "event_id")


@query("SELECT run, round(avg(avg_nll), 6) AS ave_nll, round(sum(total_nll) / nullif(sum(total_tokens), 0), 6) AS weighted_ave_nll, count(*) AS n FROM nll GROUP BY 1", V.LIKELIHOODS)
def nll_run_means(spark, d):
    return rounded(likelihood.run_means(V.likelihoods(spark, d), ["run"]))


@query(
    "SELECT run, count(*) AS n_files, count(*) FILTER (c) AS n_valid, round(sum(total_nll) FILTER (c) / nullif(sum(total_tokens) FILTER (c), 0), 6) AS weighted_nll, round(avg(avg_nll) FILTER (c), 6) AS avg_mean, round(stddev_samp(avg_nll) FILTER (c), 6) AS avg_stdev_samp, round(min(avg_nll) FILTER (c), 6) AS avg_min, round(quantile_cont(avg_nll, 0.5) FILTER (c), 6) AS avg_p50, round(max(avg_nll) FILTER (c), 6) AS avg_max FROM (SELECT *, avg_nll IS NOT NULL AND total_nll IS NOT NULL AND total_tokens IS NOT NULL AS c FROM nll) GROUP BY 1",
    V.LIKELIHOODS,
)
def nll_dataset(spark, d):
    return rounded(likelihood.dataset(V.likelihoods(spark, d), ["run"]))


@query(
    "SELECT run, round(avg(avg_nll), 6) AS avg_mean, round(coalesce(sum(avg_nll * total_tokens) / nullif(sum(total_tokens) FILTER (avg_nll IS NOT NULL), 0), avg(avg_nll)), 6) AS weighted_avg, round(coalesce(sum(coalesce(total_nll, avg_nll * total_tokens)) FILTER (total_tokens IS NOT NULL) / nullif(sum(total_tokens) FILTER (coalesce(total_nll, avg_nll * total_tokens) IS NOT NULL), 0), avg(avg_nll)), 6) AS weighted_total FROM nll GROUP BY 1",
    V.LIKELIHOODS,
)
def nll_scalar(spark, d):
    return rounded(likelihood.scalar(V.likelihoods(spark, d), ["run"]))


@query("SELECT run, round(sum(coalesce(total_nll, avg_nll * total_tokens)) / sum(total_tokens), 6) AS nll_weighted, count(*) AS n FROM nll WHERE nullif(total_tokens, 0) IS NOT NULL AND coalesce(total_nll, avg_nll * total_tokens) IS NOT NULL GROUP BY 1", V.LIKELIHOODS)
def nll_token_weighted(spark, d):
    rows = likelihood.values(V.likelihoods(spark, d), weighted=True)
    return rounded(rows.groupBy("run").agg((F.sum("value") / F.sum("weight")).alias("nll_weighted"), F.count(F.lit(1)).alias("n")))


@query("SELECT file, max(source) AS source, arg_max(total_tokens, source) FILTER (TRUE) AS t FROM (SELECT file, source, coalesce(total_tokens, -1) AS total_tokens FROM nll) GROUP BY 1", V.LIKELIHOODS)
def nll_last_wins(spark, d):
    rows = likelihood.last_wins(V.likelihoods(spark, d), ["file"], ["source"])
    return rows.select("file", "source", F.coalesce("total_tokens", F.lit(-1)).alias("t"))


@query('SELECT interval, arg_max(avg_nll, source) FILTER (gen_frame = 0) AS "0", arg_max(avg_nll, source) FILTER (gen_frame = 1) AS "1", arg_max(avg_nll, source) FILTER (gen_frame = 2) AS "2", arg_max(avg_nll, source) FILTER (gen_frame = 3) AS "3" FROM nll WHERE avg_nll IS NOT NULL GROUP BY 1', V.LIKELIHOODS)
def nll_grid(spark, d):
    return reshape.grid(V.likelihoods(spark, d), "interval", "gen_frame", "avg_nll", "source", [0, 1, 2, 3])


BOXES = """v AS (SELECT event_type, ln(1 + value) AS x FROM events WHERE value IS NOT NULL),
q AS (SELECT event_type, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, count(*) AS count FROM v GROUP BY 1),
b AS (SELECT *, x BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside FROM v JOIN q USING (event_type))"""


def log_values(spark, d):
    return V.table(spark, d, "events").select("event_type", F.log1p("value").alias("x"))


@query(
    "SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(least(q1, min(x) FILTER (inside)), 6) AS whisker_low, round(greatest(q3, max(x) FILTER (inside)), 6) AS whisker_high, "
    "count(*) FILTER (NOT inside) AS outliers, count FROM b GROUP BY event_type, q1, median, q3, count", BOXES,
)
def box_statistics(spark, d):
    return rounded(stats.boxes(log_values(spark, d), ["event_type"], "x")[0].drop("mean"))


@query("SELECT event_type, round(x, 6) AS value FROM b WHERE NOT inside", BOXES)
def box_outliers(spark, d):
    return rounded(stats.boxes(log_values(spark, d), ["event_type"], "x")[1])


@query(
    "SELECT event_type, round(low + k * step, 6) AS x, round(sum(CASE WHEN abs((k - bin) * step) <= 6 * h THEN c * exp(-(((k - bin) * step / h) ** 2) / 2) ELSE 0 END) / (n * h * sqrt(2 * pi())), 6) AS density "
    "FROM w, range(128) AS r(k) GROUP BY event_type, low, step, h, n, k",
    "g AS (SELECT event_type, min(value) AS low, (max(value) - min(value)) / 127 AS step, stddev_samp(value) * count(value)::DOUBLE ** -0.2 AS h, count(value) AS n FROM events GROUP BY 1)",
    "w AS (SELECT event_type, low, step, h, n, round((value - low) / step)::INT AS bin, count(*) AS c FROM events JOIN g USING (event_type) WHERE value IS NOT NULL AND step > 0 GROUP BY ALL)",
)
def value_density(spark, d):
    return rounded(stats.density(V.table(spark, d, "events"), ["event_type"], "value"))


@query(f"SELECT {FIVE} FROM (SELECT l_extendedprice AS x FROM lineitem)")
def price_quantiles(spark, d):
    """Five numbers of all prices, without a key: by selection."""
    return rounded(stats.five_number(V.table(spark, d, "lineitem"), [], "l_extendedprice"))


@query(f"SELECT o_orderpriority, {FIVE} FROM (SELECT o_orderpriority, o_totalprice AS x FROM orders) GROUP BY 1")
def five_number(spark, d):
    return rounded(stats.five_number(V.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"))


@query(
    "SELECT o_orderstatus, count(x)::DOUBLE AS count, round(sum(x), 6) AS sum, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance_pop, round(CASE WHEN count(x) = 1 THEN 0 ELSE var_samp(x) END, 6) AS variance_samp, round(stddev_pop(x), 6) AS stdev_pop, round(CASE WHEN count(x) = 1 THEN 0 ELSE stddev_samp(x) END, 6) AS stdev_samp, round(CASE WHEN count(x) = 1 THEN 0 ELSE stddev_samp(x) END, 6) AS std, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr FROM (SELECT o_orderstatus, (o_custkey % 512) / 8.0::DOUBLE AS x FROM orders) GROUP BY 1"
)
def descriptive_stats(spark, d):
    rows = V.table(spark, d, "orders").select("o_orderstatus", ((F.col("o_custkey") % 512) / 8).alias("x"))
    return rounded(stats.describe(rows, ["o_orderstatus"], "x"))


#: All kinds of the supplied events.
KINDS = ("click", "error", "purchase", "signup", "view")


@query(
    "SELECT run, " + ", ".join(f'round(avg(v) FILTER (kind = \'{k}\'), 6) AS "{k}-mean", round(stddev_samp(v) FILTER (kind = \'{k}\'), 6) AS "{k}-stdev_samp"' for k in KINDS) + " FROM (SELECT user_id % 20 AS run, event_type AS kind, (event_id % 64) / 4.0::DOUBLE AS v FROM events) GROUP BY 1"
)
def type_stat_pivot(spark, d):
    rows = V.table(spark, d, "events").select((F.col("user_id") % 20).alias("run"), F.col("event_type").alias("kind"), ((F.col("event_id") % 64) / 4).alias("v"))
    return rounded(reshape.statistics_grid(rows, "run", "kind", list(KINDS), "v"))


KEYS = r"""k AS (SELECT k, name, lower(name) AS low, nullif(regexp_extract(lower(name), 'interval[_-]?(\d+)', 1), '') AS i,
  coalesce(nullif(regexp_extract(lower(name), 'gen[_-]?frame[_-]?(\d+)', 1), ''), nullif(regexp_extract(lower(name), 'interval[_-]?\d+.*?gen[_-]?(\d+)', 1), ''), nullif(regexp_extract(lower(name), 'gen[_-]?(\d+)', 1), '')) AS g FROM names)"""


@query("SELECT k, CASE WHEN g IS NOT NULL THEN i::BIGINT END AS interval, g::BIGINT AS gen_frame FROM k", V.RUN_NAMES, KEYS)
def path_key(spark, d):
    return rounded(V.run_names(spark, d).select("k", S.interval_gen(F.col("name")).alias("x")).select("k", "x.*"))


@query(r"SELECT k, coalesce(nullif(regexp_extract(name, 'interval[_-]?(\d+)', 1), ''), 'NA') AS interval, coalesce(nullif(regexp_extract(name, 'gen[_-]?frame[_-]?(\d+)', 1), ''), 'NA') AS gen_frame, coalesce(nullif(regexp_extract(name, 'prompt[_-]?(\d+)', 1), ''), 'NA') AS prompt, coalesce(nullif(regexp_extract(name, 'prompt[_-]?\d+[_-]?gen[_-]?(\d+)', 1), ''), 'NA') AS gen FROM names", V.RUN_NAMES)
def path_parameters(spark, d):
    return V.run_names(spark, d).select("k", S.run_parameters(F.col("name")).alias("x")).select("k", "x.*")


@query(
    r"""SELECT k, CASE WHEN regexp_matches(name, 'interval[_-]?\d+') AND regexp_matches(name, 'gen[_-]?frame[_-]?\d+') THEN regexp_extract(name, 'interval[_-]?(\d+)', 1)::BIGINT END AS interval,
  nullif(regexp_extract(name, '(?i)^.*gen[_-]?frame[_-]?(\d+)', 1), '')::BIGINT AS frames, regexp_replace(replace(name, '-', '_'), '^interval(\d+)_gen(\d+)_(.*)$', 'interval_\1_gen_frame_\2/\3') AS folder FROM names""",
    V.RUN_NAMES,
)
def path_key_strict(spark, d):
    n = F.col("name")
    rows = V.run_names(spark, d).select("k", S.strict_interval_gen(n, F.lit("")).alias("x"), S.nearest_frames(n).alias("frames"), S.run_folder(F.translate(n, "-", "_")).alias("folder"))
    return rounded(rows.select("k", "x.interval", "frames", "folder"))


@query(
    r"""SELECT k, coalesce(nullif(right(regexp_replace(regexp_replace(regexp_replace(replace(name, '..', '_'), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 200), ''), 'batch_run') AS file_name,
  CASE WHEN regexp_matches(b, '(?i)\.midi?') THEN regexp_replace(b, '(?i)\.midi?.*$', '') ELSE regexp_replace(b, '(.)\.[^.]*$', '\1') END AS stem,
  CASE WHEN length(name) - length(replace(name, '_', '')) >= 2 THEN array_to_string(string_split(name, '_')[1:2], '_') END AS head,
  array_to_string(list_slice(p, greatest(len(p) - 2, 1), len(p)), '_') AS last_parts
  FROM (SELECT *, regexp_extract(name, '([^/]*)$', 1) AS b, list_filter(string_split(name, '/'), lambda x: x <> '') AS p FROM names)""",
    V.RUN_NAMES,
)
def name_parts(spark, d):
    n = F.col("name")
    return V.run_names(spark, d).select("k", S.file_name(n).alias("file_name"), S.stem(n).alias("stem"), S.cut_at(n, 2)["head"].alias("head"), S.last_parts(n).alias("last_parts"))


@query("SELECT g AS group, m AS member, count(*) AS n FROM (SELECT CASE WHEN contains(low, 'offline') THEN 'offline' ELSE coalesce('interval' || i, name) END AS g, CASE WHEN contains(low, 'offline') THEN '' ELSE coalesce('gen' || nullif(regexp_extract(low, 'gen(?:[_-]?frame)?[_-]?(\\d+)', 1), ''), '') END AS m FROM k) GROUP BY 1, 2".replace("AS group", 'AS "group"').replace("\\\\", "\\"), V.RUN_NAMES, KEYS)
def group_labels(spark, d):
    rows = V.run_names(spark, d).select(S.group_label(F.col("name")).alias("x")).select("x.group", "x.member")
    return rows.groupBy("group", "member").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, try_cast(props->>'$.page' AS BIGINT) AS page, props->>'$.missing.x' AS missing FROM events")
def json_path(spark, d):
    doc = F.try_parse_json("props")
    return V.table(spark, d, "events").select("event_id", S.at_path(doc, "page", "long").alias("page"), S.at_path(doc, "missing.x", "string").alias("missing"))


RANKED = r"""rows AS (SELECT DISTINCT name FROM names),
cands AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'sys_' || lower(s_name) WHEN 1 THEN 'Interval_' || (s_suppkey % 12)::VARCHAR || '_gen_' || (s_suppkey % 9)::VARCHAR || '_' || s_suppkey::VARCHAR
  WHEN 2 THEN 'xgen_' || (s_suppkey % 9)::VARCHAR || 'interval' || (s_suppkey % 12)::VARCHAR ELSE 'offline_' || s_suppkey::VARCHAR || '.midi' END AS candidate FROM supplier),
pr AS (SELECT name, candidate, lower(name) AS rl, lower(candidate) AS cl, replace(lower(name), '_', '') AS rp, replace(lower(candidate), '_', '') AS cp, rk.i AS ri, rk.g AS rg, ck.i AS ci, ck.g AS cg
  FROM (SELECT name, {'i': i, 'g': g} AS rk FROM kn) JOIN (SELECT candidate, {'i': i, 'g': g} AS ck FROM kc) ON true),
f AS (SELECT *, rl = cl AS exact, contains(cl, rl) OR contains(rl, cl) AS cont, ri = ci AND rg = cg AS num, contains(cp, rp) AS within, contains(cp, rp) OR contains(rp, cp) AS either FROM pr)"""


def keys_in(table: str, name: str) -> str:
    """SQL for names with their interval (only beside a gen number) and gen."""
    gen = f"coalesce(nullif(regexp_extract(lower({name}), 'gen[_-]?frame[_-]?(\\d+)', 1), ''), nullif(regexp_extract(lower({name}), 'interval[_-]?\\d+.*?gen[_-]?(\\d+)', 1), ''), nullif(regexp_extract(lower({name}), 'gen[_-]?(\\d+)', 1), ''))::INT"
    return f"(SELECT {name}, {gen} AS g, CASE WHEN {gen} IS NOT NULL THEN nullif(regexp_extract(lower({name}), 'interval[_-]?(\\d+)', 1), '')::INT END AS i FROM {table})"


RANKED = RANKED.replace("FROM kn)", f"FROM {keys_in('rows', 'name')})").replace("FROM kc)", f"FROM {keys_in('cands', 'candidate')})")


def ranked_tables(spark, d):
    rows = V.run_names(spark, d).select("name").distinct()
    k = F.col("s_suppkey")
    text = lambda m: (k % m).cast("string")
    candidate = (
        F.when(k % 4 == 0, F.concat(F.lit("sys_"), F.lower("s_name"))).when(k % 4 == 1, F.concat(F.lit("Interval_"), text(12), F.lit("_gen_"), text(9), F.lit("_"), k.cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("xgen_"), text(9), F.lit("interval"), text(12))).otherwise(F.concat(F.lit("offline_"), k.cast("string"), F.lit(".midi")))
    )
    return rows, V.table(spark, d, "supplier").select(candidate.alias("candidate")).distinct()


@query("SELECT r.name, candidate, rule FROM rows r LEFT JOIN (SELECT name, candidate, CASE WHEN num THEN 'numeric' WHEN cont THEN 'containment' ELSE 'plain_within' END AS rule FROM f WHERE num OR cont OR within QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN num THEN 0 WHEN cont THEN 1 ELSE 2 END, candidate) = 1) b ON r.name = b.name", V.RUN_NAMES, RANKED)
def ranked_match_system(spark, d):
    return matching.ranked(*ranked_tables(spark, d), rules=matching.SYSTEM_RULES)


@query("SELECT r.name, candidate, rule FROM rows r LEFT JOIN (SELECT name, candidate, CASE WHEN exact THEN 'exact' WHEN cont THEN 'containment' WHEN num THEN 'numeric' ELSE 'plain_either' END AS rule FROM f WHERE exact OR num OR cont OR either QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN exact THEN 0 WHEN cont THEN 1 WHEN num THEN 2 ELSE 3 END, candidate) = 1) b ON r.name = b.name", V.RUN_NAMES, RANKED)
def ranked_match_nll(spark, d):
    return matching.ranked(*ranked_tables(spark, d), rules=matching.LIKELIHOOD_RULES)


@query("SELECT page_id, (SELECT md5(min(text)) FROM benchmark WHERE text <> '' AND contains(html, text)) AS candidate_md5 FROM pages")
def ranked_match_pages(spark, d):
    """Which benchmark text each page's html holds whole, if any: names as long as pages, of many lengths."""
    pages, items = V.table(spark, d, "pages").select(F.col("html").alias("name")), V.table(spark, d, "benchmark").select(F.col("text").alias("candidate"))
    held = matching.within(items.where("candidate is not null").distinct(), pages.where("name is not null").distinct(), "candidate", "name")
    best = held.groupBy("name").agg(F.min("candidate").alias("candidate"))
    found = V.table(spark, d, "pages").join(best, F.col("html") == F.col("name"), "left")
    return found.select("page_id", F.md5(F.col("candidate").cast("binary")).alias("candidate_md5"))


FILES = "gen AS (SELECT 'out/' || (k % 40)::VARCHAR || '/p' || (k % 70)::VARCHAR || CASE WHEN k % 3 = 0 THEN '.mid.mid' ELSE '.MID' END AS path, 'p' || (k % 70)::VARCHAR AS key FROM (SELECT c_custkey AS k FROM customer)), gt AS (SELECT 'gt/' || (k % 9)::VARCHAR || '/p' || (k % 50)::VARCHAR || '.midi' AS path, 'p' || (k % 50)::VARCHAR AS key FROM (SELECT s_suppkey AS k FROM supplier))"


def file_tables(spark, d):
    k, s = V.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    mod = lambda m: (F.col("k") % m).cast("string")
    gen = k.select(F.concat(F.lit("out/"), mod(40), F.lit("/p"), mod(70), F.when(F.col("k") % 3 == 0, ".mid.mid").otherwise(".MID")).alias("path"))
    return gen, s.select(F.concat(F.lit("gt/"), mod(9), F.lit("/p"), mod(50), F.lit(".midi")).alias("path"))


@query("SELECT gen.key, gen.path AS generated, g.path AS ground_truth FROM gen JOIN (SELECT key, min(path) AS path FROM gt GROUP BY 1) g ON gen.key = g.key", FILES)
def file_pairs(spark, d):
    return matching.file_pairs(*file_tables(spark, d))


@query("SELECT key, count(*) AS n FROM gen WHERE key NOT IN (SELECT key FROM gt) GROUP BY 1", FILES)
def unmatched_files(spark, d):
    return matching.unmatched(*file_tables(spark, d)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, line_no, section FROM (SELECT conv_id, turn, line_no, last_value(CASE WHEN line_no % 3 = 0 THEN left(line, 12) END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY line_no) AS section FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM conversations))")
def text_sections(spark, d):
    rows = reshape.lines(V.table(spark, d, "conversations"), ["conv_id", "turn"], "text")
    out = reshape.sectioned(rows, ["conv_id", "turn"], F.when(F.col("line_no") % 3 == 0, F.left("line", F.lit(12))))
    return rounded(out.select("conv_id", "turn", "line_no", "section"))


@query("SELECT o_orderkey, 'price' AS metric, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'cust', CASE WHEN o_custkey % 3 > 0 THEN o_custkey::DOUBLE END FROM orders WHERE o_custkey % 3 > 0")
def melt_long(spark, d):
    rows = V.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("cust"))
    return reshape.melted(rows, ["o_orderkey"], ["price", "cust"])


@query("SELECT conv_id, coalesce(min(text) FILTER (role = 'user'), '') AS user, coalesce(min(text) FILTER (role = 'assistant'), '') AS assistant, coalesce(min(text) FILTER (role = 'system'), '') AS system FROM (SELECT conv_id, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1) GROUP BY 1")
def text_grid(spark, d):
    rows = matching.first_ranked(V.table(spark, d, "conversations"), ["conv_id", "role"], [F.col("turn")])
    return reshape.text_grid(rows, "conv_id", "role", ["user", "assistant", "system"], "text")


@query("SELECT c_name, c_acctbal AS v FROM customer WHERE c_acctbal > 1000")
def threshold_ranking(spark, d):
    return reshape.ranked_by(V.table(spark, d, "customer").select("c_name", F.col("c_acctbal").alias("v")), "v", "c_name", threshold=1000.0)


@query("SELECT a.label::BIGINT AS label, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, count(x) AS n FROM (SELECT a.label, sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda k: (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE) ** 2))) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a GROUP BY 1")
def paired_l2(spark, d):
    e = V.table(spark, d, "embeddings")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return rounded(vectors.paired_distance(both, ["label"], "embedding", "other"), 5)


@query("SELECT label::BIGINT AS label, dim, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY 1, 2")
def mean_vector(spark, d):
    return rounded(vectors.means(V.table(spark, d, "embeddings"), ["label"], "embedding"), 5)


@query("SELECT i, j, count(*) AS n, round(sum(x), 4) AS si, round(sum(y), 4) AS sj, round(sum(x * y), 4) AS sij FROM (SELECT i, j, embedding[i + 1]::DOUBLE AS x, embedding[j + 1]::DOUBLE AS y FROM embeddings, range(64) AS a(i), range(64) AS b(j) WHERE i <= j AND j < len(embedding)) GROUP BY 1, 2")
def embedding_moments(spark, d):
    return rounded(vectors.moments(V.table(spark, d, "embeddings"), [], "embedding"), 4)


@query()
def frechet_distance(spark, d):
    e = V.table(spark, d, "embeddings")
    return spark.createDataFrame([(vectors.frechet(e.where("label < 5"), e.where("label >= 5"), "embedding"),)], "frechet double")


ROLL = "n AS (SELECT piece_id, pitch, floor(t0 / (15.0::DOUBLE / 120)) AS a, greatest(floor(t0 / (15.0::DOUBLE / 120)) + 1, ceil(t1 / (15.0::DOUBLE / 120))) AS b FROM notes)"


@query("SELECT piece_id, win, step, pitch, max(e - step)::BIGINT AS dur FROM (SELECT piece_id, pitch, win, greatest(0, a - win * 32)::BIGINT AS step, least(32, b - win * 32)::BIGINT AS e FROM (SELECT *, unnest(range(floor(a / 32)::BIGINT, floor((b - 1) / 32)::BIGINT + 1)) AS win FROM n)) GROUP BY 1, 2, 3, 4", V.NOTES, ROLL)
def piano_roll(spark, d):
    return rounded(vectors.roll(V.notes(spark, d), ["piece_id"], F.lit(120.0)))


BEATS = """beats AS (SELECT piece_id, k AS beat, k * 0.5::DOUBLE AS b0, k * 0.5::DOUBLE + 0.5 AS b1 FROM (SELECT piece_id, unnest(range(ceil(max(t1) / 0.5)::BIGINT)) AS k FROM notes GROUP BY 1)),
c AS (SELECT b.piece_id, beat, pitch % 12 AS pc, sum(least(b1, t1) - greatest(b0, t0)) AS w, min(pitch) AS low FROM beats b JOIN notes n ON n.piece_id = b.piece_id AND t1 > b0 AND t0 < b1 GROUP BY 1, 2, 3)"""


@query("SELECT piece_id, beat, first(pc ORDER BY w DESC, pc) AS root, min(low) AS bass, count(*) AS n_classes FROM c GROUP BY 1, 2", V.NOTES, BEATS)
def beat_chords(spark, d):
    """Chords of all beats up to each piece's last note end."""
    notes = V.notes(spark, d)
    beats = notes.groupBy("piece_id").agg(F.ceil(F.max("t1") / 0.5).alias("n")).where("n > 0")
    beats = beats.select("piece_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("beat"))
    beats = beats.withColumn("b0", F.col("beat") * 0.5).withColumn("b1", F.col("b0") + 0.5)
    out = vectors.beat_chords(notes, beats, ["piece_id"])
    return rounded(out.select("piece_id", "beat", "root", "bass", F.aggregate("chroma", F.lit(0), lambda a, x: a + x).alias("n_classes")))


@query("SELECT run, 'Pitch JSD' AS metric, round(x / 4, 4) AS min, round(x / 2, 4) AS q1, round(x, 4) AS median, round(x + 1, 4) AS q3, round(x + 2, 4) AS max FROM printed", V.PRINTED)
def printed_divergences(spark, d):
    return rounded(reshape.divergence_blocks(V.printed(spark, d), ["run"], "text"), 4)


@query("SELECT run, CASE WHEN run % 5 > 0 THEN round(x * 8, 4) END AS frechet FROM printed", V.PRINTED)
def printed_frechet(spark, d):
    return rounded(reshape.frechet_line(V.printed(spark, d), ["run"], "text"), 4)


@query("SELECT run, 'consonant ratio' AS ratio, round(x / 2, 4) AS mean FROM printed UNION ALL SELECT run, 'unsupported ratio', round(x / 8, 4) FROM printed", V.PRINTED)
def printed_ratios(spark, d):
    return rounded(reshape.ratio_means(V.printed(spark, d), ["run"], "text"), 4)


@query("SELECT run, 'continuation' AS section, round(x + 3, 4) AS mean FROM printed", V.PRINTED)
def printed_section_means(spark, d):
    return rounded(reshape.section_means(V.printed(spark, d), ["run"], "text", {"Prompt Latents": "continuation"}, "txt mean distance"), 4)


@query("SELECT name, row_number() OVER (ORDER BY regexp_extract(lower(name), '^[a-z]+'), regexp_extract(name, '[0-9]+')::INT, name) - 1 AS place FROM (SELECT DISTINCT (CASE WHEN c_custkey % 2 = 0 THEN 'Run' ELSE 'gen' END) || (c_custkey * 7 % 10007)::VARCHAR AS name FROM customer)")
def natural_order(spark, d):
    k = F.col("c_custkey")
    rows = V.table(spark, d, "customer").select(F.concat(F.when(k % 2 == 0, "Run").otherwise("gen"), (k * 7 % 10007).cast("string")).alias("name"))
    return reshape.natural_order(rows, "name")


@query("SELECT run, epoch(start)::BIGINT AS start, n, round(hit_rate, 6) AS hit_rate FROM (SELECT user_id % 20 AS run, date_trunc('day', ts) AS start, count(*) AS n, avg((event_type <> 'error')::INT) AS hit_rate FROM events GROUP BY 1, 2)")
def tick_windows(spark, d):
    from tessera.streaming.ticks import windowed

    e = V.table(spark, d, "events")
    rows = e.select(F.col("ts"), (F.col("user_id") % 20).alias("run"), (F.col("event_type") != "error").alias("is_hit"), F.lit(1.0).alias("backup_level"))
    out = rounded(windowed(rows, ["run"], window="1 day"))
    return out.select("run", F.col("start").cast("long").alias("start"), "n", "hit_rate")


def documents_of(spark, d):
    """A run's result as JSON for each supplier: parts missing by turns, the distance once a number and once a summary."""
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("run"), (F.col("s_suppkey") % 64 / 64).alias("x"))
    number = lambda v: F.format_string("%.6f", v)
    x, k = F.col("x"), F.col("run")
    fmd = F.when(k % 3 == 0, number(x)).when(k % 3 == 1, F.concat(F.lit('{"mean": '), number(x * 2), F.lit("}"))).otherwise("null")
    text = F.concat(
        F.lit('{"summary": {"accompaniment_vs_groundtruth": {"pitch_jsd": {"mean": '), number(x / 2), F.lit('}, "onset_jsd": null, "frechet_music_distance": '), fmd,
        F.lit('}, "inter_track_continuity": {"auto_phrase_pairs": {"rd": {"mean": '), number(x + 1), F.lit("}}}}, "), F.lit('"details": [{"pitch_jsd": '), number(x),
        F.lit(', "harmonicity": {"consonant_ratio": '), number(x / 4), F.lit('}}, {"consonant_ratio": null, "harmonicity": {"consonant_ratio": 9}}, 7]}'),
    )
    return s.select("run", "x", F.try_parse_json(text).alias("doc"))


RUNS = "d AS (SELECT s_suppkey AS run, s_suppkey % 64 / 64.0::DOUBLE AS x FROM supplier)"


@query("SELECT run, round(x / 2, 6) AS pitch_jsd, NULL::DOUBLE AS onset_jsd, round(CASE run % 3 WHEN 0 THEN x WHEN 1 THEN x * 2 END, 6) AS frechet_music_distance, round(x + 1, 6) AS rd FROM d", RUNS)
def report_metrics(spark, d):
    from tessera.plans import evaluation

    none = spark.createDataFrame([], "candidate string, global_hit_rate double, global_avg_backup double, ISR_w double")
    rows = evaluation.report(documents_of(spark, d).select(F.col("run").cast("string").alias("name"), "doc"), none)
    return rounded(rows.select(F.col("name").cast("long").alias("run"), "pitch_jsd", "onset_jsd", "frechet_music_distance", "rd"))


@query("SELECT run, 0 AS item, round(x, 6) AS pitch_jsd, round(x / 4, 6) AS consonant_ratio FROM d UNION ALL SELECT run, k, NULL, NULL FROM d, range(1, 3) AS r(k)", RUNS)
def result_items(spark, d):
    from tessera.plans import evaluation
    from tessera.sources import files

    rows = files.result_items(documents_of(spark, d), ["run"], evaluation.ITEM_METRICS)
    return rounded(rows.select("run", F.col("item").cast("long").alias("item"), "pitch_jsd", "consonant_ratio"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 16 > 0 THEN (o_custkey % 16) / 4.0 WHEN o_orderkey % 8 > 0 THEN (o_orderkey % 8) / 2.0 END::DOUBLE AS avg_nll, CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 5)::DOUBLE END AS total_nll, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 END AS total_tokens FROM orders")
def nll_aliases(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    doc = F.to_json(F.struct((c % 16 / 4).alias("avg_loss"), (k % 8 / 2).alias("mean_nll"), (c % 5).alias("sum_nll"), (k % 7).alias("n_tokens")))
    return V.table(spark, d, "orders").select(k, likelihood.aliased(F.try_parse_json(doc)).alias("x")).select("o_orderkey", "x.avg_nll", "x.total_nll", F.col("x.total_tokens").cast("long").alias("total_tokens"))


@query("SELECT run % 4 AS kind, max(x + 1) AS box_top, max(x + 1 - x / 2) AS iqr_max, max(x + 1) + greatest(0.01, 0.3 * max(x + 1 - x / 2)) AS focus FROM d GROUP BY 1".replace("max(x + 1 - x / 2)", "round(max(x + 1 - x / 2), 6)").replace("max(x + 1) + greatest", "round(max(x + 1) + greatest").replace(", 6)) AS focus", ", 6)), 6) AS focus"), RUNS)
def axis_caps(spark, d):
    rows = documents_of(spark, d).select((F.col("run") % 4).alias("kind"), (F.col("x") / 2).alias("q1"), (F.col("x") + 1).alias("q3"))
    return rounded(reshape.axis_caps(rows, ["kind"]))


@query(
    "SELECT piece_id, row_number() OVER (PARTITION BY piece_id ORDER BY t) - 1 AS bar_idx, t FROM (SELECT piece_id, unnest(list_distinct(list_append(list_append(list_transform(range(floor(e / 1.5)::BIGINT + 1), lambda k: k * 1.5::DOUBLE), e), 0.0::DOUBLE))) AS t FROM (SELECT piece_id, max(t1) AS e FROM notes GROUP BY 1))",
    V.NOTES,
)
def bar_boundaries(spark, d):
    """Bars of pieces without beats: of three beats at 120 a minute, with the start and the end."""
    meta = V.notes(spark, d).groupBy("piece_id").agg(F.max("t1").alias("end_time")).withColumns({"tempo": F.lit(120.0), "ts_numerator": F.lit(3)})
    none = spark.createDataFrame([], "piece_id long, t double")
    return rounded(phrases.bar_boundaries(meta, none, none, ["piece_id"]))


@query("SELECT name, n, last_of_group FROM (SELECT name, g, row_number() OVER w - 1 AS n, coalesce(lead(g) OVER w <> g, true) AS last_of_group FROM (SELECT DISTINCT 'interval' || (c_custkey % 120)::VARCHAR || '_gen' || (c_custkey % 77)::VARCHAR AS name, 'interval' || (c_custkey % 120)::VARCHAR AS g, c_custkey % 120 AS i, c_custkey % 77 AS j FROM customer) WINDOW w AS (ORDER BY i, j))")
def group_boundaries(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.lit("interval"), (k % 120).cast("string"), F.lit("_gen"), (k % 77).cast("string"))
    rows = reshape.boundaries(V.table(spark, d, "customer").select(name.alias("name")), "name")
    return rounded(rows.select("name", F.col("place").alias("n"), "last_of_group"))
