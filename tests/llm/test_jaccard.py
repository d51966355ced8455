import random
import re

from tessera.llm import components as C
from tessera.llm import jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute(rows, size=5, percent=75):
    own = [(k, shingles(t, size)) for k, t in rows]
    up = {k: k for k, _ in own}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    links = [0] * len(own)
    for i, (a, x) in enumerate(own):
        for j, (b, y) in enumerate(own[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links[i] += 1
                links[j] += 1
                if root(a) != root(b):
                    low, high = sorted((root(a), root(b)))
                    up[high] = low
    return sorted((k, len(s), root(k), n) for (k, s), n in zip(own, links))


def got(df, **more):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in J.components(df, links=True, **more).collect())


def test_supplied_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == brute(rows)


def near_copies(rng, n=160):
    """Families of edited copies of all sizes around the threshold, short and empty texts, exact copies."""
    rows = []
    for k in range(n):
        kind = rng.random()
        if not rows or kind < 0.25:
            words = [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.choice([1, 3, 5, 8, 20, 60]))]
        else:
            words = list(rows[rng.randrange(len(rows))])
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice("qrstuv") * 2
        rows.append(words)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(J, "REPEATS", 2)
    monkeypatch.setattr(J, "HUB_PAIRS", 3)
    for seed in range(2):
        rows = near_copies(random.Random(seed))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(df) == brute(rows)
        assert got(df, size=2, percent=50) == brute(rows, 2, 50)
    monkeypatch.setattr(J, "CELL_DOCS", 3)  # several blocks
    monkeypatch.setattr(J, "LISTED", 2)  # shingles counted by products
    assert got(df) == brute(rows)
    monkeypatch.setattr(J, "HEAVY", 0)
    assert got(df) == brute(rows)


def test_without_pilot(spark, monkeypatch):
    """The join alone finds every link."""
    rows = near_copies(random.Random(9))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for repeats in (2, 1000):
        monkeypatch.setattr(J, "REPEATS", repeats)
        monkeypatch.setattr(J, "pilot_pairs", lambda prefixes, percent: prefixes.selectExpr("doc a", "doc b").limit(0))
        assert got(df) == brute(rows)


def test_full_shingles(spark, monkeypatch):
    """Shingles with more rows than a task takes go the salted way; the result is the same."""
    rows = near_copies(random.Random(5))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(J, "REPEATS", 1000)
    monkeypatch.setattr(J, "pilot_pairs", lambda prefixes, percent: prefixes.selectExpr("doc a", "doc b").limit(0))
    monkeypatch.setattr(J, "TOKEN_ROWS", 2)
    monkeypatch.setattr(J, "INDEX_ROWS", 40)
    assert got(df) == brute(rows)


def test_one_shingle_in_all_documents(spark, monkeypatch):
    """No task pairs the rows of a shingle that all documents have, though the tasks' counts don't tell that it is common."""
    rows = [(k, f"all of them have this {' '.join(f'w{k}x{j}' for j in range(3))}") for k in range(50_000)]
    rows += [(k + 50_000, rows[k][1]) for k in range(0, 50_000, 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16, "doc_id")
    monkeypatch.setattr(J, "REPEATS", 1_000_000)
    found = {r.doc_id: (r.component_id, r.n_links) for r in J.components(df, links=True).collect()}
    assert found == {k: (k % 50_000, int(k % 1000 == 0)) for k, _ in rows}


def test_groups_of_equal_prefix(spark, monkeypatch):
    """Where the smallest members of two groups don't link, further members do."""
    monkeypatch.setattr(J, "pilot_pairs", lambda prefixes, percent: prefixes.selectExpr("doc a", "doc b").limit(0))
    real = J.labelled
    monkeypatch.setattr(J, "labelled", lambda prefixes, labels: real(prefixes, labels).withColumn("label", J.F.pmod("doc", J.F.lit(2))))  # labels as wide as can be
    rows = [(k, t) for k, t in near_copies(random.Random(4), 60) if len(t.split()) > 4]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = J.linked, []
    monkeypatch.setattr(J, "linked", lambda pairs, *more: links[1].append(1) or links[0](pairs, *more))
    J.components(df).collect()
    assert len(links[1]) >= 2


def test_keys(spark):
    """Null keys are no nodes; rows of one key are one node, with classes and links of their own."""
    words = "the quick brown fox jumps over the lazy dog and runs"
    rows = [(1, words), (2, f"another {words} text"), (5, words), (5, f"another {words} text"), (None, words), (None, "only this one is here now"), (8, "only this one is here now"), (9, words), (9, words), (11, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = J.components(df, links=True).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.class_id, r.component_id) for r in out} == {(1, 1, 1), (2, 2, 1), (5, 1, 1), (5, 2, 1), (9, 1, 1), (8, 8, 8), (11, 11, 11), (None, None, None)}
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out if r.doc_id is not None) == brute([r for r in rows if r[0] is not None])
    assert {r.n_links for r in out if r.doc_id is None} == {0}


def test_odd(spark, odd_docs, no_docs):
    want = {r.doc_id: (r.n_shingles, r.component_id) for r in J.components(odd_docs).collect()}
    assert want[1] == want[0] == (8, 0)
    assert [want[k] for k in (2, 3, 4)] == [(0, 2), (0, 3), (0, 4)]
    assert J.components(odd_docs).count() == odd_docs.count() and J.components(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 450)]
    up = {}

    def root(k):
        up.setdefault(k, k)
        return k if up[k] == k else root(up[k])

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    got = {r.u: r.v for r in C.smallest(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: root(k) for k in up if root(k) != k}


def test_common_shingles(spark):
    """Pairs of different labels over a shingle, whichever label is the main one; ties between labels included."""
    rows = [(t, g, 70, 10, label) for t, own in enumerate(([(1, 1), (2, 2)], [(9, 9), (3, 3)], [(1, 1), (2, 1), (3, 3), (4, 4)])) for g, label in own]
    for n in (1, 4):
        df = spark.createDataFrame(rows, J.ENTRY).repartition(n)
        got = {(r.a, r.b) for r in J.common_pairs(df, 75).collect()}
        assert got == {(1, 2), (3, 9), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)}
