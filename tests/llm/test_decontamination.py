import hashlib
import re

from tessera.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, size=10):
    words, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
    for name, t in items:
        own = WORD.findall((t or "").translate(LOWER))
        m = min(size, len(own))
        wins = {tuple(own[k : k + m]) for k in range(len(own) - m + 1)} if m else ()
        for k in range(len(words) - m + 1 if m else 0):
            if tuple(words[k : k + m]) in wins:
                hit |= set(range(k, k + m))
                found.add(str(name))
    return len(words), sorted(hit), sorted(found)


def check(spark, df, bench, size=10):
    items = [tuple(r) for r in bench.collect()]
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = D.scan(df, bench, ["doc_id"], size=size).collect()
    assert len(rows) == df.count()
    for r in rows:
        n, hit, found = brute(texts[r.doc_id], items, size)
        got = [k for s in r.hits for k in range(s.start, s.end)]
        assert (r.n_words, r.n_hit, got, r["items"]) == (n, len(hit), hit, found)
    return rows


def test_against_brute_force(spark, sf_dir, docs):
    rows = check(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert any(r.n_hit for r in rows)


def test_odd(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "QUICK brown"), (2, None), (3, ""), (4, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem"), (5, "a b c"), (5, "one"), (1, "quick brown"), (6, "again")], "item_id long, text string")
    check(spark, odd_docs.dropDuplicates(["doc_id"]), bench)
    check(spark, odd_docs.dropDuplicates(["doc_id"]), bench, size=2)
    assert D.scan(no_docs, bench, ["doc_id"]).count() == 0
    assert {r.n_hit for r in D.scan(odd_docs, bench.limit(0), ["doc_id"]).collect()} == {0}


def test_items_in_parts(spark, sf_dir, docs, odd_docs, monkeypatch):
    """More items than one scan takes go in parts: hits and ids are as with all at once."""
    monkeypatch.setattr(D, "PART_BYTES", 500)
    assert any(r.n_hit for r in check(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(["QUICK brown", "lorem ipsum dolor", "dolor sit amet lorem", "a b c", "again and"] * 9)], "item_id long, text string")
    check(spark, odd_docs.dropDuplicates(["doc_id"]), bench)
    more = odd_docs.withColumn("hits", D.F.lit("x")).withColumn("_items", D.F.lit("y")).withColumn("n_words", D.F.lit("z"))
    out = D.scan(more, bench, ["doc_id", "text", "hits", "_items", "n_words", "lang"])
    assert out.columns == ["doc_id", "text", "lang", "n_words", "n_hit", "hits", "items"] and out.count() == odd_docs.count()


def test_many_parts_one_at_a_time(spark, monkeypatch):
    """Thirty parts: what is planned at last scans for one of them, and all their hits are there, for repeated rows too."""
    monkeypatch.setattr(D, "PART_BYTES", 150)
    bench = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} of item {k}") for k in range(50)], "item_id long, text string")
    rows = [(k, " ".join(f"x alpha{j} beta{j} gamma{j} of item {j} y" for j in range(k % 7, 50, 9))) for k in range(12)] + [(3, "alpha3 beta3 gamma3 of item 3"), (None, None)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string").withColumn("a,b c", D.F.lit(1))
    found = D.scan(df, bench, ["doc_id", "text", "a,b c"])
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = found.collect()
    assert len(got) == len(rows) + 2
    for r in got:
        n, hit, names = brute(r.text, [(k, f"alpha{k} beta{k} gamma{k} of item {k}") for k in range(50)])
        assert (r.n_words, r.n_hit, r["items"], r["a,b c"]) == (n, len(hit), names, 1)


def test_query(spark, sf_dir):
    rows = D.op7_wu_manber(spark, sf_dir).collect()
    assert len(rows) == 200 and all((r.n_hit > 0) == r.contaminated == (r.n_items > 0) for r in rows)
    assert {r.items_sha256 for r in rows if not r.n_items} == {hashlib.sha256(b"").hexdigest()}
