import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + d for k in range(len(words) - 2) if wins[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def normal(line):
    return " ".join(WORD.findall(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))))


def brute(rows, min_texts, share, most_texts=10**9):
    texts, out = defaultdict(set), []
    for r in rows:
        texts[r.source].add(r.text)
    often = {}
    for host, own in texts.items():
        n = Counter(x for t in own if t is not None for x in {normal(x) for x in t.split("\n")} - {""})
        often[host] = {x for x, k in n.items() if k > min(max(min_texts, share * len(own)), most_texts)}
    for r in rows:
        b = base(r.text)
        lost = sum(len(WORD.findall(x)) for x in (r.text or "").split("\n") if normal(x) in often[r.source])
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        out.append((r.doc_id, *b, lost, failed, not failed and lost <= 0.5 * b[0]))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.removed_words, r.base_failed, r.kept) for r in df.collect())


def test_against_brute_force(docs, odd_docs, no_docs):
    for df, *limits in ((docs, 2, 0.0, 10**9), (docs, 20, 0.05, 10**9), (docs, 20, 0.5, 4), (odd_docs, 0, 0.0, 10**9), (docs, Q.MIN_TEXTS, Q.SHARE, Q.MOST_TEXTS)):
        assert got(Q.judge(df, ["doc_id"], min_texts=limits[0], share=limits[1], most_texts=limits[2])) == brute(df.collect(), *limits)
    assert Q.judge(no_docs, ["doc_id"]).count() == 0


def test_depleted(spark):
    shared = "these boilerplate words stand in every page of the host and fill it " * 5
    rows = [(k, shared + "\n" + " ".join(f"own{k}x{j}" for j in range(10)), "a") for k in range(60)]
    rows += [(100 + k, " ".join(f"w{k}x{j}" for j in range(80)), None) for k in range(3)] + [(100, " ".join(f"w0x{j}" for j in range(80)), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = Q.judge(df, ["doc_id"]).collect()
    assert {r.doc_id for r in out if r.removed_words} == set(range(60))
    assert {r.doc_id for r in out if r.kept} == {100, 101, 102}


def test_clashes(docs):
    """Added names win; _row and _host are left out; the rest is as without them."""
    more = docs.limit(30).withColumn("kept", Q.F.lit("x")).withColumn("n_words", Q.F.lit("y")).withColumn("_row", Q.F.lit(1)).withColumn("_host", Q.F.lit("z"))
    one, two = Q.judge(more, ["doc_id", "kept", "n_words", "_row", "_host"]), Q.judge(docs.limit(30), ["doc_id"])
    assert one.columns == two.columns and got(one) == got(two)


@pytest.mark.parametrize("few", [Q.FEW, 0])
def test_frequent_lines_are_removed(spark, docs, odd_docs, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    for df, least in ((docs, 2), (odd_docs, 0)):
        rows = df.collect()
        texts, n = defaultdict(set), defaultdict(Counter)
        for r in rows:
            texts[r.source].add(r.text or "")
        for host, own in texts.items():
            for t in own:
                n[host].update({normal(x) for x in t.split("\n")} - {""})
        want, cut = [], 0
        for r in rows:
            lines = list(enumerate((r.text or "").split("\n")))
            gone = [k for k, x in lines if n[r.source][normal(x)] > least]
            cut += bool(gone)
            want.append((r.doc_id, gone, None if r.text is None else "\n".join(x for k, x in lines if k not in gone)))
        got = Q.judge(df, ["doc_id", "text"], min_texts=least, share=0.0).collect()
        key = lambda x: (x[0], str(x))
        assert cut and sorted(((r.doc_id, r.removed_lines, r.clean_text) for r in got), key=key) == sorted(want, key=key)
        plain = Q.judge(df, ["doc_id"], min_texts=least, share=0.0)
        cols = plain.columns
        assert sorted(map(str, plain.collect())) == sorted(map(str, Q.judge(df, ["doc_id", "text"], min_texts=least, share=0.0).select(cols).collect()))
