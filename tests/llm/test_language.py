import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language as L


def test_held_out_accuracy(spark):
    rows = L.op4_ecoc_language(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    got = [r for r in rows.join(truth, "doc_id").collect() if r.held_out]
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_codewords():
    for n in (2, 3, 4, 5, 9):
        code = L.codewords(n)
        assert len({tuple(r) for r in code}) == n and set(code.ravel()) == {-1, 1}
    assert min((a != b).sum() for k, a in enumerate(L.codewords(4)) for b in L.codewords(4)[:k]) == 4


def test_odd(odd_docs, no_docs):
    code = L.train(odd_docs)
    assert code.langs == ["en"]
    rows = {r.doc_id: r for r in L.identify(odd_docs.where("doc_id != 8"), code, ["doc_id"]).collect()}
    assert {k for k in rows if rows[k].lang_pred == "und"} == {2, 3, 4}
    assert L.identify(no_docs, code, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in L.identify(odd_docs, L.train(no_docs), ["doc_id"]).collect()} == {"und"}


def test_counts_are_sums_over_all_rows(docs):
    langs, counts = L.class_counts(docs)
    for lang, have in zip(langs, counts):
        texts = [r.text for r in docs.where(docs.lang == lang).collect()]
        assert have.sum() == sum(L.grams(pa.array([t]))[1].sum() for t in texts)


def plain_decision(code, texts):
    """Decoding one text, bit and language at a time."""
    out = []
    for text in texts:
        counts, n = (x[0] for x in L.grams(pa.array([text])))
        losses = []
        for word in code.words:
            loss = 0.0
            for bit, weight, side in zip(word, code.bit_weights, code.weights):
                margin = L.SCALE * sum(int(counts[b]) * side[b] for b in np.flatnonzero(counts)) / max(int(n), 1)
                loss += weight * math.log1p(math.exp(-bit * margin)) if bit * margin > -700 else weight * -bit * margin
            losses.append(loss)
        order = sorted(range(len(losses)), key=lambda k: (losses[k], k))
        share = 1 / sum(math.exp(losses[order[0]] - x) for x in losses)
        known = any(map(str.isalpha, text or ""))
        out.append((code.langs[order[0]] if known else "und", share if known else 0.0, not known or losses[order[1]] - losses[order[0]] < L.LEAD))
    return out


def made(rng, lang, n):
    """Words of a language of its own: syllables that others don't favour."""
    syllables = [f"{a}{b}" for a in "bcdfghjklmnpqrstvwxz"[lang::3] for b in "aeiouy"[lang % 2 :]]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.mark.parametrize("n", [2, 3, 7])
def test_decoding(spark, n):
    """Scores, ties and doubts against plain loops; more languages than the exhaustive code takes are told apart too."""
    rng = random.Random(n)
    rows = [(k, made(rng, k % n, 40), f"l{k % n}") for k in range(40 * n)]
    code = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [made(rng, k % n, 30) for k in range(10 * n)] + ["a", "", None, "12 3", "Ünï", "qqq " * 3000, made(rng, 0, 5) + made(rng, 1, 5)]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)] + [(len(texts), texts[0], "x", "y")], "doc_id long, text string, lang_pred string, score string")
    got = sorted(L.identify(df, code, ["doc_id", "lang_pred", "score"]).collect())
    want = plain_decision(code, [*texts, texts[0]])
    assert len(got) == len(want)
    for r, (lang, score, doubt) in zip(got, want):
        assert r.lang_pred == lang and math.isclose(r.score, score, rel_tol=1e-6, abs_tol=1e-12) and r.ambiguous == doubt
    assert np.mean([r.lang_pred == f"l{k % n}" for k, r in enumerate(got[: 10 * n])]) > 0.95


def test_ties():
    """Without evidence all languages are as near, and the first one counts."""
    code = L.Code(["a", "b", "c"], np.ones((3, L.BINS)))
    which, share, doubt = code.decide(np.zeros((1, L.BINS)), np.zeros(1))
    assert which[0] == 0 and math.isclose(share[0], 1 / 3) and doubt[0]


def test_codes_of_many_languages():
    """Any two codewords differ in a third of the bits at least."""
    for n in (6, 9, 20, 60):
        code = L.codewords(n)
        assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= code.shape[1] / 3.5
