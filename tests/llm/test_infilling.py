import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import infilling

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
ODD = ["  two  blanks  before ", "é ü\t日本語 \n\n", "holds <P> a mark", "<S", "a<", ">b <", "   ", "x", "   wide blanks", "\x00\x1f\x85 controls", "word " * 20_000 + "é" * 5_000]


def brute(key, text, split=TOKEN.findall):
    """By a list of units and slices of it."""
    text = text or ""
    units, h = split(text), hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:one], units[one:two], units[two:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def held(df, unit, split):
    rows = infilling.transform(df, ["doc_id", "text"], unit=unit).withColumn("again", infilling.restore(F.col("output"), F.col("form"))).collect()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, split)
        assert r.again == (r.text or "")
    return rows


@pytest.mark.parametrize(("unit", "split"), [("tokens", TOKEN.findall), ("characters", list)])
def test_against_lists_of_units(spark, docs, odd_docs, unit, split):
    odd = spark.createDataFrame([(k, t) for k in range(1000, 1600) for t in [ODD[k % len(ODD)]]] + [(None, "no id at all"), (None, None)], "doc_id long, text string")
    assert {r.form for r in held(docs, unit, split)} == {"plain", "psm", "spm"}
    assert {r.form for r in held(odd, unit, split)} == {"plain", "psm", "spm"}
    rows = held(odd_docs, unit, split)
    assert sum(r.doc_id == 0 for r in rows) == 2


def test_digest(docs):
    found = infilling.transform(docs, ["doc_id"])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {r.doc_id: (sha(r.output), sha(t or "")) for r, t in ((r, r.text) for r in infilling.transform(docs, ["doc_id", "text"]).collect())}
    assert {r.doc_id: (r.output_sha256, r.restored_sha256) for r in infilling.digest(found).collect()} == want


def test_clashing_names_shares_and_marks(odd_docs, no_docs):
    df = odd_docs.selectExpr("doc_id", "text", "1 as n", "2 as form", "3 as _key", "4 as _text", "5 as `a.b`")
    found = infilling.transform(df, ["doc_id", "n", "a.b"], share=100, suffix_first=0, marks=("[[p", "[[s", "[[m"))
    assert found.columns == ["doc_id", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = found.collect()
    assert len(rows) == odd_docs.count() and {r.form for r in rows} == {"plain", "psm"}
    assert infilling.transform(no_docs, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        infilling.transform(df, [], marks=("<P>", "<P>x", "<M>"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nab<é日👍", max_size=30)), min_size=1, max_size=6), st.sampled_from(infilling.UNITS), st.integers(0, 40))
def test_every_cut(texts, unit, k):
    import numpy as np

    runs = infilling.Runs(pa.array(texts, pa.string()), unit)
    units = [(TOKEN.findall if unit == "tokens" else list)(t or "") for t in texts]
    assert runs.n.tolist() == [len(u) for u in units]
    cuts = np.array([k % (len(u) + 1) for u in units])
    at, points = runs.cut(cuts)
    for own, c, b, p, begin in zip(units, cuts, at, points, runs.ends):
        assert p == len("".join(own[:c])) and b - begin == len("".join(own[:c]).encode())
