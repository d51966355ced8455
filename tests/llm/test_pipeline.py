import re
import sys
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tessera.llm import language, packing, secrets

from .test_decontamination import brute as hits
from .test_jaccard import brute as groups


@pytest.fixture(scope="module")
def planted(spark, docs):
    """Supplied documents with copies, a passage of the benchmark, a secret, a text without letters, and nulls."""
    rows = [tuple(r) for r in docs.orderBy("doc_id").limit(60).collect()]
    bench = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    long = max(rows, key=lambda r: len(r[1]))
    rows += [
        (900, long[1], *long[2:]), (901, long[1] + " end", *long[2:]), (901, long[1] + " end", *long[2:]),
        (902, "Lead in. " + bench[0] + " And out of it.", "en", "src0", 1), (903, "the key AKIA" + "Q7ZR" * 4 + " and more of the text", "en", "src0", 1),
        (904, "1234 5678 ...", "en", "src0", 1), (905, None, "en", "src0", None), (906, "the end of the text and more", None, None, None),
    ]
    return spark.createDataFrame(rows, docs.schema)


def test_stages_against_brute_force(spark, planted, sf_dir):
    now, rows = planted, planted.collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in P.STAGES:
        now = P.written(stage(spark, now, sf_dir), name)
        if name != "packing":
            assert now.columns == planted.columns and now.dtypes == planted.dtypes
        got = now.collect()
        if name == "language":
            want = [r for r in rows if any(map(str.isalpha, r.text or ""))]
            assert sorted(got, key=str) == sorted(want, key=str) and 906 in {r.doc_id for r in got}
        elif name == "near_duplicates":
            roots = {k: root for k, _, root, _ in groups([(r.doc_id, r.text) for r in rows])}
            assert sorted(r.doc_id for r in got) == sorted(k for k, root in roots.items() if k == root)
        elif name == "benchmark":
            assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows if not hits(r.text, items)[1])
            assert 902 not in {r.doc_id for r in got}
        elif name == "secrets":
            before = {r.doc_id: r for r in rows}
            assert len(got) == len(rows)
            for r in got:
                if r.text == before[r.doc_id].text:
                    assert r.n_chars == before[r.doc_id].n_chars
                else:
                    assert secrets.REDACTED in r.text and r.n_chars == len(r.text)
            assert "AKIA" not in {r.doc_id: r.text for r in got}[903]
        else:
            one, ids = Tokenizer.from_file(packing.tokenizer_path()), defaultdict(list)
            for p in sorted(got, key=lambda p: (p.doc_id, p.start)):
                ids[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
            assert ids == {r.doc_id: one.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows}
        rows = got


def test_run_is_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, sf_dir), name)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(P.run(spark, sf_dir)) == key(docs)


def test_empty(spark, planted, sf_dir):
    now = planted.limit(0)
    for _, stage in P.STAGES:
        now = stage(spark, now, sf_dir)
    assert now.count() == 0


def test_odd(spark, planted, sf_dir):
    """Null keys, repeated rows with other columns, and columns with added names: they keep their values at every stage."""
    odd = planted.unionByName(planted.where("doc_id in (902, 3, 901)").withColumn("source", P.F.lit("b"))).unionByName(planted.where("doc_id = 5").withColumn("doc_id", P.F.lit(None).cast("long")))
    names = ("lang_pred", "score", "n_words", "hits", "items", "_hits", "findings", "redacted_text", "class_id", "k", "_row", "_text")
    odd = odd.withColumns({c: P.F.concat(P.F.lit(c), P.F.coalesce("source", P.F.lit(""))) for c in names}).withColumn("m", P.F.create_map(P.F.lit("a"), "source"))
    now = odd
    for name, stage in P.STAGES[:-1]:
        now = P.written(stage(spark, now, sf_dir), name)
        assert now.columns == odd.columns and now.dtypes == odd.dtypes
        for r in now.collect():
            assert all(r[c] == c + (r.source or "") for c in names) and r.m == {"a": r.source}
        if name == "near_duplicates":
            rows = now.collect()
            ids = [r.doc_id for r in rows]
            assert None in ids and len(ids) == len(set(ids))
            assert next(r.source for r in rows if r.doc_id == 3) == "b"  # sorts before src0
    assert P.packed(spark, now, sf_dir).count() > 0


def test_nothing_to_learn(spark, planted, sf_dir):
    """Without any known language only texts without a letter go."""
    got = {r.doc_id for r in P.known_language(spark, planted.withColumn("lang", P.F.lit(None).cast("string")), sf_dir).collect()}
    assert got == {r.doc_id for r in planted.collect() if any(map(str.isalpha, r.text or ""))}


def test_a_very_long_text(spark, planted, sf_dir):
    """A text of some megabytes with a secret far inside it goes through all stages whole; so does one of many short lines."""
    rows = [r for r in planted.collect() if r.text and len(r.text) > 300 and r.lang][:40]
    long = " ".join(f"{r.text} {k}" for k in range(3_000_000 // sum(len(r.text) for r in rows) + 1) for r in rows)
    secret = "AKIA" + "Q7ZR" * 4
    at = len(long) // 2
    docs = spark.createDataFrame([(10**6, f"{long[:at]} {secret} {long[at:]}", rows[0].lang, "src0", len(long))], planted.schema).unionByName(planted)
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = P.written(stage(spark, now, sf_dir), name)
        if name != "benchmark":
            assert now.where("doc_id = 1000000").count() == 1
        else:
            now = now.unionByName(docs.where("doc_id = 1000000")).dropDuplicates(["doc_id"])
    text = now.where("doc_id = 1000000").first().text
    assert secret not in text and len(text) > 2_900_000
    pieces = P.packed(spark, now.where("doc_id = 1000000"), sf_dir).collect()
    assert sum(r.length for r in pieces) == pieces[0].doc_tokens > 500_000
