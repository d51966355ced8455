import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
import regex

from tessera.llm import secrets as S


@pytest.fixture(scope="module")
def forest(spark):
    return S.train(spark)


def test_held_out_labels(spark, forest):
    from pyspark.sql import functions as F

    rows = S.labelled(spark, 2 * S.LABELLED).where(F.col("id") >= S.LABELLED) if "id" in S.labelled(spark).columns else S.labelled(spark, 2 * S.LABELLED)
    rows = rows.withColumn("x", S.features(F.col("value"), F.col("before"), F.col("after"), F.col("path")))
    score = S.trees.total(forest, lambda k: F.col("x")[S.FEATURES[k]]) / len(forest)
    got = rows.select("label", (score >= 0.5).cast("int").alias("p")).collect()[S.LABELLED :]
    assert len(got) == S.LABELLED and sum(r.label == r.p for r in got) / len(got) > 0.95


def test_places_and_redaction(spark, forest, docs, odd_docs, no_docs):
    key, token = "AKIA" + "Q7ZR" * 4, "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    rows = [(1, f"a key {key} and\ntoken = \"{token}\", then password=changeme_example end", "src"), (2, f"é {key}", None), (3, f"commit {token} was built", "x"), (4, "password=", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in S.scan(df, forest, ["doc_id"]).collect()}
    for k, text, _ in rows:
        for f in got[k].findings:
            assert text[f.start : f.start + f.length] == f.value
    assert {f.value for f in got[1].findings if f.secret} == {key, token}
    assert got[1].redacted_text == rows[0][1].replace(key, S.REDACTED).replace(token, S.REDACTED)
    assert got[2].redacted_text == f"é {S.REDACTED}" and got[3].redacted_text == rows[2][1]
    assert not got[4].findings
    for df in (docs, odd_docs):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in S.scan(df, forest, ["doc_id"]).collect():
            out, at = "", 0
            for f in r.findings:
                assert texts[r.doc_id][f.start : f.start + f.length] == f.value
                out += texts[r.doc_id][at : f.start] + (S.REDACTED if f.secret else f.value)
                at = f.start + f.length
            assert r.redacted_text == (None if texts[r.doc_id] is None else out + texts[r.doc_id][at:])
    assert S.scan(no_docs, forest, ["doc_id"]).count() == 0


def test_values_are_whole(spark, forest):
    """Long values leave no tail, a late digit counts, and the forest sees values after any name."""
    rng = random.Random(5)
    made = lambda n, chars=string.ascii_letters + string.digits: "".join(rng.choice(chars) for _ in range(n))
    akia = "AKIA" + made(16, string.ascii_uppercase + string.digits)
    parts = [("token=", made(400)), ("token=", made(100_000)), ("see ", made(90, string.ascii_letters) + made(40)), ("AccountKey=", made(86)), ("DB_PASS=", made(12) + "!7"), ("https://a.b/c?sv=2020&sig=", made(44)), ("u@", made(40)), ("x.", made(40)), ("u=https://h.x/?k=", akia)]
    rows = [(k, f"{before}{value} end", "src0") for k, (before, value) in enumerate(parts)]
    got = {r.doc_id: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), forest, ["doc_id"]).collect()}
    for k, (before, value) in enumerate(parts):
        assert [f.value for f in got[k].findings if f.secret] == [value] and got[k].redacted_text == f"{before}{S.REDACTED} end"


def plain_features(value, before, after, path):
    low, near, n = value.lower(), (before + " " + after).lower(), len(value)
    kinds = re.sub("[^aA0]+", "-", re.sub("[0-9]+", "0", re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", value))))
    share = lambda x, pattern: (len(x) - len(re.sub(pattern, "", x))) / len(x)
    flag = lambda pattern, x: float(bool(re.search(pattern, x)))
    return [
        n, (len(kinds) - 1) / n, share(value, "[0-9]"), share(value, "[A-Z]"), -sum(k / n * math.log2(k / n) for k in Counter(value).values()), share(low, S.DICTIONARY), share(low, "[aeiou]"),
        flag(rf"^(?:{S.PROVIDER})", value), flag(rf"(?:{S.NEAR_SECRET})[^a-z]{{0,12}}$", before.lower()), flag(rf"(?:^|[^a-z])(?:{S.NEAR_OTHER})(?:[^a-z]|$)", near),
        flag("[:=][\"' \t\n\x0b\f\r]*$", before), flag(S.PATHS, path.lower()), flag("^[0-9a-f]+$", low),
    ]


def test_against_plain_python(spark, forest, docs):
    """Candidates by another engine of patterns, features in Python, the forest in numpy."""
    rng = random.Random(3)
    bits = ["token = ", "password:  '", "key=", "commit ", " ", "\n", "AKIA" + "A1B2" * 4, "x" * 30 + "7", "sk-" + "aB3" * 9, "deadbeef" * 5, "é", "'", "user.name=", "hunter2!x", "=", "/usr/lib/python3/x", "0" * 40, "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(40))), rng.choice([None, "src0", "tests/x"])) for k in range(300)]
    rows += [(1000 + r.doc_id, r.text, r.source) for r in docs.collect()]
    got = {r.doc_id: r.findings for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), forest, ["doc_id"]).collect()}
    pattern, total = regex.compile(S.CANDIDATE, regex.ASCII), 0
    for k, text, path in rows:
        found = [(m.start(), m.start() + len(sign := regex.match(f"(?:{S.SIGN})?", m[0], regex.ASCII)[0]), m.end(), sign) for m in pattern.finditer(text)]
        ends, starts = [0, *[end for _, _, end, _ in found]], [*[at for _, at, _, _ in found], len(text)]
        want = []
        for j, (begin, at, end, sign) in enumerate(found):
            before = text[ends[j] : begin][-60:] + re.sub("[ \t\n\x0b\f\r]+", " ", sign)
            x = np.array([plain_features(text[at:end], before[-60:], text[end : starts[j + 1]][:30], path or "")], float)
            want.append((at, text[at:end], sum(S.trees.applied(t, x)[0] for t in forest) / len(forest)))
        assert [(f.start, f.value) for f in got[k]] == [w[:2] for w in want]
        assert all(math.isclose(f.score, w[2], rel_tol=1e-9) and f.secret == (f.score >= S.THRESHOLD) for f, w in zip(got[k], want))
        total += len(want)
    assert total > 1000


def test_private_keys_and_blanks(spark, forest):
    """A private key is one finding from its first line to its last; blanks around a sign don't hide a value."""
    rng = random.Random(2)
    body = "\n".join("".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)) for _ in range(25))
    key = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}==\n-----END RSA PRIVATE KEY-----"
    token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(0, f"a\n{key}\nb"), (1, f"password   =      '{token}' end"), (2, "-----BEGIN PRIVATE KEY----- cut off"), (3, ("-----BEGIN PRIVATE KEY-----" + "a-b " * 200) * 300)]
    got = {r.doc_id: r for r in S.scan(spark.createDataFrame([(k, t, "src") for k, t in rows], "doc_id long, text string, source string"), forest, ["doc_id"]).collect()}
    assert got[0].redacted_text == f"a\n{S.REDACTED}\nb" and [f.value for f in got[0].findings] == [key]
    assert got[1].redacted_text == f"password   =      '{S.REDACTED}' end"
    assert [len(got[k].findings) for k in (2, 3)] == [1, 300]  # without a last line, the first one alone


def test_blanks_hide_nothing(spark, forest):
    """Any number of blanks of any kind on either side of the sign, after a secret's name and after others."""
    rng = random.Random(7)
    token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = []
    for name in ("password", "'api_key'", "access_key", "auth token"):
        for before in (0, 1, 8, 9, 10, 100, 5000):
            for after in (0, 1, 8, 9, 10, 100, 5000):
                rows.append((len(rows), f"see {name}{''.join(rng.choices(' \t\n', k=before))}={''.join(rng.choices(' \t\n', k=after))}{token} end", "src"))
    rows.append((len(rows), "password          =          hunter2!xQ", "src"))
    for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), forest, ["doc_id", "text"]).collect():
        value = r.text.split()[-1] if r.doc_id == len(rows) - 1 else token
        assert [f.value for f in r.findings if f.secret] == [value] and r.redacted_text == r.text.replace(value, S.REDACTED), (r.findings, r.text[:200])
    blanks = [(1, "token " + " " * 300_000 + "x", "s"), (2, "a = " * 50_000, "s"), (3, "token = " * 30_000, "s")]
    assert S.scan(spark.createDataFrame(blanks, "doc_id long, text string, source string"), forest, ["doc_id"]).count() == 3


def test_many_candidates(spark, forest):
    """Places are right over many candidates in one text, and repeated rows and clashing names are no matter."""
    text = " ".join(f"token={k:032x}" for k in range(3000))
    df = spark.createDataFrame([(1, text, "src", "x")] * 2, "doc_id long, text string, source string, findings string")
    for r in S.scan(df, forest, ["doc_id", "findings"]).collect():
        assert [f.start for f in r.findings] == [m.start(1) for m in re.finditer(r"token=(\S+)", text)]


def test_planted_tokens_are_found(spark, forest):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id for r in docs.collect() if re.search(r"AKIA[0-9A-Z]{16}|(?:token = \"|password=)[0-9a-f]{16,}", r.text)}
    got = {r.doc_id for r in S.scan(docs, forest, ["doc_id"]).collect() if any(f.secret for f in r.findings)}
    assert want and want <= got


def test_no_python_in_the_plan(docs, forest):
    plan = S.scan(docs, forest, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
