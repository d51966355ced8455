import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import urls as U


@pytest.fixture(scope="module")
def model(spark):
    return U.train(U.labelled(spark))


def test_held_out_labels(spark, model):
    rows = U.labelled(spark, 3 * U.LABELLED).where(F.col("id") >= U.LABELLED)
    got = U.judge(rows, model, ["id", "bad"], rules=()).collect()
    assert sum((r.verdict == "block") == bool(r.bad) for r in got) > 0.97 * len(got)


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), k == "block", h + p, k) for k, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2:] if fits else (None, None)


def test_ties(spark, model):
    """Of rules of one length block goes before allow, and a score on the threshold is one over it."""
    df = spark.createDataFrame([(1, "http://a.example/x/"), (2, "http://other.test/")], "page_id long, url string")
    same = (("allow", "example", "/x"), ("block", "a.example", ""))
    rules = (("allow", "a.example", "/x"), ("block", "a.example", "/x"))
    assert {r.verdict for r in U.judge(df.where("page_id = 1"), model, ["page_id"], rules=rules).collect()} == {"block"}
    assert {r.verdict for r in U.judge(df.where("page_id = 1"), model, ["page_id"], rules=rules[::-1]).collect()} == {"block"}
    assert len({(r.rule, r.verdict) for x in (same, same[::-1]) for r in U.judge(df.where("page_id = 1"), model, ["page_id"], rules=x).collect()}) == 1


def test_rules(spark, model, sf_dir):
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1", "http://example.net/EN/1", "https://net/", "http://xnet/", "http://a.b.net", "ftp://a.example.com/de/x?y#z", "http://É.example.org/fr/?q", "http://x.org/frs", "http://x.org/fr/", "a://b://c.net/", "http://u?x=://y.net/", "http://h.example.com\n/de/", "http://h.example.com/de/\n"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(odd)], "page_id long, url string").unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") + 100).alias("page_id"), "url"))
    urls = {r.page_id: r.url for r in df.collect()}
    for r in U.judge(df, model, ["page_id"]).collect():
        host, path, (rule, verdict) = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert {r.verdict for r in U.judge(df.where("page_id < 4"), model, ["page_id"]).collect()} == {"allow"}


def lexical(model, url):
    """The features in plain Python."""
    host, path, _ = brute(url)
    url = url or ""
    query = m[1] if (m := re.search(r"\?([^#]*)", url)) else ""
    share = lambda x: sum(c in "0123456789" for c in x) / len(x) if x else 0.0
    counts = Counter(host)
    words = [w for w in re.split("[-.]", re.sub(r"\.?[^.]*$", "", host, count=1)) if w not in ("", "www")]
    return [
        len(url), len(host), len([x for x in path.split("/") if x]), share(url), share(host), -sum(n / len(host) * math.log2(n / len(host)) for n in counts.values()),
        len(re.split("[&;]", query)) if query else 0, host.count("-"), host.count(".") + 1, model.suffixes.get(host.split(".")[-1], model.default),
        max((model.words.get(w, model.default) for w in words), default=model.default),
    ]


def test_trees_against_plain_python(spark, model, sf_dir):
    """Features and trees as SQL expressions against Python and numpy; the verdict follows the score."""
    odd = [None, "", "http://", "http://a..b/", "HTTP://www.Cheap-Pills99.example.org/a//b/?x=1&y=2;z#f?g", "http://é-ü.com/?", "http://a.b/" + "long/" * 5000, "http://a.b/c", "http://a.b/c"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(odd)], "page_id long, url string").unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") + 100).alias("page_id"), "url"))
    df = df.unionByName(U.labelled(spark, 200).select((F.col("id") + 10**6).alias("page_id"), "url"))
    urls = {r.page_id: r.url for r in df.collect()}
    got = U.judge(df.withColumn("score", F.lit("x")), model, ["page_id", "score"], rules=()).collect()
    assert len(got) == len(urls) and {r.verdict for r in got} == {"allow", "block"}
    for r in got:
        x = np.array([lexical(model, urls[r.page_id])], float)
        want = 1 / (1 + math.exp(-(model.start + sum(U.trees.applied(t, x)[0] for t in model.trees)))) if r.host else 0.0
        assert math.isclose(r.score, want, rel_tol=1e-9) and (r.verdict == "block") == (want >= U.THRESHOLD)


def test_all_words_of_the_sample_count(spark):
    """However many words and suffixes the labelled rows have, each that repeats has its share."""
    rows = [(f"http://w{k}x.s{k}/{j}", int(k % 2)) for k in range(500) for j in range(4)]
    model = U.train(spark.createDataFrame(rows, "url string, bad int"))
    assert len(model.suffixes) == len(model.words) == 500


def test_empty(spark, model):
    none = spark.createDataFrame([], "page_id long, url string, host int")
    assert U.judge(none, model, ["page_id", "host"]).count() == 0
    empty = U.train(U.labelled(spark).limit(0))
    assert {r.verdict for r in U.judge(spark.createDataFrame([(1, "http://casino-win.com/")], "page_id long, url string"), empty, ["page_id"]).collect()} == {"allow"}
