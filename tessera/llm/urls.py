"""URL filter: stated rules first, then gradient-boosted trees on lexical features.

A rule (verdict, host, path) fits its host and all subdomains where the path starts with the rule's; the longest (host
and path together) wins, `block` first among equals. What no rule decides goes to the boosted trees: length, depth,
digit ratio, entropy, parameter count, hyphens, labels, and the share of blocked URLs among labelled ones with the same
suffix or the same words in the host. They are trained from labelled URLs - a given table, or LABELLED rows made by
stated rules - and applied as nested IFs, so scoring stays in the JVM. Rules are few and stated: they become
expressions too, and nothing is joined or shuffled.

Nulls: a null URL, or one without `://`, has an empty host and path, fits no rule and is allowed. URLs of any length are
whole. Ties: the longest rules that fit equally go to `block`; a score of just the threshold blocks. Repeated rows are
rows of their own. Empty tables give empty results; without labelled rows of both kinds all that no rule blocks is allowed.
Columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import trees
from tessera.llm.shared import table

LABELLED = 2000
THRESHOLD = 0.5
#: Pseudo-count of words and suffixes towards the overall share.
SMOOTH = 3.0

#: (verdict, host, path) of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

FEATURES = ("length", "host_length", "depth", "digits", "host_digits", "entropy", "parameters", "hyphens", "labels", "suffix", "word")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The fitting rule as text (null if none) and its verdict."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own_host, own_path in reversed(ordered):
        own_host = own_host.lower()
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(own_path)
        name, verdict = F.when(fits, own_host + own_path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def entropy(c: Column) -> Column:
    n = F.length(c)
    parts = F.transform(F.array_distinct(F.split(c, "")), lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def words_of(host: Column) -> Column:
    """The parts of the host without its suffix and `www`."""
    return F.filter(F.split(F.regexp_replace(host, r"\.?[^.]*$", ""), "[-.]"), lambda w: (w != "") & (w != "www"))


def known(value: Column, shares: dict[str, float], default: float) -> Column:
    if not shares:
        return F.lit(default)
    table_ = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])
    return F.coalesce(F.try_element_at(table_, value), F.lit(default))


def share(c: Column, pattern: str) -> Column:
    n = F.length(c)
    return F.when(n > 0, (n - F.length(F.regexp_replace(c, pattern, ""))) / n).otherwise(0.0)


@dataclass
class Model:
    default: float = 0.0
    suffixes: dict | None = None
    words: dict | None = None
    start: float = -9.0
    trees: list | None = None

    def features(self, url: Column, host: Column, path: Column) -> Column:
        url = F.coalesce(url, F.lit(""))
        query = F.regexp_extract(url, r"\?([^#]*)", 1)
        worst = F.array_max(F.transform(words_of(host), lambda w: known(w, self.words or {}, self.default)))
        got = {
            "length": F.length(url), "host_length": F.length(host), "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
            "digits": share(url, "[0-9]"), "host_digits": share(host, "[0-9]"), "entropy": entropy(host),
            "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
            "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))), "labels": F.size(F.split(host, r"\.")),
            "suffix": known(suffix_of(host), self.suffixes or {}, self.default), "word": F.coalesce(worst, F.lit(self.default)),
        }
        return F.struct(*[got[k].cast("double").alias(k) for k in FEATURES])

    def score(self, x: Column) -> Column:
        """The chance that the URL should be blocked."""
        return 1 / (1 + F.exp(-(F.lit(self.start) + trees.total(self.trees or [], lambda k: x[FEATURES[k]]))))


def labelled(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """Labelled URLs (url, bad), made by rule from the row's number."""
    h = lambda k: F.xxhash64(F.col("id"), F.lit(k))

    def pick(words: str, k: int) -> Column:
        own = words.split("|")
        return F.element_at(F.array(*map(F.lit, own)), (F.pmod(h(k), F.lit(len(own))) + 1).cast("int"))

    digits = lambda k, m: F.pmod(h(k), F.lit(m)).cast("string")
    part = "ing|tion|er|the|an|re|ou|ent|is|ver|che|ten|mi|ra|el|co|da|sta|lor|no"
    plain = F.concat(pick(part, 1), pick(part, 2), pick(part, 3))
    spam = "casino|pills|viagra|porn|adult|xxx|bet|bets|poker|slots|loan|payday|spam|win|winner|free|cheap|replica|crack|warez|torrent|escort|dating|ads|track|click|popup|bonus|lottery|farm"
    bad_host = F.concat(pick("|www.|m.|blog.|a1.|go.", 4), pick(spam, 5), pick("-|-|", 6), F.when(F.pmod(h(7), F.lit(3)) == 0, plain).otherwise(pick(spam, 8)), F.when(F.pmod(h(9), F.lit(3)) == 0, digits(10, 999)).otherwise(""))
    good_host = F.concat(pick("|www.|m.|blog.|en.|docs.", 11), plain, F.when(F.pmod(h(12), F.lit(4)) == 0, F.concat(F.lit("-"), pick("news|blog|school|science|city|library|music|press|wiki|museum", 13))).otherwise(""))
    suffix = F.when(F.col("bad"), pick(".com|.net|.org|.info|.xyz|.top|.click|.example.com|.example.net|.example.org", 14)).otherwise(pick(".com|.net|.org|.edu|.gov|.de|.fr|.example.com|.example.net|.example.org", 15))
    good_path = F.concat(F.lit("/"), pick("en|de|fr|es|news|articles|2023/05|wiki", 16), F.lit("/"), F.when(F.pmod(h(17), F.lit(2)) == 0, digits(18, 60000)).otherwise(plain), pick("|/|.html|#top|?utm_source=feed|?page=2&ref=x", 19))
    bad_path = F.when(F.pmod(h(20), F.lit(2)) == 0, good_path).otherwise(F.concat(F.lit("/"), pick("go|click|out|promo|lp", 21), pick("/|.php", 22), F.lit("?aff="), digits(23, 99999), F.lit("&sid="), F.substring(F.sha2(F.col("id").cast("string").cast("binary"), 256), 1, 20), F.lit("&c="), digits(24, 99)))
    base = spark.range(rows, numPartitions=1).withColumn("bad", F.pmod(h(0), F.lit(2)) == 0)
    return base.select("id", F.concat(pick("http://|https://|https://", 25), F.when(F.col("bad"), bad_host).otherwise(good_host), suffix, F.when(F.col("bad"), bad_path).otherwise(good_path)).alias("url"), F.col("bad").cast("int").alias("bad"))


def shares(rows: DataFrame, value: Column, overall: float) -> dict[str, float]:
    """Smoothed shares of blocked URLs of each value that occurs more than twice."""
    counts = rows.select(value.alias("v"), "bad").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b"))
    return {r.v: round(float((r.b + SMOOTH * overall) / (r.n + SMOOTH)), 5) for r in counts.where("n > 2").collect()}


def train(rows: DataFrame, most: int = LABELLED) -> Model:
    """Trees from labelled URLs (url, bad). All is learned from at most `most` rows: those of least hash."""
    spark = rows.sparkSession
    got = [(r.url, int(r.bad)) for r in rows.select("url", "bad").where("bad is not null").orderBy(F.xxhash64("url"), "url", "bad").limit(most).collect()]
    rows = spark.createDataFrame(got, "url string, bad int").coalesce(1)
    overall = sum(b for _, b in got) / len(got) if got else None
    if overall is None or overall in (0, 1):
        return Model(default=float(overall or 0.0))
    host = host_of(F.col("url"))
    model = Model(round(float(overall), 5), shares(rows, suffix_of(host), overall), shares(rows.select(F.explode(words_of(host)).alias("w"), "bad"), F.col("w"), overall))
    have = np.array([tuple(r) for r in rows.select(model.features(F.col("url"), host, path_of(F.col("url"))).alias("x"), "bad").select("x.*", "bad").collect()], float)
    model.start, model.trees = trees.boosted(have[:, :-1], have[:, -1])
    return model


def judge(pages: DataFrame, model: Model, keep: list[str], url: str = "url", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """keep, with host, path, rule, score (of the trees) and verdict."""
    keep = [c for c in keep if c not in ("host", "path", "rule", "score", "verdict")]
    held = [f"_{k}" for k in range(len(keep))]
    own = pages.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(keep, held)], F.col(f"`{url}`").alias("_url")).withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    own = own.withColumn("_x", model.features(F.col("_url"), F.col("host"), F.col("path"))).withColumn("score", F.when(F.col("host") == "", 0.0).otherwise(model.score(F.col("_x"))))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return own.select(*[F.col(h).alias(c) for c, h in zip(keep, held)], "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"))


def op6_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), train(labelled(spark)), ["page_id"]).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op6_boosted_urls": op6_boosted_urls}
SQL: dict[str, str] = {}
