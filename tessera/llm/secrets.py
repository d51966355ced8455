"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

Candidates are provider keys, values after a secret's name or after '=', and long mixed strings, all whole. A text is cut at its
candidates, so each one's place and neighbours come from the pieces around it; features and the forest (nested IFs)
are evaluated inside the row. Nothing is shuffled, and a text with many candidates stays one row.

The forest learns from labelled findings: LABELLED rows generated by stated rules (true ones: random keys, tokens and
passwords beside their names; false ones: placeholders, words, checksums, ids, paths, versions), whose features are
computed by the same expressions. LABELLED bounds what the driver fits on; the corpus is never sampled.

Nulls: a null text has no findings and stays null; a null path is an ordinary one. Empty texts have no findings. Texts
and candidates of any length are whole, a private key from its first line to its last. Where candidates could overlap, the
first one counts, and at one place a provider's key. Repeated rows are rows of their own. Empty tables give empty results.
Columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import trees
from tessera.llm.shared import table

LABELLED = 2400
THRESHOLD = 0.5
REDACTED = "<secret>"
#: Candidates whose places are summed up at a time, so that a text with many takes no time that grows with their square.
RUN = 256

PROVIDER = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]{0,20}PRIVATE KEY-----)?+"
NAME = r"(?:passw(?:or)?d|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth)"


def run(chars: str, least: int) -> str:
    """A whole run of those characters, however long, up to a provider's key within it."""
    return rf"(?:(?!(?<![A-Za-z0-9])(?:{PROVIDER})){chars}){{{least},}}+"


#: Signs with the blanks and the quote around them, however many blanks: after a secret's name, and after any name.
AFTER_NAME = rf"(?i:(?<={NAME}[\"']{{0,1}}))\s*+[:=]\s*+[\"']{{0,1}}"
AFTER_ANY = r"(?<=[A-Za-z0-9_.\]-][\"']{0,1})\s*+=\s*+[\"']{0,1}"
LONG = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]){run('[A-Za-z0-9+/_-]', 20)}"
#: A value: a provider's key, what stands after a sign and a secret's name or after '=' and any name, or a long run with a
#: digit. A match begins with the sign, which SIGN tells from the value.
CANDIDATE = rf"""(?<![A-Za-z0-9])(?:{PROVIDER})|(?=[\s:=])(?:{AFTER_NAME}{run(r"""[^\s"'<>,;]""", 6)}|{AFTER_ANY}{run(r"""[^\s"'<>,;&]""", 6)})|{LONG}"""
SIGN = r"^\s*+[:=]\s*+[\"']{0,1}"

#: What every candidate has: a digit, a sign or a provider's mark. Most texts have none and need no closer look.
QUICK = r"[0-9:=]|-----BEGIN|AKIA|gh[pousr]_|xox[abprs]-|sk-|eyJ"

#: Fixed words by which a candidate, or what stands around it, is known to be no secret.
DICTIONARY = "password|passwd|secret|token|example|sample|dummy|test|your|here|change|default|placeholder|insert|admin|user|name|value|string|demo|foobar|hello|world|none|null|true|false|redacted|hidden|todo|enter|some|access|private|public|file|image|version|release|index|config|page|article|about|news|content|www|http|com|html"
NEAR_SECRET = "password|passwd|pwd|passphrase|secret|token|key|auth|credential|login"
NEAR_OTHER = "commit|sha1|sha256|md5|checksum|hash|uuid|guid|revision|digest|etag|version|build|example|sample|dummy|placeholder|doi|isbn|order|invoice|tracking|id"
PATHS = "test|example|sample|fixture|mock|doc|readme|spec|demo"

FEATURES = ("length", "transitions", "digits", "uppers", "entropy", "dictionary", "vowels", "provider", "near_secret", "near_other", "assigned", "path", "hex")


def share(c: Column, pattern: str) -> Column:
    """Share of the characters of c that the pattern matches."""
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / F.length(c)


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """A struct of the FEATURES of a candidate between `before` and `after` in a text of this path."""
    low = F.lower(value)
    n = F.length(value)
    chars = F.array_distinct(F.split(value, ""))
    parts = F.transform(chars, lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n)
    entropy = F.aggregate(parts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    flag = lambda c: c.cast("double")
    got = {
        "length": n.cast("double"),
        "transitions": (F.length(kinds) - 1) / n,
        "digits": share(value, "[0-9]"),
        "uppers": share(value, "[A-Z]"),
        "entropy": entropy,
        "dictionary": share(low, DICTIONARY),
        "vowels": share(low, "[aeiou]"),
        "provider": flag(value.rlike(f"^(?:{PROVIDER})")),
        "near_secret": flag(F.lower(before).rlike(rf"(?:{NEAR_SECRET})[^a-z]{{0,12}}$")),
        "near_other": flag(F.lower(F.concat(before, F.lit(" "), after)).rlike(rf"(?:^|[^a-z])(?:{NEAR_OTHER})(?:[^a-z]|$)")),
        "assigned": flag(before.rlike("[:=][\"'\\s]*$")),
        "path": flag(F.lower(path).rlike(PATHS)),
        "hex": flag(low.rlike("^[0-9a-f]+$")),
    }
    return F.struct(*[got[k].alias(k) for k in FEATURES])


def pick(words: str, seed: Column) -> Column:
    """One of the words (parted by |), by a hash."""
    own = words.split("|")
    return F.element_at(F.array(*map(F.lit, own)), (F.pmod(seed, F.lit(len(own))) + 1).cast("int"))


def labelled(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """Labelled findings (value, before, after, path, label), made by rule from the row's number."""
    h = lambda k: F.xxhash64(F.col("id"), F.lit(k))
    hexed = F.sha2(F.concat(F.lit("f"), F.col("id").cast("string")).cast("binary"), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(hexed)), "[+/=]", "")
    upper = F.upper(F.translate(mixed, "abcdefghi", "QRSTUVWXY"))
    n = lambda k, low, high: (F.pmod(h(k), F.lit(high - low + 1)) + low).cast("int")
    name = pick("password|token|secret|api_key|passwd|access_key|auth_token|Password|TOKEN|api-key", h(1))
    sign = pick("=| = |: |=\"| = \"|: '", h(2))
    word = lambda k: pick("other|the|und|que|de|with|this|value|line|for|la|in|set|use|they|der", h(k))
    filler = F.concat_ws(" ", word(3), word(4), word(5), word(6))
    plain = F.concat(filler, F.lit(" "))
    named = F.concat(filler, F.lit(" "), name, sign)
    other = F.concat(filler, F.lit(" "), pick("commit|sha1|md5|checksum|uuid|digest|version|build|etag|revision|order|invoice", h(7)), pick(" |: |=", h(8)))
    phrase = F.concat(pick("your|example|dummy|change|insert|sample|test|default|enter|some", h(10)), pick("_|-|", h(9)), pick("password|token|secret|value|here|me|key|string", h(11)), pick("_|-|", h(9)), pick("here|123|1|example|goes|todo|", h(12)))
    syllables = F.concat(*[pick("ing|tion|er|the|an|re|ou|ent|is|ver|che|ten|mi|ra|el|co|da", h(20 + k)) for k in range(8)])
    # (value, before, true secret)
    kinds = [
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), plain, 1),
        (F.substr(hexed, F.lit(1), pick("18|20|24|32|40|64", h(13)).cast("int")), named, 1),
        (F.substr(mixed, F.lit(1), n(14, 8, 40)), named, 1),
        (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), plain, 1),
        (F.concat(F.lit("sk-"), F.substr(mixed, F.lit(1), n(15, 24, 40))), plain, 1),
        (F.concat(pick("xoxb-|xoxp-", h(16)), F.substring(mixed, 1, 24)), named, 1),
        (F.concat(pick("Sun|Moon|tiger|green|Blue|ocean", h(17)), F.substring(mixed, 1, 5), pick("!|#|$|%|9|7", h(18))), named, 1),
        (F.substr(mixed, F.lit(1), n(19, 28, 42)), plain, 1),
        (phrase, named, 0),
        (syllables, named, 0),
        (F.concat(syllables, n(40, 1, 99).cast("string")), plain, 0),
        (F.substr(hexed, F.lit(1), pick("32|40|64", h(41)).cast("int")), other, 0),
        (F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12)), pick("uuid |id=|guid: | ", h(42)), 0),
        (F.concat_ws("/", pick("usr|home|content|images|news", h(43)), syllables, F.concat(n(44, 1, 2024).cast("string"), F.lit("_"), word(45))), plain, 0),
        (F.concat(n(46, 100000000, 999999999).cast("string"), n(47, 100000000, 999999999).cast("string"), n(48, 10, 9999).cast("string")), pick("order |tracking |invoice: |id | ", h(49)), 0),
        (pick("xxxxxxxxxx|**********|none|null|undefined|<password>|${TOKEN}|%s|process.env.TOKEN|os.environ|get_token()|self.password|getpass()|required|optional", h(50)), named, 0),
    ]
    one = F.element_at(F.array(*[F.struct(v.alias("value"), b.alias("before"), F.lit(y).alias("label")) for v, b, y in kinds]), (F.pmod(F.col("id"), F.lit(len(kinds))) + 1).cast("int"))
    after = F.concat(pick("|\"|'| ", h(51)), F.lit(" "), word(52))
    path = pick("src0|src12|app/main.py|web/page|tests/fixture|docs/readme|example/demo|lib/util|conf/app|crawl", h(53))
    return spark.range(rows, numPartitions=1).select(one.alias("f"), after.alias("after"), path.alias("path")).select("f.*", "after", "path")


@cache
def _fitted(rows: tuple) -> tuple:
    data = np.array(rows, float)
    return tuple(trees.forest(data[:, :-1], data[:, -1]))


def train(spark: SparkSession, rows: int = LABELLED) -> list:
    """The forest over the labelled findings; `rows` of them at most come to the driver."""
    have = labelled(spark, rows).select(features(F.col("value"), F.col("before"), F.col("after"), F.col("path")).alias("x"), "label")
    return list(_fitted(tuple(tuple(r) for r in have.select("x.*", "label").collect())))


def sums_of(steps: Column) -> Column:
    """Running sums of an array. Each step copies what is there, so arrays should be short."""
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums")),
        lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["sums"], F.array(a["at"] + x)).alias("sums")),
    )["sums"]


def scan(docs: DataFrame, forest: list, keep: list[str], text: str = "text", path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """keep, with findings (start and length in characters from 0, value, kind, score, secret) and redacted_text."""
    keep = [c for c in keep if c not in ("findings", "redacted_text")]
    has = F.col("_text").rlike(QUICK) & F.col("_text").rlike(CANDIDATE)
    held = [f"_{k}" for k in range(len(keep))]
    cut = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(keep, held)], F.col(f"`{text}`").alias("_text"), F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("_path"))
    none = F.array().cast("array<string>")
    cut = cut.withColumn("_has", F.coalesce(has, F.lit(False)))
    cut = cut.withColumn("_found", F.when(F.col("_has"), F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0))).otherwise(none))
    cut = cut.withColumn("_signs", F.transform("_found", lambda v: F.regexp_extract(v, SIGN, 0)))
    cut = cut.withColumn("_values", F.zip_with("_found", "_signs", lambda v, sign: F.substr(v, F.length(sign) + 1)))
    # what stands before a value ends with its sign; after the last one there is none
    pieces = F.zip_with(F.split("_text", CANDIDATE, -1), "_signs", lambda piece, sign: F.concat(piece, F.coalesce(sign, F.lit(""))))
    cut = cut.withColumn("_pieces", F.when(F.col("_has"), pieces).otherwise(F.array("_text")))
    # arrays go through a lambda side by side: one that is looked up by place there would be made anew for each element
    n = F.size("_values")
    parts = F.arrays_zip(
        F.col("_values").alias("value"), F.slice("_pieces", 1, n).alias("before"), F.slice("_pieces", 2, n).alias("after"), F.col("_signs").alias("sign"), F.slice(F.concat(F.array(F.lit("")), "_values"), 1, n).alias("last")
    )
    cut = cut.withColumn("_parts", parts)
    # blanks around a sign count as one, so that they put no name out of reach
    near = lambda p: F.concat(F.right(F.left(p["before"], F.length(p["before"]) - F.length(p["sign"])), F.lit(60)), F.regexp_replace(p["sign"], r"\s+", " "))
    described = lambda p: features(p["value"], F.right(near(p), F.lit(60)), F.left(p["after"], F.lit(30)), F.col("_path"))
    cut = cut.withColumn("_described", F.transform("_parts", lambda p: F.struct(p["value"].alias("value"), described(p).alias("x"))))
    # places: each candidate starts after all pieces up to its own and all candidates before it
    cut = cut.withColumn("_steps", F.transform("_parts", lambda p: F.length(p["before"]) + F.length(p["last"])))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_steps") - 1, F.lit(0)), F.lit(RUN)), lambda k: sums_of(F.slice("_steps", k + 1, RUN)))
    cut = cut.withColumn("_runs", runs)
    ends = sums_of(F.transform("_runs", lambda r: F.coalesce(F.get(r, F.size(r) - 1), F.lit(0))))
    starts = F.zip_with("_runs", F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size("_runs")), lambda r, base: F.transform(r, lambda x: x + base))
    cut = cut.withColumn("_starts", F.flatten(starts))

    def finding(d: Column, start: Column) -> Column:
        score = trees.total(forest, lambda k: d["x"][FEATURES[k]]) / len(forest)
        kind = F.when(d["x"]["provider"] > 0, "provider").when(d["x"]["assigned"] > 0, "assigned").otherwise("long")
        return F.struct(start.cast("long").alias("start"), F.length(d["value"]).cast("long").alias("length"), d["value"].alias("value"), kind.alias("kind"), score.alias("score"), (score >= threshold).alias("secret"))

    cut = cut.withColumn("findings", F.zip_with("_described", "_starts", finding))
    said = F.zip_with("_pieces", "findings", lambda piece, f: F.concat(piece, F.when(f.isNull(), "").when(f["secret"], F.lit(REDACTED)).otherwise(f["value"])))
    redacted = F.when(F.size("findings") > 0, F.array_join(said, "")).otherwise(F.col("_text"))
    return cut.withColumn("redacted_text", redacted).select(*[F.col(h).alias(c) for c, h in zip(keep, held)], "findings", "redacted_text")


def op10_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), train(spark), ["doc_id"])
    secrets = F.filter("findings", lambda f: f["secret"])
    return found.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"), "findings")


QUERIES = {"op10_forest_secrets": op10_forest_secrets}
SQL: dict[str, str] = {}
