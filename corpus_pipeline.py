"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, packing.

Each stage takes the documents that its predecessor kept, all their columns and rows, and returns documents; the last
returns packed pieces.

* language: leaves out documents without a letter, or whose language's share stays below language.REJECT and whose lead
  is ambiguous. Where no document has a language to learn from, only those without a letter go.
* near_duplicates: of each group of linked documents the one with the smallest doc_id stays; of rows with the same doc_id
  and text the one whose other columns sort first.
* benchmark: leaves out documents with an occurrence of a benchmark window.
* secrets: keeps every document; findings judged secret are replaced in the text, and n_chars follows.
* packing: pieces of binary lengths with their token ids.

Nulls: a null or empty text has no letter and goes with the first stage; documents with a null doc_id are copies of
nothing and stay; nulls elsewhere are kept as they are. Texts of any length are whole. Columns of documents keep their
values even where an operator adds some of their names. Ties between repeated rows go by all columns that can be
sorted. No stage's result depends on the order of rows. Empty tables give empty results.

run() writes only what is read several times; the last four stages are one pass over the documents once it is known which
of them stay. Tests hold the stages and run() against brute force (tests/llm/test_pipeline.py), as no stage but the third
is plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard, language, packing, secrets
from tessera.llm.shared import small_side, table, written


def beside(docs: DataFrame, added: tuple[str, ...], make: Callable[[DataFrame, list[str]], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs as make(docs, columns) and then keep() leave them, without the added columns; columns of docs of these names are
    put aside meanwhile."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in added}
    own = docs.withColumnsRenamed(aside)
    return keep(make(own, own.columns)).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


#: Rows of an Arrow batch: Spark's default of ten times as many is tens of MB of text, twice in the JVM and once in Python.
BATCH_SETTING, BATCH_ROWS, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000, "10000"


def small_batches(spark: SparkSession) -> None:
    """Bounds what each of an executor's tasks holds of texts; a session with a setting of its own keeps it."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    code = language.train(docs.where(~F.coalesce(language.held_out(), F.lit(False))))
    if not code.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    doubtful = F.col("ambiguous") & (F.col("score") < language.REJECT)
    return beside(docs, ("lang_pred", "score", "ambiguous"), lambda own, columns: language.identify(own, code, columns), lambda found: found.where((F.col("lang_pred") != "und") & ~doubtful))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = written(jaccard.components(docs), "groups")
    others = small_side(groups.where("doc_id != component_id").select("doc_id").distinct(), 16)
    kept = docs.join(others, "doc_id", "left_anti").select(docs.columns)
    repeated = written(groups.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    single = kept.join(small_side(repeated, 16), "doc_id", "left_anti").select(docs.columns)
    again = kept.join(small_side(repeated, 16), "doc_id", "left_semi")
    order = F.struct(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant"))])
    first = again.groupBy("doc_id", "text").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("_row"))
    return single.unionByName(first.select("_row.*"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return beside(docs, ("n_words", "n_hit", "hits", "items", "_hits", "_items"), lambda own, columns: decontamination.scan(own, items, columns), lambda found: found.where("n_hit = 0"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forest = secrets.train(spark)

    def clean(found: DataFrame) -> DataFrame:
        changed = F.col("text") != F.col("redacted_text")
        return found.withColumn("n_chars", F.when(changed, F.length("redacted_text").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col("redacted_text"))

    return beside(docs, ("findings", "redacted_text"), lambda own, columns: secrets.scan(own, forest, columns), clean)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == "language":  # near_duplicates reads it several times
            docs = written(docs, name)
    return docs
