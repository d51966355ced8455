"""Spark-side helpers of the corpus operators: written intermediates, checked broadcasts, row slicing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only up to this many bytes by count times row width.
BROADCAST_BYTES = 32 << 20
#: Text that one step in a Python worker takes at a time; a longer text is taken whole, alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only in local mode without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_to.isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set_to.get().rstrip("/")


def written(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: the lineage is cut and no executor holds the only copy.

    large: the shuffles behind it are large, and are dropped at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if large:
        release(spark)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of jobs that are over: it does so when their plans are collected,

    which takes a second collection after the last job's end has been told to all listeners.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows prove it small, else as it is (a shuffled join, split by AQE where skewed).

    df should be cheap to count, so a written() table or a small aggregate of one.
    """
    return F.broadcast(df) if df.limit(limit // row_bytes + 1).count() * row_bytes <= limit else df


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """Shuffle partitions for so many rows: at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def give_back() -> None:
    """Returns memory that Arrow's pool and the C library hold free to the system, for the executor's other processes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of at most `most` bytes in the string column (a longer row alone)."""
    for batch in batches:
        lengths = batch.column(column).cast(pa.large_string())
        import numpy as np

        offsets = np.frombuffer(lengths.buffers()[1], dtype=np.int64)[lengths.offset : lengths.offset + len(lengths) + 1]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
        give_back()


def appended(df: DataFrame, keep: list[str], text: str, make, added: str) -> DataFrame:
    """The columns `keep` of df and those of the schema string `added`, which make() gives for each run of texts.

    make() is called once in each task and gives a function from an Arrow array of texts (and the run's rows) to Arrow
    arrays, one value a row. Columns in `keep` whose names are in `added` are replaced.
    """
    new = df.sparkSession.createDataFrame([], added).schema
    keep = [c for c in keep if c not in new.names]
    held = [f"_{k}" for k in range(len(keep))]  # no name in keep can clash with the text's or an added one then
    rows = df.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(keep, held)], F.col(f"`{text}`").alias("_text"))
    kept = rows.select(*held).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in slices(batches, "_text"):
            own = [batch.column(h) for h in held]
            yield pa.RecordBatch.from_arrays([*own, *one(batch.column("_text"), pa.RecordBatch.from_arrays(own, keep) if keep else batch)], [*held, *new.names])

    out = rows.mapInArrow(run, type(kept)([*kept.fields, *new.fields]))
    return out.select(*[F.col(h).alias(c) for c, h in zip(keep, held)], *new.names)
