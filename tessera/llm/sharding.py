"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` points of a 64-bit ring; a key belongs to the first point clockwise from its hash. No shard
takes more than its bound: the keys of an arc that find their shard full go on clockwise to the next shards with room,
so loads are bounded by construction and only overflowing keys leave their home.

How much of each arc goes where depends on the arcs' counts alone (shards x vnodes numbers, whatever the data), so the
driver plans the overflow from one small aggregate, and rows find their shard by their rank in the arc. Equal rows are
one row with a number until they have their places. An arc of many rows, such as one key's, is ranked in parts by a hash
of whole rows. Texts are never shuffled, only ids, sizes and checksums.

Nulls: a null text has no bytes (size is the overhead, checksum that of no bytes); null keys hash like any value. Empty
and very long texts count only by their size. Ties in the hash go by the row's other columns; equal rows have places next
to each other. Repeated rows are rows of their own. An empty table gives an empty result. Columns that clash are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import table

#: Bytes that a row takes besides its text.
OVERHEAD = 16
#: Equal parts of the ring by which points are found.
CELLS = 4096
#: Rows of an arc that are ranked together, and places of equal rows that are made by one task at a time.
ARC_ROWS = 500_000
RUN = 100_000


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of all virtual nodes on the ring of signed 64-bit numbers, and their shards."""
    points = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points])


def bounds(rows: int, shards: int, load: float) -> list[int]:
    """Most rows of each shard. load 1 fills all shards evenly (counts at most one apart); above, load x the mean."""
    if load <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-(-int(rows * load) // shards)] * shards


def plan(counts: np.ndarray, owner: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the keys of each arc go.

    In round r every arc offers what it has left to the r-th different shard clockwise; arcs are served in ring order.
    """
    n, shards = len(owner), len(room)
    left, given, used, room = counts.astype(int).tolist(), [0] * n, [0] * shards, list(room)
    turns: list[list[int]] = []
    for arc in range(n):
        seen: list[int] = []
        at = arc
        while len(seen) < shards:
            if owner[at] not in seen:
                seen.append(int(owner[at]))
            at = (at + 1) % n
        turns.append(seen)
    out = []
    for r in range(shards):
        for arc in range(n):
            if left[arc] and (free := room[s := turns[arc][r]] - used[s]) > 0:
                take = min(free, left[arc])
                out.append((arc, given[arc], given[arc] + take, s, used[s]))
                used[s] += take
                given[arc] += take
                left[arc] -= take
    return out


def assign(rows: DataFrame, key: str = "doc_id", shards: int = 40, vnodes: int = 128, load: float = 1.0) -> DataFrame:
    """rows with `shard` and `slot` (gapless from 0 in its shard)."""
    spark = rows.sparkSession
    names, key = rows.columns, f"c{rows.columns.index(key)}"
    rows = rows.toDF(*[f"c{k}" for k in range(len(names))])
    places, owner = ring(shards, vnodes)
    width = (1 << 64) // CELLS
    cell_of = [(int(p) + (1 << 63)) // width for p in places]
    cells = [(c, int(np.searchsorted(cell_of, c)), [int(p) for p, k in zip(places, cell_of) if k == c]) for c in range(CELLS)]
    lookup = spark.createDataFrame(cells, "_cell long, _base int, _cuts array<long>")
    keyed = rows.withColumn("_h", F.xxhash64(F.col(key)))
    keyed = keyed.withColumn("_cell", F.shiftright("_h", 64 - CELLS.bit_length() + 1) + CELLS // 2)
    keyed = keyed.join(F.broadcast(lookup), "_cell")  # CELLS rows, whatever the data
    arc = F.col("_base") + F.size(F.filter("_cuts", lambda p: p < F.col("_h")))
    keyed = keyed.withColumn("_arc", F.pmod(arc, F.lit(len(owner)))).drop("_cell", "_base", "_cuts")
    by_hash = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    if len(by_hash) == len(rows.columns):  # else equal rows can't be told
        keyed = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("_times"))
    else:
        keyed = keyed.withColumn("_times", F.lit(1).cast("long"))
    by_arc = {r._arc: r for r in keyed.groupBy("_arc").agg(F.sum("_times").alias("n"), F.count(F.lit(1)).alias("k"), F.max("_times").alias("most")).collect()}  # shards x vnodes rows at most
    parts = {a: -(-r.k // ARC_ROWS) for a, r in by_arc.items() if r.k > ARC_ROWS}
    cut = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(parts.items()) for x in pair]), F.col("_arc")), F.lit(1)) if parts else F.lit(1)
    keyed = keyed.withColumn("_part", F.pmod(F.xxhash64("_h", *by_hash), cut.cast("long")))
    counts = np.zeros(len(owner), np.int64)
    for a, r in by_arc.items():
        counts[a] = r.n
    steps = plan(counts, owner, bounds(int(counts.sum()), shards, load))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("_arc", "_from", "_to", "_shard", "_slot")])
    moves = spark.createDataFrame(steps, schema)
    moves = moves.groupBy("_arc").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_shard", "_slot"))).alias("_moves"))
    order = Window.partitionBy("_arc", "_part").orderBy("_h", *by_hash).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = keyed.withColumn("_rank", F.sum("_times").over(order) - F.col("_times"))
    if parts:  # ranks go on from part to part: as many numbers as there are parts of ARC_ROWS rows
        sums = keyed.where(F.col("_arc").isin(list(parts))).groupBy("_arc", "_part").agg(F.sum("_times").alias("_n"))
        before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("_arc").orderBy("_part")) - F.col("_n")).drop("_n")
        ranked = ranked.join(F.broadcast(before), ["_arc", "_part"], "left").withColumn("_rank", F.col("_rank") + F.coalesce("_before", F.lit(0)))
    most = max((r.most for r in by_arc.values()), default=1)
    if most > RUN:  # runs of places, dealt out before they are made
        runs = F.sequence(F.col("_rank"), F.col("_rank") + F.col("_times") - 1, F.lit(RUN))
        ranked = ranked.withColumn("_end", F.col("_rank") + F.col("_times")).withColumn("_rank", F.explode(runs))
        ranked = ranked.withColumn("_times", F.least(F.lit(RUN), F.col("_end") - F.col("_rank"))).repartition("_rank", "_arc")
    if most > 1:
        ranked = ranked.withColumn("_rank", F.explode(F.sequence(F.col("_rank"), F.col("_rank") + F.col("_times") - 1)))
    ranked = ranked.join(F.broadcast(moves), "_arc")  # at most shards x arcs moves
    move = F.filter("_moves", lambda m: (m["_from"] <= F.col("_rank")) & (F.col("_rank") < m["_to"]))[0]
    return ranked.withColumn("_move", move).select(*[F.col(c).alias(name) for c, name in zip(rows.columns, names) if name not in ("shard", "slot")], F.col("_move._shard").cast("int").alias("shard"), (F.col("_move._slot") + F.col("_rank") - F.col("_move._from")).alias("slot"))


def op5_consistent_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_consistent_hash_shards": op5_consistent_hash_shards}
SQL: dict[str, str] = {}
