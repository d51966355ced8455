"""N-gram Jaccard join by grouped prefixes: which documents share `percent` of their shingles, and their components.

A document's set holds the hashes of its distinct word shingles. Equal sets are one class with one representative. In
one global order of shingles - common ones last - two sets that link share a shingle among the first
n - ceil(percent n) + 1 of each, so an index of these prefixes finds every link. Documents with identical prefixes and
size are collapsed into one group; group pairs pass filters by size, by the number of shared shingles and by place. Of
those that pass the representatives' whole sets are compared first, and further members only where these don't link.

Components come first; pairs that are connected already need no comparison there. So the prefixes are used twice:

1. Pilot: by each of a few prefix shingles (and its group) a document meets the smallest document there; those pairs are
   compared, and components of the links are the first labels. Copies by the thousand become one label by as many
   comparisons as there are copies.
2. Join: the whole prefix index, in groups of equal prefix, size and label; only pairs of different labels pass.
   Bitmaps of whole sets leave out pairs that surely differ too much, before any text is fetched.

The order: the most common shingles are found by counting all documents' shingles, in each task, and adding up what
repeats there; the HEAVY most common at most (a bound of the broadcast: 16 MB) go last by count, all others by hash.
Any order gives the same links. Rows of a common shingle that all have one label are dropped before the shuffle; the rest
meet salted: documents outside the shingle's main label against all others. Any other shingle with more than TOKEN_ROWS
rows in the index is found where its rows arrive, and goes the same way, so no shingle's rows are paired by one task.

3. Links: every link lies in one component, so they are counted there, among the classes of equal sets of each component
   with several. These are dealt into blocks of bounded size, and each cell, a pair of blocks, counts the shingles that
   its documents share. A cell gives one number for each of its documents: links are never rows, and none is left out.
   A component's comparisons grow with the square of its different sets, its rows with that square over the block's size.

Comparing reads the texts again: a document's set stands against all partners in a stream sorted by document, salted
where it has many. Shingle sets are never stored or collected.

Nulls: a null text has no set: n 0, linked with nothing, a component of its own. A row with a null key is no node: it
takes no part in the join, has null ids and no links. Repeated rows fall into one class, and each counts as a link of the
others. Rows of one key with different texts are one node: their components are one, their classes and links their own.
Texts of any length are taken whole. Ties (equal counts of shingles) go by hash; they don't change the result. Empty
tables give empty results; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.components import smallest
from tessera.llm.shared import drop_written, give_back, partitions, shared_dir, slices, small_side, table, written

SHINGLE = 5
PERCENT = 75
#: Common shingles with a place of their own in the order; counts that repeat so often in COUNTED shingles of a task.
HEAVY = 1 << 20
REPEATS = 2
COUNTED = 1 << 20
#: Bits of a set's bitmap.
BITS = 1024
#: Prefix shingles by which documents meet in the pilot.
PILOT = 3
#: Rows that one task of the index, rows of one shingle there, and pairs that one stream of comparisons takes.
INDEX_ROWS = 400_000
TOKEN_ROWS = 2_000
HUB_PAIRS = 64
#: Documents and shingles of a block in which links are counted; documents up to which a shingle's pairs are listed there.
CELL_DOCS = 256
CELL_SHINGLES = 100_000
LISTED = 16


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n + (-percent * n) // 100 + 1


def needed(a, b, percent: int):
    """Least number of common shingles for sets of a and b to link (any numbers or columns of whole numbers)."""
    return -((-percent * (a + b)) // (100 + percent))


def sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words, one hash of all."""
    data, offsets = W.buffers(texts)
    data = W.LOWER[data]
    starts, ends, before = W.spans(data, offsets, W.SPACED)
    hashes = W.span_hashes(data, starts, ends)
    whole, place = W.windows(hashes, size), W.within(before, size)
    shingles = whole[place] if len(place) else np.zeros(0, W.U)
    n = np.maximum(np.diff(before) - size + 1, 0)
    edges = np.concatenate([[0], np.cumsum(n)])
    out = []
    for k in range(len(texts)):
        words = int(before[k + 1] - before[k])
        if words >= size:
            out.append(np.unique(shingles[edges[k] : edges[k + 1]]))
        elif words:
            out.append(W.windows(hashes[before[k] : before[k + 1]], words) + W.U(words))
        else:
            out.append(np.zeros(0, W.U))
    return out


def set_keys(flat: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Two independent hashes of each set."""
    return [W.sums_by(W.mix(flat ^ W.U(salt)), edges).view(np.int64) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]


SIGNED = "doc long, n long, k1 long, k2 long, token long, times long"


def signer(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (its set's size and key), and one for each shingle that repeats in the task."""
        held: list[np.ndarray] = []

        def repeated() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate([np.zeros(0, W.U), *held]), return_counts=True)
            held.clear()
            often = times >= REPEATS
            tokens, times = tokens[often].view(np.int64), times[often]
            empty = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array(tokens), pa.array(times)], names)

        names = ["doc", "n", "k1", "k2", "token", "times"]
        for batch in slices(batches, "text"):
            own = sets(batch.column("text"), size)
            n = np.array([len(s) for s in own], np.int64)
            edges, flat = np.concatenate([[0], np.cumsum(n)]), np.concatenate([np.zeros(0, W.U), *own])
            empty = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n), *map(pa.array, set_keys(flat, edges)), empty, empty], names)
            held += own
            if sum(map(len, held)) >= COUNTED:
                yield repeated()
        yield repeated()

    return sign


def sieve(heavy: np.ndarray) -> np.ndarray:
    """Whether any heavy shingle has these low bits: most others are told apart so."""
    bits = np.zeros(1 << 23, bool)
    bits[(heavy & W.U(len(bits) - 1)).astype(np.int64)] = True
    return bits


def ordered(own: list[np.ndarray], heavy: np.ndarray, counts: np.ndarray, bits: np.ndarray, percent: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The prefix of each set: shingles that are not heavy by hash, then heavy ones by count; and how many are not heavy."""
    n = np.array([len(s) for s in own], np.int64)
    flat = np.concatenate([np.zeros(0, W.U), *own])
    rank = np.zeros(len(flat), np.int64)
    if len(heavy):
        maybe = np.flatnonzero(bits[(flat & W.U(len(bits) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(heavy, flat[maybe]), len(heavy) - 1)
        rank[maybe] = np.where(heavy[at] == flat[maybe], counts[at], 0)
    lengths, out, start, rare = prefix_length(n, percent), [], 0, []
    for s, k, p in zip(own, n.tolist(), lengths.tolist()):
        r = rank[start : start + k]
        start += k
        out.append((s if not r.any() else s[np.lexsort((s, r))])[:p] if k else s)
        rare.append(min(k - np.count_nonzero(r), len(out[-1])))
    return out, np.array(rare, np.int64)


def bitmaps(own: list[np.ndarray]) -> np.ndarray:
    """A row of BITS bits for each set: every shingle turns one bit over. Bits that differ are at most as many as shingles."""
    owner = np.repeat(np.arange(len(own)), [len(s) for s in own])
    flat = np.concatenate([np.zeros(0, W.U), *own])
    turns = np.bincount(owner * BITS + (flat >> W.U(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=len(own) * BITS)
    return np.packbits((turns & 1).astype(np.uint8)).view("<i8").reshape(len(own), BITS // 64)


def heaviest(signs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat, sorted, and their counts: all above the least count that leaves at most HEAVY."""
    times = signs.where("n is null").groupBy("token").agg(F.sum("times").alias("times"))
    times = written(times, "times")
    most, left = None, HEAVY
    for r in times.groupBy(F.least("times", F.lit(10_000)).alias("t")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("t")).collect():  # 10,000 rows at most
        left -= r.k
        if left < 0:
            break
        most = r.t
    if most is None:
        return np.zeros(0, W.U), np.zeros(0, np.int64)
    got = times.where(F.col("times") >= most).toArrow()
    token, n = got.column("token").to_numpy().view(W.U), got.column("times").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


PREFIXED = "doc long, n long, gkey long, prefix array<long>, rare long, pilot array<long>, bits array<long>"


def prefixer(size: int, percent: int, heavy: np.ndarray, counts: np.ndarray):
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve(heavy)
        for batch in slices(batches, "text"):
            own = sets(batch.column("text"), size)
            n = np.array([len(s) for s in own], np.int64)
            firsts, rare = ordered(own, heavy, counts, bits, percent)
            p = np.array([len(f) for f in firsts], np.int64)
            edges, flat = np.concatenate([[0], np.cumsum(p)]), np.concatenate([np.zeros(0, W.U), *firsts])
            place = np.arange(len(flat)) - np.repeat(edges[:-1], p)
            gkey = W.mix(W.sums_by(W.mix(flat + W.mix(place.astype(W.U))), edges) + n.astype(W.U))
            pilots = []
            for k, f in enumerate(firsts):  # a sample of the prefix by another hash, and the group itself
                mixed = W.mix(f ^ W.U(0x2545F4914F6CDD1D))
                pilots.append(np.concatenate([f[np.argsort(mixed)[:PILOT]], gkey[k : k + 1]]) if len(f) else f)
            q = np.concatenate([[0], np.cumsum([len(x) for x in pilots])])
            as_list = lambda values, e: pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"), pa.array(n), pa.array(gkey.view(np.int64)), as_list(flat, edges), pa.array(rare),
                    as_list(np.concatenate([np.zeros(0, W.U), *pilots]), q), as_list(bitmaps(own).reshape(-1), np.arange(len(n) + 1) * (BITS // 64)),
                ],
                ["doc", "n", "gkey", "prefix", "rare", "pilot", "bits"],
            )

    return prefix


def comparer(size: int, percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (hub, salt, second, doc, text) sorted so that each hub's own text comes before its partners'."""
        key, own = None, []
        for batch in slices(batches, "text"):
            hubs, salts, second, docs = (batch.column(c).to_pylist() for c in ("hub", "salt", "second", "doc"))
            found = []
            for hub, salt, after, doc, s in zip(hubs, salts, second, docs, sets(batch.column("text"), size)):
                if key != (hub, salt):
                    key, own = (hub, salt), []
                if not after:
                    own.append(s)
                    continue
                for h in own:  # more than one only where rows share a key
                    if len(s) and len(h):
                        common = len(np.intersect1d(h, s, assume_unique=True))
                        if 100 * common >= percent * (len(h) + len(s) - common):
                            found.append((hub, doc))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["u", "v"])

    return compare


def linked(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the written pairs (a, b) whose documents (doc, text) link, as (u, v)."""
    spark = pairs.sparkSession
    many = small_side(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HUB_PAIRS), 24)
    salted = pairs.join(many, "a", "left").withColumn("salts", F.coalesce((F.col("k") / HUB_PAIRS).cast("long"), F.lit(0)) + 1)
    partners = salted.select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.lit(True).alias("second"), F.col("b").alias("doc"))
    hubs = salted.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).distinct()
    wanted = written(partners.unionByName(hubs.withColumn("second", F.lit(False)).withColumn("doc", F.col("hub"))), "wanted")
    rows = docs.join(small_side(wanted, 48), "doc").select("hub", "salt", "second", "doc", "text")
    n = partitions(spark, wanted.count(), 20_000)
    return rows.repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", "second").mapInArrow(comparer(size, percent), "u long, v long")


def pilot_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): a document b with the smallest document a that it meets by a pilot shingle, where sizes allow a link."""
    meets = prefixes.select("doc", "n", F.explode(F.array_distinct("pilot")).alias("token"))
    firsts = meets.groupBy("token").agg(F.min(F.struct("doc", "n")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    pairs = meets.join(firsts, "token").where(F.col("first.doc") != F.col("doc"))
    fits = 100 * F.least("n", "first.n") >= percent * F.greatest("n", "first.n")
    return pairs.where(fits).select(F.col("first.doc").alias("a"), F.col("doc").alias("b")).distinct()


ENTRY = "token long, g long, n long, at long, label long"


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index: a row for each shingle in `part` of a group's prefix.

    at: the place in the prefix; for shingles that are not common, the number of common ones after them stands in its
    upper half.
    """
    for batch in batches:
        lists = batch.column("part")
        flat = lists.flatten()
        n = np.diff(lists.offsets.to_numpy())
        rows = pa.array(np.repeat(np.arange(len(n)), n))
        at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(batch.column("first").to_numpy() + (batch.column("after").to_numpy() << 32), n)
        yield pa.RecordBatch.from_arrays([flat, batch.column("doc").take(rows), batch.column("n").take(rows), pa.array(at), batch.column("label").take(rows)], ["token", "g", "n", "at", "label"])


#: Pairs (a, b, lack, k), or index rows of shingles that have too many for one task (token is set).
CROSSED = "a long, b long, lack long, k long, token long, g long, n long, at long, label long"


def crosser(percent: int, most: int):
    names = [c.split()[0] for c in CROSSED.split(", ")]

    def as_pairs(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, x), *[pa.nulls(x.shape[1], pa.int64())] * 5], names)

    def as_index(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.nulls(x.shape[1], pa.int64())] * 4, *map(pa.array, x)], names)

    def counted(found: list[np.ndarray]) -> np.ndarray:
        pairs = np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1)
        order = np.lexsort((pairs[1], pairs[0]))
        pairs = pairs[:, order]
        new = np.ones(pairs.shape[1], bool)
        new[1:] = (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])
        at = np.flatnonzero(new)
        return np.stack([pairs[0, at], pairs[1, at], pairs[2, at], np.add.reduceat(pairs[3], at)]) if len(at) else pairs

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of groups with different labels and fitting sizes that share shingles: how many (k), how many they lack.

        In prefixes of sets that link at least needed(a, b) - ceil(percent of the larger) + 1 shingles are shared: what
        follows the prefix that ends first is no longer than ceil(percent of its set) - 1. Of these, common shingles
        are not counted here and are taken as shared; `lack` is what is left.
        """
        full = np.zeros(0, np.int64)  # shingles with too many rows, sent on as they come
        waiting, rows, bound = [], 0, 4 * INDEX_ROWS

        def parted() -> tuple[np.ndarray, np.ndarray]:
            """Rows that wait, and those of shingles that have too many by now."""
            nonlocal full
            own = np.concatenate([np.zeros((5, 0), np.int64), *waiting], axis=1)
            tokens, times = np.unique(own[0], return_counts=True)
            full = np.union1d(full, tokens[times > most])
            gone = np.isin(own[0], full) if len(full) else np.zeros(own.shape[1], bool)
            return own[:, ~gone], own[:, gone]

        for batch in batches:
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "g", "n", "at", "label")])
            if len(full) and (gone := np.isin(own[0], full)).any():
                yield as_index(own[:, gone])
                own = own[:, ~gone]
            waiting.append(own)
            rows += own.shape[1]
            if rows > bound:
                own, gone = parted()
                if gone.shape[1]:
                    yield as_index(gone)
                waiting, rows = [own], own.shape[1]
                bound = max(bound, 2 * rows)
        own, gone = parted()
        waiting = []
        if gone.shape[1]:
            yield as_index(gone)
        token, g, n, at, label = own[:, np.lexsort((own[4], own[0]))]
        after = at >> 32
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(token))
        mixed = label[end - 1] != label[begin] if len(begin) else np.zeros(0, bool)
        found: list[np.ndarray] = []
        held = 0
        for low, high in zip(begin[mixed].tolist(), end[mixed].tolist()):
            own = label[low:high]
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sizes = np.diff(np.append(cuts, len(own)))
            main = own[cuts[sizes.argmax()]]
            for k in np.flatnonzero(own != main):
                i = low + int(k)
                other = np.arange(low, high)
                other = other[(own != own[k]) & ((own == main) | (other > i))]
                other = other[100 * np.minimum(n[i], n[other]) >= percent * np.maximum(n[i], n[other])]
                if len(other):
                    b = g[other]
                    lack = needed(n[i], n[other], percent) + (-percent * np.maximum(n[i], n[other])) // 100 + 1 - np.minimum(after[i], after[other])
                    found.append(np.stack([np.minimum(g[i], b), np.maximum(g[i], b), lack, np.ones(len(b), np.int64)]))
                    held += len(b)
            if held > 500_000:
                found = [counted(found)]
                if (held := found[0].shape[1]) > 250_000:
                    yield as_pairs(found[0])
                    found, held = [], 0
        yield as_pairs(counted(found))
        del own, token, g, n, at, label, after, found
        give_back()

    return cross


def common_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs as crosser() gives, for shingles of many rows: rows outside a shingle's main label against all others, salted.

    Here a pair passes by the places of the shingle in both prefixes: were it the first shared one, enough could follow.
    """
    # the main label must not depend on the order of rows, as both sides of the join work it out
    by_label = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    mains = by_label.groupBy("token").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("k")).where("labels > 1")
    mains = small_side(written(mains.select("token", "main", (F.col("k") / 5000).cast("long").alias("salts")), "mains"), 32)
    rows = rows.join(mains, "token")
    left = rows.where("label != main").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts")))).alias("x")
    right = rows.withColumn("salt", F.pmod(F.xxhash64("g"), F.col("salts") + 1)).alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    fits = (100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))) & (F.least(x("n") - x("at"), y("n") - y("at")) * (100 + percent) >= percent * (x("n") + y("n")))
    apart = (x("label") != y("label")) & ((y("label") == y("main")) | (x("g") < y("g")))
    pairs = left.join(right, (x("token") == y("token")) & (x("salt") == y("salt")) & apart & fits)
    zero = F.lit(0).cast("long")
    return pairs.select(F.least(x("g"), y("g")).alias("a"), F.greatest(x("g"), y("g")).alias("b"), zero.alias("lack"), zero.alias("k")).distinct()


def not_apart(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps differ in no more bits than sets that link may differ in shingles."""
    own = written(prefixes.select("doc", "n", "bits"), "bits")
    for side in ("a", "b"):
        mine = own.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
        pairs = pairs.join(small_side(mine, 16 + BITS // 8), side)
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    sizes = F.col("n_a") + F.col("n_b")
    return pairs.where((sizes - differ) * (100 + percent) >= 2 * percent * sizes).select("a", "b")


def labelled(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    found = prefixes.drop("pilot").join(small_side(labels, 32).select(F.col("u").alias("doc"), F.col("v").alias("label")), "doc", "left")
    return found.withColumn("label", F.coalesce("label", "doc"))


def join_pairs(prefixes: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): all pairs of groups (by their smallest document) with different labels whose prefixes allow a link; and

    (g, doc): the members of the groups that have several.
    """
    spark = prefixes.sparkSession
    rows = labelled(prefixes, labels)
    members = rows.select("doc", "n", "gkey", "label")
    groups = members.groupBy("gkey", "n", "label").agg(F.min("doc").alias("g"), F.count(F.lit(1)).alias("k")).where("k > 1")
    joined = written(members.join(groups, ["gkey", "n", "label"]).select("g", "doc"), "members")
    hidden = small_side(joined.where("g != doc").select("doc"), 16)
    total = prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    index = rows.join(hidden, "doc", "left_anti")
    n = partitions(spark, total, INDEX_ROWS)
    rare, common = F.slice("prefix", 1, F.col("rare").cast("int")), F.slice("prefix", F.col("rare").cast("int") + 1, F.size("prefix"))
    after = (F.size("prefix") - F.col("rare")).cast("long")
    none = F.lit(0).cast("long")
    part = lambda c, first, rest: index.select("doc", "n", "label", c.alias("part"), first.cast("long").alias("first"), rest.alias("after")).where("size(part) > 0").mapInArrow(entries, ENTRY)
    crossed = written(part(rare, none, after).repartition(n, "token").mapInArrow(crosser(percent, TOKEN_ROWS), CROSSED), "crossed", large=True)
    full = crossed.where("token is not null").select("token", "g", "n", F.col("at").bitwiseAND((1 << 32) - 1).alias("at"), "label")
    pairs = crossed.where("token is null").select("a", "b", "lack", "k")
    pairs = pairs.union(common_pairs(written(part(common, F.col("rare"), none).union(full), "common"), percent))
    pairs = pairs.groupBy("a", "b").agg(F.sum("k").alias("k"), F.min("lack").alias("lack")).where("k >= lack").select("a", "b")
    return written(pairs, "groups"), joined


def further(pairs: DataFrame, joined: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): pairs of members, not both the smallest, of those group pairs whose labels still differ."""
    own = small_side(labels, 32)
    for side in ("a", "b"):
        pairs = pairs.join(own.select(F.col("u").alias(side), F.col("v").alias(f"label_{side}")), side, "left")
    pairs = pairs.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
    for side in ("a", "b"):
        pairs = pairs.join(small_side(joined.select(F.col("g").alias(side), F.col("doc").alias(f"{side}2")), 32), side, "left")
    pairs = pairs.where((F.coalesce("a2", "a") != F.col("a")) | (F.coalesce("b2", "b") != F.col("b")))
    return pairs.select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))


def common_counts(own: list[np.ndarray], split: int) -> np.ndarray:
    """How many shingles the first `split` sets share with each of the others; with split = len(own), all with all."""
    n = len(own)
    flat = np.concatenate([np.zeros(0, W.U), *own])
    owner = np.repeat(np.arange(n), [len(s) for s in own])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(flat)))
    rows, columns = (slice(0, split), slice(split, n)) if split < n else (slice(0, n), slice(0, n))
    out = np.zeros((n, n), np.int64)
    run = np.repeat(np.arange(len(begin)), size)
    listed = np.repeat((size > 1) & (size <= LISTED), size)
    at = np.flatnonzero(listed)
    for step in range(1, LISTED):
        at = at[at + step < len(flat)]
        at = at[run[at + step] == run[at]]  # what fails at one step fails at all later ones
        if not len(at):
            break
        out += np.bincount(owner[at] * n + owner[at + step], minlength=n * n).reshape(n, n)
    out += out.T.copy()
    wide = np.flatnonzero(size > LISTED)
    whole = np.zeros((rows.stop - rows.start, columns.stop - columns.start), np.float32)
    for k in range(0, len(wide), 2048):
        part = wide[k : k + 2048]
        at = np.repeat(begin[part], size[part]) + np.arange(int(size[part].sum())) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        has = np.zeros((n, len(part)), np.float32)
        has[owner[at], np.repeat(np.arange(len(part)), size[part])] = 1
        whole += has[rows] @ has[columns].T
    return out[rows, columns] + whole.astype(np.int64)


COUNTS = "component long, doc long, key long, links long"


def link_counter(size: int, percent: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell: for each set of a cell the documents that it links with across the cell."""
        cell, held = None, {}

        def counted() -> pa.RecordBatch:
            component, i, j = cell
            rows = sorted(held.items(), key=lambda x: x[0][2])  # the first block's sets come first
            sets_ = [s for _, (s, _) in rows]
            times = np.array([t for _, (_, t) in rows], np.int64)
            split = sum(not second for (_, _, second), _ in rows) if i != j else len(rows)
            n = np.array([len(s) for s in sets_], np.int64)
            links = np.zeros(len(rows), np.int64)
            if i == j or 0 < split < len(rows):
                share = common_counts(sets_, split)
                one, two = (slice(0, split), slice(split, len(rows))) if i != j else (slice(0, len(rows)),) * 2
                ok = 100 * share >= percent * (n[one][:, None] + n[two][None] - share)
                if i == j:
                    np.fill_diagonal(ok, False)
                links[one] += ok @ times[two]
                if i != j:
                    links[two] += ok.T @ times[one]
            keys = [k for k, _ in rows]
            return pa.RecordBatch.from_arrays([pa.array([component] * len(rows), pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(links)], ["component", "doc", "key", "links"])

        for batch in slices(batches, "text"):
            own = sets(batch.column("text"), size)
            edges, flat = np.concatenate([[0], np.cumsum([len(s) for s in own])]), np.concatenate([np.zeros(0, W.U), *own])
            keys = set_keys(flat, edges)[0].tolist()
            for component, i, j, second, doc, classes, s, key in zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j", "second", "doc", "classes")), own, keys):
                if cell != (component, i, j):
                    if held:
                        yield counted()
                    cell, held = (component, i, j), {}
                for c in classes:  # another text under this key may be of a class of another document
                    if c["key"] == key:
                        held[doc, key, second] = (s, c["k"])
        if held:
            yield counted()

    return count


def link_counts(source: DataFrame, classes: DataFrame, found: DataFrame, size: int, percent: int) -> DataFrame:
    """component, doc, key (of a set), links: for the classes of components with several, documents of other classes that link."""
    spark = source.sparkSession
    nodes = written(found.select(F.col("u").alias("doc"), F.col("v").alias("component")).union(found.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct()), "nodes")
    own = classes.select(F.col("rep").alias("doc"), "n", F.col("k1").alias("key"), "k").join(small_side(nodes, 32), "doc")
    by_component = own.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    blocks = by_component.select("component", F.greatest(F.ceil(F.col("m") / CELL_DOCS), F.ceil(F.col("shingles") / CELL_SHINGLES)).alias("blocks"))
    docs = own.groupBy("component", "doc").agg(F.collect_list(F.struct("key", "k")).alias("classes"))  # one but where texts share a key
    docs = written(docs.join(small_side(written(blocks, "blocks"), 32), "component"), "linked")
    rows = source.join(small_side(docs, 96), "doc").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = rows.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"), "doc", "classes", "text")
    n = partitions(spark, docs.agg(F.sum("blocks")).first()[0] or 0, 1_000)
    counts = cells.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(link_counter(size, percent), COUNTS)
    return counts.groupBy("component", "doc", "key").agg(F.sum("links").alias("links"))


def same_key(own: DataFrame, repeated: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): edges between the classes of texts that share a key."""
    rows = own.join(small_side(repeated, 16), "doc", "left_semi").select("doc", "k1", "k2", "n").distinct().join(classes, ["k1", "k2", "n"])
    least = rows.groupBy("doc").agg(F.min("rep").alias("u"))
    return rows.join(least, "doc").where("rep != u").select("u", F.col("rep").alias("v")).distinct()


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, links: bool = False) -> DataFrame:
    """key, n_shingles, class_id (smallest key with an equal set) and component_id (smallest key reachable by links).

    links: also n_links, the number of other rows that a row links with, copies included.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    signs = written(source.mapInArrow(signer(size), SIGNED), "signs")
    own = signs.where("n is not null").drop("token", "times")
    classes = own.where("n > 0 and doc is not null").groupBy("k1", "k2", "n").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("k"))
    classes = written(classes, "classes")
    heavy, counts = heaviest(signs)

    source = source.where("doc is not null")
    reps = classes.select(F.col("rep").alias("doc"))
    prefixes = source.mapInArrow(prefixer(size, percent, heavy, counts), PREFIXED).where("n > 0")
    prefixes = prefixes.join(small_side(reps, 16), "doc", "left_semi")
    repeated = written(own.groupBy("doc").agg(F.count(F.lit(1)).alias("k")).where("k > 1 and doc is not null").select("doc"), "repeated")
    several = not repeated.isEmpty()
    if several:  # rows that share a key: the same row again, or another text
        again = prefixes.join(small_side(repeated, 16), "doc", "left_semi").dropDuplicates(["doc", "gkey", "n"])
        prefixes = prefixes.join(small_side(repeated, 16), "doc", "left_anti").unionByName(again)
    prefixes = written(prefixes, "prefixes")
    first = linked(written(pilot_pairs(prefixes, percent), "pairs"), source, size, percent)
    labels = smallest(written(first.union(same_key(own, repeated, classes)) if several else first, "links"))
    pairs, joined = join_pairs(prefixes, labels, percent)
    second = linked(written(not_apart(pairs, prefixes, percent), "pairs"), source, size, percent)
    found = smallest(labels.unionByName(second))
    if not joined.isEmpty():
        more = written(not_apart(further(pairs, joined, found), prefixes, percent), "pairs")
        if not more.isEmpty():
            found = smallest(found.unionByName(linked(more, source, size, percent)))
    drop_written(prefixes)

    copied = classes.where("k > 1").select("k1", "k2", "n", "rep", "k")
    rows = own.join(small_side(copied, 56), ["k1", "k2", "n"], "left")
    rows = rows.withColumn("class_id", F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc")))
    out = [F.col("doc").alias(key), F.col("n").alias("n_shingles"), "class_id", F.coalesce("component_id", "class_id").alias("component_id")]
    if not links:
        rows = rows.join(small_side(found.select(F.col("u").alias("class_id"), F.col("v").alias("component_id")), 32), "class_id", "left")
        return rows.select(*out)
    counted = written(link_counts(source, classes, found, size, percent), "counts")
    counted = counted.select(F.col("doc").alias("class_id"), F.col("key").alias("k1"), F.col("component").alias("component_id"), "links")
    rows = rows.join(small_side(counted, 48), ["class_id", "k1"], "left")
    copies = F.when(F.col("class_id").isNotNull() & (F.col("n") > 0), F.coalesce("k", F.lit(1)) - 1).otherwise(0)
    return rows.select(*out, (F.coalesce("links", F.lit(0)) + copies).cast("long").alias("n_links"))


def op1_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), links=True).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


QUERIES = {"op1_grouped_prefix_join": op1_grouped_prefix_join}
SQL: dict[str, str] = {
    "op1_grouped_prefix_join": rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT id, array_to_string(w[k:k + {SHINGLE - 1}], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
link AS (SELECT x, y, c = p.n AND c = q.n AS equal FROM common JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
reach AS (SELECT id AS x, id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
root AS (SELECT x AS id, min(doc_id) AS component_id FROM reach JOIN d ON d.id = y GROUP BY 1),
own AS (SELECT x AS id, count(*) AS n_links, min(doc_id) FILTER (equal) AS copy FROM link JOIN d ON d.id = y GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, least(doc_id, coalesce(copy, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links FROM d LEFT JOIN n USING (id) LEFT JOIN root USING (id) LEFT JOIN own USING (id)"""
}
