"""Problem 2: all pairs of records whose value sets overlap strongly.

Method: T-occurrence list merging over partitioned inverted lists. A record of ``c`` values can only
reach a Jaccard overlap of ``num/den`` with a partner if they share at least ``ceil(num (c + d) / (num + den))`` values.

1. Values become 64-bit hashes. Rows are shuffled once by value, where repeats go and the number of
   records of each value is counted; a value of more than ``1/4096`` of all rows is cut in as many salts as it needs.
2. Rows are shuffled once by record. A value held by no other record only counts; a record with too few
   others has no partner and leaves. Records' values are kept rarest first.
3. Records with equal sets collapse to their smallest id.
4. A representative goes to the partitions of its prefix, the rarest values of which any partner must
   hold one. There an inverted list per value is probed: MergeSkip with a heap over the short lists,
   binary search in the longest ones, and records that reach the overlap come out. Partitions that grow too
   large are cut in blocks, each pair of blocks being a task.
5. Pairs are verified on the 64-bit values, and copies are joined back.

Two values of a pair are taken for one only if their 64-bit hashes agree: about 10^-15 for sets of 100.

Null values and null ids are dropped, repeated rows count once. Sets of more than ``GIANT`` values, which one task
shouldn't hold, are compared among themselves by prefix and count, in joins only. Empty tables give no pairs.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.skew import attach, grid_join, lookup_join, pairs_within
from tessella.session import materialize, parallelism

GIANT = 20_000
BINS = 65_536
HOT_SHARE = 4_096
#: Rows of a hot value that meet in one task.
ROWS = 1_000_000
#: Values that one cell of the probing stage holds.
CELL = 400_000


def hot_values(rows: DataFrame, total: int) -> DataFrame:
    """``h, k, two`` of the hashes with more than ``total / HOT_SHARE`` rows (so at most HOT_SHARE of them): salts to cut them in, and whether two records hold them.

    First rows are counted in ``BINS`` bins, whose number is fixed; only the rows of bins over the bound are counted by value.
    """
    least = max(1000, total // HOT_SHARE)
    bin_ = F.pmod("h", F.lit(BINS)).alias("bin")
    bins = rows.groupBy(bin_).agg(F.count("*").alias("n")).where(F.col("n") > least).select("bin")
    found = rows.withColumn("bin", bin_).join(F.broadcast(bins), "bin", "left_semi").groupBy("h").agg(F.count("*").alias("n"), F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    return found.where(F.col("n") > least).select("h", F.ceil(F.col("n") / F.lit(ROWS)).cast("int").alias("k"), (F.col("lo") != F.col("hi")).alias("two"))


def _records(num: int, den: int):
    """Rows sorted by uid, n, h to records with a partner's chance."""
    schema = pa.schema([("uid", pa.int64()), ("c", pa.int32()), ("pre", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("toks", pa.list_(pa.int64()))])

    def mixed(t: np.ndarray) -> tuple[int, int]:
        with np.errstate(over="ignore"):
            x = t.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            y = x * np.uint64(0x94D049BB133111EB)
            return int((x ^ (x >> np.uint64(29))).sum().view(np.int64)), int((y ^ (y >> np.uint64(32))).sum().view(np.int64))

    def made(uid: np.ndarray, n: np.ndarray, h: np.ndarray) -> pa.RecordBatch | None:
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(uid)) + 1, [len(uid)]])
        size = np.diff(cuts)
        shared = np.add.reduceat((n > 1).astype(np.int64), cuts[:-1])
        keep = np.flatnonzero((den * shared >= num * size) & (shared > 0))
        if not len(keep):
            return None
        cols: list[list] = [[], [], [], [], []]
        toks = []
        for i in keep:
            c, m, end = int(size[i]), int(shared[i]), int(cuts[i + 1])
            t = h[end - m : end]
            prefix = c - -(-num * c // den) + 1 - (c - m)
            for col, v in zip(cols, (int(uid[end - 1]), c, prefix, *mixed(t)), strict=True):
                col.append(v)
            toks.append(t)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in toks])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(toks)))
        arrays = [pa.array(col, type=schema.field(k).type) for k, col in enumerate(cols)]
        return pa.RecordBatch.from_arrays([*arrays, lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            cols = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(cols[0]):
                continue
            last = cols[0][-1]
            first = int(np.searchsorted(cols[0], last))  # sorted within a task
            if first or held and held[0][0][0] != last:
                whole = [np.concatenate(x) for x in zip(*held, tuple(c[:first] for c in cols), strict=True)] if held else [c[:first] for c in cols]
                if len(whole[0]) and (out := made(*whole)) is not None:
                    yield out
                held = []
            held.append(tuple(c[first:] for c in cols))
        if held and (out := made(*[np.concatenate(x) for x in zip(*held, strict=True)])) is not None:
            yield out

    return run


def needed(c: int, d: int, num: int, den: int) -> int:
    """Least number of common values of sets of c and d with ``den * I >= num * U``."""
    return -(-num * (c + d) // (num + den))


def divide_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """Numbers that occur on at least ``least`` of the sorted lists, with how often.

    The longest lists are set aside; the others are merged with a heap that, once a number falls short, skips
    each list to the next that could still succeed. The longest are searched for what remains.
    """
    if len(lists) < least:
        return
    lists.sort(key=len)
    aside = min(least - 1, int(least / (0.01 * log(max(2, len(lists[-1]))) + 1)), sum(len(x) > 8 for x in lists))
    short, long = (lists[:-aside], lists[-aside:]) if aside else (lists, [])
    t = least - len(long)
    at = [0] * len(short)
    heap = [(x[0], i) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= t:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= t:
            n = len(popped) + sum((k := bisect_left(x, top)) < len(x) and x[k] == top for x in long)
            if n >= least:
                yield top, n
            for i in popped:
                at[i] += 1
                if at[i] < len(short[i]):
                    heapq.heappush(heap, (short[i][at[i]], i))
        else:
            while heap and len(popped) < t - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            goal = heap[0][0]
            for i in popped:
                at[i] = bisect_left(short[i], goal, at[i])
                if at[i] < len(short[i]):
                    heapq.heappush(heap, (short[i][at[i]], i))


#: Candidates of a record that are looked at singly before its lists are probed.
FEW = 64


def probe(uids: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, pre: np.ndarray, offs: np.ndarray, toks: np.ndarray, part: int, parts: int, cross: bool, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of one cell's records (sorted by size) that reach the overlap; with ``cross``, of different blocks only.

    A pair is found in the partition of the first prefix value the two have in common, in the order of the larger one. A record
    without a candidate of which this is true here isn't probed here.
    """
    vals, inv, df = np.unique(toks, return_inverse=True, return_counts=True)
    many = df[inv] > 1
    n = len(uids)
    rec = np.repeat(np.arange(n), np.diff(offs))
    here = np.bincount(rec, weights=many, minlength=n).astype(np.int64)
    able = here >= -(-num * sizes // den)  # as any partner demands
    at = np.arange(len(toks)) - offs[rec]
    first = many & able[rec] & (at < pre[rec]) & (toks % parts == part)
    heads: dict[int, list[int]] = {}
    own: dict[int, list[int]] = {}
    for r, v in zip(rec[first].tolist(), inv[first].tolist(), strict=True):
        heads.setdefault(v, []).append(r)
        own.setdefault(r, []).append(v)
    live = many & able[rec]
    rec, inv = rec[live], inv[live]
    order = np.lexsort((rec, inv))
    col, ends = rec[order], np.searchsorted(inv[order], np.arange(len(vals) + 1))
    starts = np.searchsorted(rec, np.arange(n + 1))
    lists: dict[int, list[int]] = {}
    prefixes: dict[int, list[int]] = {}

    def prefix(x: int) -> list[int]:
        p = prefixes.get(x)
        if p is None:
            p = prefixes[x] = toks[offs[x] : offs[x] + max(0, pre[x])].tolist()
        return p

    def owned(x: int, y: int) -> bool:
        there = prefix(y)
        for v in prefix(x):
            if v in there:
                return v % parts == part
        return False

    for x in sorted(own):
        c = int(sizes[x])
        floor = int(np.searchsorted(sizes, -(-num * c // den)))
        if floor >= x:
            continue
        near: set[int] = set()
        for v in own[x]:
            h = heads[v]
            near.update(h[bisect_left(h, floor) : bisect_left(h, x)])
        if not near or len(near) <= FEW and not any(owned(x, y) for y in near):
            continue
        mine = []
        for v in inv[starts[x] : starts[x + 1]].tolist():
            held = lists.get(v)
            if held is None:
                held = lists[v] = col[ends[v] : ends[v + 1]].tolist()
            if held[0] < x and len(held) > 1:
                lo, hi = bisect_left(held, floor), bisect_left(held, x)
                if lo < hi:
                    mine.append(held[lo:hi])
        for y, k in divide_skip(mine, needed(c, int(sizes[floor]), num, den)):
            if k >= needed(c, int(sizes[y]), num, den) and not (cross and blocks[x] == blocks[y]) and owned(x, y):
                yield int(uids[x]), int(uids[y])


def _probe_cells(num: int, den: int, parts: int):
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("toks").combine_chunks()
            order = np.argsort(t.column("c").to_numpy(), kind="stable")
            lists = lists.take(pa.array(order)) if len(order) else lists
            offs = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            pairs = list(probe(*[t.column(n).to_numpy()[order] for n in ("uid", "c", "block", "pre")], offs, lists.flatten().to_numpy(), key[0], parts, key[1] != key[2], num, den))
            if pairs:
                a = np.array(pairs, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a.min(axis=1)), pa.array(a.max(axis=1))], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(n).to_numpy() for n in ("part", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(k, axis=0) != 0).any(axis=1)) + 1).tolist(), len(k)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(k[lo].tolist())
                if now != key:
                    if held:
                        yield from done()
                    held, key = [], now
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from done()

    return run


def partnered(df: DataFrame, c: str, num: int, den: int) -> DataFrame:
    """Rows whose set size has another of a ratio that allows a pair, or may have.

    Sizes are binned by the ratio ``den/num``; a partner is in the same or a neighbouring bin. There are a few hundred bins at most.
    """
    bin_ = F.floor(F.log(F.col(c).cast("double")) / log(den / num)).cast("int")
    held = {r["b"]: r["n"] for r in df.groupBy(bin_.alias("b")).agg(F.count("*").alias("n")).collect()}
    able = [b for b in held if held[b] + held.get(b - 1, 0) + held.get(b + 1, 0) > 1]
    return df.where(bin_.isin(able)) if able else df.where(F.lit(False))


def records_of(sets: DataFrame, value: str, uid: str, num: int, den: int) -> tuple[DataFrame, DataFrame | None]:
    """Records with a chance of a partner, ``uid, c, pre, s1, s2, toks``, and the distinct rows of giants and sets that may reach one, if there are any giants."""
    rows = sets.where(F.col(value).isNotNull() & F.col(uid).isNotNull()).select(F.col(uid).cast("long").alias("uid"), F.xxhash64(value).alias("h"))
    sizes = rows.groupBy("uid").agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    giants = None
    if (most or 0) > GIANT:
        # few (at most total / GIANT), and one long each: Spark broadcasts them below its own limit; repeated rows go before sizes are compared
        large = materialize(sizes.where(F.col("n") > GIANT * num // den).select("uid"), "large")
        values = materialize(rows.join(large, "uid", "left_semi").distinct(), "values")
        big = materialize(values.groupBy("uid").agg(F.count("*").alias("n")).where(F.col("n") > GIANT * num // den).select("uid", (F.col("n") > GIANT).alias("_giant")), "big")
        if big.where("_giant").take(1):
            giants = values.join(big.select("uid"), "uid", "left_semi")
            rows = rows.join(big.where("_giant").select("uid"), "uid", "left_anti")
    hot = materialize(hot_values(rows, total or 0), "hot")
    marked = rows.join(F.broadcast(hot), "h", "left") if hot.take(1) else rows.withColumn("k", F.lit(None).cast("int")).withColumn("two", F.lit(None).cast("boolean"))
    placed = marked.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("k")) + 1, F.lit(0)).cast("int")).repartition("h", "salt").dropDuplicates(["h", "salt", "uid"])
    counted = placed.withColumn("n", F.count("*").over(W.partitionBy("h", "salt")))
    n = F.when(F.col("k").isNull(), F.col("n").cast("int")).when(F.col("two"), F.lit(2**31 - 1)).otherwise(F.lit(1))
    # a value of one record only counts: its hash needn't travel
    flat = counted.select("uid", n.alias("n"), "h").select("uid", "n", F.when(F.col("n") > 1, F.col("h")).otherwise(F.lit(0)).alias("h"))
    out = flat.repartition("uid").sortWithinPartitions("uid", "n", "h").mapInArrow(_records(num, den), "uid long, c int, pre int, s1 long, s2 long, toks array<long>")
    return partnered(materialize(out, "records"), "c", num, den), giants


def giant_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs with a set over GIANT, among the few sets of that order of size; relational, without collecting a set.

    Sets meet by their prefixes, the rarest values of which any partner must hold one, and only those that met are compared.
    """
    d = rows.distinct()
    sizes = partnered(materialize(d.groupBy("uid").agg(F.count("*").alias("c")), "giants"), "c", num, den)
    if not sizes.take(1):
        return rows.sparkSession.createDataFrame([], "left_uid long, right_uid long, intersection_count long, union_count long")
    d = materialize(d.join(sizes, "uid"), "giants")
    held = materialize(d.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").withColumn("m", F.col("n")), "held")
    shared = lookup_join(d, held, ["h"], "m", held.agg(F.sum("n")).first()[0] or 0)
    each = W.partitionBy("uid")
    ranked = shared.withColumn("r", F.row_number().over(each.orderBy("n", "h")) + F.col("c") - F.count("*").over(each))
    prefix = materialize(ranked.where(F.col("r") <= F.col("c") - F.ceil(F.col("c") * num / den) + 1).select("uid", "c", "h"), "prefix")
    near = pairs_within(prefix, ["h"], "uid", extra=["c"]).where((F.greatest("left_c", "right_c") > GIANT) & (F.least("left_c", "right_c") * den >= F.greatest("left_c", "right_c") * num)).distinct()
    near = materialize(near, "near")
    values = d.select(F.col("uid").alias("left_uid"), "h")
    both = grid_join(near, values, ["left_uid"]).join(d.select(F.col("uid").alias("right_uid"), "h"), ["right_uid", "h"])
    met = both.groupBy("left_uid", "right_uid", "left_c", "right_c").agg(F.count("*").alias("intersection_count"))
    met = met.withColumn("union_count", F.col("left_c") + F.col("right_c") - F.col("intersection_count"))
    return met.where(F.col("intersection_count") * den >= F.col("union_count") * num).select("left_uid", "right_uid", "intersection_count", "union_count")


def class_pairs(records: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Representatives' pairs ``left, right, intersection_count, union_count``, and the membership ``uid, rep, c``."""
    spark = records.sparkSession
    whole = F.size("toks") == F.col("c")
    key = [F.when(whole, F.col("s1")).otherwise(F.col("uid")).alias("k1"), F.when(whole, F.col("s2")).otherwise(F.lit(0)).alias("k2"), F.when(whole, F.col("c")).otherwise(F.lit(-1)).alias("k3")]
    keyed = records.select("*", *key)
    reps = keyed.groupBy("k1", "k2", "k3").agg(F.min("uid").alias("rep"))
    members = materialize(keyed.select("uid", "c", "k1", "k2", "k3").join(reps, ["k1", "k2", "k3"]).select("uid", "rep", "c"), "members")
    own = records.join(members.where("uid = rep").select("uid"), "uid", "left_semi")
    # 32 bits suffice to find candidates: values that collide can only add to an overlap
    pre = F.slice("toks", 1, F.greatest("pre", F.lit(0)))
    load = own.agg(F.sum(F.size("toks").cast("long") * F.least(F.greatest("pre", F.lit(0)), F.lit(256)))).first()[0] or 0
    parts = max(parallelism(spark), ceil(load / CELL))
    routed = own.withColumn("part", F.explode(F.array_distinct(F.transform(pre, lambda x: F.pmod(F.hash(x), F.lit(parts))))))
    loads = routed.groupBy("part").agg(F.sum(F.size("toks")).alias("load")).where(F.col("load") > 2 * CELL)
    cut = routed.join(loads.select("part", F.ceil(F.col("load") / F.lit(CELL)).cast("int").alias("k")), "part", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(3)), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = cut.select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "uid", "c", "pre", F.transform("toks", lambda x: F.hash(x)).alias("toks"))
    found = cells.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(_probe_cells(num, den, parts), "x long, y long").distinct()
    a = records.select(F.col("uid").alias("x"), F.col("c").alias("cx"), F.col("toks").alias("tx"))
    b = records.select(F.col("uid").alias("y"), F.col("c").alias("cy"), F.col("toks").alias("ty"))
    both = found.join(a, "x").join(b, "y").withColumn("intersection_count", F.size(F.array_intersect("tx", "ty")).cast("long"))
    both = both.withColumn("union_count", F.col("cx") + F.col("cy") - F.col("intersection_count")).where(F.col("intersection_count") * den >= F.col("union_count") * num)
    return both.select(F.col("x").alias("left"), F.col("y").alias("right"), "intersection_count", "union_count"), members


def similar_pairs(sets: DataFrame, value: str = "gram", uid: str = "uid", num: int = 4, den: int = 5) -> DataFrame:
    """All pairs with ``den * intersection >= num * union``: ``left_uid < right_uid, intersection_count, union_count``."""
    records, giants = records_of(sets, value, uid, num, den)
    found, members = class_pairs(records, num, den)
    found = materialize(found, "pairs")
    spread = attach(attach(found, "left", members, "rep", "uid", "a"), "right", members, "rep", "uid", "b")
    spread = spread.select(F.least("a", "b").alias("left_uid"), F.greatest("a", "b").alias("right_uid"), "intersection_count", "union_count")
    copies = pairs_within(members, ["rep"], "uid", extra=["c"]).select("left_uid", "right_uid", F.col("left_c").cast("long").alias("intersection_count"), F.col("left_c").cast("long").alias("union_count"))
    out = spread.unionByName(copies)
    return out.unionByName(giant_pairs(giants, num, den)) if giants is not None else out


def similar_between(left: DataFrame, right: DataFrame, value: str = "gram", uid: str = "uid", num: int = 4, den: int = 5) -> DataFrame:
    """Pairs of a record of ``left`` and one of ``right``, as :func:`similar_pairs`: ``left_uid`` is of the first table, ``right_uid`` of the second.

    Both tables go through one join, so that equal sets of either are one class; ids of one table are told from those of the other by
    their last bit, and have to lie within 62 bits.
    """
    tagged = lambda df, side: df.select((F.col(uid).cast("long") * 2 + side).alias("uid"), F.col(value).alias("value"))
    records, giants = records_of(tagged(left, 0).unionByName(tagged(right, 1)), "value", "uid", num, den)
    found, members = class_pairs(records, num, den)
    found = materialize(found, "pairs")
    ends = ["intersection_count", "union_count"]
    either = found.unionByName(found.select(F.col("right").alias("left"), F.col("left").alias("right"), *ends))
    first, second = members.where("uid % 2 = 0"), members.where("uid % 2 <> 0")
    out = attach(attach(either, "left", first, "rep", "uid", "a"), "right", second, "rep", "uid", "b").select("a", "b", *ends)
    same = grid_join(first.select("rep", F.col("uid").alias("a"), F.col("c").cast("long").alias("intersection_count")), second.select("rep", F.col("uid").alias("b")), ["rep"])
    out = out.unionByName(same.select("a", "b", "intersection_count", F.col("intersection_count").alias("union_count")))
    if giants is not None:
        g = giant_pairs(giants, num, den).where("left_uid % 2 <> right_uid % 2")
        swap = F.col("left_uid") % 2 == 0
        out = out.unionByName(g.select(F.when(swap, F.col("left_uid")).otherwise(F.col("right_uid")).alias("a"), F.when(swap, F.col("right_uid")).otherwise(F.col("left_uid")).alias("b"), *ends))
    return out.select(F.shiftright("a", 1).alias("left_uid"), F.shiftright("b", 1).alias("right_uid"), *ends)


def giant_classes(rows: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links ``left, right`` between representatives of which one is over GIANT, and the membership ``uid, rep`` of all ``rows``.

    Sets are equal if the count and two order-free digests of their distinct values are.
    """
    d = rows.distinct()
    digests = [F.bit_xor(F.xxhash64(F.lit(k), "h")).alias(f"d{k}") for k in (1, 2)]
    made = materialize(d.groupBy("uid").agg(F.count("*").alias("c"), *digests), "digests")
    key = ["c", "d1", "d2"]
    members = materialize(made.join(made.groupBy(*key).agg(F.min("uid").alias("rep")), key).select("uid", "rep"), "members")
    own = d.join(members.where("uid = rep").select("uid"), "uid", "left_semi")
    return giant_pairs(own, num, den).select(F.col("left_uid").alias("left"), F.col("right_uid").alias("right")), members


def similar_classes(sets: DataFrame, value: str = "gram", uid: str = "uid", num: int = 4, den: int = 5) -> DataFrame:
    """One row per record with a partner: its class of equal sets, the class's size and its links to other classes.

    The form for corpora in which one set is held by very many records: nothing is expanded.
    """
    records, giants = records_of(sets, value, uid, num, den)
    found, members = class_pairs(records, num, den)
    found, members = found.select("left", "right"), members.select("uid", "rep")
    if giants is not None:
        # sets that aren't over GIANT have the same representative, the least uid of their equals, on both sides
        links, more = giant_classes(giants, num, den)
        found, members = found.unionByName(links), materialize(members.unionByName(more).distinct(), "members")
    ends = found.select(F.col("left").alias("rep")).unionByName(found.select(F.col("right").alias("rep"))).groupBy("rep").agg(F.count("*").alias("linked_classes"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("members"))
    per = sizes.join(ends, "rep", "left").fillna(0, ["linked_classes"]).where("members > 1 or linked_classes > 0")
    return members.join(per, "rep").select("uid", F.col("rep").alias("class_uid"), "members", "linked_classes")
