"""Paired inference over clusters' counts: exchange tests, bootstrap, Holm, and the exact moments of random edits.

Counts are integers and comparisons of F1 are made by cross-multiplication in ``decimal(38,0)``, ties included, and beyond its
38 digits by integers of any length. Two arms must have the same gold support in every cluster.
"""

from __future__ import annotations

import hashlib
import json
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_EXHAUSTIVE = 20
ARMS = ("tp_a", "fp_a", "fn_a", "tp_b", "fp_b", "fn_b")


class UnequalSupport(ValueError):
    """The arms of a pair don't hold the same gold records."""


def paired(counts: DataFrame, cluster: str, system: str, a: str, b: str) -> DataFrame:
    """One row per cluster with the counts of both arms; an arm without rows in a cluster counts 0 there."""
    pick = lambda s, c: F.coalesce(F.sum(F.when(F.col(system) == s, F.col(c))), F.lit(0)).alias(f"{c}_{'a' if s == a else 'b'}")
    return counts.where(F.col(system).isin(a, b)).groupBy(cluster).agg(*[pick(s, c) for s in (a, b) for c in ("tp", "fp", "fn")])


def support_faults(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("tp_a") + F.col("fn_a") != F.col("tp_b") + F.col("fn_b"))


def _few(pairs: DataFrame, cluster: str, most: int) -> list[tuple[int, ...]]:
    """The clusters' counts, in the order of their ids; a fixed number at most, so they may come to the driver."""
    rows = pairs.orderBy(cluster).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} clusters")
    if not rows:
        raise ValueError("no clusters")
    for r in rows:
        if r["tp_a"] + r["fn_a"] != r["tp_b"] + r["fn_b"]:
            raise UnequalSupport(str(r[cluster]))
    return [tuple(int(r[c]) for c in ARMS) for r in rows]


def f1_parts(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column]:
    """Numerator and denominator of F1, 0/1 where it has none."""
    den = 2 * tp + fp + fn
    return F.when(den > 0, 2 * tp).otherwise(F.lit(0).cast("long")), F.when(den > 0, den).otherwise(F.lit(1).cast("long"))


def _wide(c: Column) -> Column:
    return c.cast("decimal(18,0)")


def difference(left: tuple[Column, ...], right: tuple[Column, ...]) -> tuple[Column, Column]:
    """|F1(left) - F1(right)| as numerator and denominator."""
    (n, d), (m, e) = f1_parts(*left), f1_parts(*right)
    return F.abs(_wide(n) * _wide(e) - _wide(m) * _wide(d)).cast("decimal(38,0)"), (_wide(d) * _wide(e)).cast("decimal(38,0)")


def reaches(n: Column, d: Column, n0: Column, d0: Column) -> Column:
    """Whether n/d >= n0/d0, exactly."""
    s = lambda c: c.cast("decimal(19,0)")
    return s(n) * s(d0) >= s(n0) * s(d)


#: Below this sum of denominators all cross-products fit in 38 digits.
DECIMAL_REACH = 3_000_000_000


def at_least_as_far(left: tuple[Column, ...], a: list[int], b: list[int]) -> Column:
    """Whether |F1(left) - F1(a + b - left)| reaches |F1(a) - F1(b)|, exactly; counts of any size.

    Decimals within the code Spark generates while the products fit, else integers of any length in vectorised Python.
    """
    whole = [x + y for x, y in zip(a, b, strict=True)]
    lit = lambda v: F.lit(v).cast("long")
    if 2 * whole[0] + whole[1] + whole[2] < DECIMAL_REACH:
        num, den = difference(left, tuple(lit(w) - c for w, c in zip(whole, left, strict=True)))
        return reaches(num, den, *difference(tuple(map(lit, a)), tuple(map(lit, b))))

    def f1(t: int, p: int, n: int) -> tuple[int, int]:
        return (2 * t, 2 * t + p + n) if 2 * t + p + n else (0, 1)

    def apart(x: list[int], y: list[int]) -> tuple[int, int]:
        (n, d), (m, e) = f1(*x), f1(*y)
        return abs(n * e - m * d), d * e

    n0, d0 = apart(a, b)

    @F.pandas_udf(T.BooleanType())
    def far(t: pd.Series, p: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for x in zip(t.tolist(), p.tolist(), n.tolist(), strict=True):
            k, d = apart(list(x), [w - v for w, v in zip(whole, x, strict=True)])
            out.append(k * d0 >= n0 * d)
        return pd.Series(out)

    return far(*left)


def exchange_exact(pairs: DataFrame, cluster: str) -> DataFrame:
    """Exhaustive paired exchange over all 2^n swaps of at most 20 clusters, two-sided, ties included.

    The clusters' differences are constants of one generated expression over ``spark.range(2^n)``; clusters without a difference
    only double the count and are left out of the sums.
    """
    rows = _few(pairs, cluster, MOST_EXHAUSTIVE)
    spark, n = pairs.sparkSession, len(rows)
    a = [sum(r[i] for r in rows) for i in range(3)]
    b = [sum(r[i + 3] for r in rows) for i in range(3)]
    live = [(i, [r[k + 3] - r[k] for k in range(3)]) for i, r in enumerate(rows) if r[:3] != r[3:]]
    masks = spark.range(1 << n)
    bit = lambda i: F.shiftrightunsigned(F.col("id"), i).bitwiseAND(F.lit(1))
    left = [F.lit(a[k]).cast("long") for k in range(3)]
    for i, delta in live:
        left = [c + bit(i) * F.lit(v) if v else c for c, v in zip(left, delta, strict=True)]
    m = masks.select(*[c.alias(f"l{k}") for k, c in enumerate(left)])
    lit = lambda v: F.lit(v).cast("long")
    hits = m.select(at_least_as_far(tuple(F.col(f"l{k}") for k in range(3)), a, b).alias("far")).agg(F.count_if("far").alias("hits"))
    return hits.select(lit(n).alias("clusters"), lit(1 << n).alias("assignments"), "hits", (F.col("hits") / F.lit(float(1 << n))).alias("p"))


def exchange_draws(pairs: DataFrame, cluster: str, swaps: DataFrame, draws: int) -> DataFrame:
    """Monte-Carlo exchange for any number of clusters: ``swaps`` has ``draw, <cluster>`` of each swapped cluster.

    p = (hits + 1) / (draws + 1). A draw that swaps nothing needs no row.
    """
    t = pairs.agg(*[F.sum(c).alias(c) for c in ARMS], F.count_if(F.col("tp_a") + F.col("fn_a") != F.col("tp_b") + F.col("fn_b")).alias("faults"), F.count("*").alias("clusters")).first()
    if t["faults"]:
        raise UnequalSupport(f"{t['faults']} clusters")
    if not t["clusters"]:
        raise ValueError("no clusters")
    moved = pairs.select(cluster, *[(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(c) for c in ("tp", "fp", "fn")]).where("tp <> 0 or fp <> 0 or fn <> 0")
    sums = swaps.join(moved, cluster).groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    lit = lambda v: F.lit(int(v)).cast("long")
    left = tuple(F.col(c) + lit(t[f"{c}_a"]) for c in ("tp", "fp", "fn"))
    far = at_least_as_far(left, *[[int(t[f"{c}_{arm}"]) for c in ("tp", "fp", "fn")] for arm in "ab"])
    # draws without a row leave both arms as they were, which is a tie
    out = sums.select(far.alias("far")).agg((F.count_if("far") + F.lit(draws) - F.count("*")).alias("hits"))
    return out.select(lit(t["clusters"]).alias("clusters"), lit(draws).alias("draws"), "hits", ((F.col("hits") + 1) / F.lit(float(draws + 1))).alias("p"))


def hash_coin(*parts: Column) -> Column:
    """A fair coin from the last hex digit of a SHA-256, so that SQL can toss it too."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 64, 1), 16, 10).cast("int") % 2 == 1


def hash_index(n: int, *parts: Column) -> Column:
    """0 to n - 1 from the first 8 hex digits of a SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long"), F.lit(n))


def hash_swaps(pairs: DataFrame, cluster: str, draws: int, salt: str) -> DataFrame:
    """Swapped clusters of each draw, by hash coins. Each cluster's row is expanded where it lies."""
    d = pairs.select(cluster, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    return d.where(hash_coin(F.lit(salt), F.col("draw"), F.col(cluster))).select("draw", cluster)


def stream(payload: dict) -> np.random.Generator:
    """A PCG64 generator seeded by the SHA-256 of a payload's canonical JSON, read as a big-endian integer."""
    raw = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode()
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(raw).digest(), "big")))


def numpy_masks(payload: dict, clusters: int, draws: int) -> tuple[np.ndarray, str]:
    """Fair bits, one call of the stream, with the SHA-256 of their bytes."""
    m = stream(payload).integers(0, 2, size=(draws, clusters), dtype=np.uint8)
    return m, hashlib.sha256(m.tobytes()).hexdigest()


def numpy_indices(payload: dict, clusters: int, draws: int) -> tuple[np.ndarray, str]:
    """Bootstrap indices, one call of the stream, with the SHA-256 of their bytes."""
    i = stream(payload).integers(0, clusters, size=(draws, clusters), dtype=np.int64)
    return i, hashlib.sha256(i.astype("<u8", copy=False).tobytes()).hexdigest()


def swaps_table(spark: SparkSession, masks: np.ndarray, ids: list, cluster: str) -> DataFrame:
    """A mask matrix as ``draw, <cluster>`` rows of the swapped ones."""
    draw, at = np.nonzero(masks)
    return spark.createDataFrame(pd.DataFrame({"draw": draw, cluster: np.array(ids, dtype=object if isinstance(ids[0], str) else None)[at]}))


def bootstrap(counts: DataFrame, cluster: str, by: list[str], picks: DataFrame, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Percentile interval of F1, linearly interpolated, from common picks ``draw, <cluster>`` (repeats allowed).

    Picks become multiplicities first, so a cluster drawn three times in a draw meets its counts once. ``by`` are the columns whose
    values each get an interval; all share the same picks.
    """
    times = picks.groupBy("draw", cluster).agg(F.count("*").alias("m"))
    sums = times.join(counts, cluster).groupBy("draw", *by).agg(*[F.sum(F.col(c) * F.col("m")).alias(c) for c in ("tp", "fp", "fn")])
    num, den = f1_parts(F.col("tp"), F.col("fp"), F.col("fn"))
    f1 = sums.select(*by, (num / den.cast("double")).alias("f1"))
    return f1.groupBy(*by).agg(F.expr(f"percentile(f1, {levels[0]})").alias("lower"), F.expr(f"percentile(f1, {levels[1]})").alias("upper"), F.count("*").alias("draws"))


def paired_bootstrap(pairs: DataFrame, cluster: str, picks: DataFrame, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Percentile interval of the difference of F1 between two arms."""
    times = picks.groupBy("draw", cluster).agg(F.count("*").alias("m"))
    sums = times.join(pairs, cluster).groupBy("draw").agg(*[F.sum(F.col(c) * F.col("m")).alias(c) for c in ARMS])
    (n, d), (m, e) = f1_parts(*[F.col(c) for c in ARMS[:3]]), f1_parts(*[F.col(c) for c in ARMS[3:]])
    delta = sums.select((n / d.cast("double") - m / e.cast("double")).alias("delta"))
    return delta.agg(F.expr(f"percentile(delta, {levels[0]})").alias("lower"), F.expr(f"percentile(delta, {levels[1]})").alias("upper"), F.count("*").alias("draws"))


def hash_picks(pairs: DataFrame, cluster: str, draws: int, salt: str) -> DataFrame:
    """As many hash-drawn picks per draw as there are clusters; clusters are numbered in the order of their ids."""
    ids = [r[0] for r in pairs.select(cluster).distinct().orderBy(cluster).collect()]
    spark = pairs.sparkSession
    names = F.array(*[F.lit(i) for i in ids])
    slots = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(len(ids) - 1))).alias("slot"))
    return slots.select("draw", F.get(names, hash_index(len(ids), F.lit(salt), F.col("draw"), F.col("slot")).cast("int")).alias(cluster))


def holm(df: DataFrame, family: list[str], p: str, order: str) -> DataFrame:
    """Adds ``holm``: the step-down adjusted p of each family, ties in the declared order, at most 1; and ``rejected`` at 1/20."""
    w = W.partitionBy(*family).orderBy(p, order)
    ranked = df.withColumn("_rank", F.row_number().over(w) - 1).withColumn("_m", F.count("*").over(W.partitionBy(*family)))
    run = F.max((F.col("_m") - F.col("_rank")) * F.col(p)).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = ranked.withColumn("holm", F.least(run, F.lit(1.0)))
    return out.withColumn("rejected", F.col("holm") <= 0.05).drop("_rank", "_m")


def holm_exact(ps: list[Fraction]) -> list[Fraction]:
    """The same for a handful of exact rationals."""
    out, high = [Fraction(0)] * len(ps), Fraction(0)
    for rank, i in enumerate(sorted(range(len(ps)), key=lambda k: (ps[k], k))):
        high = max(high, (len(ps) - rank) * ps[i])
        out[i] = min(high, Fraction(1))
    return out


def budget_moments(pool: DataFrame, strata: list[str], budget: str, hit: str) -> DataFrame:
    """Mean and variance of the hits when ``budget`` of each stratum's edits are chosen at random without replacement.

    Hypergeometric per stratum, summed over independent strata. ``pool`` has one row per edit, with its stratum's budget and whether it is a hit.
    A budget over the stratum's size takes all of it.
    """
    s = pool.groupBy(*strata).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col(hit)).cast("double").alias("k"), F.max(budget).cast("double").alias("b0"))
    s = s.withColumn("b", F.least("b0", "n"))
    mean = F.col("b") * F.col("k") / F.col("n")
    var = F.when(F.col("n") > 1, F.col("b") * F.col("k") / F.col("n") * (1 - F.col("k") / F.col("n")) * (F.col("n") - F.col("b")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return s.agg(F.sum(mean).alias("mean_hits"), F.sum(var).alias("variance_hits"), F.sum("b").cast("long").alias("budget"))


def choice_bits(n: int, k: int) -> float:
    """log2 of n choose k."""
    from math import lgamma, log

    return 0.0 if k < 0 or k > n else (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) / log(2)
