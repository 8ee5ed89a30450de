"""Selection with deterministic ties: lexicographic argmax, exact F1 order, hash-ordered subsets, topological order."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def argmax(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The row of each group that comes first by the keys, each larger before smaller; give ``-x`` for the other way. One pass, no sort."""
    best = F.max_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(*order)).alias("_b")
    return df.groupBy(*by).agg(best).select(*by, "_b.*")


_DIGITS = 10**18


def f1_key(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    """F1 as three whole numbers, its first 54 decimals, in whose order the exact fractions are; 0 without a denominator.

    Two different fractions with denominators below 2^63 are more than 10^-38 apart, so counts of any size are told apart.
    """
    wide = lambda c: c.cast("decimal(19,0)")
    den = wide(2 * F.col(tp) + F.col(fp) + F.col(fn))
    rest, out = wide(2 * F.col(tp)), []
    for _ in range(3):
        x = rest * F.lit(_DIGITS).cast("decimal(19,0)")
        rest = wide(x % den)
        out.append(F.when(den > 0, ((x - rest) / den).cast("decimal(19,0)").cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def f1_sum(a: list[Column], b: list[Column]) -> list[Column]:
    """The sum of two keys, carried; exact for denominators below 10^13."""
    low = a[2] + b[2]
    mid = a[1] + b[1] + F.when(low >= _DIGITS, 1).otherwise(0)
    return [a[0] + b[0] + F.when(mid >= _DIGITS, 1).otherwise(0), F.pmod(mid, F.lit(_DIGITS)), F.pmod(low, F.lit(_DIGITS))]


def best_threshold(df: DataFrame, by: list[str]) -> DataFrame:
    """Grid rows with tp, fp, fn, threshold, epoch: F1, then fewer false positives, higher threshold, earlier epoch."""
    return argmax(df, by, [*f1_key(), -F.col("fp"), F.col("threshold"), -F.col("epoch")])


def best_edit_threshold(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with tp, fp, fn, the edit counts and threshold: F1, then less harm, fewer edits, higher threshold."""
    harm = F.col("wrong_added") + F.col("correct_deleted")
    return argmax(df, by, [*f1_key(), -harm, -(harm + F.col("correct_added") + F.col("wrong_deleted")), F.col("threshold")])


def best_pair_setting(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with counts of two endpoints (``*_r``, ``*_e``), two thresholds and epoch: mean F1, fewer false positives in all, then the thresholds, then earlier."""
    mean = f1_sum(f1_key("tp_r", "fp_r", "fn_r"), f1_key("tp_e", "fp_e", "fn_e"))
    return argmax(df, by, [*mean, -(F.col("fp_r") + F.col("fp_e")), F.col("threshold_r"), F.col("threshold_e"), -F.col("epoch")])


def best_control(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """F1, then the later name; a tie over all goes by name alone."""
    return argmax(df, by, [*f1_key(), F.col(name)])


def hash_subset(df: DataFrame, by: list[str], key: Column, k: int, salt: str = "") -> DataFrame:
    """The ``k`` rows of each group with the least SHA-256 of the key; the same ones in any run.

    Groups are cut by a bounded top-k aggregate, so a hot group isn't sorted whole.
    """
    h = F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)
    rows = df.withColumn("_h", h)
    part = rows.withColumn("_s", F.spark_partition_id())
    first = part.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_s").orderBy("_h"))).where(F.col("_r") <= k)
    return first.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_h"))).where(F.col("_r") <= k).withColumnRenamed("_r", "rank").drop("_h", "_s")


def hash_topological(edges: list[tuple[str, str]], nodes: list[str], salt: dict | None = None) -> list[str]:
    """An order of a small graph's nodes: of those whose predecessors are done, the one with the least hash. Raises on a cycle."""
    digest = lambda n: hashlib.sha256(json.dumps([salt or {}, n], sort_keys=True).encode()).hexdigest()
    waits = {n: {a for a, b in edges if b == n} for n in nodes}
    out: list[str] = []
    while waits:
        ready = [n for n, before in waits.items() if before <= set(out)]
        if not ready:
            raise ValueError("cycle")
        out.append(min(ready, key=digest))
        del waits[out[-1]]
    return out
