"""Integrity checks: each gives the rows that break a rule, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Broken(ValueError):
    """A check found something."""


def require_empty(df: DataFrame, what: str, show: int = 3) -> None:
    bad = df.take(show)
    if bad:
        raise Broken(f"{what}: {[r.asDict() for r in bad]}")


def population(actual: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Keys missing from actual, unexpected in it, or there more than once; one shuffle."""
    k = actual.select(*key, F.lit(1).alias("a"), F.lit(0).alias("e")).unionByName(expected.select(*key, F.lit(0).alias("a"), F.lit(1).alias("e")))
    g = k.groupBy(*key).agg(F.sum("a").alias("a"), F.max("e").alias("e"))
    fault = F.when(F.col("a") == 0, "missing").when(F.col("e") == 0, "unexpected").when(F.col("a") > 1, "repeated")
    return g.select(*key, fault.alias("fault")).where("fault is not null")


def constant_support(counts: DataFrame, by: list[str], tp: str = "tp", fn: str = "fn") -> DataFrame:
    """Groups whose gold support tp + fn isn't the same in all their rows."""
    s = F.col(tp) + F.col(fn)
    return counts.groupBy(*by).agg(F.min(s).alias("least"), F.max(s).alias("most")).where("least <> most")


def conservation(slices: DataFrame, totals: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Groups whose slices don't add up to their totals."""
    a = slices.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])
    both = a.select(*by, *columns, F.lit(1).alias("_s")).unionByName(totals.select(*by, *columns, F.lit(-1).alias("_s")))
    d = both.groupBy(*by).agg(*[F.sum(F.col(c) * F.col("_s")).alias(c) for c in columns])
    return d.where(" or ".join(f"{c} <> 0" for c in columns))


def outside_candidates(predicted: DataFrame, candidates: DataFrame, key: list[str], p: str, least: float) -> DataFrame:
    """Predictions that are no candidate, or whose probability isn't in [least, 1]; NaN and null are outside."""
    lost = predicted.join(candidates.select(*key).distinct(), key, "left_anti").withColumn("fault", F.lit("not_a_candidate"))
    odd = predicted.where(~F.coalesce(F.col(p).between(least, 1.0) & ~F.isnan(p), F.lit(False))).withColumn("fault", F.lit("probability"))
    return lost.unionByName(odd)


def covered_once(map_: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Ids that a cluster map doesn't cover exactly once."""
    return population(map_, ids, [key])


def manifest_faults(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, fault`` of files whose bytes aren't as listed. ``files(path, content)``, ``manifest(path, sha256, size_bytes)``."""
    f = files.select("path", F.sha2("content", 256).alias("sha"), F.length("content").cast("long").alias("size"))
    j = manifest.select("path", F.lower("sha256").alias("want"), F.col("size_bytes").cast("long").alias("bytes")).join(f, "path", "full_outer")
    fault = F.when(F.col("sha").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("size") != F.col("bytes"), "size").when(F.col("sha") != F.col("want"), "digest")
    return j.select("path", fault.alias("fault")).where("fault is not null")


def same_selection(grid_choice: DataFrame, frozen: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Choices that a recomputation doesn't confirm."""
    return frozen.select(*key, *columns).exceptAll(grid_choice.select(*key, *columns)).withColumn("side", F.lit("frozen")).unionByName(grid_choice.select(*key, *columns).exceptAll(frozen.select(*key, *columns)).withColumn("side", F.lit("recomputed")))


def equal_within(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Keys at which two replays differ by more than the tolerance, or that one of them lacks; NaN differs from everything."""
    x = a.select(*key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(1).alias("_x"))
    y = b.select(*key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(1).alias("_y"))
    bad: Column = F.col("_x").isNull() | F.col("_y").isNull()
    for c in columns:
        bad = bad | F.coalesce(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) > tolerance, F.col(f"_a_{c}").isNull() != F.col(f"_b_{c}").isNull())
    return x.join(y, key, "full_outer").where(bad).select(*key)
