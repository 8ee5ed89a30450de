"""Provenance of texts: exact duplicates by several views, near duplicates by word grams, their clusters."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.skew import lookup_join, pairs_within, semi_join
from tessella.operators.stars import star_components
from tessella.session import materialize


def eligible(study: str, near: bool) -> Column:
    """Which pairs count: a side is of the study corpus; and for near ones, corpora differ, or splits do, or both are test."""
    l, r = (lambda c: F.col(f"left_{c}")), (lambda c: F.col(f"right_{c}"))  # noqa: E731, E741
    one = (l("corpus") == study) | (r("corpus") == study)
    if not near:
        return F.coalesce(one, F.lit(False))
    return F.coalesce(one & ((l("corpus") != r("corpus")) | ~l("split").eqNullSafe(r("split")) | (l("split") == "test")), F.lit(False))


def exact_pairs(units: DataFrame, uid: str, views: dict[str, str], study: str) -> DataFrame:
    """``kind, left_uid, right_uid`` of units that agree in a view; null and empty values agree with nothing.

    All views go through one salted self-join: a unit is one row per view.
    """
    seen = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in views.items()]))
    rows = units.select(F.col(uid).alias("uid"), "corpus", "split", seen.alias("v")).where("v.value <> ''")
    rows = rows.select("uid", "corpus", "split", F.col("v.kind").alias("kind"), F.concat_ws("|", "v.kind", "v.value").alias("key"))
    p = pairs_within(rows, ["key"], "uid", extra=["corpus", "split", "kind"])
    return p.where(eligible(study, False)).select(F.col("left_kind").alias("kind"), "left_uid", "right_uid")


def with_possible_partner(sizes: DataFrame, c: str, num: int, den: int) -> DataFrame:
    """Sets whose size is near enough to another's for a pair: binned by the ratio, at most a few hundred bins."""
    bin_ = F.floor(F.log(F.col(c).cast("double")) / log(den / num)).cast("int")
    held = {r["b"]: r["n"] for r in sizes.groupBy(bin_.alias("b")).agg(F.count("*").alias("n")).collect()}
    able = [b for b in held if held[b] + held.get(b - 1, 0) + held.get(b + 1, 0) > 1]
    return sizes.where(bin_.isin(able)) if able else sizes.where(F.lit(False))


def near_pairs(grams: DataFrame, uid: str, gram: str, num: int = 4, den: int = 5) -> DataFrame:
    """All pairs with ``den * I >= num * U``: ``left_uid, right_uid, intersection_count, union_count``; relational throughout.

    A prefix filter, rarest grams first, makes candidates; sizes must be within the ratio; intersections are counted exactly.
    Sets without another of comparable size, as a whole volume, leave before anything is gathered per set. Nulls are dropped, repeats count once.
    """
    rows = grams.where(F.col(uid).isNotNull() & F.col(gram).isNotNull()).select(F.col(uid).alias("uid"), F.xxhash64(gram).alias("g")).distinct()
    rows = materialize(rows, "grams")
    sizes = with_possible_partner(materialize(rows.groupBy("uid").agg(F.count("*").cast("int").alias("c")), "sizes"), "c", num, den)
    df = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").withColumn("_n", F.col("n"))
    shared = lookup_join(rows, df, ["g"], "_n", rows.count())
    kept = shared.groupBy("uid").agg(F.count("*").alias("m")).join(sizes, "uid").where(F.col("m") * den >= F.col("c") * num).select("uid", "c", "m")
    placed = materialize(shared.join(kept, "uid"), "placed")
    rank = F.row_number().over(W.partitionBy("uid").orderBy("n", "g"))
    prefix = placed.withColumn("r", rank).where(F.col("r") <= F.col("c") - F.ceil(F.col("c") * num / den) + 1 - (F.col("c") - F.col("m"))).select("uid", "c", "g")
    met = pairs_within(prefix, ["g"], "uid", extra=["c"])
    met = met.where(F.least("left_c", "right_c") * den >= F.greatest("left_c", "right_c") * num).select("left_uid", "right_uid").distinct()
    sets = placed.groupBy("uid").agg(F.collect_set("g").alias("s"), F.first("c").alias("c"))
    side = lambda s: sets.select(*[F.col(c).alias(f"{s}_{c}") for c in ("uid", "s", "c")])
    both = met.join(side("left"), "left_uid").join(side("right"), "right_uid").withColumn("intersection_count", F.size(F.array_intersect("left_s", "right_s")).cast("long"))
    both = both.withColumn("union_count", F.col("left_c") + F.col("right_c") - F.col("intersection_count"))
    return both.where(F.col("intersection_count") * den >= F.col("union_count") * num).select("left_uid", "right_uid", "intersection_count", F.col("union_count").cast("long"))


def clusters(nodes: DataFrame, uid: str, edges: DataFrame, left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """``uid, cluster``: connected components, isolated nodes kept, named by their least member.

    Edges are rewritten by large-star and small-star, so rounds follow the logarithm of the largest component, a long chain's too. Each
    round is written to the shared folder. Edges to unknown nodes and null ends tie nothing.
    """
    ends = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).select(F.col(left).alias("a"), F.col(right).alias("b")).distinct()
    known = materialize(nodes.where(F.col(uid).isNotNull()).select(F.col(uid).alias("u")).distinct(), "nodes")
    both = ends
    for end in ("a", "b"):  # an end may hold a third of all edges: they find it by lookup
        degree = both.groupBy(end).agg(F.count("*").alias("n")).join(known.withColumnRenamed("u", end), end, "left_semi")
        both = materialize(semi_join(both, degree, [end], "n", both.count()), "edges")
    group = star_components(both, "a", "b", max_rounds).withColumnsRenamed({"node": "u", "group": "l"})
    return known.join(group, "u", "left").select(F.col("u").alias(uid), F.coalesce("l", "u").alias("cluster"))


def split_overlap(df: DataFrame, split: str, key: str) -> DataFrame:
    """For each pair of splits, how many distinct keys both hold; null keys and splits don't count."""
    held = df.where(F.col(key).isNotNull() & F.col(split).isNotNull()).select(split, key).distinct()
    sets = held.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    n = F.size("s")
    pairs = sets.select("s", F.explode(F.sequence(F.lit(0), n - 2)).alias("i")).select("s", "i", F.explode(F.sequence(F.col("i") + 1, n - 1)).alias("j"))
    return pairs.groupBy(F.get("s", F.col("i")).alias("left_split"), F.get("s", F.col("j")).alias("right_split")).agg(F.count("*").alias("shared"))


def conflicts(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys with more than one distinct non-null value in any of the columns, with the numbers of values."""
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.countDistinct(v).alias(f"{v}_values") for v in values])
    return out.where(" or ".join(f"{v}_values > 1" for v in values))
