"""Set and multiset scoring of predicted against gold records.

Records are rows; the key of a record is any list of columns, nulls being values like others. Malformed
predictions keep their rows and can't match, so they count as false positives. Zero denominators give 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Adds micro ``precision``, ``recall`` and ``f1``; 0 where a denominator is 0."""
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return df.withColumns({"precision": _ratio(t.cast("double"), t + p), "recall": _ratio(t.cast("double"), t + n), "f1": _ratio(2.0 * t, 2 * t + p + n)})


def counts_by_flags(df: DataFrame, by: list[str | Column], pred: Column, gold: Column) -> DataFrame:
    """tp, fp, fn where one row is one record that may be predicted, gold or both; one pass, no join. Null flags are false."""
    p, g = F.coalesce(pred, F.lit(False)), F.coalesce(gold, F.lit(False))
    return df.groupBy(*by).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))


def aligned(pred: DataFrame, gold: DataFrame, key: list[str], valid: str | None = None) -> DataFrame:
    """One row per key with its multiplicities ``p`` and ``g``; one shuffle, no join.

    Both sides are stacked and grouped, which is a full outer join on a key that may be null.
    Invalid predictions (``valid`` false or null) come out with ``ok`` false.
    """
    ok = F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(True)
    a = pred.select(*key, ok.alias("ok"), F.lit(1).alias("p"), F.lit(0).alias("g"))
    b = gold.select(*key, F.lit(True).alias("ok"), F.lit(0).alias("p"), F.lit(1).alias("g"))
    return a.unionByName(b).groupBy(*key, "ok").agg(F.sum("p").alias("p"), F.sum("g").alias("g"))


def set_counts(pred: DataFrame, gold: DataFrame, key: list[str], by: list[str], valid: str | None = None) -> DataFrame:
    """Set semantics: distinct keys; tp, fp, fn by the columns ``by``, which must be among the key's."""
    m = aligned(pred, gold, key, valid)
    p, g = F.col("ok") & (F.col("p") > 0), F.col("ok") & (F.col("g") > 0)
    return m.groupBy(*by).agg(F.count_if(p & g).alias("tp"), F.count_if((F.col("p") > 0) & ~(p & g)).alias("fp"), F.count_if(g & ~p).alias("fn"))


def multiset_counts(pred: DataFrame, gold: DataFrame, key: list[str], by: list[str], valid: str | None = None) -> DataFrame:
    """Multiset semantics: sum of min(p, g) per key; also the totals and whether they are conserved."""
    m = aligned(pred, gold, key, valid)
    hit = F.when(F.col("ok"), F.least("p", "g")).otherwise(F.lit(0))
    out = m.groupBy(*by).agg(F.sum(hit).alias("tp"), F.sum(F.col("p") - hit).alias("fp"), F.sum(F.col("g") - hit).alias("fn"), F.sum("p").alias("prediction_count"), F.sum("g").alias("gold_count"))
    return out.withColumn("conserved", (F.col("tp") + F.col("fp") == F.col("prediction_count")) & (F.col("tp") + F.col("fn") == F.col("gold_count")))


def pooled(counts: DataFrame, by: list[str], tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Sums of counts over all that isn't in ``by``: seeds and repeats within a cluster, clusters within a system."""
    return counts.groupBy(*by).agg(F.sum(tp).alias(tp), F.sum(fp).alias(fp), F.sum(fn).alias(fn))


def edit_confusion(old: DataFrame, new: DataFrame, gold: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Correct and wrong additions and deletions between two record sets, against gold; one shuffle."""
    flag = lambda df, o, n, g: df.select(*key, F.lit(o).alias("o"), F.lit(n).alias("n"), F.lit(g).alias("g"))
    k = flag(old, 1, 0, 0).unionByName(flag(new, 0, 1, 0)).unionByName(flag(gold, 0, 0, 1)).groupBy(*key).agg(F.max("o").alias("o"), F.max("n").alias("n"), F.max("g").alias("g"))
    is_ = lambda o, n, g: F.count_if((F.col("o") == o) & (F.col("n") == n) & (F.col("g") == g))
    return k.groupBy(*by).agg(is_(0, 1, 1).alias("correct_added"), is_(0, 1, 0).alias("wrong_added"), is_(1, 0, 1).alias("correct_deleted"), is_(1, 0, 0).alias("wrong_deleted"))


def pooled_sets(counts: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Counts pooled over several grouping sets in one pass; a column outside a set is null there, and ``level`` tells the sets apart."""
    out = counts.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return out.agg(F.grouping_id().cast("long").alias("level"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def sweep_counts(df: DataFrame, by: list[str], score: Column, thresholds: list[float], gold: Column) -> DataFrame:
    """tp, fp, fn at every threshold (predicted where ``score >= t``) in one pass over the rows.

    Rows are aggregated by the highest threshold they reach, at most one row per group and threshold; running sums
    from the top down give the counts. Null scores are below every threshold.
    """
    ts = sorted(thresholds)
    reached = F.lit(0)
    for i, t in enumerate(ts):
        reached = F.when(score >= F.lit(t), F.lit(i + 1)).otherwise(reached)
    reached = F.coalesce(reached, F.lit(0))
    cells = df.groupBy(*by, reached.alias("_r")).agg(F.count_if(gold).alias("g"), F.count_if(~F.coalesce(gold, F.lit(False))).alias("w"))
    grid = cells.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate(ts)])))
    hit = F.col("_r") >= F.col("_t.i")
    return grid.groupBy(*by, F.col("_t.t").alias("threshold")).agg(F.sum(F.when(hit, F.col("g")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("w")).otherwise(0)).alias("fp"), F.sum(F.when(hit, F.lit(0)).otherwise(F.col("g"))).alias("fn"))


def root_graphs(edges: DataFrame, root: list[str], tail: list[str], graph: str = "graph") -> DataFrame:
    """One row per root with its set of tails, sorted: two roots are equal graphs if the sets are equal."""
    return edges.groupBy(*root).agg(F.array_sort(F.collect_set(F.struct(*tail))).alias(graph))


def reversed_closure(edges: DataFrame, head: str, tail: str, keep: list[str]) -> DataFrame:
    """Edges with their reversals, distinct."""
    back = edges.select(*keep, F.col(tail).alias(head), F.col(head).alias(tail))
    return edges.select(*keep, head, tail).unionByName(back).distinct()


def symmetry_ceiling(gold: DataFrame, head: str, tail: str, label: list[str]) -> DataFrame:
    """Best counts a direction-blind predictor can reach on distinct directed edges.

    It must take an unordered pair whole or not at all. A pair whose reverse is missing from gold brings one hit and one
    false positive; taking all pairs is optimal for F1 as 2tp/(2tp+fp+fn) only grows by it. Self-loops bring a hit only.
    """
    e = gold.select(*label, head, tail).distinct()
    pair = e.groupBy(*label, F.least(head, tail).alias("lo"), F.greatest(head, tail).alias("hi")).agg(F.count("*").alias("n"))
    one_way = (F.col("n") == 1) & (F.col("lo") != F.col("hi"))
    return pair.agg(F.sum("n").alias("tp"), F.count_if(one_way).alias("fp"), F.lit(0).cast("long").alias("fn"), F.count_if(one_way).alias("missing_reverse"))


def conditional_binding(pred: DataFrame, gold: DataFrame, core: list[str], rest: list[str]) -> DataFrame:
    """Of the distinct predictions whose core is right, how many bind the rest right as well."""
    p, g = pred.select(*core, *rest).distinct(), gold.select(*core, *rest).distinct()
    right = p.join(g.select(*core).distinct(), core, "left_semi").withColumn("_p", F.lit(1)).select(*core, *rest, "_p", F.lit(0).alias("_g"))
    marked = right.unionByName(g.select(*core, *rest, F.lit(0).alias("_p"), F.lit(1).alias("_g"))).groupBy(*core, *rest).agg(F.max("_p").alias("p"), F.max("_g").alias("g"))
    return marked.agg(F.count_if(F.col("p") == 1).alias("core_correct"), F.count_if((F.col("p") == 1) & (F.col("g") == 1)).alias("bound"))


def with_uncovered(counts: DataFrame, gold: DataFrame, covered: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Full-document sensitivity: gold records no window covers are added to fn."""
    missed = gold.join(covered.select(*key).distinct(), key, "left_anti").groupBy(*by).agg(F.count("*").alias("_u"))
    out = counts.join(missed, by, "left").withColumn("uncovered", F.coalesce("_u", F.lit(0))).drop("_u")
    return out.withColumn("fn", F.col("fn") + F.col("uncovered"))


def oracle_ceiling(old: DataFrame, pool: DataFrame, gold: DataFrame, key: list[str], operation: str = "operation") -> DataFrame:
    """Counts of the best graph an edit pool allows: right additions and wrong deletions applied, no others."""
    flag = lambda df, n: df.select(*key, F.lit(n).alias("_f"))
    marks = flag(old, "old").unionByName(flag(gold, "gold")).unionByName(pool.select(*key, F.col(operation).alias("_f")))
    m = marks.groupBy(*key).agg(*[F.max((F.col("_f") == f).cast("int")).alias(f) for f in ("old", "gold", "add", "delete")])
    m = m.withColumn("keep", F.when(F.col("gold") == 1, F.col("old") + F.col("add") > 0).otherwise((F.col("old") == 1) & (F.col("delete") == 0)))
    return m.agg(F.count_if(F.col("keep") & (F.col("gold") == 1)).alias("tp"), F.count_if(F.col("keep") & (F.col("gold") == 0)).alias("fp"), F.count_if(~F.col("keep") & (F.col("gold") == 1)).alias("fn"))
