"""Scoring queries: a line item is a record, predicted or gold by its own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import score
from tessella.sources.tables import table


def _pred() -> Column:
    return F.col("l_discount") >= 0.05


def _gold() -> Column:
    return F.col("l_returnflag") == "R"


def _with_region(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Line items with the nation and region of their customer; each side is pruned to what is used."""
    li = table(spark, d, "lineitem").select("l_orderkey", *cols)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    place = c.join(n, "n_nationkey").join(r, "r_regionkey")
    return li.join(o, "l_orderkey").join(place, "o_custkey")


def micro_prf_by_region(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_region(spark, d, "l_discount", "l_returnflag")
    c = rows.groupBy("r_name").agg(F.count_if(_pred() & _gold()).alias("tp"), F.count_if(_pred() & ~_gold()).alias("fp"), F.count_if(~_pred() & _gold()).alias("fn"))
    return score.prf(c)


_REGION = """lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""
_PRF = """CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision,
CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall,
CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END AS f1"""

QUERIES = {"micro_prf_by_region": micro_prf_by_region}
SQL = {
    "micro_prf_by_region": f"""WITH c AS (SELECT r_name, CAST(count(*) FILTER (l_discount >= 0.05 AND l_returnflag = 'R') AS BIGINT) AS tp,
CAST(count(*) FILTER (l_discount >= 0.05 AND l_returnflag <> 'R') AS BIGINT) AS fp, CAST(count(*) FILTER (l_discount < 0.05 AND l_returnflag = 'R') AS BIGINT) AS fn
FROM {_REGION} GROUP BY r_name) SELECT r_name, tp, fp, fn, {_PRF} FROM c""",
}

THRESHOLDS = (0.03, 0.05, 0.07)


def _li(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def prf_rollup_seed_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Three thresholds stand for seeds: per seed and cluster, per cluster, per seed, and in all."""
    li = _li(spark, d).withColumn("cluster", F.pmod("l_suppkey", F.lit(20)).cast("int"))
    c = score.sweep_counts(li, ["cluster"], F.col("l_discount"), list(THRESHOLDS), _gold()).withColumnRenamed("threshold", "seed")
    return score.prf(score.pooled_sets(c, [["seed", "cluster"], ["cluster"], ["seed"], []], ["seed", "cluster"]))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    li = _li(spark, d)
    return score.prf(score.sweep_counts(li, ["l_linestatus"], F.col("l_quantity"), [5.0, 10.0, 20.0, 30.0, 40.0, 50.0], _gold()))


def set_prf_by_label(spark: SparkSession, d: str) -> DataFrame:
    li = _li(spark, d).select("l_partkey", "l_suppkey", "l_returnflag", "l_discount", "l_linestatus")
    return score.prf(score.set_counts(li.where(_pred()), li.where("l_linestatus = 'O'"), ["l_partkey", "l_suppkey", "l_returnflag"], ["l_returnflag"]))


def multiset_prf_by_label(spark: SparkSession, d: str) -> DataFrame:
    li = _li(spark, d).select("l_partkey", "l_returnflag", "l_discount", "l_linestatus")
    return score.multiset_counts(li.where(_pred()), li.where("l_linestatus = 'O'"), ["l_partkey", "l_returnflag"], ["l_returnflag"])


def invalid_predictions_count(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with a quantity over 45 count as malformed: false positives, never hits."""
    li = _li(spark, d).select("l_partkey", "l_suppkey", "l_returnflag", "l_discount", "l_linestatus", (F.col("l_quantity") <= 45).alias("valid"))
    return score.multiset_counts(li.where(_pred()), li.where("l_linestatus = 'O'"), ["l_partkey", "l_returnflag"], ["l_returnflag"], valid="valid")


def edit_confusion(spark: SparkSession, d: str) -> DataFrame:
    li = _li(spark, d).select("l_partkey", "l_suppkey", "l_returnflag", "l_discount", "l_linestatus", "l_quantity")
    return score.edit_confusion(li.where("l_discount >= 0.05"), li.where("l_discount >= 0.05 and l_quantity > 10 or l_quantity > 48"), li.where("l_linestatus = 'O'"), ["l_partkey", "l_suppkey", "l_returnflag"], ["l_returnflag"])


def root_graph_exact(spark: SparkSession, d: str) -> DataFrame:
    """An order is a root, its set of parts and flags its graph; predicted and gold graphs must be equal as sets."""
    li = _li(spark, d).select("l_orderkey", "l_partkey", "l_returnflag", "l_discount", "l_quantity")
    p = score.root_graphs(li.where("l_quantity > 5"), ["l_orderkey"], ["l_partkey", "l_returnflag"])
    g = score.root_graphs(li.where("l_discount > 0.01"), ["l_orderkey"], ["l_partkey", "l_returnflag"])
    return score.prf(score.set_counts(p, g, ["l_orderkey", "graph"], []))


def _user_edges(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    w = W.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return e.select("event_type", F.col("user_id").alias("head"), F.lead("user_id").over(w).alias("tail")).where("tail is not null").distinct()


def symmetric_closure(spark: SparkSession, d: str) -> DataFrame:
    c = score.reversed_closure(_user_edges(spark, d), "head", "tail", ["event_type"])
    return c.groupBy("event_type").agg(F.count("*").alias("edges"))


def symmetric_closure_ceiling(spark: SparkSession, d: str) -> DataFrame:
    return score.prf(score.symmetry_ceiling(_user_edges(spark, d), "head", "tail", ["event_type"]))


def core_projection(spark: SparkSession, d: str) -> DataFrame:
    """Records scored on their core only, the supplier dropped."""
    li = _li(spark, d)
    return score.prf(score.set_counts(li.where(_pred()), li.where("l_linestatus = 'O'"), ["l_partkey", "l_returnflag"], []))


def conditional_binding(spark: SparkSession, d: str) -> DataFrame:
    li = _li(spark, d)
    return score.conditional_binding(li.where(_pred()), li.where("l_linestatus = 'O'"), ["l_partkey", "l_returnflag"], ["l_suppkey"])


def full_document_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Gold line items of orders that no predicted window (orders of high priority) covers are added to fn."""
    li, o = _li(spark, d).select("l_orderkey", "l_returnflag", "l_discount"), table(spark, d, "orders")
    counts = score.counts_by_flags(li, ["l_returnflag"], F.col("l_discount") >= 0.05, F.col("l_discount") >= 0.03)
    covered = o.where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    return score.with_uncovered(counts, li.where("l_discount >= 0.03"), covered, ["l_orderkey"], ["l_returnflag"])


def oracle_edit_ceiling(spark: SparkSession, d: str) -> DataFrame:
    li = _li(spark, d).select("l_partkey", "l_suppkey", "l_discount", "l_linestatus", "l_quantity")
    pool = li.where("l_quantity > 45").withColumn("operation", F.lit("add")).unionByName(li.where("l_quantity < 5").withColumn("operation", F.lit("delete")))
    return score.prf(score.oracle_ceiling(li.where(_pred()), pool, li.where("l_linestatus = 'O'"), ["l_partkey", "l_suppkey"]))


def label_conservation(spark: SparkSession, d: str) -> DataFrame:
    """Label slices against the family's total; nothing comes out where they agree."""
    from pyspark.sql import functions as F

    li = _li(spark, d)
    by = score.counts_by_flags(li, ["l_linestatus", "l_returnflag"], _pred(), _gold())
    all_ = score.counts_by_flags(li, ["l_linestatus"], _pred(), _gold())
    part = score.pooled(by, ["l_linestatus"])
    return part.exceptAll(all_).unionByName(all_.exceptAll(part)).select("l_linestatus", "tp", "fp", "fn")


def gold_support_invariant(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with their gold support at each seed; ``variants`` must be 1."""
    li = _li(spark, d).withColumn("cluster", F.pmod("l_suppkey", F.lit(20)).cast("int"))
    c = score.sweep_counts(li, ["cluster"], F.col("l_discount"), list(THRESHOLDS), _gold())
    return c.groupBy("cluster").agg(F.countDistinct(F.col("tp") + F.col("fn")).alias("variants"), F.min(F.col("tp") + F.col("fn")).alias("support"))


_GOLD = "l_linestatus = 'O'"
_SETS = """p AS (SELECT DISTINCT {k} FROM lineitem WHERE {pred}), g AS (SELECT DISTINCT {k} FROM lineitem WHERE {gold}),
m AS (SELECT {k}, max(a) a, max(b) b FROM (SELECT {k}, 1 a, 0 b FROM p UNION ALL SELECT {k}, 0, 1 FROM g) GROUP BY {k})"""
_TPFPFN = "CAST(count(*) FILTER (a = 1 AND b = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (a = 1 AND b = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (a = 0 AND b = 1) AS BIGINT) AS fn"
_SWEEP = "SELECT t AS {name}, {by}, CAST(count(*) FILTER ({score} >= t AND l_returnflag = 'R') AS BIGINT) tp, CAST(count(*) FILTER ({score} >= t AND l_returnflag <> 'R') AS BIGINT) fp, CAST(count(*) FILTER ({score} < t AND l_returnflag = 'R') AS BIGINT) fn FROM lineitem, (SELECT unnest({ts}) AS t) GROUP BY ALL"
_MULTI = """k AS (SELECT l_partkey, l_returnflag, ok, sum(p) p, sum(g) g FROM (
SELECT l_partkey, l_returnflag, {ok} ok, 1 p, 0 g FROM lineitem WHERE l_discount >= 0.05 UNION ALL SELECT l_partkey, l_returnflag, true, 0, 1 FROM lineitem WHERE l_linestatus = 'O') GROUP BY ALL),
s AS (SELECT l_returnflag, CAST(sum(CASE WHEN ok THEN least(p, g) ELSE 0 END) AS BIGINT) tp, CAST(sum(p) AS BIGINT) prediction_count, CAST(sum(g) AS BIGINT) gold_count FROM k GROUP BY 1)
SELECT l_returnflag, tp, prediction_count - tp AS fp, gold_count - tp AS fn, prediction_count, gold_count, true AS conserved FROM s"""
_EDGES = "e AS (SELECT DISTINCT event_type, head, tail FROM (SELECT event_type, user_id AS head, lead(user_id) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS tail FROM events) WHERE tail IS NOT NULL)"

QUERIES |= {
    f.__name__: f
    for f in (
        prf_rollup_seed_cluster, threshold_sweep, set_prf_by_label, multiset_prf_by_label, invalid_predictions_count, edit_confusion, root_graph_exact, symmetric_closure,
        symmetric_closure_ceiling, core_projection, conditional_binding, full_document_sensitivity, oracle_edit_ceiling, label_conservation, gold_support_invariant,
    )
}
SQL |= {
    "prf_rollup_seed_cluster": f"""WITH c AS ({_SWEEP.format(name="seed", by="CAST(l_suppkey % 20 AS INT) AS cluster", score="l_discount", ts="[0.03::DOUBLE, 0.05, 0.07]")}),
r AS (SELECT seed, cluster, CAST(grouping(seed, cluster) AS BIGINT) AS level, CAST(sum(tp) AS BIGINT) tp, CAST(sum(fp) AS BIGINT) fp, CAST(sum(fn) AS BIGINT) fn FROM c GROUP BY GROUPING SETS ((seed, cluster), (cluster), (seed), ()))
SELECT seed, cluster, level, tp, fp, fn, {_PRF} FROM r""",
    "threshold_sweep": f"""WITH c AS ({_SWEEP.format(name="threshold", by="l_linestatus", score="l_quantity", ts="[5.0::DOUBLE, 10, 20, 30, 40, 50]")}) SELECT threshold, l_linestatus, tp, fp, fn, {_PRF} FROM c""",
    "set_prf_by_label": f"WITH {_SETS.format(k='l_partkey, l_suppkey, l_returnflag', pred='l_discount >= 0.05', gold=_GOLD)}, c AS (SELECT l_returnflag, {_TPFPFN} FROM m GROUP BY 1) SELECT l_returnflag, tp, fp, fn, {_PRF} FROM c",
    "multiset_prf_by_label": f"WITH {_MULTI.format(ok='true')}",
    "invalid_predictions_count": f"WITH {_MULTI.format(ok='l_quantity <= 45')}",
    "edit_confusion": """WITH m AS (SELECT l_partkey, l_suppkey, l_returnflag, bool_or(l_discount >= 0.05) o, bool_or(l_discount >= 0.05 AND l_quantity > 10 OR l_quantity > 48) n, bool_or(l_linestatus = 'O') g FROM lineitem GROUP BY ALL)
SELECT l_returnflag, CAST(count(*) FILTER (NOT o AND n AND g) AS BIGINT) correct_added, CAST(count(*) FILTER (NOT o AND n AND NOT g) AS BIGINT) wrong_added,
CAST(count(*) FILTER (o AND NOT n AND g) AS BIGINT) correct_deleted, CAST(count(*) FILTER (o AND NOT n AND NOT g) AS BIGINT) wrong_deleted FROM m WHERE o OR n OR g GROUP BY 1""",
    "root_graph_exact": f"""WITH p AS (SELECT l_orderkey, list_sort(list(DISTINCT (l_partkey, l_returnflag))) graph FROM lineitem WHERE l_quantity > 5 GROUP BY 1),
g AS (SELECT l_orderkey, list_sort(list(DISTINCT (l_partkey, l_returnflag))) graph FROM lineitem WHERE l_discount > 0.01 GROUP BY 1),
m AS (SELECT p.graph IS NOT NULL AND g.graph IS NOT NULL AND p.graph = g.graph hit, p.graph IS NOT NULL a, g.graph IS NOT NULL b FROM p FULL JOIN g USING (l_orderkey)),
c AS (SELECT CAST(count(*) FILTER (hit) AS BIGINT) tp, CAST(count(*) FILTER (a AND NOT hit) AS BIGINT) fp, CAST(count(*) FILTER (b AND NOT hit) AS BIGINT) fn FROM m) SELECT tp, fp, fn, {_PRF} FROM c""",
    "symmetric_closure": f"WITH {_EDGES} SELECT event_type, CAST(count(*) AS BIGINT) AS edges FROM (SELECT event_type, head, tail FROM e UNION SELECT event_type, tail, head FROM e) GROUP BY 1",
    "symmetric_closure_ceiling": f"""WITH {_EDGES}, x AS (SELECT e.*, EXISTS (SELECT 1 FROM e f WHERE f.event_type = e.event_type AND f.head = e.tail AND f.tail = e.head) back FROM e),
c AS (SELECT CAST(count(*) AS BIGINT) tp, CAST(count(*) FILTER (NOT back) AS BIGINT) fp, CAST(0 AS BIGINT) fn, CAST(count(*) FILTER (NOT back) AS BIGINT) missing_reverse FROM x) SELECT tp, fp, fn, missing_reverse, {_PRF} FROM c""",
    "core_projection": f"WITH {_SETS.format(k='l_partkey, l_returnflag', pred='l_discount >= 0.05', gold=_GOLD)}, c AS (SELECT {_TPFPFN} FROM m) SELECT tp, fp, fn, {_PRF} FROM c",
    "conditional_binding": """WITH p AS (SELECT DISTINCT l_partkey, l_returnflag, l_suppkey FROM lineitem WHERE l_discount >= 0.05), g AS (SELECT DISTINCT l_partkey, l_returnflag, l_suppkey FROM lineitem WHERE l_linestatus = 'O')
SELECT CAST(count(*) AS BIGINT) core_correct, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM g WHERE g.l_partkey = p.l_partkey AND g.l_returnflag = p.l_returnflag AND g.l_suppkey = p.l_suppkey)) AS BIGINT) bound
FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.l_partkey = p.l_partkey AND g.l_returnflag = p.l_returnflag)""",
    "full_document_sensitivity": """WITH u AS (SELECT l_returnflag, count(*) n FROM lineitem WHERE l_discount >= 0.03 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY 1),
c AS (SELECT l_returnflag, count(*) FILTER (l_discount >= 0.05) tp, count(*) FILTER (l_discount >= 0.03 AND l_discount < 0.05) fn FROM lineitem GROUP BY 1)
SELECT l_returnflag, CAST(tp AS BIGINT) tp, CAST(0 AS BIGINT) fp, CAST(fn + coalesce(n, 0) AS BIGINT) fn, CAST(coalesce(n, 0) AS BIGINT) uncovered FROM c LEFT JOIN u USING (l_returnflag)""",
    "oracle_edit_ceiling": f"""WITH m AS (SELECT l_partkey, l_suppkey, bool_or(l_discount >= 0.05) o, bool_or(l_linestatus = 'O') g, bool_or(l_quantity > 45) a, bool_or(l_quantity < 5) d FROM lineitem GROUP BY ALL),
k AS (SELECT g, CASE WHEN g THEN o OR a ELSE o AND NOT d END keep FROM m), c AS (SELECT CAST(count(*) FILTER (keep AND g) AS BIGINT) tp, CAST(count(*) FILTER (keep AND NOT g) AS BIGINT) fp, CAST(count(*) FILTER (NOT keep AND g) AS BIGINT) fn FROM k)
SELECT tp, fp, fn, {_PRF} FROM c""",
    "label_conservation": """WITH c AS (SELECT l_linestatus, l_returnflag, count(*) FILTER (l_discount >= 0.05 AND l_returnflag = 'R') tp, count(*) FILTER (l_discount >= 0.05 AND l_returnflag <> 'R') fp, count(*) FILTER (l_discount < 0.05 AND l_returnflag = 'R') fn FROM lineitem GROUP BY ALL),
s AS (SELECT l_linestatus, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM c GROUP BY 1), t AS (SELECT l_linestatus, count(*) FILTER (l_discount >= 0.05 AND l_returnflag = 'R') tp, count(*) FILTER (l_discount >= 0.05 AND l_returnflag <> 'R') fp, count(*) FILTER (l_discount < 0.05 AND l_returnflag = 'R') fn FROM lineitem GROUP BY 1)
SELECT l_linestatus, CAST(tp AS BIGINT) tp, CAST(fp AS BIGINT) fp, CAST(fn AS BIGINT) fn FROM ((SELECT * FROM s EXCEPT ALL SELECT * FROM t) UNION ALL (SELECT * FROM t EXCEPT ALL SELECT * FROM s))""",
    "gold_support_invariant": f"""WITH c AS ({_SWEEP.format(name="seed", by="CAST(l_suppkey % 20 AS INT) AS cluster", score="l_discount", ts="[0.03::DOUBLE, 0.05, 0.07]")}) SELECT cluster, CAST(count(DISTINCT tp + fn) AS BIGINT) variants, min(tp + fn) support FROM c GROUP BY 1""",
}
