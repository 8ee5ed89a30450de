"""Inference queries: regions, suppliers and nations are clusters, two predictors of the same gold the arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import stats
from tessella.plans.scoring import _REGION, _with_region
from tessella.sources.tables import table

#: Draws of the hash-derived streams.
DRAWS, RESAMPLES = 4000, 2000
_ARM = {"a": "l_discount >= 0.05", "b": "l_quantity >= 30"}


def _pairs(rows: DataFrame, cluster: str) -> DataFrame:
    gold = F.col("l_returnflag") == "R"
    agg = [F.count_if(c).alias(f"{n}_{arm}") for arm, p in ((a, F.expr(e)) for a, e in _ARM.items()) for n, c in (("tp", p & gold), ("fp", p & ~gold), ("fn", ~p & gold))]
    return rows.groupBy(cluster).agg(*agg)


def _by_region(spark: SparkSession, d: str, cluster: str) -> DataFrame:
    return _pairs(_with_region(spark, d, "l_discount", "l_quantity", "l_returnflag"), cluster)


def _by_supplier(spark: SparkSession, d: str, n: int) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.pmod("l_suppkey", F.lit(n)).cast("int").alias("cluster"), "l_discount", "l_quantity", "l_returnflag")
    return _pairs(li, "cluster")


def exact_exchange_regions(spark: SparkSession, d: str) -> DataFrame:
    return stats.exchange_exact(_by_region(spark, d, "r_name"), "r_name")


def exact_exchange_suppliers10(spark: SparkSession, d: str) -> DataFrame:
    return stats.exchange_exact(_by_supplier(spark, d, 10), "cluster")


def exact_exchange_suppliers16(spark: SparkSession, d: str) -> DataFrame:
    return stats.exchange_exact(_by_supplier(spark, d, 16), "cluster")


def mc_exchange_nations(spark: SparkSession, d: str) -> DataFrame:
    p = _by_region(spark, d, "n_name")
    return stats.exchange_draws(p, "n_name", stats.hash_swaps(p, "n_name", DRAWS, "swap"), DRAWS)


def mc_exchange_nations_pcg(spark: SparkSession, d: str) -> DataFrame:
    """The same with a NumPy stream, which SQL can't draw."""
    p = _by_region(spark, d, "n_name")
    ids = [r[0] for r in p.select("n_name").orderBy("n_name").collect()]
    masks, _ = stats.numpy_masks({"clusters": ids, "seed": 1}, len(ids), 20_000)
    return stats.exchange_draws(p, "n_name", stats.swaps_table(spark, masks, ids, "n_name"), 20_000)


def bootstrap_ci_nations(spark: SparkSession, d: str) -> DataFrame:
    p = _by_region(spark, d, "n_name")
    arms = [F.struct(F.lit(a).alias("system"), *[F.col(f"{c}_{a}").alias(c) for c in ("tp", "fp", "fn")]) for a in "ab"]
    counts = p.select("n_name", F.explode(F.array(*arms)).alias("s")).select("n_name", "s.*")
    return stats.bootstrap(counts, "n_name", ["system"], stats.hash_picks(p, "n_name", RESAMPLES, "pick"))


def paired_bootstrap_nations(spark: SparkSession, d: str) -> DataFrame:
    p = _by_region(spark, d, "n_name")
    return stats.paired_bootstrap(p, "n_name", stats.hash_picks(p, "n_name", RESAMPLES, "pick"))


def holm_families(spark: SparkSession, d: str) -> DataFrame:
    """A p-like share for each ship mode of parts, adjusted within brands."""
    part = table(spark, d, "part").groupBy("p_brand", "p_size").agg((F.count_if(F.col("p_retailprice") > 1500) / F.count("*") / 20.0).alias("p"))
    return stats.holm(part, ["p_brand"], "p", "p_size")


def budget_matched_expectation(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of each flag's edits is chosen at random: how many right ones to expect."""
    li = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_linestatus") == "O").alias("hit"))
    budgets = li.groupBy("l_returnflag").agg(F.floor(F.count("*") / 10).alias("b"))
    return stats.budget_moments(li.join(F.broadcast(budgets), "l_returnflag"), ["l_returnflag"], "b", "hit").select(F.round("mean_hits", 6).alias("mean_hits"), F.round("variance_hits", 6).alias("variance_hits"), "budget")


QUERIES = {
    f.__name__: f
    for f in (exact_exchange_regions, exact_exchange_suppliers10, exact_exchange_suppliers16, mc_exchange_nations, mc_exchange_nations_pcg, bootstrap_ci_nations, paired_bootstrap_nations, holm_families, budget_matched_expectation)
}
_PAIR = """SELECT {k} AS c, count(*) FILTER (l_discount >= 0.05 AND l_returnflag = 'R')::HUGEINT ta, count(*) FILTER (l_discount >= 0.05 AND l_returnflag <> 'R')::HUGEINT pa, count(*) FILTER (l_discount < 0.05 AND l_returnflag = 'R')::HUGEINT na,
count(*) FILTER (l_quantity >= 30 AND l_returnflag = 'R')::HUGEINT tb, count(*) FILTER (l_quantity >= 30 AND l_returnflag <> 'R')::HUGEINT pb, count(*) FILTER (l_quantity < 30 AND l_returnflag = 'R')::HUGEINT nb FROM {t} GROUP BY 1"""
_EXACT = """WITH p AS ({pair}), i AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i FROM p), m AS (SELECT unnest(range(1 << (SELECT count(*) FROM p)::INT)) AS m),
s AS (SELECT m, sum(CASE WHEN (m >> i) & 1 = 1 THEN tb ELSE ta END) x, sum(CASE WHEN (m >> i) & 1 = 1 THEN 2 * tb + pb + nb ELSE 2 * ta + pa + na END) dx,
sum(CASE WHEN (m >> i) & 1 = 1 THEN ta ELSE tb END) y, sum(CASE WHEN (m >> i) & 1 = 1 THEN 2 * ta + pa + na ELSE 2 * tb + pb + nb END) dy FROM m, i GROUP BY m),
q AS (SELECT m, abs(2 * x * dy - 2 * y * dx) n, dx * dy d FROM s), o AS (SELECT n n0, d d0 FROM q WHERE m = 0)
SELECT CAST((SELECT count(*) FROM p) AS BIGINT) clusters, CAST(count(*) AS BIGINT) assignments, CAST(count(*) FILTER (n * d0 >= n0 * d) AS BIGINT) hits, count(*) FILTER (n * d0 >= n0 * d) / CAST(count(*) AS DOUBLE) p FROM q, o"""
_PICKS = """n AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i FROM p), z AS (SELECT count(*) k FROM p),
k AS (SELECT draw, n.c FROM (SELECT draw, unnest(range((SELECT k FROM z)::BIGINT)) slot FROM (SELECT unnest(range({r})) draw)) x JOIN n ON n.i = CAST('0x' || substr(sha256('pick|' || draw || '|' || slot), 1, 8) AS BIGINT) % (SELECT k FROM z))"""
SQL = {
    "exact_exchange_regions": _EXACT.format(pair=_PAIR.format(k="r_name", t=_REGION)),
    "exact_exchange_suppliers10": _EXACT.format(pair=_PAIR.format(k="l_suppkey % 10", t="lineitem")),
    "exact_exchange_suppliers16": _EXACT.format(pair=_PAIR.format(k="l_suppkey % 16", t="lineitem")),
    "mc_exchange_nations": f"""WITH p AS ({_PAIR.format(k="n_name", t=_REGION)}), m AS (SELECT unnest(range({DRAWS})) AS m),
x AS (SELECT m, p.*, CAST('0x' || substr(sha256('swap|' || m || '|' || c), 64, 1) AS INT) % 2 = 1 w FROM m, p),
s AS (SELECT m, sum(CASE WHEN w THEN tb ELSE ta END) x, sum(CASE WHEN w THEN 2 * tb + pb + nb ELSE 2 * ta + pa + na END) dx, sum(CASE WHEN w THEN ta ELSE tb END) y, sum(CASE WHEN w THEN 2 * ta + pa + na ELSE 2 * tb + pb + nb END) dy FROM x GROUP BY m),
o AS (SELECT abs(2 * sum(ta) * sum(2 * tb + pb + nb) - 2 * sum(tb) * sum(2 * ta + pa + na)) n0, sum(2 * ta + pa + na) * sum(2 * tb + pb + nb) d0, count(*) k FROM p)
SELECT CAST(max(k) AS BIGINT) clusters, CAST({DRAWS} AS BIGINT) draws, CAST(count(*) FILTER (abs(2 * x * dy - 2 * y * dx) * d0 >= n0 * (dx * dy)) AS BIGINT) hits, (count(*) FILTER (abs(2 * x * dy - 2 * y * dx) * d0 >= n0 * (dx * dy)) + 1) / CAST({DRAWS + 1} AS DOUBLE) p FROM s, o""",
    "bootstrap_ci_nations": f"""WITH p AS ({_PAIR.format(k="n_name", t=_REGION)}), {_PICKS.format(r=RESAMPLES)},
f AS (SELECT draw, 2 * sum(ta) / sum(2 * ta + pa + na)::DOUBLE a, 2 * sum(tb) / sum(2 * tb + pb + nb)::DOUBLE b FROM k JOIN p USING (c) GROUP BY draw)
SELECT 'a' AS system, quantile_cont(a, 0.025) AS lower, quantile_cont(a, 0.975) AS upper, CAST(count(*) AS BIGINT) draws FROM f UNION ALL SELECT 'b', quantile_cont(b, 0.025), quantile_cont(b, 0.975), CAST(count(*) AS BIGINT) FROM f""",
    "paired_bootstrap_nations": f"""WITH p AS ({_PAIR.format(k="n_name", t=_REGION)}), {_PICKS.format(r=RESAMPLES)},
f AS (SELECT draw, 2 * sum(ta) / sum(2 * ta + pa + na)::DOUBLE - 2 * sum(tb) / sum(2 * tb + pb + nb)::DOUBLE x FROM k JOIN p USING (c) GROUP BY draw)
SELECT quantile_cont(x, 0.025) AS lower, quantile_cont(x, 0.975) AS upper, CAST(count(*) AS BIGINT) draws FROM f""",
    "holm_families": """WITH t AS (SELECT p_brand, p_size, count(*) FILTER (p_retailprice > 1500) / CAST(count(*) AS DOUBLE) / 20.0 AS p FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_size) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS m FROM t),
h AS (SELECT p_brand, p_size, p, least(max((m - k) * p) OVER (PARTITION BY p_brand ORDER BY p, p_size ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE) AS holm FROM r) SELECT *, holm <= 0.05 AS rejected FROM h""",
    "budget_matched_expectation": """WITH s AS (SELECT l_returnflag, count(*)::DOUBLE n, count(*) FILTER (l_linestatus = 'O')::DOUBLE k, floor(count(*) / 10.0) b FROM lineitem GROUP BY 1)
SELECT round(sum(b * k / n), 6) mean_hits, round(sum(b * k / n * (1 - k / n) * (n - b) / (n - 1)), 6) variance_hits, CAST(sum(b) AS BIGINT) budget FROM s""",
}
