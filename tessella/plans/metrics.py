"""Queries on populations, histograms, usage, unions, grids, supervision, coverage and whole-document scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import candidates, edits, graph, records, score, select, stats
from tessella.plans.native import _records, _sides
from tessella.plans.scoring import _PRF
from tessella.sources.tables import table


def _li(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def subset_populations(spark: SparkSession, d: str) -> DataFrame:
    """One pass over four populations: small and large quantities, those of status O, and all."""
    q = F.col("l_quantity")
    member = F.array(F.lit("all"), F.when(q < 20, "small"), F.when(q >= 20, "large"), F.when(F.col("l_linestatus") == "O", "open"))
    li = _li(spark, d).withColumn("population", F.explode(F.filter(member, lambda x: x.isNotNull())))
    return score.prf(score.counts_by_flags(li, ["population"], F.col("l_discount") >= 0.05, F.col("l_returnflag") == "R"))


def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


def usage_by_stage(spark: SparkSession, d: str) -> DataFrame:
    """Event types are stages: calls, failures (no value) and spent amounts in hundredths."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("value").isNull()).alias("failed"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("spent"), F.countDistinct("user_id").alias("clients"))


def mean_over_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Hits of ten hash-drawn choices of a tenth of the lines each, their mean and population variance, by flag."""
    li = _li(spark, d).groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.max((F.col("l_linestatus") == "O").cast("int")).alias("hit"))
    seeds = li.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(9)))).where(stats.hash_index(10, F.col("seed"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag")) == 0)
    per = seeds.groupBy("l_returnflag", "seed").agg(F.sum("hit").alias("hits"))
    return per.groupBy("l_returnflag").agg(F.sum("hits").alias("total"), F.round(F.avg("hits"), 9).alias("mean"), F.round(F.var_pop("hits"), 6).alias("variance"), F.expr("percentile(hits, 0.5)").alias("median"))


def union_of_windows(spark: SparkSession, d: str) -> DataFrame:
    """Orders' windows are their lines: of a part met in several the last window's flag stays."""
    return _li(spark, d).groupBy("l_orderkey", "l_partkey").agg(F.max_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("flag"))


def multiset_intersection(spark: SparkSession, d: str) -> DataFrame:
    li = _li(spark, d)
    a, b = li.where("l_discount >= 0.05").select("l_partkey", "l_returnflag"), li.where("l_quantity > 20").select("l_partkey", "l_returnflag")
    return a.intersectAll(b).groupBy("l_returnflag").agg(F.count("*").alias("common"))


def set_difference(spark: SparkSession, d: str) -> DataFrame:
    li = _li(spark, d)
    a, b = li.where("l_discount >= 0.05").select("l_partkey", "l_suppkey"), li.where("l_quantity > 20").select("l_partkey", "l_suppkey")
    side = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "first only")).unionByName(side(b.subtract(a), "second only"))


def optional_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the order priority their orders agree on: known, missing or conflicting."""
    m = table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("k"), F.min("o_orderpriority").alias("v"))
    j = table(spark, d, "customer").join(m, F.col("c_custkey") == F.col("o_custkey"), "left")
    state = F.when(F.col("k").isNull() | (F.col("k") == 0), "missing").when(F.col("k") > 1, "conflicting").otherwise(F.col("v"))
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def two_endpoint_selection(spark: SparkSession, d: str) -> DataFrame:
    """Two thresholds over months: the setting with the best mean F1 of two endpoints, by line status."""
    li = _li(spark, d).withColumn("epoch", F.month("l_shipdate"))
    one = lambda col, gold, s: score.sweep_counts(li, ["l_linestatus", "epoch"], F.col(col), [10.0, 25.0, 40.0] if s == "r" else [0.02, 0.05, 0.08], gold).withColumnsRenamed({c: f"{c}_{s}" for c in ("threshold", "tp", "fp", "fn")})
    grid = one("l_quantity", F.col("l_returnflag") == "R", "r").join(one("l_discount", F.col("l_returnflag") == "A", "e"), ["l_linestatus", "epoch"])
    return select.best_pair_setting(grid, ["l_linestatus"])


def control_choice(spark: SparkSession, d: str) -> DataFrame:
    c = score.counts_by_flags(_li(spark, d).withColumn("name", F.concat(F.lit("control"), F.pmod("l_suppkey", F.lit(9)))), ["l_returnflag", "name"], F.col("l_discount") >= 0.05, F.col("l_linestatus") == "O")
    return select.best_control(c, ["l_returnflag"], "name")


def holm_nested(spark: SparkSession, d: str) -> DataFrame:
    """The same p values adjusted in families of one brand and of all brands."""
    p = table(spark, d, "part").groupBy("p_brand").agg((F.count_if(F.col("p_retailprice") > 1500) / F.count("*") / 5.0).alias("p"))
    fam = p.withColumn("family", F.explode(F.array(F.lit("all"), F.substring("p_brand", 1, 7))))
    return stats.holm(fam, ["family"], "p", "p_brand")


def role_groups(spark: SparkSession, d: str) -> DataFrame:
    g = candidates.role_groups(_li(spark, d).select("l_orderkey", "l_returnflag", "l_partkey"), ["l_orderkey"], "l_returnflag", "l_partkey", ["A", "N", "R"])
    return g.select("l_orderkey", *[F.size(c).alias(f"n_{c.lower()}") for c in "ANR"], *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c.lower()) for c in "ANR"])


def window_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Groups are an order's parts by flag, windows its parts by status: is a group inside a window?"""
    li = _li(spark, d)
    g = li.groupBy("l_orderkey", F.col("l_returnflag").alias("g")).agg(F.collect_set("l_partkey").alias("m"))
    w = li.groupBy("l_orderkey", "l_linestatus").agg(F.collect_set("l_partkey").alias("w"))
    return candidates.covered_groups(g, w, "l_orderkey", "g", "m", "w").select("l_orderkey", "g", "covered")


def pair_supervision(spark: SparkSession, d: str) -> DataFrame:
    """All ordered part pairs of small orders, marked by the flags of the pair's first part."""
    li = _li(spark, d).select("l_orderkey", "l_partkey", "l_returnflag").distinct()
    p = candidates.directed_pairs(li.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts")), ["l_orderkey"], "parts").select("l_orderkey", "head", "tail")
    gold = li.select("l_orderkey", F.col("l_partkey").alias("head"), "l_returnflag").join(li.select("l_orderkey", F.col("l_partkey").alias("tail"), F.col("l_returnflag").alias("f2")), "l_orderkey").where("l_returnflag = f2")
    s = candidates.pair_supervision(p, gold, ["l_orderkey"], "head", "tail", "l_returnflag", ["A", "N", "R"])
    return s.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), *[F.sum(c).alias(f"n_{c.lower()}") for c in "ANR"])


def span_supervision(spark: SparkSession, d: str) -> DataFrame:
    """Candidate spans of up to 32 pieces of ten characters against gold mentions: labelled candidates, and gold that none reaches, as mentions of several segments."""
    from tessella.plans.annotations import p6_loaded

    n = F.floor((F.length("text") - 1) / 10).cast("int")
    docs = table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((i * 10).alias("a"), (i * 10 + 10).alias("b"))).alias("o"))
    one = F.when(F.size("segments") == 1, F.get("segments", F.lit(0)))
    gold = p6_loaded(spark, d).where("kind = 'T'").select("doc_id", (F.floor(one["a"] / 10) * 10).cast("int").alias("begin"), (F.ceil(one["b"] / 10) * 10).cast("int").alias("end"), "label")
    labelled, lost = candidates.span_supervision(docs, gold, ["doc_id"], "o", "begin", "end", "label")
    return labelled.groupBy("label").agg(F.count("*").alias("n")).unionByName(lost.agg(F.count("*").alias("n")).select(F.lit("UNREACHED").alias("label"), "n"))


def token_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Annotated segments against pieces of seven characters in chunks of 60 pieces, 40 apart: each piece weighs one over the span's pieces and chunks, so sums are the spans."""
    from tessella.plans.annotations import p6_loaded

    spans = p6_loaded(spark, d).where("kind = 'T'").select("doc_id", F.col("row_id").alias("span"), F.posexplode("segments").alias("k", "s")).select("doc_id", F.concat_ws("-", "span", "k").alias("span"), F.col("s.a").alias("begin"), F.col("s.b").alias("end"))
    tok = table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(7))).alias("token", "a")).withColumn("b", F.col("a") + 7)
    tok = tok.withColumn("chunk", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("token") - 59) / 40)).cast("int"), F.floor(F.col("token") / 40).cast("int"))))
    return candidates.alignment(tok, spans, "doc_id", "chunk").groupBy("doc_id").agg(F.count("*").alias("rows"), F.round(F.sum("weight"), 6).alias("spans"))


def evidence_gates(spark: SparkSession, d: str) -> DataFrame:
    """Edits between two predictors through the guard and the verdict gate: additions need a line of high tax, deletions one of low tax."""
    li = _li(spark, d).select("l_partkey", "l_suppkey", "l_discount", "l_quantity", "l_tax")
    diff = edits.graph_diff(li.where("l_discount >= 0.05"), li.where("l_quantity > 20"), ["l_partkey", "l_suppkey"])
    ev = li.groupBy("l_partkey", "l_suppkey").agg(F.max("l_tax").alias("hi"), F.min("l_tax").alias("lo"))
    return edits.guarded(diff.join(ev, ["l_partkey", "l_suppkey"], "left"), F.col("lo") < 0.02, F.col("hi") > 0.05).groupBy("operation").agg(F.count("*").alias("n"))


def endpoint_forms(spark: SparkSession, d: str) -> DataFrame:
    """Segments as text and occurrence and back; ``same`` must be all."""
    from tessella.plans.annotations import p6_loaded

    t = p6_loaded(spark, d).where("kind = 'T'").select("doc_id", F.inline("segments")).where("b > a").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    f = t.withColumn("form", records.endpoint_form(F.col("text"), F.col("a"), F.col("b")))
    back = records.endpoint_span(F.col("text"), F.col("form.text"), F.col("form.occurrence"))
    return f.agg(F.count("*").alias("segments"), F.count_if((back["begin"] == F.col("a")) & (back["end"] == F.col("b"))).alias("same"), F.max("form.occurrence").cast("long").alias("most"))


def document_scores(spark: SparkSession, d: str) -> DataFrame:
    """All eight metrics of the native documents, summed; a prediction of another document is an error."""
    s = _sides(spark, d)
    return score.prf(records.population_scores(records.document_scores(s, ["doc"]), s.where("gold").select("doc"), ["doc"]))


def match_witnesses(spark: SparkSession, d: str) -> DataFrame:
    """Event matches whose mapping doesn't hold when checked by joins; there must be none."""
    s = _sides(spark, d)
    return graph.witness_faults(s, graph.match_documents(s, ["doc"], "E"), ["doc"])


def nested_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Events of the native records that refer to themselves through others."""
    s = records.resolved(_records(spark, d, 0), gold=True)
    e = graph.record_edges(s.where("kind = 'E'"), ["doc"]).where("edge <> 'trigger'")
    return graph.nested_cycles(e, "id", "ref", ["doc"])


def relation_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Mentions and events of the native records that relations lead back to."""
    e = records.resolved(_records(spark, d, 0), gold=True).where("valid and kind = 'R'").select("doc", F.col("arg1").alias("id"), F.col("arg2").alias("ref"))
    return graph.nested_cycles(e, "id", "ref", ["doc"])


def json_faults(spark: SparkSession, d: str) -> DataFrame:
    """Events' property texts by strict reading, some of them broken on purpose: cut short, with a key twice, with a number that isn't finite."""
    e, props = F.pmod("event_id", F.lit(11)), F.col("props")
    broken = F.when(e == 3, F.expr("left(props, length(props) - 1)")).when(e == 5, F.lit('{"a": 1, "b": {"k": 1, "k": 2}}')).when(e == 7, F.lit('{"a": [NaN]}')).otherwise(props)
    planted = table(spark, d, "events").select(F.when(props.isNotNull(), broken).alias("props"))
    return planted.select(F.coalesce(text.strict_json_fault("props"), F.lit("sound")).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        subset_populations, label_histogram, usage_by_stage, mean_over_seeds, union_of_windows, multiset_intersection, set_difference, optional_metadata, two_endpoint_selection, control_choice,
        holm_nested, role_groups, window_coverage, pair_supervision, span_supervision, token_alignment, evidence_gates, endpoint_forms, document_scores, match_witnesses, nested_cycles, relation_cycles, json_faults,
    )
}
_F1 = "CASE WHEN 2 * {t} + {p} + {n} > 0 THEN 2 * {t} / (2 * {t} + {p} + {n})::DOUBLE ELSE 0 END"
SQL = {
    "subset_populations": f"""WITH x AS (SELECT *, unnest(list_filter(['all', CASE WHEN l_quantity < 20 THEN 'small' END, CASE WHEN l_quantity >= 20 THEN 'large' END, CASE WHEN l_linestatus = 'O' THEN 'open' END], lambda p: p IS NOT NULL)) AS population FROM lineitem),
c AS (SELECT population, CAST(count(*) FILTER (l_discount >= 0.05 AND l_returnflag = 'R') AS BIGINT) tp, CAST(count(*) FILTER (l_discount >= 0.05 AND l_returnflag <> 'R') AS BIGINT) fp, CAST(count(*) FILTER (l_discount < 0.05 AND l_returnflag = 'R') AS BIGINT) fn FROM x GROUP BY 1)
SELECT population, tp, fp, fn, {_PRF} FROM c""",
    "label_histogram": "SELECT p_brand, p_type, CAST(count(*) AS BIGINT) n FROM part GROUP BY ALL",
    "usage_by_stage": "SELECT event_type, CAST(count(*) AS BIGINT) calls, CAST(count(*) FILTER (value IS NULL) AS BIGINT) failed, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) spent, CAST(count(DISTINCT user_id) AS BIGINT) clients FROM events GROUP BY 1",
    "mean_over_seeds": """WITH l AS (SELECT l_partkey, l_suppkey, l_returnflag, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) hit FROM lineitem GROUP BY ALL), s AS (SELECT *, unnest(range(10)) seed FROM l),
p AS (SELECT l_returnflag, seed, sum(hit) hits FROM s WHERE CAST('0x' || substr(sha256(seed || '|' || l_partkey || '|' || l_suppkey || '|' || l_returnflag), 1, 8) AS BIGINT) % 10 = 0 GROUP BY ALL)
SELECT l_returnflag, CAST(sum(hits) AS BIGINT) total, round(avg(hits), 9) mean, round(var_pop(hits), 6) variance, quantile_cont(hits::DOUBLE, 0.5) median FROM p GROUP BY 1""",
    "union_of_windows": "SELECT l_orderkey, l_partkey, arg_max(l_returnflag, (l_linenumber, l_returnflag)) AS flag FROM lineitem GROUP BY ALL",
    "multiset_intersection": """WITH k AS (SELECT l_partkey, l_returnflag, least(count(*) FILTER (l_discount >= 0.05), count(*) FILTER (l_quantity > 20)) n FROM lineitem GROUP BY ALL) SELECT l_returnflag, CAST(sum(n) AS BIGINT) common FROM k GROUP BY 1 HAVING sum(n) > 0""",
    "set_difference": """WITH k AS (SELECT l_partkey, l_suppkey, bool_or(l_discount >= 0.05) a, bool_or(l_quantity > 20) b FROM lineitem GROUP BY ALL) SELECT 'both' AS what, CAST(count(*) FILTER (a AND b) AS BIGINT) n FROM k UNION ALL SELECT 'first only', CAST(count(*) FILTER (a AND NOT b) AS BIGINT) FROM k UNION ALL SELECT 'second only', CAST(count(*) FILTER (b AND NOT a) AS BIGINT) FROM k""",
    "optional_metadata": """WITH m AS (SELECT o_custkey, count(DISTINCT o_orderpriority) k, min(o_orderpriority) v FROM orders GROUP BY 1), j AS (SELECT CASE WHEN k IS NULL OR k = 0 THEN 'missing' WHEN k > 1 THEN 'conflicting' ELSE v END AS state FROM customer LEFT JOIN m ON c_custkey = o_custkey) SELECT state, CAST(count(*) AS BIGINT) n FROM j GROUP BY 1""",
    "two_endpoint_selection": f"""WITH r AS (SELECT l_linestatus, month(l_shipdate) AS epoch, t AS threshold_r, count(*) FILTER (l_quantity >= t AND l_returnflag = 'R') tp_r, count(*) FILTER (l_quantity >= t AND l_returnflag <> 'R') fp_r, count(*) FILTER (l_quantity < t AND l_returnflag = 'R') fn_r FROM lineitem, (SELECT unnest([10.0::DOUBLE, 25, 40]) t) GROUP BY l_linestatus, month(l_shipdate), t),
e AS (SELECT l_linestatus, month(l_shipdate) AS epoch, t AS threshold_e, count(*) FILTER (l_discount >= t AND l_returnflag = 'A') tp_e, count(*) FILTER (l_discount >= t AND l_returnflag <> 'A') fp_e, count(*) FILTER (l_discount < t AND l_returnflag = 'A') fn_e FROM lineitem, (SELECT unnest([0.02::DOUBLE, 0.05, 0.08]) t) GROUP BY l_linestatus, month(l_shipdate), t),
k AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY {_F1.format(t='tp_r', p='fp_r', n='fn_r')} + {_F1.format(t='tp_e', p='fp_e', n='fn_e')} DESC, fp_r + fp_e, threshold_r DESC, threshold_e DESC, epoch) i FROM r JOIN e USING (l_linestatus, epoch))
SELECT l_linestatus, CAST(epoch AS INT) epoch, threshold_r, CAST(tp_r AS BIGINT) tp_r, CAST(fp_r AS BIGINT) fp_r, CAST(fn_r AS BIGINT) fn_r, threshold_e, CAST(tp_e AS BIGINT) tp_e, CAST(fp_e AS BIGINT) fp_e, CAST(fn_e AS BIGINT) fn_e FROM k WHERE i = 1""",
    "control_choice": f"""WITH c AS (SELECT l_returnflag, 'control' || (l_suppkey % 9) AS name, count(*) FILTER (l_discount >= 0.05 AND l_linestatus = 'O') tp, count(*) FILTER (l_discount >= 0.05 AND l_linestatus <> 'O') fp, count(*) FILTER (l_discount < 0.05 AND l_linestatus = 'O') fn FROM lineitem GROUP BY l_returnflag, l_suppkey % 9),
k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_F1.format(t='tp', p='fp', n='fn')} DESC, name DESC) i FROM c) SELECT l_returnflag, name, CAST(tp AS BIGINT) tp, CAST(fp AS BIGINT) fp, CAST(fn AS BIGINT) fn FROM k WHERE i = 1""",
    "holm_nested": """WITH t AS (SELECT p_brand, count(*) FILTER (p_retailprice > 1500) / CAST(count(*) AS DOUBLE) / 5.0 AS p FROM part GROUP BY 1), f AS (SELECT *, unnest(['all', substr(p_brand, 1, 7)]) AS family FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, p_brand) - 1 AS k, count(*) OVER (PARTITION BY family) AS m FROM f), h AS (SELECT family, p_brand, p, least(max((m - k) * p) OVER (PARTITION BY family ORDER BY p, p_brand ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE) AS holm FROM r) SELECT *, holm <= 0.05 AS rejected FROM h""",
    "role_groups": """WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey) FILTER (l_returnflag = 'A')) a, list_sort(list(DISTINCT l_partkey) FILTER (l_returnflag = 'N')) n, list_sort(list(DISTINCT l_partkey) FILTER (l_returnflag = 'R')) r FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(coalesce(len(a), 0) AS INT) n_a, CAST(coalesce(len(n), 0) AS INT) n_n, CAST(coalesce(len(r), 0) AS INT) n_r, coalesce(array_to_string(a, ','), '') a, coalesce(array_to_string(n, ','), '') n, coalesce(array_to_string(r, ','), '') r FROM g""",
    "window_coverage": """WITH p AS (SELECT l_orderkey, l_returnflag AS g, count(DISTINCT l_partkey) k FROM lineitem GROUP BY ALL), w AS (SELECT l_orderkey, l_linestatus, l_partkey FROM lineitem GROUP BY ALL), m AS (SELECT DISTINCT l_orderkey, l_returnflag AS g, l_partkey FROM lineitem),
h AS (SELECT l_orderkey, g, l_linestatus, count(*) n FROM m JOIN w USING (l_orderkey, l_partkey) GROUP BY ALL) SELECT l_orderkey, g, max(n) = any_value(k) AS covered FROM p JOIN h USING (l_orderkey, g) GROUP BY l_orderkey, g""",
    "pair_supervision": """WITH p AS (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem), q AS (SELECT l_orderkey, l_partkey, bool_or(l_returnflag = 'A') a, bool_or(l_returnflag = 'N') n, bool_or(l_returnflag = 'R') r FROM p GROUP BY ALL)
SELECT x.l_orderkey, CAST(count(*) AS BIGINT) pairs, CAST(count(*) FILTER (x.a AND y.a) AS BIGINT) n_a, CAST(count(*) FILTER (x.n AND y.n) AS BIGINT) n_n, CAST(count(*) FILTER (x.r AND y.r) AS BIGINT) n_r FROM q x JOIN q y USING (l_orderkey) GROUP BY x.l_orderkey""",
    "evidence_gates": """WITH k AS (SELECT l_partkey, l_suppkey, bool_or(l_discount >= 0.05) o, bool_or(l_quantity > 20) n, max(l_tax) hi, min(l_tax) lo FROM lineitem GROUP BY ALL) SELECT CASE WHEN n THEN 'add' ELSE 'delete' END AS operation, CAST(count(*) AS BIGINT) n FROM k WHERE o <> n AND CASE WHEN n THEN hi > 0.05 ELSE lo < 0.02 END GROUP BY 1""",
}
