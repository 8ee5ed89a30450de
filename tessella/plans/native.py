"""Queries over native records: resolution, scores, graph matches, reachability, sampling, checks, pacing, journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import checks, graph, linegrammar, records, sample, score
from tessella.plans.annotations import SOURCES, _checked
from tessella.sources import files
from tessella.sources.tables import table
from tessella.streaming import journal, pacing


def _records(spark: SparkSession, d: str, i: int) -> DataFrame:
    """One row per line of a source: its latest delivery, parsed; ``occ`` is the row id."""
    c = _checked(spark, d, *SOURCES[i])
    parts = F.struct(F.col("doc_id").alias("doc"), "kind", "id", "label", "spans", "arg1", "arg2", "trigger", "roles", F.col("reason").alias("issue"))
    one = c.groupBy("row_id").agg(F.max_by(F.struct(parts.alias("p"), "code"), F.struct("stamp", "code")).alias("r")).select(F.col("row_id").alias("occ"), "r.p.*", (F.col("r.code") == 0).alias("valid"))
    return one.withColumn("segments", F.when(F.col("valid") & (F.col("kind") == "T"), linegrammar.segments(F.col("spans")))).withColumn("role_list", F.when(F.col("valid") & (F.col("kind") == "E"), linegrammar.roles(F.col("roles"))))


def resolved_records(spark: SparkSession, d: str) -> DataFrame:
    """Emissions by what became of them."""
    r = records.resolved(_records(spark, d, 1), gold=False)
    return r.groupBy(F.coalesce("issue", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"), F.countDistinct("doc").alias("documents"))


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """Gold and predicted records; all native documents are the population, a missing prediction is an empty one."""
    g = records.resolved(_records(spark, d, 0), gold=True).withColumn("gold", F.lit(True))
    p = records.resolved(_records(spark, d, 1), gold=False).withColumn("gold", F.lit(False))
    return g.unionByName(p)


def native_mention_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of the native documents as multisets, by category."""
    s = _sides(spark, d).where("kind = 'T'").withColumn("key", records.mention_key(F.col("label"), F.col("segments"))).withColumn("category", records.category(F.col("kind"), F.col("label")))
    return score.prf(score.multiset_counts(s.where("not gold"), s.where("gold"), ["doc", "category", "key"], ["category"], valid="valid").drop("conserved"))


def projected_relation_key(spark: SparkSession, d: str) -> DataFrame:
    """Relations by label and their endpoints' mentions, events projected to their triggers."""
    s = _sides(spark, d)
    side = lambda g: records.relation_keys(s.where(F.col("gold") == g))
    return score.prf(score.multiset_counts(side(False), side(True), ["doc", "label", "key"], ["label"], valid="valid").drop("conserved"))


def graph_match_global(spark: SparkSession, d: str) -> DataFrame:
    """Events of each native document's predictions against its gold ones as whole graphs."""
    return graph.match_documents(_sides(spark, d), ["doc"], "E")


def relation_match_global(spark: SparkSession, d: str) -> DataFrame:
    return graph.match_documents(_sides(spark, d), ["doc"], "R")


def closure_reachability(spark: SparkSession, d: str) -> DataFrame:
    """What each event and relation of the native records refers to, directly or through others: number of nodes by root."""
    r = records.resolved(_records(spark, d, 0), gold=True)
    e = records.references(r).join(r.select("doc", "occ", "id"), ["doc", "occ"])
    roots = r.where("valid and kind in ('R', 'E')").select("doc", F.col("id").alias("root"))
    return graph.reachable(e, roots, "id", "ref", ["doc"]).groupBy("doc", "root").agg(F.count("*").alias("nodes"))


def schema_inventory(spark: SparkSession, d: str) -> DataFrame:
    return records.inventory(records.resolved(_records(spark, d, 0), gold=True))


def motif_chains(spark: SparkSession, d: str) -> DataFrame:
    return records.motif_chains(records.resolved(_records(spark, d, 0), gold=True)).groupBy("doc").agg(F.count("*").alias("chains"))


def reference_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Sound T lines whose third field isn't the text of their segments, by whether it is missing."""
    lines = table(spark, d, "native_records").select(F.col("record_id").alias("occ"), F.get(F.split(F.regexp_replace(F.col("raw").cast("string"), "\r$", ""), "\t"), F.lit(2)).alias("surface")).groupBy("occ").agg(F.max("surface").alias("surface"))
    t = _records(spark, d, 0).where("valid and kind = 'T'").join(lines, "occ").join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc", "left")
    ref = records.reference_text(F.col("text"), F.col("segments"))
    state = F.when(F.col("surface").isNull(), "missing_reference_text").when(F.col("surface") == ref, "equal").otherwise("reference_text_mismatch")
    return t.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def signature_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Predicted relations of a (label, head type, tail type) that no gold relation has."""
    s = _sides(spark, d)

    def typed(side: DataFrame) -> DataFrame:
        t = side.where("valid and kind = 'T'").select("doc", "id", F.col("label").alias("type"))
        r = side.where("valid and kind = 'R'").select("doc", "occ", "label", "arg1", "arg2")
        end = lambda a: t.select("doc", F.col("id").alias(a), F.col("type").alias(f"{a}_type"))
        return r.join(end("arg1"), ["doc", "arg1"]).join(end("arg2"), ["doc", "arg2"])

    sig = ["label", "arg1_type", "arg2_type"]
    return records.signature_warnings(typed(s.where("not gold")), typed(s.where("gold")), sig).groupBy(*sig).agg(F.count("*").alias("n"))


def lossless_lines(spark: SparkSession, d: str) -> DataFrame:
    return records.lossless(table(spark, d, "native_records").select("record_id", "raw").distinct(), "raw", ["record_id"])


def negatives_4to1(spark: SparkSession, d: str) -> DataFrame:
    """Returned line items are positives; of each stratum's others (seven strata of suppliers) four to one, 64 to 1,024, by hash order."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.col("l_returnflag").alias("flag")).groupBy("l_suppkey", "l_partkey").agg(F.max((F.col("flag") == "R").cast("int")).alias("r"))
    rows = li.select(F.pmod("l_suppkey", F.lit(7)).alias("stratum"), "l_suppkey", "l_partkey", (F.col("r") == 1).alias("positive"))
    s = sample.with_negatives(rows, ["stratum"], "positive", F.concat_ws("-", "l_suppkey", "l_partkey"))
    return s.groupBy("stratum", "positive").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


def product_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five members of each order's implicit product of lines."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count("*") * F.count("*") * F.count("*")).alias("size"))
    return sample.sampled_product(o, ["l_orderkey"], "size", 5, "s")


def donor_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Lines' parts dealt out anew within each order."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    return sample.permuted_within(li, ["l_orderkey"], "l_linenumber", "part", "donor")


def hash_positions(spark: SparkSession, d: str) -> DataFrame:
    return sample.hash_order(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], F.col("o_orderkey"))


def population_faults(spark: SparkSession, d: str) -> DataFrame:
    """Customers against the customers of orders: those without, and those with several."""
    return checks.population(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, d, "customer"), ["c_custkey"]).groupBy("fault").agg(F.count("*").alias("n"))


def label_slice_conservation(spark: SparkSession, d: str) -> DataFrame:
    """Flags' counts against suppliers' totals; of every fifth supplier a flag's lines were left out, which must come out as what is missing."""
    li = table(spark, d, "lineitem")
    c = lambda rows, by: score.counts_by_flags(rows, by, F.col("l_discount") >= 0.05, F.col("l_linestatus") == "O")
    return checks.conservation(c(li.where("l_suppkey % 5 <> 0 or l_returnflag <> 'R'"), ["l_suppkey", "l_returnflag"]), c(li, ["l_suppkey"]), ["l_suppkey"], ["tp", "fp", "fn"])


def unlisted_predictions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("p")).distinct()
    c = table(spark, d, "lineitem").where("l_quantity > 3").select("l_partkey", "l_suppkey")
    return checks.outside_candidates(p, c, ["l_partkey", "l_suppkey"], "p", 0.2).groupBy("fault").agg(F.count("*").alias("n"))


def rolling_admission_60s(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events and values in the minute up to each event."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("s"), F.floor("value").cast("long").alias("v"))
    return pacing.rolling_load(e, "user_id", "s", "v", 60).select("user_id", "event_id", "recent", "recent_n")


def paced_admission(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as requests, an hour as a second: errors are rate failures, others use four fifths of what they asked for and last up to half a minute."""
    e, v = table(spark, d, "events"), F.coalesce(F.floor("value"), F.lit(0)).cast("long")
    outcome = [F.floor(v * 4 / 5).cast("long").alias("used"), F.pmod("event_id", F.lit(30)).cast("double").alias("lasts"), (F.col("event_type") == "error").alias("rate_failure"), F.lit(0.0).alias("retry_after")]
    e = e.select(F.col("user_id").cast("string").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 36e8).alias("now"), v.alias("tokens"), *outcome)
    return pacing.paced_batch(e, 400, 3, 1600)


def reply_reassembly(spark: SparkSession, d: str) -> DataFrame:
    """Orders are replies, their lines chunks; a line of status F with number over 5 ends one."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("t"), F.min("l_linestatus").alias("s"))
    r = journal.replies(li.withColumn("end", (F.col("s") == "F") & (F.col("l_linenumber") > 5)), "l_orderkey", "l_linenumber", "t", "end")
    return r.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"))


def numbered_attempts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return journal.attempts(e, "user_id", ["ts", "event_id"], 3).groupBy("allowed").agg(F.count("*").alias("n"), F.max("attempt").cast("long").alias("most"))


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return journal.event_counts(table(spark, d, "events"), "ts", "event_type")


def table_digest(spark: SparkSession, d: str) -> DataFrame:
    """Rows and an order-free digest of a table."""
    return spark.createDataFrame([("orders", table(spark, d, "orders").count(), str(files.digest(table(spark, d, "orders"))))], "name string, n long, digest string")


QUERIES = {
    f.__name__: f
    for f in (
        resolved_records, native_mention_scores, projected_relation_key, graph_match_global, relation_match_global, closure_reachability, schema_inventory, motif_chains, reference_mismatches,
        signature_warnings, lossless_lines, negatives_4to1, product_sample, donor_permutation, hash_positions, population_faults, label_slice_conservation, unlisted_predictions,
        rolling_admission_60s, paced_admission, reply_reassembly, numbered_attempts, event_counts, table_digest,
    )
}
SQL = {
    "lossless_lines": """SELECT DISTINCT record_id, CASE WHEN raw IS NULL THEN '{"record_id":' || record_id || '}' ELSE '{"record_id":' || record_id || ',"raw_base64":"' || base64(raw) || '"}' END AS json FROM native_records""",
    "negatives_4to1": """WITH r AS (SELECT l_suppkey % 7 AS stratum, l_suppkey, l_partkey, bool_or(l_returnflag = 'R') pos FROM lineitem GROUP BY ALL), n AS (SELECT stratum, count(*) FILTER (pos) p, count(*) FILTER (NOT pos) q FROM r GROUP BY 1),
k AS (SELECT r.*, row_number() OVER (PARTITION BY stratum ORDER BY sha256(l_suppkey || '-' || l_partkey)) i FROM r WHERE NOT pos), s AS (SELECT stratum, l_partkey, pos FROM r WHERE pos UNION ALL SELECT stratum, l_partkey, pos FROM k JOIN n USING (stratum) WHERE i <= least(q, 1024, greatest(64, 4 * p)))
SELECT stratum, pos AS positive, CAST(count(*) AS BIGINT) n, CAST(sum(l_partkey) AS BIGINT) parts FROM s GROUP BY ALL""",
    "product_sample": """WITH o AS (SELECT l_orderkey, CAST(count(*) ** 3 AS BIGINT) AS size FROM lineitem GROUP BY 1), w AS (SELECT l_orderkey, size, unnest(range(size)) AS i FROM o WHERE size <= 5),
t AS (SELECT l_orderkey, size, j, CAST('0x' || substr(sha256('s|' || l_orderkey || '|' || j), 1, 15) AS BIGINT) % size AS i FROM (SELECT *, unnest(range(20)) j FROM o WHERE size > 5)), u AS (SELECT l_orderkey, size, i, min(j) j FROM t GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY j) k FROM u) SELECT l_orderkey, size, i AS "index" FROM w UNION ALL SELECT l_orderkey, size, i FROM v WHERE k <= 5""",
    "hash_positions": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY sha256(o_orderkey::VARCHAR)) - 1 AS INT) AS position FROM orders",
    "population_faults": """WITH o AS (SELECT o_custkey k, count(*) n FROM orders GROUP BY 1), j AS (SELECT CASE WHEN n IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' END fault FROM customer FULL JOIN o ON c_custkey = k)
SELECT fault, CAST(count(*) AS BIGINT) n FROM j WHERE fault IS NOT NULL GROUP BY 1""",
    "label_slice_conservation": """SELECT l_suppkey, CAST(-count(*) FILTER (l_discount >= 0.05 AND l_linestatus = 'O') AS BIGINT) tp, CAST(-count(*) FILTER (l_discount >= 0.05 AND l_linestatus <> 'O') AS BIGINT) fp, CAST(-count(*) FILTER (l_discount < 0.05 AND l_linestatus = 'O') AS BIGINT) fn
FROM lineitem WHERE l_suppkey % 5 = 0 AND l_returnflag = 'R' GROUP BY 1 HAVING tp <> 0 OR fp <> 0 OR fn <> 0""",
    "unlisted_predictions": """WITH p AS (SELECT DISTINCT l_partkey, l_suppkey, l_discount * 10 p FROM lineitem) SELECT 'not_a_candidate' AS fault, CAST(count(*) AS BIGINT) n FROM p WHERE NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_quantity > 3 AND c.l_partkey = p.l_partkey AND c.l_suppkey = p.l_suppkey) HAVING count(*) > 0
UNION ALL SELECT 'probability', CAST(count(*) AS BIGINT) FROM p WHERE NOT (p BETWEEN 0.2 AND 1.0) HAVING count(*) > 0""",
    "rolling_admission_60s": """SELECT user_id, event_id, CAST(sum(v) OVER w AS BIGINT) recent, CAST(count(*) OVER w AS BIGINT) recent_n FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) s, CAST(floor(value) AS BIGINT) v FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    "reply_reassembly": """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) t, min(l_linestatus) = 'F' AND l_linenumber > 5 e FROM lineitem GROUP BY l_orderkey, l_linenumber), r AS (SELECT l_orderkey, count(*) FILTER (e) ends, arg_max(e, l_linenumber) AS fin, CAST(sum(length(t)) AS BIGINT) c FROM l GROUP BY 1),
s AS (SELECT CASE WHEN ends = 0 THEN 'partial' WHEN NOT fin OR ends > 1 THEN 'over' ELSE 'complete' END AS status, c FROM r) SELECT status, CAST(count(*) AS BIGINT) n, CAST(sum(CASE WHEN status = 'complete' THEN c ELSE 0 END) AS BIGINT) chars FROM s GROUP BY 1""",
    "numbered_attempts": "WITH a AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM events) SELECT k <= 3 AS allowed, CAST(count(*) AS BIGINT) n, max(k) AS most FROM a GROUP BY 1",
    "event_counts": "SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) n FROM events GROUP BY ALL",
}
