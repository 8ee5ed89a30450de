"""Queries on duplicates, clusters, retrieval, selection and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import keys, text
from tessella.operators import dedup, edits, retrieve, score, select
from tessella.sources.tables import latest, table

STUDY = "SupraNotes"


def _units(spark: SparkSession, d: str) -> DataFrame:
    u = latest(table(spark, d, "units"), "uid", "ingested_at", ["corpus", "split", "doi", "byte_sha", "projected_sha", "norm_sha", "document_id", "ingested_at"])
    return u.withColumn("split", keys.plain_key(F.col("split"))).withColumn("doi", keys.bare_doi(F.col("doi")))


VIEWS = {"exact_native_source_bytes": "byte_sha", "exact_projected_text_utf8": "projected_sha", "normalized_text": "norm_sha", "normalized_doi": "doi"}


def exact_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_pairs(_units(spark, d), "uid", VIEWS, STUDY)


def near_dup_5gram(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose lower-case word 5-grams overlap by four fifths; both have 20 words or more."""
    w = text.words(F.lower("text"))
    docs = table(spark, d, "documents").select("doc_id", w.alias("w")).where(F.size("w") >= 20)
    return dedup.near_pairs(docs.select("doc_id", F.explode(text.word_grams(F.col("w"))).alias("gram")), "doc_id", "gram").withColumnsRenamed({"left_uid": "left_doc", "right_uid": "right_doc"})


def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the units tied by the recorded pairs, isolated ones kept."""
    p = table(spark, d, "pairs").where(keys.plain_key(F.col("kind")).isin("exact_native_source_bytes", "normalized_text", "word5gram_jaccard_ge_0.8"))
    return dedup.clusters(table(spark, d, "units").select("uid"), "uid", p, "left_uid", "right_uid")


def cross_split_overlap(spark: SparkSession, d: str) -> DataFrame:
    return dedup.split_overlap(_units(spark, d), "split", "norm_sha")


def corpus_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).groupBy("corpus", "split").agg(F.count("*").alias("units"), F.countDistinct("document_id").alias("documents"))


def doi_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """DOIs held by several corpora or documents."""
    return dedup.conflicts(_units(spark, d), "doi", ["corpus", "document_id"])


def year_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Venues by year, missing years apart, and how many venues have several."""
    v = table(spark, d, "documents").groupBy("venue").agg(F.countDistinct("pub_year").alias("years"), F.count_if(F.col("pub_year").isNull()).alias("missing"), F.count("*").alias("documents"))
    return v.withColumn("conflicting", F.col("years") > 1)


def tfidf_top3_one_per_venue(spark: SparkSession, d: str) -> DataFrame:
    """Every document whose id is divisible by 50 against all: three hits, one per venue."""
    docs = table(spark, d, "documents").select("doc_id", text.latin_words(F.col("text")).alias("terms"), "venue").where("terms is not null")
    return retrieve.top_hits(retrieve.tfidf(docs, "doc_id", "terms"), "doc_id", F.col("doc_id") % 50 == 0, docs, "venue")


def argmax_selection(spark: SparkSession, d: str) -> DataFrame:
    """For each line status the best quantity threshold; months stand for epochs."""
    li = table(spark, d, "lineitem").withColumn("epoch", F.month("l_shipdate"))
    grid = score.sweep_counts(li, ["l_linestatus", "epoch"], F.col("l_quantity"), [5.0, 15.0, 25.0, 35.0, 45.0], F.col("l_returnflag") == "R")
    return select.best_threshold(grid, ["l_linestatus"])


def canonical_hash_order(spark: SparkSession, d: str) -> DataFrame:
    """Five documents of each source by the order of their hashes."""
    return select.hash_subset(table(spark, d, "documents").select("doc_id", "source"), ["source"], F.col("doc_id"), 5)


def graph_diff(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    diff = edits.graph_diff(li.where("l_discount >= 0.05"), li.where("l_quantity > 20"), ["l_partkey", "l_suppkey"])
    return diff.groupBy("operation").agg(F.count("*").alias("edits"), F.sum("l_partkey").alias("parts"))


def document_edit_pool(spark: SparkSession, d: str) -> DataFrame:
    """Orders are documents, their lines windows; discounts are confidences in hundredths."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.when(F.col("l_linestatus") == "O", "delete").otherwise("add").alias("operation"), F.round(F.col("l_discount") * 100).cast("int").alias("confidence"), (F.col("l_quantity") > 10).alias("eligible"), "l_linenumber")
    return edits.document_pool(li, ["l_orderkey", "l_returnflag"], "operation", "confidence", "eligible", "l_linenumber")


def budget_matched_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Of each flag and status as many parts as a tenth of its distinct ones, by hash order."""
    pool = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_partkey").distinct()
    budgets = pool.groupBy("l_returnflag", "l_linestatus").agg(F.floor(F.count("*") / 10).cast("int").alias("budget"))
    return edits.matched_choice(pool, ["l_returnflag", "l_linestatus"], F.col("l_partkey"), budgets)


def edit_identity(spark: SparkSession, d: str) -> DataFrame:
    """Gain of each brand's edits by the closed form, and by counting."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_discount", "l_quantity", "l_returnflag")
    p, q, g = F.col("l_discount") >= 0.05, (F.col("l_discount") >= 0.05) | (F.col("l_quantity") > 45), F.col("l_returnflag") == "R"
    c = li.groupBy(F.pmod("l_suppkey", F.lit(25)).alias("cluster")).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(q & g).alias("tp2"), F.count_if(q & ~g).alias("fp2"))
    return c.select("cluster", edits.gain_numerator(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tp2") + F.col("fp2") - F.col("tp") - F.col("fp"), F.col("tp2") - F.col("tp")).alias("gain"))


_U = r"""u AS (SELECT DISTINCT ON (uid) uid, corpus, lower(trim(split)) split, byte_sha, projected_sha, norm_sha, document_id, regexp_replace(lower(regexp_replace(doi, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '^(doi:|https?://(dx\.)?resolver\.example/)[\s\p{Z}]*', '') x FROM units WHERE uid IS NOT NULL ORDER BY uid, ingested_at DESC),
v AS (SELECT *, CASE WHEN regexp_full_match(x, '10\.[0-9]{4,9}/\S+') THEN x END doi FROM u)"""
_TFIDF = """w AS (SELECT doc_id, venue, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{2,}')) term FROM documents WHERE text IS NOT NULL), tf AS (SELECT doc_id, term, count(*) tf FROM w GROUP BY ALL),
df AS (SELECT term, count(*) df FROM tf GROUP BY 1), r AS (SELECT doc_id, term, tf * (ln(((SELECT count(*) FROM documents WHERE text IS NOT NULL) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE) w FROM tf JOIN df USING (term)),
n AS (SELECT doc_id, sqrt(sum(w * w)) norm FROM r GROUP BY 1), x AS (SELECT doc_id, term, w / norm w FROM r JOIN n USING (doc_id))"""

QUERIES = {
    f.__name__: f
    for f in (
        exact_dup_pairs, near_dup_5gram, dup_clusters, cross_split_overlap, corpus_split_counts, doi_conflicts, year_distribution, tfidf_top3_one_per_venue, argmax_selection, canonical_hash_order,
        graph_diff, document_edit_pool, budget_matched_hash_sample, edit_identity,
    )
}
SQL = {
    "exact_dup_pairs": f"""WITH {_U}, k AS ({' UNION ALL '.join(f"SELECT '{k}' kind, uid, corpus, {c} val FROM v WHERE {c} <> ''" for k, c in VIEWS.items())})
SELECT a.kind, a.uid AS left_uid, b.uid AS right_uid FROM k a JOIN k b ON a.kind = b.kind AND a.val = b.val AND a.uid < b.uid WHERE a.corpus = '{STUDY}' OR b.corpus = '{STUDY}'""",
    "near_dup_5gram": r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w FROM documents WHERE text IS NOT NULL), g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 20)),
s AS (SELECT doc_id, count(*) c FROM g GROUP BY 1), p AS (SELECT a.doc_id l, b.doc_id r, count(*) i FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT l AS left_doc, r AS right_doc, i AS intersection_count, x.c + y.c - i AS union_count FROM p JOIN s x ON x.doc_id = l JOIN s y ON y.doc_id = r WHERE 5 * i >= 4 * (x.c + y.c - i)""",
    "dup_clusters": """WITH RECURSIVE n AS (SELECT DISTINCT uid FROM units WHERE uid IS NOT NULL), e0 AS (SELECT left_uid a, right_uid b FROM pairs WHERE lower(trim(kind)) IN ('exact_native_source_bytes', 'normalized_text', 'word5gram_jaccard_ge_0.8') AND left_uid IN (FROM n) AND right_uid IN (FROM n)),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), r AS (SELECT uid, uid AS t FROM n UNION SELECT r.uid, e.b FROM r JOIN e ON r.t = e.a) SELECT uid, min(t) AS cluster FROM r GROUP BY 1""",
    "cross_split_overlap": f"WITH {_U}, h AS (SELECT DISTINCT split, norm_sha FROM v WHERE split IS NOT NULL AND norm_sha IS NOT NULL) SELECT a.split AS left_split, b.split AS right_split, CAST(count(*) AS BIGINT) shared FROM h a JOIN h b ON a.norm_sha = b.norm_sha AND a.split < b.split GROUP BY ALL",
    "corpus_split_counts": f"WITH {_U} SELECT corpus, split, CAST(count(*) AS BIGINT) units, CAST(count(DISTINCT document_id) AS BIGINT) documents FROM v GROUP BY ALL",
    "doi_conflicts": f"WITH {_U} SELECT doi, CAST(count(DISTINCT corpus) AS BIGINT) corpus_values, CAST(count(DISTINCT document_id) AS BIGINT) document_id_values FROM v WHERE doi IS NOT NULL GROUP BY 1 HAVING count(DISTINCT corpus) > 1 OR count(DISTINCT document_id) > 1",
    "year_distribution": "SELECT venue, CAST(count(DISTINCT pub_year) AS BIGINT) AS years, CAST(count(*) FILTER (pub_year IS NULL) AS BIGINT) AS missing, CAST(count(*) AS BIGINT) AS documents, count(DISTINCT pub_year) > 1 AS conflicting FROM documents GROUP BY 1",
    "tfidf_top3_one_per_venue": f"""WITH {_TFIDF}, c AS (SELECT q.doc_id AS query, x.doc_id AS hit, round(sum(q.w * x.w), 9) score FROM x q JOIN x USING (term) WHERE q.doc_id % 50 = 0 AND q.doc_id <> x.doc_id GROUP BY ALL),
g AS (SELECT c.*, coalesce(venue, '#' || doc_id) AS "group" FROM c JOIN documents ON doc_id = hit), b AS (SELECT *, row_number() OVER (PARTITION BY query, "group" ORDER BY score DESC, hit) k FROM g),
z AS (SELECT query, hit, "group", score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS INT) AS rank FROM b WHERE k = 1) SELECT * FROM z WHERE rank <= 3""",
    "argmax_selection": """WITH g AS (SELECT l_linestatus, month(l_shipdate) AS epoch, t AS threshold, count(*) FILTER (l_quantity >= t AND l_returnflag = 'R') tp, count(*) FILTER (l_quantity >= t AND l_returnflag <> 'R') fp, count(*) FILTER (l_quantity < t AND l_returnflag = 'R') fn
FROM lineitem, (SELECT unnest([5.0::DOUBLE, 15, 25, 35, 45]) t) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END DESC, fp, threshold DESC, epoch) k FROM g)
SELECT l_linestatus, CAST(epoch AS INT) epoch, threshold, CAST(tp AS BIGINT) tp, CAST(fp AS BIGINT) fp, CAST(fn AS BIGINT) fn FROM r WHERE k = 1""",
    "canonical_hash_order": "SELECT doc_id, source, CAST(k AS INT) AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) k FROM documents) WHERE k <= 5",
    "graph_diff": """WITH k AS (SELECT l_partkey, l_suppkey, bool_or(l_discount >= 0.05) o, bool_or(l_quantity > 20) n FROM lineitem GROUP BY ALL) SELECT CASE WHEN n THEN 'add' ELSE 'delete' END AS operation, CAST(count(*) AS BIGINT) edits, CAST(sum(l_partkey) AS BIGINT) parts FROM k WHERE o <> n GROUP BY 1""",
    "document_edit_pool": """WITH c AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'delete' ELSE 'add' END AS operation, CAST(round(l_discount * 100) AS INT) conf, l_quantity > 10 ok, l_linenumber FROM lineitem),
p AS (SELECT l_orderkey, l_returnflag, operation, l_linenumber, max(conf) FILTER (ok) c, bool_or(ok) ok FROM c GROUP BY ALL),
q AS (SELECT l_orderkey, l_returnflag, operation, min(c) lo, max(c) hi, bool_and(ok) AS all_ok, bool_or(ok) AS any_ok FROM p GROUP BY l_orderkey, l_returnflag, operation)
SELECT l_orderkey, l_returnflag, operation, CASE WHEN operation = 'delete' THEN lo ELSE hi END AS confidence FROM q WHERE CASE WHEN operation = 'delete' THEN all_ok ELSE any_ok END""",
    "budget_matched_hash_sample": """WITH p AS (SELECT DISTINCT l_returnflag, l_linestatus, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY sha256(l_partkey::VARCHAR)) k, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) n FROM p)
SELECT l_returnflag, l_linestatus, l_partkey FROM r WHERE k <= n // 10""",
    "edit_identity": """WITH c AS (SELECT l_suppkey % 25 AS cluster, count(*) FILTER (l_discount >= 0.05 AND l_returnflag = 'R') tp, count(*) FILTER (l_discount >= 0.05 AND l_returnflag <> 'R') fp, count(*) FILTER (l_discount < 0.05 AND l_returnflag = 'R') fn,
count(*) FILTER (l_discount < 0.05 AND l_quantity > 45 AND l_returnflag = 'R') r, count(*) FILTER (l_discount < 0.05 AND l_quantity > 45) a FROM lineitem GROUP BY 1) SELECT cluster, CAST(r * (2 * tp + fp + fn) - tp * a AS BIGINT) gain FROM c""",
}
