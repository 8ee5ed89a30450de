"""Queries over documents: words, grams, windows, spans, occurrences, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import keys, text
from tessella.operators import candidates
from tessella.operators.intervals import overlaps
from tessella.sources.tables import table


def _docs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *(cols or ("text",)))


def collapsed_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2(text.collapsed(F.col("text")), 256).alias("sha"))


def casefold_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2(text.casefold_collapsed("text"), 256).alias("casefold_sha"), F.sha2(text.nfkc_collapsed("text"), 256).alias("nfkc_sha"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.size(text.words(t)).alias("words"), F.size(text.latin_words(t)).alias("latin"), F.size(text.long_words(t)).alias("long"))


def word_5grams(spark: SparkSession, d: str) -> DataFrame:
    g = text.word_grams(text.words(F.lower("text")))
    return _docs(spark, d).select("doc_id", F.explode(g).alias("gram"))


def bare_dois(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "units")
    return u.select("uid", "doi").distinct().select("uid", keys.bare_doi(F.col("doi")).alias("bare"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.filter(F.split("text", " "), lambda w: w != "").alias("tokens"))


def token_windows_1000_800(spark: SparkSession, d: str) -> DataFrame:
    """Characters stand for tokens, so that texts have more than one window."""
    chars = _docs(spark, d).where("text is not null").select("doc_id", F.filter(F.split("text", ""), lambda c: c != "").alias("tokens"))
    return candidates.token_windows(chars).select("doc_id", "window_id", "start", "end", F.size("window_tokens").alias("n"))


def chunks_510_384(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return _docs(spark, d).where("text is not null").select("doc_id", F.inline(candidates.chunk_starts(n))).withColumnsRenamed({"a": "begin", "b": "end"})


def window_owner_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Sentence ends are the members of groups; each group comes out of its first window only."""
    chars = _docs(spark, d).where("text is not null").withColumn("tokens", F.split("text", ""))
    w = candidates.token_windows(chars).select("doc_id", "start", "end")
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.pmod(F.col("l_partkey") * 7, F.lit(3000)).cast("int").alias("a"), F.pmod(F.col("l_suppkey") * 11, F.lit(3000)).cast("int").alias("b")).distinct()
    g = t.join(w, "doc_id").where((F.least("a", "b") >= F.col("start")) & (F.greatest("a", "b") < F.col("end")))
    return g.where(candidates.owned(F.col("start"), F.array(F.col("a") + 1, F.col("b") + 1))).select("doc_id", "a", "b", "start")


def span_candidates_le32(spark: SparkSession, d: str) -> DataFrame:
    """Spans of up to 32 words, counted per document by number of words."""
    pieces = F.transform("tokens", lambda w, i: F.struct((i * 2).alias("a"), (i * 2 + 1).alias("b")))
    t = _tokens(spark, d).where("size(tokens) > 0").select("doc_id", pieces.alias("offsets"))
    s = candidates.span_candidates(t, ["doc_id"], "offsets")
    return s.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("begin")).cast("long").alias("width"))


def directed_pair_population(spark: SparkSession, d: str) -> DataFrame:
    """All ordered pairs of an order's parts, itself included, with the sums of their geometry."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    p = candidates.directed_pairs(o, ["l_orderkey"], "parts")
    return p.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.count_if(F.col("i") == F.col("j")).alias("diagonal"), F.sum(F.when(F.col("head") < F.col("tail"), 1).otherwise(0)).cast("long").alias("rising"))


def pair_geometry(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    g = candidates.pair_geometry(a, a + 5, b, b + 9)
    return e.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(g[i], 9).alias(n) for i, n in enumerate(("distance", "overlap", "head_width", "tail_width"))])


def union_widths(spark: SparkSession, d: str) -> DataFrame:
    """Days that an order's shipments of three days each cover."""
    day = F.datediff("l_shipdate", F.lit("1990-01-01"))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(day.alias("a"), (day + 3).alias("b"))).alias("s"))
    return o.select("l_orderkey", candidates.union_width(F.col("s")).alias("days"))


def interval_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Annotated T segments against words of fixed length: how many words each touches."""
    from tessella.plans.annotations import p6_loaded

    t = p6_loaded(spark, d).where("kind = 'T'").select("doc_id", "row_id", F.inline("segments"))
    w = _docs(spark, d).where("text is not null").select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(7))).alias("begin")).withColumn("end", F.col("begin") + 7)
    return overlaps(t, w, ["doc_id"], ("a", "b"), ("begin", "end")).groupBy("doc_id").agg(F.count("*").alias("overlaps"), F.sum(F.least("b", "end") - F.greatest("a", "begin")).cast("long").alias("shared"))


def role_products(spark: SparkSession, d: str) -> DataFrame:
    """Role products of orders by the flags of their lines, enumerated and by formula."""
    role = lambda c, n: F.array_sort(F.collect_set(F.when(c, F.col("l_partkey")))).alias(n)
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(role(F.col("l_returnflag") == "A", "cn"), role(F.col("l_returnflag") == "N", "pn"), role(F.col("l_returnflag") == "R", "pv"), role(F.col("l_linestatus") == "F", "cond"))
    size = candidates.role_product_size(F.col("cn"), F.col("pn"), F.col("pv"), F.col("cond"))
    rows = candidates.role_product(o.withColumn("formula", size), "cn", "pn", "pv", "cond")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("enumerated"), F.max("formula").alias("formula"))


def overlapping_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", text.occurrences(F.col("text"), F.lit("en")).alias("at")).select("doc_id", F.size("at").alias("n"), F.get("at", F.lit(0)).alias("first"), F.get("at", F.lit(2)).alias("third"))


def anchored_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Labels whose first title word some occurrence of which lies in the document's first half."""
    s = table(spark, d, "subjects").select("subject", F.lower(F.substring_index("title", " ", 1)).alias("quote"))
    labels = table(spark, d, "subject_labels").select("doc_id", F.lower(F.trim("subject")).alias("subject")).distinct()
    m = _docs(spark, d).where("text is not null").join(labels, "doc_id").join(s, "subject")
    at = text.occurrences(F.lower("text"), F.col("quote"))
    return m.select("doc_id", "subject", F.contains(F.lower("text"), F.col("quote")).alias("literal"), F.exists(at, lambda x: x * 2 < F.length("text")).alias("anchored"))


def cue_positions(spark: SparkSession, d: str) -> DataFrame:
    cue = text.cue_positions(r"\d+(?:\.\d+)? (?:K|MPa|%)")
    return _docs(spark, d).select("doc_id", F.inline(cue("text")))


def document_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("doc_id").cast("string")
    return _docs(spark, d, "text").select("doc_id", text.sha_prefix(c).alias("cache_key"), text.parity_coin(c).alias("coin"), text.holds_credential(F.col("text")).alias("credential"), text.signed_log(F.col("doc_id") - 500).alias("slog"), text.backoff_seconds(F.pmod("doc_id", F.lit(9)).cast("int"), F.when(F.col("doc_id") % 4 == 0, F.lit(77))).alias("backoff"))


_TOK = "list_filter(string_split(text, ' '), lambda w: w <> '')"
QUERIES = {
    f.__name__: f
    for f in (
        collapsed_text, casefold_text, word_counts, word_5grams, bare_dois, token_windows_1000_800, chunks_510_384, window_owner_dedup, span_candidates_le32, directed_pair_population, pair_geometry,
        union_widths, interval_overlap_pairs, role_products, overlapping_occurrences, anchored_evidence, cue_positions, document_keys,
    )
}
SQL = {
    "collapsed_text": r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g'))) AS sha FROM documents",
    "word_counts": r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS INT) words, CAST(len(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{2,}')) AS INT) latin,
CAST(len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 2)) AS INT) long FROM documents""",
    "word_5grams": r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)""",
    "bare_dois": r"""WITH a AS (SELECT DISTINCT uid, doi, lower(regexp_replace(doi, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) y FROM units),
b AS (SELECT uid, doi, regexp_replace(y, '^(doi:|https?://(dx\.)?resolver\.example/)[\s\p{Z}]*', '') x FROM a)
SELECT uid, CASE WHEN regexp_full_match(x, '10\.[0-9]{4,9}/\S+') THEN x END AS bare FROM b""",
    "token_windows_1000_800": """SELECT doc_id, CAST(start / 800 AS INT) window_id, CAST(start AS INT) AS start, CAST(least(start + 1000, n) AS INT) AS "end", CAST(least(start + 1000, n) - start AS INT) n
FROM (SELECT doc_id, length(text) n, unnest(range(0, length(text), 800)) AS start FROM documents WHERE text IS NOT NULL)""",
    "chunks_510_384": """SELECT doc_id, CAST(s AS INT) AS begin, CAST(least(s + 510, n) AS INT) AS "end" FROM (SELECT doc_id, length(text) n, unnest(range(0, greatest(length(text), 1), 384)) s FROM documents WHERE text IS NOT NULL) WHERE s = 0 OR s - 384 + 510 < n""",
    "window_owner_dedup": """WITH w AS (SELECT doc_id, s, least(s + 1000, n) e FROM (SELECT doc_id, length(text) n, unnest(range(0, length(text), 800)) s FROM documents WHERE text IS NOT NULL)),
g AS (SELECT DISTINCT l_orderkey doc_id, CAST(l_partkey * 7 % 3000 AS INT) a, CAST(l_suppkey * 11 % 3000 AS INT) b FROM lineitem)
SELECT doc_id, a, b, CAST(min(s) AS INT) AS start FROM g JOIN w USING (doc_id) WHERE least(a, b) >= s AND greatest(a, b) < e GROUP BY ALL""",
    "span_candidates_le32": f"""WITH t AS (SELECT doc_id, len({_TOK}) n FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, n, unnest(range(1, least(n, 32) + 1)) k FROM t WHERE n > 0)
SELECT doc_id, CAST(sum(n - k + 1) AS BIGINT) spans, CAST(sum((n - k + 1) * (2 * k - 1)) AS BIGINT) width FROM s GROUP BY 1""",
    "directed_pair_population": """WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT a.l_orderkey, CAST(count(*) AS BIGINT) pairs, CAST(count(*) FILTER (a.l_partkey = b.l_partkey) AS BIGINT) diagonal, CAST(count(*) FILTER (a.l_partkey < b.l_partkey) AS BIGINT) rising
FROM p a JOIN p b USING (l_orderkey) GROUP BY 1""",
    "pair_geometry": """SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sign(l_suppkey - l_partkey) * ln(1 + abs(l_suppkey - l_partkey)), 9) AS distance, CASE WHEN l_partkey < l_suppkey + 9 AND l_partkey + 5 > l_suppkey THEN 1.0::DOUBLE ELSE 0 END AS overlap,
round(ln(6), 9) AS head_width, round(ln(10), 9) AS tail_width FROM lineitem""",
    "union_widths": """SELECT l_orderkey, CAST(count(DISTINCT day) AS INT) AS days FROM (SELECT l_orderkey, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + unnest([0, 1, 2]) AS day FROM lineitem) GROUP BY 1""",
    "role_products": """WITH o AS (SELECT l_orderkey, count(DISTINCT l_partkey) FILTER (l_returnflag = 'A') a, count(DISTINCT l_partkey) FILTER (l_returnflag = 'N') n, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') r, count(DISTINCT l_partkey) FILTER (l_linestatus = 'F') f FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(a * n * r * (f + 1) AS BIGINT) enumerated, CAST(a * n * r * (f + 1) AS BIGINT) formula FROM o WHERE a * n * r > 0""",
    "overlapping_occurrences": """WITH o AS (SELECT doc_id, list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 2) = 'en') pos FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(pos) AS INT) n, CAST(pos[1] AS INT) AS first, CAST(pos[3] AS INT) AS third FROM o""",
    "anchored_evidence": """WITH s AS (SELECT subject, lower(string_split(title, ' ')[1]) q FROM subjects), m AS (SELECT DISTINCT l.doc_id, s.subject, q, lower(text) t FROM subject_labels l JOIN s ON lower(trim(l.subject)) = s.subject JOIN documents d ON d.doc_id = l.doc_id WHERE text IS NOT NULL)
SELECT doc_id, subject, contains(t, q) AS literal, contains(t, q) AND (strpos(t, q) - 1) * 2 < length(t) AS anchored FROM m""",
    "document_keys": """SELECT doc_id, substr(sha256(doc_id::VARCHAR), 1, 20) cache_key, CAST('0x' || substr(sha256(doc_id::VARCHAR), 64, 1) AS INT) % 2 = 1 AS coin, regexp_matches(text, 'sk-[A-Za-z0-9]{32,}') AS credential,
sign(doc_id - 500) * ln(1 + abs(doc_id - 500)) AS slog, greatest(least(300.0::DOUBLE, 5 * pow(2.0, least(doc_id % 9, 6))), CASE WHEN doc_id % 4 = 0 THEN 77.0 ELSE 0 END) AS backoff FROM documents""",
}
