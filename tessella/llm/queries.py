"""The queries of the training-data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import components, edit_join, group_split, mixing, overlap, plain_form, setjoin, spans, subjects, tokenize
from tessella.llm.units import distinct_units
from tessella.functions.keys import plain_key
from tessella.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(distinct_units(spark, folder, ["norm_text"]))


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_shares(distinct_units(spark, folder, ["norm_text"]))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.similar_pairs(table(spark, folder, "grams")).select("left_uid", "right_uid")


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.similar_pairs(table(spark, folder, "grams"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.similar_classes(table(spark, folder, "grams"))


def p2_between(spark: SparkSession, folder: str) -> DataFrame:
    """Units of train and of the other splits, as two tables, whose gram sets overlap."""
    split = distinct_units(spark, folder, ["split"]).select("uid", plain_key(F.col("split")).alias("split"))
    grams = table(spark, folder, "grams")
    side = lambda *names: grams.join(split.where(F.col("split").isin(*names)).select("uid"), "uid", "left_semi")
    return setjoin.similar_between(side("train"), side("dev", "test"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(distinct_units(spark, folder, ["split", "corpus", "doi", "norm_text"]))
    return pairs.select(*overlap.ordered(F.col("eval_uid"), F.col("train_uid"))).distinct()


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(distinct_units(spark, folder, ["split", "corpus", "doi", "norm_text"]))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_classes(distinct_units(spark, folder, ["split", "corpus", "doi", "norm_text"]))


def p3_short(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs across splits of texts of under 20 words whose plain forms are within two edits."""
    u = distinct_units(spark, folder, ["split", "norm_text"])
    return edit_join.near_short_pairs(u.select("uid", plain_key(F.col("split")).alias("split"), plain_form.plain_form("norm_text").alias("plain_text")), overlap.LEAST_WORDS)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return plain_form.print_alike_pairs(distinct_units(spark, folder, ["norm_text"]))


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    units = plain_form.with_plain_form(distinct_units(spark, folder, ["norm_text", "norm_sha"]), "norm_text")
    return units.select("uid", "plain_text", "plain_sha", F.coalesce(F.col("norm_sha") != F.col("plain_sha"), F.lit(True)).alias("rewritten"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    return plain_form.alike_classes(distinct_units(spark, folder, ["norm_text"]))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "pairs").where(plain_key(F.col("kind")).isin(*components.TYING))
    return components.star_components(pairs, "left_uid", "right_uid").select(F.col("node").alias("uid"), F.col("group").alias("group_uid"))


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return group_split.related_groups(distinct_units(spark, folder, ["document_id", "doi"]))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return group_split.related_units(_groups(spark, folder))


def p7_splits(spark: SparkSession, folder: str) -> DataFrame:
    return group_split.assign_splits(_groups(spark, folder))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    s = p7_splits(spark, folder)
    return s.groupBy("split").agg(F.count("*").alias("units"), F.countDistinct("group_id").alias("groups"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode(table(spark, folder, "documents"))


def p8_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.offsets(table(spark, folder, "documents"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.decoded(tokenize.encode(table(spark, folder, "documents")))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]()


def _subject_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("documents", "subject_labels", "subjects")]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.document_subjects(*_subject_tables(spark, folder))


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subject_shares(*_subject_tables(spark, folder))


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by area, and the area's share of the corpus with each document counting as one."""
    s = p10_shares(spark, folder)
    return s.groupBy("subject").agg(F.count_if(F.col("share") >= subjects.LEAST).alias("documents"), F.round(F.sum("share"), 6).alias("document_equivalents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_UNITS = "u AS (SELECT uid, norm_text, document_id, doi FROM units WHERE norm_text IS NOT NULL AND uid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ingested_at DESC NULLS LAST) = 1)"
_SETS = "g AS (SELECT DISTINCT uid, gram FROM grams WHERE uid IS NOT NULL AND gram IS NOT NULL), z AS (SELECT uid, count(*) AS c FROM g GROUP BY 1)"
_MET = f"""WITH {_SETS}, i AS (SELECT a.uid AS l, b.uid AS r, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.uid < b.uid JOIN z x ON x.uid = a.uid JOIN z y ON y.uid = b.uid WHERE 5 * least(x.c, y.c) >= 4 * greatest(x.c, y.c) GROUP BY ALL),
m AS (SELECT l AS left_uid, r AS right_uid, n AS intersection_count, x.c + y.c - n AS union_count FROM i JOIN z x ON x.uid = l JOIN z y ON y.uid = r WHERE 5 * n >= 4 * (x.c + y.c - n))"""
_TIED = f"""t AS (SELECT DISTINCT left_uid AS a, right_uid AS b FROM pairs WHERE lower(trim(kind)) IN ({', '.join(f"'{k}'" for k in components.TYING)}) AND left_uid <> right_uid), e AS (SELECT a, b FROM t UNION SELECT b, a FROM t)"""
#: Windows of 30 words by text, and the words they cover.
_SHARED = f"""WITH {_UNITS}, w AS (SELECT uid, list_filter(string_split(norm_text, ' '), lambda x: x <> '') AS w FROM u), p AS (SELECT uid, i, sha256(array_to_string(w[i:i + 29], ' ')) AS h FROM (SELECT uid, w, unnest(range(1, len(w) - 28)) AS i FROM w WHERE len(w) >= 30)),
r AS (SELECT h FROM p GROUP BY h HAVING min(uid) <> max(uid)), m AS (SELECT uid, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY uid ORDER BY i), -99) + 30 THEN 1 ELSE 0 END AS fresh FROM p WHERE h IN (SELECT h FROM r)),
k AS (SELECT uid, i, sum(fresh) OVER (PARTITION BY uid ORDER BY i) AS run FROM m), s AS (SELECT uid, CAST(min(i) - 1 AS INT) AS first_word, CAST(max(i) - min(i) + 30 AS INT) AS n_words FROM k GROUP BY uid, run)"""
#: Documents and DOIs of units, and the least document each reaches.
_RELATED = rf"""WITH RECURSIVE {_UNITS}, x AS (SELECT uid, '0' || document_id AS d, CASE WHEN regexp_full_match(y, '10\.[0-9]{{4,9}}/\S+') THEN '1' || y END AS o
FROM (SELECT uid, document_id, regexp_replace(lower(regexp_replace(doi, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '^(doi:|https?://(dx\.)?resolver\.example/)[\s\p{{Z}}]*', '') AS y FROM u)),
n AS (SELECT uid, coalesce(d, o, '2' || uid) AS node FROM x), l AS (SELECT DISTINCT d AS a, o AS b FROM x WHERE d IS NOT NULL AND o IS NOT NULL), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.seen), c AS (SELECT node, min(seen) AS grp FROM reach GROUP BY 1),
q AS (SELECT uid, coalesce(grp, node) AS grp FROM n LEFT JOIN c USING (node)), v AS (SELECT uid, CASE grp[1] WHEN '0' THEN substr(grp, 2) WHEN '1' THEN 'doi:' || substr(grp, 2) ELSE 'unit:' || substr(grp, 2) END AS group_id FROM q)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the problems that it can say; the others are tested against brute force."""
    return {
        "p1_found": f"{_SHARED} SELECT uid, first_word, n_words FROM s",
        "p1_shares": f"""{_SHARED}, t AS (SELECT uid, CAST(sum(n_words) AS BIGINT) AS shared_words, count(*) AS spans FROM s GROUP BY 1) SELECT uid, CAST(len(w) AS INT) AS words, coalesce(shared_words, 0) AS shared_words, CAST(coalesce(spans, 0) AS BIGINT) AS spans,
CASE WHEN len(w) > 0 THEN coalesce(shared_words, 0) / CAST(len(w) AS DOUBLE) ELSE 0.0 END AS shared_share FROM w LEFT JOIN t USING (uid)""",
        "p2_found": f"{_MET} SELECT left_uid, right_uid FROM m",
        "p2_counts": f"{_MET} SELECT * FROM m",
        "p2_classes": f"""{_MET}, same AS (SELECT left_uid, right_uid FROM m WHERE intersection_count = union_count), c AS (SELECT uid, coalesce(min(left_uid), uid) AS class_uid FROM z LEFT JOIN same ON right_uid = uid GROUP BY uid), k AS (SELECT class_uid, count(*) AS members FROM c GROUP BY 1),
e AS (SELECT DISTINCT x.class_uid AS a, y.class_uid AS b FROM m JOIN c x ON x.uid = left_uid JOIN c y ON y.uid = right_uid WHERE x.class_uid <> y.class_uid), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), f AS (SELECT a AS class_uid, count(*) AS n FROM b GROUP BY 1)
SELECT uid, class_uid, CAST(members AS BIGINT) AS members, CAST(coalesce(n, 0) AS BIGINT) AS linked_classes FROM c JOIN k USING (class_uid) LEFT JOIN f USING (class_uid) WHERE members > 1 OR n > 0""",
        "p2_between": f"""{_MET}, v AS (SELECT uid, lower(trim(split)) AS side FROM units WHERE norm_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ingested_at DESC NULLS LAST) = 1), b AS (SELECT * FROM m UNION ALL SELECT right_uid, left_uid, intersection_count, union_count FROM m)
SELECT left_uid, right_uid, intersection_count, union_count FROM b JOIN v x ON x.uid = left_uid JOIN v y ON y.uid = right_uid WHERE x.side = 'train' AND y.side IN ('dev', 'test')""",
        "p5_found": f"WITH RECURSIVE {_TIED}, r AS (SELECT a AS uid, a AS seen FROM e UNION SELECT r.uid, e.b FROM r JOIN e ON e.a = r.seen) SELECT uid, min(seen) AS group_uid FROM r GROUP BY 1",
        "p7_found": f"{_RELATED} SELECT uid, group_id FROM v QUALIFY count(*) OVER (PARTITION BY group_id) > 1",
    }
