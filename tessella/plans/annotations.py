"""Queries over annotation lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import linegrammar as g
from tessella.sources.tables import table

#: source, its id, its bytes, when it came, whether it holds native lines
SOURCES = (("native_records", "record_id", "raw", "received_at", True), ("emissions", "emission_id", "payload", "emitted_at", False))


def _checked(spark: SparkSession, d: str, src: str, row_id: str, raw: str, stamp: str, native: bool) -> DataFrame:
    lines = table(spark, d, src).where(F.col(row_id).isNotNull())
    return g.checked_lines(g.parsed_lines(lines, row_id, raw, native, stamp), lines, table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Broken lines with the first reason; of a line that came twice the latest delivery counts."""
    parts = []
    for src, *how in SOURCES:
        c = _checked(spark, d, src, *how).groupBy("row_id").agg(F.max_by("code", F.struct("stamp", "code")).alias("code")).where("code > 0")
        parts.append(c.select(F.lit(src).alias("src"), "row_id", g.reason(F.col("code")).alias("reason")))
    return parts[0].unionByName(parts[1])


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The sound native lines with their parts; a line that came twice comes out once."""
    c = _checked(spark, d, *SOURCES[0])
    parts = F.struct("doc_id", "kind", "id", "label", "spans", "arg1", "arg2", "trigger", "roles")
    one = c.groupBy("row_id").agg(F.max_by(F.struct("code", parts.alias("p")), F.struct("stamp", "code")).alias("r")).where("r.code = 0").select("row_id", "r.p.*")
    return one.withColumn("segments", g.segments(F.col("spans"))).withColumn("role_list", g.roles(F.col("roles"))).drop("spans", "roles")


QUERIES = {"p6_found": p6_found, "p6_loaded": p6_loaded}
SQL: dict[str, str] = {}
