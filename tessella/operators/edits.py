"""Edits of record graphs: differences, evidence gates, document-level pools, matched random choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def edit_id(operation: Column, key: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of the operation and the written key."""
    return F.substring(F.sha2(F.concat(operation, key), 256), 1, 16)


def graph_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys only in new (``add``) and only in old (``delete``); one shuffle for both. Null parts of a key are values."""
    k = old.select(*key, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*key, F.lit(0).alias("o"), F.lit(1).alias("n")))
    d = k.groupBy(*key).agg(F.max("o").alias("o"), F.max("n").alias("n")).where("o <> n")
    return d.select(*key, F.when(F.col("n") == 1, "add").otherwise("delete").alias("operation"))


def applied(old: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """The graph after edits: deletions out, additions in; distinct keys."""
    return old.select(*key).distinct().join(edits.where("operation = 'delete'").select(*key), key, "left_anti").unionByName(edits.where("operation = 'add'").select(*key)).distinct()


def guarded(edits: DataFrame, warned: Column, evidence: Column) -> DataFrame:
    """Deletions only where warned, additions only with evidence; a null guard is no."""
    return edits.where(((F.col("operation") == "delete") & F.coalesce(warned, F.lit(False))) | ((F.col("operation") == "add") & F.coalesce(evidence, F.lit(False))))


def quote_gate(old: DataFrame, new: DataFrame, key: list[str], valid: str, quoted: str) -> DataFrame:
    """Valid old records and quoted new ones; of one key the new record stays."""
    both = old.where(F.col(valid)).withColumn("_new", F.lit(0)).unionByName(new.where(F.col(quoted)).withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "_new")]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_new", *[F.col(c) for c in rest])).alias("_r")).select(*key, "_r.*")


def unique_verdicts(verdicts: DataFrame, edit: str) -> DataFrame:
    """Verdicts of edits judged exactly once; a contradicted edit has none."""
    once = verdicts.groupBy(edit).agg(F.count("*").alias("_n")).where("_n = 1").select(edit)
    return verdicts.join(once, edit, "left_semi")


def semantic_gate(edits: DataFrame, verdicts: DataFrame, edit: str, least: int, anchored: Column) -> DataFrame:
    """Edits with one verdict of at least ``least`` confidence, supporting them, with anchored evidence; uncertain ones abstain."""
    v = unique_verdicts(verdicts, edit).where((F.col("confidence") >= least) & (F.col("judgment") == "support") & F.coalesce(anchored, F.lit(False)))
    return edits.join(v.select(edit, "confidence"), edit)


def document_pool(copies: DataFrame, key: list[str], operation: str, confidence: str, eligible: str, window: str) -> DataFrame:
    """Edits of a document from those of its windows.

    An addition keeps the largest confidence of its eligible copies. A deletion needs every window that emitted it to have an
    eligible copy, and takes the least of the windows' largest confidences. Null eligibility is no.
    """
    ok = F.coalesce(F.col(eligible), F.lit(False))
    per = copies.groupBy(*key, operation, window).agg(F.max(F.when(ok, F.col(confidence))).alias("c"), F.bool_or(ok).alias("ok"))
    doc = per.groupBy(*key, operation).agg(F.max("c").alias("high"), F.min("c").alias("low"), F.bool_and("ok").alias("all"), F.bool_or("ok").alias("any"))
    keep = F.when(F.col(operation) == "delete", F.col("all")).otherwise(F.col("any"))
    return doc.where(keep).select(*key, operation, F.when(F.col(operation) == "delete", F.col("low")).otherwise(F.col("high")).alias(confidence))


def matched_choice(pool: DataFrame, strata: list[str], key: Column, budgets: DataFrame, budget: str = "budget", salt: str = "") -> DataFrame:
    """Of each stratum's edits as many as its budget, by the order of hashes. A stratum without a budget gives none."""
    rows = pool.join(budgets, strata).withColumn("_h", F.sha2(F.concat(F.lit(salt), key.cast("string")), 256))
    local = rows.withColumn("_s", F.spark_partition_id())
    first = local.withColumn("_r", F.row_number().over(W.partitionBy(*strata, "_s").orderBy("_h"))).where(F.col("_r") <= F.col(budget))
    return first.withColumn("_r", F.row_number().over(W.partitionBy(*strata).orderBy("_h"))).where(F.col("_r") <= F.col(budget)).drop("_h", "_s", "_r", budget)


def gain_numerator(tp: Column, fp: Column, fn: Column, added: Column, right: Column) -> Column:
    """Sign of an F1 change by edits that add ``added`` predictions net, ``right`` of them hits: right (2tp + fp + fn) - tp added."""
    return right * (2 * tp + fp + fn) - tp * added
