"""Problem 9: documents of several sources combined to target shares of the tokens.

Each document gets a hash-random key; documents are range-sorted by it within their source, distributed
prefix sums of their token counts run over each source, and each source is cut at its exact budget.
A source whose budget exceeds its tokens is repeated, whole epochs first, up to ``max_repeats`` uses of
a document; the cut falls in the last epoch.

The budget of a source is its share of ``total`` (default: all tokens of the named sources with documents). The cut never exceeds it,
and misses it by less than the document at the cut. A source that can't fill its budget, for want of
documents or of repeats, gives all it may, and the report shows its shortfall; nothing is moved to other sources.

Documents without source, with a source that isn't named, and without tokens are not used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.tokenize import DEFAULT, _arrow, _encode, vocabulary
from tessella.operators.prefix import prefix_sums
from tessella.session import materialize

#: Target rows are broadcast up to this number, counted first; more are joined by shuffle.
MOST_SOURCES = 10_000


def sized(documents: DataFrame, name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens``; the text is read once and never shuffled."""
    import pyarrow as pa
    from pyspark.sql import types as T

    path = vocabulary(name, folder)
    packed = documents.select(F.struct("doc_id", "source").alias("key"), "text")
    counted = _arrow(packed, "key", "text", [T.StructField("n_tokens", T.LongType())], lambda texts: [pa.array([len(i) for i in _encode(texts, path)], pa.int64())])
    return counted.select("key.doc_id", "key.source", "n_tokens")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, name: str = DEFAULT, folder: str | None = None) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The documents used, ``doc_id, source, n_tokens, repeats``, and a function that makes the report by source."""
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    few = t.count() <= MOST_SOURCES
    named = F.broadcast if few else lambda df: df
    docs = materialize(sized(documents, name, folder).where("source is not null and n_tokens > 0").join(named(t.select("source")), "source", "left_semi"), "sized")
    whole = docs.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("documents"))
    if total is None:
        total = docs.agg(F.sum("n_tokens")).first()[0] or 0
    plan = t.join(whole, "source", "left").fillna(0, ["available_tokens", "documents"])
    plan = plan.withColumn("budget_tokens", F.floor(F.col("target_share") * F.lit(total)).cast("long"))
    plan = plan.withColumn("epochs", F.when(F.col("available_tokens") > 0, F.least(F.floor(F.col("budget_tokens") / F.col("available_tokens")), F.col("max_repeats"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget_tokens") - F.col("epochs") * F.col("available_tokens")).otherwise(F.lit(0)))
    run = prefix_sums(docs.withColumn("h", F.xxhash64("doc_id", F.lit(seed))), "source", ["h", "doc_id"], "n_tokens")
    used = run.join(named(plan.select("source", "epochs", "rest")), "source")
    used = used.withColumn("repeats", (F.col("epochs") + (F.col("before") + F.col("n_tokens") <= F.col("rest")).cast("long")).cast("int")).where("repeats > 0")
    used = used.select("doc_id", "source", "n_tokens", "repeats")

    def report() -> DataFrame:
        taken = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("taken_tokens"), F.count("*").alias("used_documents"), F.max("repeats").alias("most_repeats"))
        out = plan.join(taken, "source", "left").fillna(0, ["taken_tokens", "used_documents", "most_repeats"])
        all_tokens = out.agg(F.sum("taken_tokens")).first()[0] or 0
        out = out.withColumn("all_tokens", F.lit(all_tokens)).select(
            "source", "target_share", "max_repeats", "documents", "available_tokens", "budget_tokens", "taken_tokens", "used_documents", "most_repeats",
            F.when(F.col("all_tokens") > 0, F.col("taken_tokens") / F.col("all_tokens")).otherwise(F.lit(0.0)).alias("actual_share"),
            (F.col("budget_tokens") - F.col("taken_tokens")).alias("shortfall_tokens"),
            (F.col("available_tokens") * F.col("max_repeats") >= F.col("budget_tokens")).alias("reachable"),
        )
        return out

    return used, report
