"""Event journals: reassembly of streamed replies, numbered attempts, and a streaming count of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replies(chunks: DataFrame, key: str, order: str, text: str, end: str) -> DataFrame:
    """``key, text, status``: chunks joined in order. ``status`` is complete, partial (no terminal event) or over (chunks after it).

    Only a complete reply has a text; a repeated order number counts once.
    """
    c = F.sort_array(F.collect_set(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(end), F.lit(False)).alias("e"))))
    g = chunks.where(F.col(key).isNotNull()).groupBy(key).agg(c.alias("c"))
    last = F.element_at("c", -1)["e"]
    ends = F.size(F.filter("c", lambda x: x["e"]))
    status = F.when(ends == 0, "partial").when(~last | (ends > 1), "over").otherwise("complete")
    joined = F.array_join(F.transform("c", lambda x: x["t"]), "")
    return g.select(key, F.when(status == "complete", joined).alias("text"), status.alias("status"))


def attempts(starts: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Start events with their number and whether it is within the cap."""
    from pyspark.sql import Window as W

    return starts.withColumn("attempt", F.row_number().over(W.partitionBy(key).orderBy(*order))).withColumn("allowed", F.col("attempt") <= most)


def journal_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def event_counts(events: DataFrame, stamp: str, kind: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by kind and tumbling window, for batches and (with a watermark) for streams alike."""
    e = events.withWatermark(stamp, late) if events.isStreaming else events
    g = e.groupBy(F.window(stamp, window), F.col(kind)).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), kind, "n")
