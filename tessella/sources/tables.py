"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.session import materialize


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Keys with several rows that are broadcast, counted first: one value each.
MOST_REPEATED = 1_000_000


def latest(df: DataFrame, key: str, stamp: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the latest by ``stamp``; rows of one stamp are ordered by their other values.

    Rows with a null key are dropped. The stamp itself isn't returned unless kept. Keys are counted alone first: where few have several rows, only
    those rows are shuffled, and the others, with their texts, stay where they are read.
    """
    keep = keep or [c for c in df.columns if c != key]
    order = ([F.col(stamp)] if stamp else []) + [F.col(c) for c in keep if c != stamp and not isinstance(df.schema[c].dataType, T.MapType)]
    best = F.max_by(F.struct(*keep), F.struct(*order)).alias("_row")
    rows = df.where(F.col(key).isNotNull())
    one = lambda x: x.groupBy(key).agg(best).select(key, "_row.*")
    again = materialize(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), "repeated")
    if again.count() > MOST_REPEATED:
        return one(rows)
    marked = F.broadcast(again)
    return rows.join(marked, key, "left_anti").select(key, *keep).unionByName(one(rows.join(marked, key, "left_semi")))
