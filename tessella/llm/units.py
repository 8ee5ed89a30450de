"""The distinct units of a units table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.tables import latest, table


def distinct_units(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Units with a non-null norm_text, one row per uid (the latest delivery), with the columns asked for.

    ``ingested_at`` only orders deliveries; where a table lacks it, the largest row by value is kept.
    """
    u = table(spark, folder, "units").where("norm_text is not null and uid is not null")
    if "ingested_at" in u.columns:
        return latest(u.select("uid", *columns, "ingested_at"), "uid", "ingested_at").select("uid", *columns)
    return latest(u.select("uid", *columns), "uid").select("uid", *columns)
