"""Overlap joins of half-open intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(left: DataFrame, right: DataFrame, key: list[str], l: tuple[str, str], r: tuple[str, str], width: int = 256) -> DataFrame:  # noqa: E741
    """Pairs with equal keys whose intervals share ground: ``la < rb and lb > ra``.

    Each interval goes to the buckets of ``width`` it touches, and the join is an equality join on key and bucket: a long
    document, even one with a third of all rows, spreads over its buckets. A pair comes out in the first bucket both touch.
    Intervals of no width overlap those that hold their point inside. Null bounds match nothing.
    """
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(a), F.col(b) - 1) / width)))
    ok = lambda df, a, b: df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(b) >= F.col(a)))
    x = ok(left, *l).withColumn("_bucket", bucket(*l))
    y = ok(right, *r).withColumn("_bucket", bucket(*r))
    first = F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / width)
    return x.join(y, [*key, "_bucket"]).where((F.col(l[0]) < F.col(r[1])) & (F.col(l[1]) > F.col(r[0])) & (F.col("_bucket") == first)).drop("_bucket")
