"""Prefix sums and ranks over sorted classes, without a window over a whole class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.session import materialize, parallelism


def prefix_sums(df: DataFrame, by: str, order: list[str], amount: str, partitions: int | None = None) -> DataFrame:
    """Adds ``rank`` (from 0) and ``before``: rows, and the sum of ``amount``, that precede a row in its class.

    Rows are range-partitioned by class and order, so a class of any size spreads over tasks. Each task
    adds its own running sums; the sums of whole tasks, one row per class and task met, give the rest. There are at
    most ``partitions`` plus the number of classes of those, and they are joined by broadcast only below Spark's limit.
    ``order`` should be unique within a class; ties are put in an arbitrary order. Null amounts count as 0.
    """
    n = partitions or parallelism(df.sparkSession)
    ranged = df.repartitionByRange(n, F.col(by), *[F.col(c) for c in order]).sortWithinPartitions(by, *order)
    schema = T.StructType([*df.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_rank", T.LongType()), T.StructField("_before", T.LongType())])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        last, rows, total = object(), 0, 0
        for b in batches:
            keys = b[by].to_numpy(dtype=object)
            sizes = b[amount].fillna(0).to_numpy(dtype=np.int64)
            ranks, befores = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            codes = pd.factorize(pd.Series(keys, dtype=object), use_na_sentinel=False)[0]
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(b)] if len(b) else []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                key = None if pd.isna(keys[i]) else keys[i]
                if key != last:
                    last, rows, total = key, 0, 0
                ranks[i:j] = rows + np.arange(j - i)
                sums = np.cumsum(sizes[i:j])
                befores[i:j] = total + sums - sizes[i:j]
                rows, total = rows + j - i, total + (int(sums[-1]) if j > i else 0)
            yield b.assign(_task=np.int32(task), _rank=ranks, _before=befores)

    done = materialize(ranged.mapInPandas(local, schema), "prefix")
    tasks = done.groupBy(by, "_task").agg((F.max("_rank") + 1).alias("_n"), F.max(F.col("_before") + F.coalesce(F.col(amount), F.lit(0))).alias("_sum"))
    from pyspark.sql import Window as W

    earlier = W.partitionBy(by).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = tasks.select(F.col(by).alias("_by"), F.col("_task").alias("_t"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_s0"))
    out = done.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_task") == F.col("_t")))
    return out.select(*df.columns, (F.col("_rank") + F.col("_n0")).alias("rank"), (F.col("_before") + F.col("_s0")).alias("before"))
