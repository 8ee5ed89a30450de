"""Python over whole groups, streamed through sorted partitions instead of one call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def per_group(df: DataFrame, key: list[str], work: Callable[[tuple, pd.DataFrame], list[tuple]], schema: str, order: list[str] = (), batch: int = 2000, placed: bool = False) -> DataFrame:
    """``work(key, rows)`` of each group gives tuples of ``schema``.

    One shuffle by key, none if ``df`` is ``placed`` by it already; a task holds one group at a time. Only for groups that are one record's own parts, as the lines of one document.
    """
    names = [f.strip().split(" ")[0] for f in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        now: tuple | None = None
        out: list[tuple] = []
        for b in batches:
            if not len(b):
                continue
            keys = list(zip(*[b[k].astype(object).where(b[k].notna(), None) for k in key], strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[lo] != now:
                    if held:
                        out += work(now, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True))
                    held, now = [], keys[lo]
                held.append(b.iloc[lo:hi])
            if len(out) >= batch:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held:
            out += work(now, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True))
        if out:
            yield pd.DataFrame(out, columns=names)

    return (df if placed else df.repartition(*key)).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def _fields(ddl: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(ddl[last:i])
            last = i + 1
    return [*out, ddl[last:]]
