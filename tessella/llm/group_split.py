"""Problem 7: train, dev and test afresh, with no group of related units parted.

Units with one document_id or one bare DOI are related, also through others. The links between
documents and DOIs go through local union-find forests: each task reduces the links it reads, without a shuffle, to a
spanning forest, the forests of ``FAN_IN`` tasks are dealt to one task of the next level, and so on as long as a task's
share stays under ``TASK_LINKS``. A task gives its forest out and starts anew whenever it holds ``TASK_LINKS`` nodes, so none holds
more of them, whatever a DOI or a group has. A forest too large for the last task, over all that is left, can't be merged so: it is
finished by star contraction, which needs no task to hold a group.

Groups are then given away largest first, each to the split furthest below its target. Groups of one
size are given away together: the driver sees one row per size (at most the square root of twice the
units), and ranks within a size come from distributed prefix sums.

A unit without document_id and DOI is a group of its own. Its ``group_id`` is then ``unit:<uid>``, and that of a
group with DOIs only ``doi:<least bare DOI>``. Null uids are dropped; a uid delivered twice is one unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.keys import bare_doi
from tessella.llm.components import star_components
from tessella.operators.prefix import prefix_sums
from tessella.operators.skew import lookup_join
from tessella.session import materialize, parallelism, release

FAN_IN = 8
#: Links that one task holds at most when forests are merged; some 300 bytes each.
TASK_LINKS = 1_000_000
#: Ranks of groups of one size that meet their cut in one task.
RANKS = 100_000
RATIO = (("train", 80), ("dev", 10), ("test", 10))


def _forest(most: int):
    """Union-find over a task's links; gives a link from each node to the least of its tree, every ``most`` nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[str, str] = {}

        def find(x: str) -> str:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while (up := parent.get(x, x)) != root:
                parent[x], x = root, up
            return root

        def given() -> Iterator[pd.DataFrame]:
            out = [(x, r) for x in parent if x != (r := find(x))]
            for i in range(0, len(out), 100_000):
                yield pd.DataFrame(out[i : i + 100_000], columns=["a", "b"])

        for b in batches:
            for x, y in zip(b["a"].tolist(), b["b"].tolist(), strict=True):
                parent.setdefault(x, x)
                parent.setdefault(y, y)
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                if len(parent) >= most:
                    yield from given()
                    parent.clear()
        yield from given()

    return run


def forest_components(links: DataFrame, fan_in: int = FAN_IN, task_links: int = TASK_LINKS) -> DataFrame:
    """``node, group`` of string nodes linked by ``a, b``; group is the least node. Nulls, self-links and repeated links tie nothing."""
    links = links.where("a is not null and b is not null and a <> b")
    step = _forest(max(2, task_links))
    forest = materialize(links.mapInPandas(step, "a string, b string"), "forest")
    held = forest.count()
    tasks = max(parallelism(links.sparkSession), -(-held // task_links))
    while tasks > 1 and held <= task_links * -(-tasks // fan_in):
        tasks = -(-tasks // fan_in)
        merged = materialize(forest.repartition(tasks).mapInPandas(step, "a string, b string"), "forest")
        release(forest)
        forest, held = merged, merged.count()
    # with fewer links than half the bound the last task can't have started anew, so it has merged all
    if tasks > 1 or held >= task_links // 2:
        return star_components(forest, "a", "b")
    return forest.select(F.col("a").alias("node"), F.col("b").alias("group")).unionByName(forest.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct())


def related_groups(units: DataFrame, uid: str = "uid", document: str = "document_id", doi: str = "doi") -> DataFrame:
    """``uid, group_id`` of every unit; the group's id is its least document_id."""
    u = units.where(F.col(uid).isNotNull()).select(F.col(uid).alias("uid"), F.concat(F.lit("0"), F.col(document)).alias("d"), F.concat(F.lit("1"), bare_doi(F.col(doi))).alias("x"))
    u = u.withColumn("node", F.coalesce("d", "x", F.concat(F.lit("2"), F.col("uid").cast("string"))))
    links = u.where("d is not null and x is not null").select(F.col("d").alias("a"), F.col("x").alias("b"))
    groups = forest_components(links)
    sizes = u.groupBy("node").agg(F.count("*").alias("n"))
    named = materialize(sizes.join(groups, "node", "left").select("node", F.coalesce("group", "node").alias("group"), "n"), "named")
    total = named.agg(F.sum("n")).first()[0] or 0
    kind, rest = F.substring("group", 1, 1), F.expr("substring(group, 2)")
    group_id = F.when(kind == "0", rest).when(kind == "1", F.concat(F.lit("doi:"), rest)).otherwise(F.concat(F.lit("unit:"), rest))
    return lookup_join(u.select("uid", "node"), named, ["node"], "n", total).select("uid", group_id.alias("group_id"))


def parted_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group_id").agg(F.count("*").alias("n"))


def related_units(groups: DataFrame) -> DataFrame:
    """Units related to another: those in groups of two or more."""
    sizes = materialize(parted_sizes(groups).where("n > 1"), "groups")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return lookup_join(groups, sizes, ["group_id"], "n", total).select("uid", "group_id")


def give_away(sizes: list[tuple[int, int]], ratio: tuple[tuple[str, int], ...] = RATIO) -> list[tuple[int, list[int]]]:
    """For each size, largest first, how many of its groups go to each split.

    One by one, a group goes to the split furthest below its target; of equals, to the first. Long runs of
    one size are shared out in bulk: first each split takes what it lacks above a common level, then one by one.
    """
    total = sum(s * m for s, m in sizes)
    whole = sum(w for _, w in ratio)
    # gaps are kept as integers, times the sum of the weights
    gap = [total * w for _, w in ratio]
    out = []
    for size, many in sorted(sizes, reverse=True):
        took, step = [0] * len(ratio), size * whole
        if many > 1000:
            lo, hi = min(gap) - step * many, max(gap)
            need = lambda level: sum(max(0, (g - level) // step) for g in gap)
            while lo < hi:  # the lowest level at which no more than ``many`` are needed
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if need(mid) <= many else (mid + 1, hi)
            took = [max(0, (g - lo) // step) for g in gap]
            gap = [g - t * step for g, t in zip(gap, took, strict=True)]
        for _ in range(many - sum(took)):
            i = max(range(len(gap)), key=lambda k: (gap[k], -k))
            took[i] += 1
            gap[i] -= step
        out.append((size, took))
    return out


def assign_splits(groups: DataFrame, ratio: tuple[tuple[str, int], ...] = RATIO) -> DataFrame:
    """``uid, group_id, split``: every unit afresh, groups whole."""
    spark = groups.sparkSession
    sizes = materialize(parted_sizes(groups), "groups")
    per_size = [(r["n"], r["m"]) for r in sizes.groupBy("n").agg(F.count("*").alias("m")).collect()]
    plan = [(size, name, lo, lo + t) for size, took in give_away(per_size, ratio) for (name, _), t, lo in zip(ratio, took, [sum(took[:i]) for i in range(len(took))], strict=True) if t]
    cuts = spark.createDataFrame(plan, "n long, split string, lo long, hi long")
    ranked = prefix_sums(sizes.withColumn("h", F.xxhash64("group_id")), "n", ["h", "group_id"], "n").select("group_id", "n", "rank")
    # nearly all groups may have one size: they meet their cuts by size and block of ranks
    blocks = cuts.select(F.col("n").alias("size"), "split", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / RANKS), F.floor((F.col("hi") - 1) / RANKS))).alias("block"))
    ranked = ranked.withColumn("at", F.floor(F.col("rank") / RANKS))
    placed = ranked.join(blocks, (F.col("n") == F.col("size")) & (F.col("at") == F.col("block")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("group_id", "split", "n")
    total = sum(s * m for s, m in per_size)
    return lookup_join(groups, placed, ["group_id"], "n", total).select("uid", "group_id", "split")
