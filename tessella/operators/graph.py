"""Reachability and exact graph matching.

A root's closure is everything its record refers to, directly or through others. Two closures are equal if an isomorphism maps root to
root, keeps each node's colour (a T's mention, an E's or R's label) and each pair's multiset of edge kinds. The global match pairs predicted
with gold roots one to one so that all chosen isomorphisms together map every id to one id only, both ways, and takes as many pairs as possible.

Matching is exact or fails: beyond ``budget`` steps it raises, and a document's row has a fault instead of counts. It runs per document; what roots don't share nodes is solved apart.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.grouped import per_group
from tessella.session import materialize, release

BUDGET = 1_000_000
#: Tables of nodes first reached in a round that are kept apart.
MOST_FRONTS = 8


def reachable(edges: DataFrame, roots: DataFrame, src: str, dst: str, by: list[str], max_rounds: int = 10_000) -> DataFrame:
    """``by, root, node``: every node reachable from a root, itself included; cycles and shared paths are met once.

    One anti-join with what is known per round; rounds are as many as the longest shortest path. ``by`` keys (the document) keep joins apart.
    """
    e = materialize(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(*by, F.col(src).alias("node"), F.col(dst).alias("to")).distinct(), "edges")
    fronts = [materialize(roots.select(*by, F.col("root"), F.col("root").alias("node")).where("root is not null").distinct(), "front")]
    for _ in range(max_rounds):
        step = fronts[-1].join(e, [*by, "node"]).select(*by, "root", F.col("to").alias("node")).distinct()
        for f in fronts:
            step = step.join(f, [*by, "root", "node"], "left_anti")
        front = materialize(step, "front")
        if not front.take(1):
            release(front)
            return reduce(DataFrame.unionByName, fronts)
        fronts.append(front)
        if len(fronts) > MOST_FRONTS:  # rounds only add; the tables are merged now and then, so that each is rewritten once in so many rounds
            whole = materialize(reduce(DataFrame.unionByName, fronts[:-1]), "seen")
            for f in fronts[:-1]:
                release(f)
            fronts = [whole, fronts[-1]]
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


class BudgetExceeded(RuntimeError):
    """The exact search would take more steps than allowed; there is no partial result."""


class Steps:
    def __init__(self, limit: int = BUDGET):
        self.left = limit

    def tick(self) -> None:
        self.left -= 1
        if self.left < 0:
            raise BudgetExceeded


class Closure:
    """What one root reaches: nodes with colours, and the kinds of edges of each ordered pair."""

    def __init__(self, root: str, colour: dict[str, tuple], out: dict[str, list[tuple[str, str]]]):
        self.root = root
        nodes, todo = [root], [root]
        edges: dict[tuple[str, str], list[str]] = defaultdict(list)
        met = {root}
        self.parent: dict[str, str] = {}
        while todo:
            u = todo.pop()
            for kind, v in out.get(u, ()):
                edges[u, v].append(kind)
                if v not in met:
                    met.add(v)
                    self.parent[v] = u
                    nodes.append(v)
                    todo.append(v)
        self.nodes = nodes
        self.edges = {pair: tuple(sorted(kinds)) for pair, kinds in edges.items()}
        mark = {n: (colour[n], n == root) for n in nodes}
        for _ in range(min(len(nodes), 4)):  # refined by neighbourhoods: equal marks are necessary for equal places
            around: dict[str, list] = {n: [] for n in nodes}
            for (u, v), kinds in self.edges.items():
                around[u].append(("out", kinds, mark[v]))
                around[v].append(("in", kinds, mark[u]))
            mark = {n: hash((mark[n], tuple(sorted(map(repr, around[n]))))) for n in nodes}
        self.mark = mark
        self.signature = (len(nodes), len(self.edges), tuple(sorted(mark.values())))
        self.colour = {n: colour[n] for n in nodes}
        self.follow: dict[str, list[str]] = {n: [] for n in nodes}
        self.touch: dict[str, set[str]] = {n: set() for n in nodes}
        for u, v in self.edges:
            self.follow[u].append(v)
            self.touch[u].add(v)
            self.touch[v].add(u)


def isomorphisms(a: Closure, b: Closure, steps: Steps) -> Iterator[dict[str, str]]:
    """All isomorphisms of two closures that map root to root."""
    steps.tick()
    if a.signature != b.signature:
        return
    fwd: dict[str, str] = {}
    taken: set[str] = set()
    order = a.nodes  # each touches an earlier one

    def fits(n: str, m: str) -> bool:
        if m in taken or (m == b.root) != (n == a.root) or a.mark[n] != b.mark[m] or a.colour[n] != b.colour[m] or a.edges.get((n, n)) != b.edges.get((m, m)):
            return False
        near = [x for x in a.touch[n] if x in fwd]
        if len(near) != sum(y in taken for y in b.touch[m]):
            return False
        return all(a.edges.get((n, x)) == b.edges.get((m, fwd[x])) and a.edges.get((x, n)) == b.edges.get((fwd[x], m)) for x in near)

    tries = [iter([b.root])]
    while tries:
        n = order[len(tries) - 1]
        if n in fwd:
            taken.discard(fwd.pop(n))
        for m in tries[-1]:
            steps.tick()
            if fits(n, m):
                fwd[n] = m
                taken.add(m)
                if len(tries) == len(order):
                    yield dict(fwd)
                else:
                    tries.append(iter(b.follow[fwd[a.parent[order[len(tries)]]]]))
                break
        else:
            tries.pop()


def components(choices: dict[str, list[tuple[str, dict[str, str]]]]) -> list[list[str]]:
    """Predicted roots in groups that share no predicted or gold node with each other in any choice."""
    up: dict[str, str] = {r: r for r in choices}

    def find(x: str) -> str:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    owner: dict[tuple[str, str], str] = {}
    for r, options in choices.items():
        for _, mapping in options:
            for key in [("p", x) for x in mapping] + [("g", y) for y in mapping.values()]:
                up[find(r)] = find(owner.setdefault(key, r))
    groups = defaultdict(list)
    for r in choices:
        groups[find(r)].append(r)
    return list(groups.values())


def _best(roots: list[str], choices: dict[str, list[tuple[str, dict[str, str]]]], steps: Steps) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """Most compatible choices of one group: depth first with an undo trail, bounded by the gold roots still open."""
    roots = sorted(roots, key=lambda r: (len(choices[r]), r))
    ahead = [set(g for r in roots[i:] for g, _ in choices[r]) for i in range(len(roots) + 1)]
    fwd: dict[str, str] = {}
    inv: dict[str, str] = {}
    used: set[str] = set()
    chosen: list[tuple[str, str]] = []
    best: list[tuple[str, str]] = []
    ids: dict[str, str] = {}
    # a frame: which root, which of its options comes next (the last is to leave it out), what the option in force has added
    stack: list[list] = [[0, 0, None]]
    while stack:
        i, nxt, added = stack[-1]
        if added is not None:
            for x, y in added:
                del fwd[x], inv[y]
            used.discard(chosen.pop()[1])
            stack[-1][2] = None
        if len(chosen) > len(best):
            best, ids = list(chosen), dict(fwd)
        if i == len(roots) or nxt > len(choices[roots[i]]) or len(chosen) + min(len(roots) - i, len(ahead[i] - used)) <= len(best):
            stack.pop()
            continue
        steps.tick()
        stack[-1][1] = nxt + 1
        if nxt == len(choices[roots[i]]):
            stack.append([i + 1, 0, None])
            continue
        g, mapping = choices[roots[i]][nxt]
        if g in used or any(fwd.get(x, y) != y or inv.get(y, x) != x for x, y in mapping.items()):
            continue
        new = [(x, y) for x, y in mapping.items() if x not in fwd]
        for x, y in new:
            fwd[x], inv[y] = y, x
        used.add(g)
        chosen.append((roots[i], g))
        stack[-1][2] = new
        stack.append([i + 1, 0, None])
    return best, ids


def global_match(pred: dict[str, Closure], gold: dict[str, Closure], label_p: dict[str, str], label_g: dict[str, str], budget: int = BUDGET) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """Pairs of predicted and gold roots of a largest sharing-consistent match, and the ids' mapping that bears it."""
    steps = Steps(budget)
    by = defaultdict(list)
    for g, c in gold.items():
        by[label_g[g], c.signature].append(g)
    choices = {}
    for p, c in pred.items():
        options = [(g, m) for g in by[label_p[p], c.signature] for m in isomorphisms(c, gold[g], steps)]
        if options:
            choices[p] = options
    out: list[tuple[str, str]] = []
    ids: dict[str, str] = {}
    for group in components(choices):
        pairs, mapping = _best(group, choices, steps)
        out += pairs
        ids |= mapping
    return out, ids


def local_match(pred: dict[str, Closure], gold: dict[str, Closure], label_p: dict[str, str], label_g: dict[str, str], budget: int = BUDGET) -> int:
    """Root-local match: isomorphism is an equivalence, so it is the sum over classes of the smaller side."""
    steps = Steps(budget)
    classes: list[tuple[str, Closure]] = []
    count: list[Counter] = []
    for side, closures, labels in (("p", pred, label_p), ("g", gold, label_g)):
        for r, c in closures.items():
            for i, (lab, rep) in enumerate(classes):
                if lab == labels[r] and next(isomorphisms(c, rep, steps), None) is not None:
                    count[i][side] += 1
                    break
            else:
                classes.append((labels[r], c))
                count.append(Counter({side: 1}))
    return sum(min(c["p"], c["g"]) for c in count)


def closures(rows: pd.DataFrame, family: str) -> tuple[dict[str, Closure], dict[str, str]]:
    """Closures and labels of the valid roots of a family in one document's records."""
    colour: dict[str, tuple] = {}
    out: dict[str, list[tuple[str, str]]] = {}
    roots: dict[str, str] = {}
    for r in rows[rows["valid"].astype(bool)].to_dict("records"):
        if r["kind"] == "T":
            colour[r["id"]] = ("T", r["label"], r["spans"])
        elif r["kind"] in ("E", "R"):
            colour[r["id"]] = (r["kind"], r["label"])
            if r["kind"] == "E":
                out[r["id"]] = [("trigger", r["trigger"])] + [("role " + role, end) for role, end in (x.rsplit(":", 1) for x in (r["roles"] or "").split())]
            else:
                out[r["id"]] = [("Arg1", r["arg1"]), ("Arg2", r["arg2"])]
            if r["kind"] == family:
                roots[r["id"]] = r["label"]
    return {i: Closure(i, colour, out) for i in roots}, roots


RECORDS = ("kind", "id", "label", "spans", "arg1", "arg2", "trigger", "roles", "valid")


#: Matches a task remembers by the records they were made of, so that equal documents, as of several systems or settings, are matched once.
REMEMBERED = 4_096


def match_documents(records: DataFrame, key: list[str], family: str = "E", budget: int = BUDGET) -> DataFrame:
    """``key, tp, fp, fn, local_tp, pairs, mapping, fault`` of each document; ``records`` has both sides, ``gold`` telling them apart.

    Counts are over all records of the family, invalid ones too. ``spans`` and ``roles`` are written forms. A document without the family on
    either side comes out with zeros. Only valid records of documents with valid roots on both sides reach the search; the others are counted. A
    document whose search exceeds the budget has null counts and the fault ``budget_exceeded``: no part of a result is given.
    """
    mine, gold, valid = F.col("kind") == family, F.coalesce("gold", F.lit(False)), F.coalesce("valid", F.lit(False))
    n = records.groupBy(*key).agg(F.count_if(mine & ~gold).alias("_np"), F.count_if(mine & gold).alias("_ng"))
    each = W.partitionBy(*key)
    roots = lambda side: F.count_if(mine & valid & side).over(each) > 0
    placed = records.select(*key, "gold", *RECORDS).repartition(*key).withColumn("_both", roots(gold) & roots(~gold)).where(F.col("_both") & valid).drop("_both")
    memo: dict[tuple, tuple] = {}

    def work(k: tuple, rows: pd.DataFrame) -> list[tuple]:
        print_ = tuple(rows[["gold", *RECORDS]].itertuples(index=False, name=None))
        if print_ not in memo:
            if len(memo) >= REMEMBERED:
                memo.clear()
            g = rows["gold"].astype(bool)
            (cp, lp), (cg, lg) = closures(rows[~g], family), closures(rows[g], family)
            try:
                pairs, ids = global_match(cp, cg, lp, lg, budget)
                memo[print_] = (len(pairs), local_match(cp, cg, lp, lg, budget), sorted(f"{a}={b}" for a, b in pairs), sorted(f"{a}={b}" for a, b in ids.items()), None)
            except BudgetExceeded:
                memo[print_] = (None, None, None, None, "budget_exceeded")
        return [(*k, *memo[print_])]

    types = dict(records.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in key] + ["_tp long", "_local long", "_pairs array<string>", "_mapping array<string>", "fault string"])
    found = per_group(placed, key, work, schema, ["gold", "id"], placed=True)
    out = n.join(found, key, "left")
    exact = lambda c: F.when(F.col("fault").isNull(), c)
    tp, none = F.coalesce("_tp", F.lit(0).cast("long")), F.array().cast("array<string>")
    return out.select(
        *key, exact(tp).alias("tp"), exact(F.col("_np") - tp).alias("fp"), exact(F.col("_ng") - tp).alias("fn"), exact(F.coalesce("_local", F.lit(0).cast("long"))).alias("local_tp"),
        exact(F.coalesce("_pairs", none)).alias("pairs"), exact(F.coalesce("_mapping", none)).alias("mapping"), "fault",
    )


def record_edges(records: DataFrame, by: list[str]) -> DataFrame:
    """``by, id, edge, ref``: what valid R and E records refer to, and as what."""
    e = records.where("valid and kind in ('R', 'E')")
    fixed = F.when(F.col("kind") == "R", F.array(*[F.struct(F.lit(n).alias("edge"), F.col(c).alias("ref")) for n, c in (("Arg1", "arg1"), ("Arg2", "arg2"))])).otherwise(F.array(F.struct(F.lit("trigger").alias("edge"), F.col("trigger").alias("ref"))))
    named = F.transform(F.filter(F.split(F.coalesce("roles", F.lit("")), " "), lambda x: x != ""), lambda x: F.struct(F.concat(F.lit("role "), F.regexp_replace(x, ":[^:]*$", "")).alias("edge"), F.substring_index(x, ":", -1).alias("ref")))
    return e.select(*by, "id", F.inline(F.concat(fixed, F.when(F.col("kind") == "E", named).otherwise(F.array().cast("array<struct<edge:string,ref:string>>")))))


def witness_faults(records: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """Documents whose mapping isn't one to one, maps a node to one of another colour, or doesn't carry the edges of its nodes over; with ``fault``.

    Checks a match without trusting the search: joins and multiset differences only.
    """
    m = matches.select(*by, F.explode("mapping").alias("m")).select(*by, F.substring_index("m", "=", 1).alias("p"), F.substring_index("m", "=", -1).alias("g"))
    out = m.groupBy(*by, "g").count().where("count > 1").select(*by, F.lit("not_injective").alias("fault"))
    colour = F.concat_ws("|", "kind", "label", F.coalesce("spans", F.lit("")))
    side = lambda gold, a: records.where(F.col("valid") & (F.col("gold") == gold)).select(*by, F.col("id").alias(a), colour.alias(f"colour_{a}"))
    tinted = m.join(side(False, "p"), [*by, "p"], "left").join(side(True, "g"), [*by, "g"], "left").where(~F.col("colour_p").eqNullSafe(F.col("colour_g")) | F.col("colour_p").isNull())
    out = out.unionByName(tinted.select(*by, F.lit("colour").alias("fault")))
    ep, eg = (record_edges(records.where(F.col("gold") == g), by) for g in (False, True))
    name = m.select(*by, F.col("p").alias("id"), F.col("g").alias("gid"))
    over = ep.join(name, [*by, "id"]).join(m.select(*by, F.col("p").alias("ref"), F.col("g").alias("gref")), [*by, "ref"]).select(*by, F.col("gid").alias("id"), "edge", F.col("gref").alias("ref"))
    held = eg.join(m.select(*by, F.col("g").alias("id")), [*by, "id"], "left_semi")
    lost = over.exceptAll(held).unionByName(held.exceptAll(over)).select(*by, F.lit("edges").alias("fault"))
    return out.unionByName(lost).distinct()


def nested_cycles(edges: DataFrame, src: str, dst: str, by: list[str]) -> DataFrame:
    """Nodes that reach themselves, each with the least member of its cycle's component as ``cycle``."""
    e = edges.select(*by, F.col(src).alias("a"), F.col(dst).alias("b")).distinct()
    r = reachable(e, e.select(*by, F.col("b").alias("root")), "a", "b", by)
    back = e.join(r.select(*by, F.col("root").alias("b"), F.col("node").alias("a")), [*by, "a", "b"], "left_semi").select(*by, F.col("a").alias("n")).distinct()
    both = r.select(*by, F.col("root").alias("n"), F.col("node").alias("m")).join(r.select(*by, F.col("root").alias("m"), F.col("node").alias("n")), [*by, "n", "m"])
    return back.join(both, [*by, "n"]).groupBy(*by, F.col("n").alias("node")).agg(F.min("m").alias("cycle"))
