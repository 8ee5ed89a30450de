"""Exact matching against enumeration, reachability with cycles, and native resolution."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.operators import records as R


def random_doc(rng, prefix, n_t=3, n_e=4):
    colour = {f"{prefix}T{i}": ("T", rng.choice("xy"), "0 1") for i in range(n_t)}
    events = [f"{prefix}E{i}" for i in range(n_e)]
    colour |= {e: ("E", rng.choice("ab")) for e in events}
    out = {e: [("trigger", rng.choice(sorted(c for c in colour if "T" in c)))] + [(rng.choice(["role p", "role q"]), rng.choice(sorted(colour))) for _ in range(rng.randrange(3))] for e in events}
    return {e: G.Closure(e, colour, out) for e in events}, {e: colour[e][1] for e in events}


def brute_isomorphisms(a, b):
    if len(a.nodes) != len(b.nodes):
        return []
    found = []
    for perm in itertools.permutations(b.nodes):
        m = dict(zip(a.nodes, perm, strict=True))
        if m[a.root] == b.root and all(a.colour[x] == b.colour[y] for x, y in m.items()) and {(m[u], m[v]): k for (u, v), k in a.edges.items()} == b.edges:
            found.append(m)
    return found


def brute_match(p, g, lp, lg):
    options = {x: [(y, m) for y in g if lp[x] == lg[y] for m in brute_isomorphisms(p[x], g[y])] for x in p}
    best = 0

    def go(roots, fwd, inv, used, n):
        nonlocal best
        best = max(best, n)
        if not roots:
            return
        go(roots[1:], fwd, inv, used, n)
        for y, m in options[roots[0]]:
            if y not in used and all(fwd.get(a, b) == b and inv.get(b, a) == a for a, b in m.items()):
                go(roots[1:], fwd | m, inv | {b: a for a, b in m.items()}, used | {y}, n + 1)

    go(list(p), {}, {}, frozenset(), 0)
    return best


def test_matching_equals_enumeration():
    rng = random.Random(5)
    shared = 0
    for _ in range(60):
        (p, lp), (g, lg) = random_doc(rng, ""), random_doc(rng, "")
        for a, b in itertools.product(p.values(), g.values()):
            got = list(G.isomorphisms(a, b, G.Steps()))
            want = brute_isomorphisms(a, b)
            assert sorted(map(repr, (sorted(m.items()) for m in got))) == sorted(map(repr, (sorted(m.items()) for m in want)))
        pairs, ids = G.global_match(p, g, lp, lg)
        assert len(set(ids.values())) == len(ids) and all(ids[a] == b for a, b in pairs)
        assert len(pairs) == brute_match(p, g, lp, lg)
        assert len(pairs) <= G.local_match(p, g, lp, lg)
        shared += len(pairs) < G.local_match(p, g, lp, lg)
    assert shared  # the sharing rule mattered somewhere


def test_budget_fails_rather_than_approximates():
    (p, lp), (g, lg) = random_doc(random.Random(1), ""), random_doc(random.Random(1), "")
    with pytest.raises(G.BudgetExceeded):
        G.global_match(p, g, lp, lg, budget=2)


def test_documents_over_budget_have_a_fault_and_others_their_counts(spark):
    row = lambda doc, gold, i, kind, trigger=None, roles=None, spans=None: (doc, gold, kind, i, "Doping", spans, None, None, trigger, roles, True)
    rows = []
    for gold in (False, True):
        rows += [row(1, gold, "T1", "T", spans="0 1"), row(1, gold, "E1", "E", "T1", "")]
        rows += [row(d, gold, f"T{i}", "T", spans="0 1") for d in (2, 3) for i in range(9)] + [row(d, gold, f"E{i}", "E", f"T{i}", f"Site:T{(i + 1) % 9}") for d in (2, 3) for i in range(9)]
    rows += [row(4, True, "T1", "T", spans="0 1"), row(4, True, "E1", "E", "T1", "")]
    df = spark.createDataFrame(rows, "doc int, gold boolean, kind string, id string, label string, spans string, arg1 string, arg2 string, trigger string, roles string, valid boolean")
    got = {r["doc"]: (r["tp"], r["fp"], r["fn"], r["local_tp"], r["fault"]) for r in G.match_documents(df, ["doc"], budget=20).collect()}
    assert got == {1: (1, 0, 0, 1, None), 2: (None, None, None, None, "budget_exceeded"), 3: (None, None, None, None, "budget_exceeded"), 4: (0, 0, 1, 0, None)}


def test_long_chains_need_no_recursion():
    colour = {f"E{i}": ("E", "a") for i in range(3000)} | {"T": ("T", "x", "0 1")}
    out = {f"E{i}": [("trigger", "T"), ("role p", f"E{i + 1}")] for i in range(2999)} | {"E2999": [("trigger", "T")]}
    c = G.Closure("E0", colour, out)
    assert len(next(G.isomorphisms(c, c, G.Steps()))) == 3001


def test_reachable(spark):
    edges = spark.createDataFrame([("d", 1, 2), ("d", 2, 3), ("d", 3, 1), ("d", 1, 3), ("e", 1, 9), ("d", 4, None), ("d", None, 4)], "doc string, a int, b int")
    roots = spark.createDataFrame([("d", 1), ("d", 4), ("e", 1), ("d", None)], "doc string, root int")
    got = {(r["doc"], r["root"], r["node"]) for r in G.reachable(edges, roots, "a", "b", ["doc"]).collect()}
    assert got == {("d", 1, 1), ("d", 1, 2), ("d", 1, 3), ("d", 4, 4), ("e", 1, 1), ("e", 1, 9)}
    assert G.reachable(edges.limit(0), roots.limit(0), "a", "b", ["doc"]).count() == 0


DDL = "doc long, occ int, id string, kind string, label string, segments array<struct<a:int,b:int>>, arg1 string, arg2 string, trigger string, role_list array<struct<role:string,target:string>>, valid boolean"


def rec(occ, id_, kind, label, seg=None, a1=None, a2=None, trig=None, roles=None, valid=True):
    return (1, occ, id_, kind, label, seg, a1, a2, trig, roles, valid)


def native(spark):
    rows = [
        rec(0, "T1", "T", "SC", [(0, 2)]), rec(1, "T2", "T", "Mystery", [(3, 3)]), rec(2, "T3", "T", "Doping", [(7, 12)]), rec(3, "T4", "T", "Element", [(13, 15)]),
        rec(4, "R1", "R", "Equivalent", a1="T1", a2="T4"), rec(5, "R2", "R", "Target", a1="T1", a2="T9"), rec(6, "R3", "R", "Odd", a1="T1", a2="T4"),
        rec(7, "E1", "E", "Doping", trig="T3", roles=[("Dopant2", "T4"), ("Site", "E2")]), rec(8, "E2", "E", "Doping", trig="T3", roles=[("Site", "E1")]),
        rec(9, "E3", "E", "Doping", trig="T3", roles=[("Extra", "T4")]), rec(10, "E4", "E", "Doping", trig="T3", roles=[("Site", "E3")]), rec(11, "E5", "E", "Doping", trig="E1"),
        rec(12, "T8", "T", "SC", [(0, 2)]), rec(13, "T8", "T", "SC", [(0, 3)]), rec(14, "R4", "R", "Condition", a1="E4", a2="T1"), rec(15, "*", "AUX", None), rec(16, "*", "AUX", None),
        rec(17, None, "T", None, valid=False), rec(18, "R5", "R", "Condition", a1="T4", a2="T1"),
    ]
    return spark.createDataFrame(rows, DDL)


def test_resolution(spark):
    got = {r["occ"]: r["issue"] for r in R.resolved(native(spark), gold=False).collect()}
    dangling = "dangling_or_invalid_dependency"
    assert got == {
        0: None, 1: "unsupported_prediction_label", 2: None, 3: None, 4: None, 5: dangling, 6: "unsupported_prediction_label", 7: None, 8: None, 9: "unsupported_prediction_role",
        10: dangling, 11: "event_trigger_not_T", 12: "duplicate_identifier", 13: "duplicate_identifier", 14: dangling, 15: None, 16: None, 17: "malformed", 18: None,
    }
    gold = {r["occ"]: r["issue"] for r in R.resolved(native(spark), gold=True).collect()}
    assert gold[1] is None and gold[9] is None and gold[10] is None and gold[14] is None and gold[5] == dangling


def test_keys_chains_inventory_and_mentions(spark):
    d = R.resolved(native(spark), gold=False)
    keys = {r["occ"]: r["key"] for r in R.relation_keys(d).collect()}
    assert keys[4] == "Equivalent|SC 0-2|Element 13-15" and keys[5] is None
    assert [(r["a"], r["b"]) for r in R.motif_chains(d).collect()] == [("T1", "T1")]
    inv = {(r["what"], r["name"]): r["n"] for r in R.inventory(d).collect()}
    assert inv["records", "T"] == 7 and inv["excess", "further_events_of_a_trigger"] == 1 and inv["roles", "Site"] == 2
    assert {r["occ"]: r["mention"] for r in R.unique_mentions(d).collect()} == {0: 0, 2: 1, 3: 2}
    assert R.resolved(native(spark).limit(0), gold=False).count() == 0


def test_emission_and_compilation(spark):
    m = spark.createDataFrame([("d", 0, "Doping", "0 2"), ("d", 1, "SC", "3 5"), ("d", 2, "Doping", "6 8")], "doc string, i int, type string, spans string")
    p = spark.createDataFrame([("d", 0, 1, "Dopant", 0.9), ("d", 0, 1, "Site", 0.1), ("d", 1, 0, "Target", 0.8), ("d", 1, 1, "Condition", 0.8), ("d", 2, 1, "Target", 0.2)], "doc string, h int, t int, label string, p double")
    got = [r["line"] for r in R.emitted_lines(m, p, 0.5, 0.5).orderBy("family", "number").collect()]
    assert got == ["E1\tDoping:T1 Dopant:T2", "E2\tDoping:T3", "R1\tTarget Arg1:T2 Arg2:E1", "R2\tCondition Arg1:T2 Arg2:T2", "T1\tDoping 0 2", "T2\tSC 3 5", "T3\tDoping 6 8"]
    good = '{"entities":[{"id":"T1","type":"SC","spans":[{"quote":"aa","occurrence":1}]},{"id":"T2","type":"S C","spans":[]},5],"relations":[{"id":"R1","type":"X","head":"T1","tail":"E2"}],"events":[]}'
    rows = [(1, "aaa", good), (2, "aaa", '{"entities":[],"entities":[]}'), (3, "aaa", '{"entities":[],"relations":[],"events":[]}'), (4, None, good), (5, "aaa", None), (6, "aaa", "{")]
    got = {r["k"]: r["g"] for r in spark.createDataFrame(rows, "k int, text string, graph string").select("k", R.compiled("text", "graph").alias("g")).collect()}
    assert got[2] is got[4] is got[5] is got[6] is None and got[3] == []
    assert [(e["family"], e["payload"]) for e in got[1]] == [("T", "T1\tSC 1 3"), ("T", "T2"), ("T", "5"), ("R", "R1\tX Arg1:T1 Arg2:E2")]


def test_cycles(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "b", "c"), (1, "d", "d"), (2, "a", "b")], "doc int, s string, t string")
    assert sorted((r["doc"], r["node"], r["cycle"]) for r in G.nested_cycles(e, "s", "t", ["doc"]).collect()) == [(1, "a", "a"), (1, "b", "a"), (1, "d", "d")]


def test_tickets(spark):
    t = '{"family":"T","operation":"add","issue":"i","recommendation":"r","uncertainty":"u","target_ids":["T1"],"source_witnesses":[]}'
    rows = [(1, f'{{"tickets":[{t},{t.replace(chr(105) + chr(34), chr(34), 1)}]}}'), (2, '{"tickets":[' + ",".join([t] * 13) + "]}"), (3, "oops"), (4, '{"x":1}'), (5, '{"tickets":[]}')]
    got = R.tickets(spark.createDataFrame(rows, "k int, raw string"), "raw", ["k"])
    assert sorted((r["k"], r["slot"], r["status"]) for r in got.where("slot is null").collect()) == [(2, None, "over_budget"), (3, None, "malformed"), (4, None, "no_ticket_list")]
    assert {(r["k"], r["slot"]) for r in got.where("slot is not null").collect()} == {(1, 0), (1, 1)}
    recs = spark.createDataFrame([(1, "T1"), (1, "T2")], "k int, id string")
    assert all(r["unique"] for r in R.ticket_targets(got, ["k"], recs, "k").collect())


def test_match_documents(spark):
    side = lambda gold: [(1, gold, "T", "T1", "SC", "0 2", None, None, None, None, True), (1, gold, "T", "T2", "Doping", "3 5", None, None, None, None, True), (1, gold, "E", "E1", "Doping", None, None, None, "T2", "Site:T1", True)]
    rows = side(True) + side(False) + [(1, False, "E", "E2", "Doping", None, None, None, "T2", "", False), (2, True, "E", "E1", "Doping", None, None, None, "T1", "", True), (2, True, "T", "T1", "Doping", "0 1", None, None, None, None, True)]
    df = spark.createDataFrame(rows, "doc long, gold boolean, kind string, id string, label string, spans string, arg1 string, arg2 string, trigger string, roles string, valid boolean")
    m = G.match_documents(df, ["doc"])
    got = {r["doc"]: (r["tp"], r["fp"], r["fn"], r["local_tp"], r["pairs"]) for r in m.collect()}
    assert G.witness_faults(df, m, ["doc"]).count() == 0
    wrong = m.withColumn("mapping", F.array(F.lit("E1=E1"), F.lit("T1=T2"), F.lit("T2=T2")))
    assert {r["fault"] for r in G.witness_faults(df, wrong.where("doc = 1"), ["doc"]).collect()} == {"not_injective", "colour", "edges"}
    assert got == {1: (1, 1, 0, 1, ["E1=E1"]), 2: (0, 0, 1, 0, [])}
    lines = R.lossless(spark.createDataFrame([(1, bytearray(b"\xff\x00a")), (2, None)], "k int, raw binary"), "raw", ["k"])
    assert {r["k"]: None if r["raw"] is None else bytes(r["raw"]) for r in R.restored(lines).collect()} == {1: b"\xff\x00a", 2: None}
