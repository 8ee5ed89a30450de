"""Operators on odd tables: hand values, boundaries, nulls, ties, repeats, empties and clashing names."""

import itertools
import io
import json
import zipfile
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import keys, text
from tessella.operators import candidates, checks, dedup, edits, intervals, prefix, retrieve, sample, score, select, skew, stats
from tessella.sources import files
from tessella.streaming import journal, pacing


def vals(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# ---- scoring


def test_set_and_multiset(spark):
    p = spark.createDataFrame([("a", 1, True), ("a", 1, True), ("b", 1, True), (None, 1, True), ("c", 1, False)], "k string, by int, ok boolean")
    g = spark.createDataFrame([("a", 1), ("c", 1), (None, 1), ("d", 1)], "k string, by int")
    assert vals(score.set_counts(p, g, ["k", "by"], ["by"]), "tp", "fp", "fn") == [(3, 1, 1)]
    assert vals(score.set_counts(p, g, ["k", "by"], ["by"], valid="ok"), "tp", "fp", "fn") == [(2, 2, 2)]
    assert vals(score.multiset_counts(p, g, ["k", "by"], ["by"]), "tp", "fp", "fn", "conserved") == [(3, 2, 1, True)]
    assert score.set_counts(p.limit(0), g.limit(0), ["k", "by"], ["by"]).count() == 0
    assert vals(score.prf(spark.createDataFrame([(0, 0, 0), (2, 1, 1)], "tp long, fp long, fn long")), "f1") == [(0.0,), (pytest.approx(2 / 3),)]


def test_symmetry_ceiling_is_the_optimum(spark):
    import itertools

    nodes = [(a, b) for a in range(3) for b in range(3) if a != b]
    for k in (1, 2, 4):
        for e in list(itertools.combinations(nodes, k))[::3]:
            r = score.symmetry_ceiling(spark.createDataFrame([(*x, "l") for x in e], "h int, t int, label string"), "h", "t", ["label"]).first()
            pairs = {frozenset(x) for x in nodes}
            best = max(2 * tp / (2 * tp + fp + fn) for n in range(1, 4) for c in itertools.combinations(pairs, n) if (tp := sum(frozenset(x) in c for x in e)) is not None and (fp := 2 * n - tp) is not None and (fn := len(e) - tp) is not None)
            assert 2 * r["tp"] / (2 * r["tp"] + r["fp"] + r["fn"]) == pytest.approx(best)


# ---- inference


def pairs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "c int, tp_a long, fp_a long, fn_a long, tp_b long, fp_b long, fn_b long")


HAND = [(2, 0, 0, 0, 2, 2), (3, 0, 0, 0, 3, 3), (1, 0, 0, 0, 1, 1)]


def test_exchange_by_hand(spark):
    r = stats.exchange_exact(pairs(spark, HAND), "c").first()
    assert (r["assignments"], r["hits"], r["p"]) == (8, 2, 0.25)
    assert stats.exchange_exact(pairs(spark, [tuple(3 * v for v in r) for r in HAND]), "c").first()["p"] == 0.25
    assert stats.exchange_exact(pairs(spark, [r[:3] * 2 for r in HAND]), "c").first()["p"] == 1
    assert stats.exchange_exact(pairs(spark, [(0,) * 6] * 7), "c").first()["p"] == 1
    big = 10**14
    assert stats.exchange_exact(pairs(spark, [tuple(big * v for v in r) for r in HAND]), "c").first()["p"] == 0.25
    near = [(big, 0, 0, big, 0, 0), (big, 1, 0, big, 0, 0), (big, 0, 0, big, 1, 0), (big, 0, 1, big, 0, 1)]  # ties that doubles can't tell
    assert stats.exchange_exact(pairs(spark, near), "c").first()["p"] == 1
    for scale in (1, big):
        rows = [(7 * scale, 1, 2, 7 * scale, 5, 2), (scale, 2, 0, scale, 3, 0), (5 * scale, 1, 1, 5 * scale + 1, 0, 0), (scale, 0, 0, scale, 0, 0)]
        f1 = lambda x: Fraction(2 * x[0], 2 * x[0] + x[1] + x[2])
        apart = []
        for mask in range(16):
            sides = [[sum(r[i + (3 if (mask >> k & 1) == side else 0)] for k, r in enumerate(rows)) for i in range(3)] for side in (1, 0)]
            apart.append(abs(f1(sides[0]) - f1(sides[1])))
        assert stats.exchange_exact(pairs(spark, rows), "c").first()["hits"] == sum(x >= apart[0] for x in apart) < 16
    with pytest.raises(stats.UnequalSupport):
        stats.exchange_exact(pairs(spark, [(1, 0, 0, 1, 0, 1)]), "c")
    with pytest.raises(ValueError):
        stats.exchange_exact(pairs(spark, [(1, 0, 0, 0, 0, 1)] * 21), "c")


def test_monte_carlo_floor_and_streams(spark):
    p = pairs(spark, [(1, 0, 0, 0, 0, 1)] * 100)
    r = stats.exchange_draws(p, "c", stats.hash_swaps(p, "c", 500, "x"), 500).first()
    assert r["p"] >= 1 / 501 and r["clusters"] == 100
    same = pairs(spark, [(1, 1, 0, 1, 1, 0)] * 30)
    assert stats.exchange_draws(same, "c", stats.hash_swaps(same, "c", 50, "x"), 50).first()["p"] == 1
    m, d = stats.numpy_masks({"a": 1}, 30, 200)
    assert m.shape == (200, 30) and stats.numpy_masks({"a": 1}, 30, 200)[1] == d != stats.numpy_masks({"a": 2}, 30, 200)[1]
    s = stats.swaps_table(spark, m, list(range(30)), "c")
    assert s.count() == int(m.sum())


def test_holm(spark):
    df = spark.createDataFrame([("f", 0, 0.01), ("f", 1, 0.03), ("f", 2, 0.04), ("g", 0, 0.9), ("g", 1, 0.9)], "f string, o int, p double")
    got = {(r["f"], r["o"]): round(r["holm"], 12) for r in stats.holm(df, ["f"], "p", "o").collect()}
    assert got == {("f", 0): 0.03, ("f", 1): 0.06, ("f", 2): 0.06, ("g", 0): 1.0, ("g", 1): 1.0}
    assert stats.holm_exact([Fraction(1, 100), Fraction(3, 100), Fraction(4, 100)]) == [Fraction(3, 100), Fraction(6, 100), Fraction(6, 100)]


def test_budget_moments_equal_enumeration(spark):
    import itertools

    pool = [("add", k in {5, 6}) for k in (5, 4, 10, 11, 6)] + [("del", k in {1}) for k in (1, 8, 9)]
    budgets = {"add": 2, "del": 1}
    hits = [sum(h for _, h in a) + sum(h for _, h in b) for a in itertools.combinations([x for x in pool if x[0] == "add"], 2) for b in itertools.combinations([x for x in pool if x[0] == "del"], 1)]
    r = stats.budget_moments(spark.createDataFrame([(o, h, budgets[o]) for o, h in pool], "o string, h boolean, b int"), ["o"], "b", "h").first()
    assert r["mean_hits"] == pytest.approx(np.mean(hits)) and r["variance_hits"] == pytest.approx(np.var(hits))
    assert stats.choice_bits(5, 2) == pytest.approx(np.log2(10))


def test_bootstrap(spark):
    counts = spark.createDataFrame([(c, s, c + 1, 1, 2) for c in range(6) for s in "ab"], "c int, s string, tp long, fp long, fn long")
    picks = stats.hash_picks(counts, "c", 100, "x")
    assert picks.count() == 600
    got = vals(stats.bootstrap(counts, "c", ["s"], picks), "s", "lower", "upper", "draws")
    assert got[0][1:] == got[1][1:] and 0 < got[0][1] < got[0][2] < 1 and got[0][3] == 100


# ---- text


def test_text_functions(spark):
    df = spark.createDataFrame([("aaa", "aa"), ("abc", ""), (None, "a"), ("x🙂y🙂", "🙂"), ("", "a")], "t string, q string")
    assert [r[0] for r in df.select(text.occurrences(F.col("t"), F.col("q"))).collect()] == [[0, 1], [], None, [1, 3], []]
    assert [r[0] for r in df.select(text.nth_occurrence(F.col("t"), F.col("q"), F.lit(1))).collect()] == [1, None, None, 3, None]
    g = spark.createDataFrame([(["a", "b", "a", "b", "a", "b"],), (["a"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in g.select(text.word_grams(F.col("t"), 3)).collect()] == [["a b a", "b a b"], [], [], None]
    s = spark.createDataFrame([("Straße  ﬁ ",), (None,)], "t string").select(text.casefold_collapsed("t").alias("a"), text.nfkc_collapsed("t").alias("b"), text.collapsed(F.col("t")).alias("c")).collect()
    assert tuple(s[0]) == ("strasse ﬁ".casefold(), "strasse fi", "straße ﬁ") and tuple(s[1]) == (None, None, None)
    c = spark.createDataFrame([("1,3–5",), ("7",), ("5-3",), ("x",), (None,)], "t string").select(text.citation_numbers(F.col("t"))).collect()
    assert [r[0] for r in c] == [[1, 3, 4, 5], [7], None, None, None]
    j = spark.createDataFrame([('{"b":1,"a":"é"}',), ('{"a":1,"a":2}',), ("[NaN]",), ("{",), (None,)], "t string").select(text.strict_json_fault("t"), text.canonical_json("t")).collect()
    assert [tuple(r) for r in j] == [(None, '{"a":"\\u00e9","b":1}'), ("duplicate_key", None), ("not_finite", None), ("malformed", None), (None, None)]
    k = spark.createDataFrame([("Dopant12",), ("Site",), ("Sites",), (None,)], "r string").select(text.base_role(F.col("r"))).collect()
    assert [r[0] for r in k] == ["Dopant", "Site", "Sites", None]
    f = spark.createDataFrame([("```json\n{}\n```",), ("{}",)], "t string").select(text.without_fence(F.col("t"))).collect()
    assert [r[0] for r in f] == ["{}", "{}"]
    p = spark.createDataFrame([("5 K 6 K",), (None,)], "t string").select(text.cue_positions(r"\d K")("t")).collect()
    assert [(x["begin"], x["end"]) for x in p[0][0]] == [(0, 3), (4, 7)] and p[1][0] is None
    paths = spark.createDataFrame([("a/b.txt",), ("../a",), ("/a",), ("a//b",), ("a/./b",), ("c:\\x",)], "t string").select(text.safe_path(F.col("t"))).collect()
    assert [r[0] for r in paths] == [True, False, False, False, False, False]
    d = spark.createDataFrame([("DOI: 10.1234/A b",), (" https://dx.resolver.example/10.1234/A ",), ("10.12/x",), ("",), (None,)], "d string").select(keys.bare_doi(F.col("d"))).collect()
    assert [r[0] for r in d] == [None, "10.1234/a", None, None, None]


# ---- candidates


def test_windows_chunks_spans(spark):
    df = spark.createDataFrame([(1, list(range(1700))), (2, []), (3, [1])], "d int, tokens array<int>")
    assert vals(candidates.token_windows(df), "d", "window_id", "start", "end") == [(1, 0, 0, 1000), (1, 1, 800, 1700), (1, 2, 1600, 1700), (3, 0, 0, 1)]
    n = spark.createDataFrame([(600,), (510,), (0,), (894,), (895,)], "n int").select(candidates.chunk_starts(F.col("n"))).collect()
    assert [[tuple(x) for x in r[0]] for r in n] == [[(0, 510), (384, 600)], [(0, 510)], [(0, 0)], [(0, 510), (384, 894)], [(0, 510), (384, 894), (768, 895)]]
    s = spark.createDataFrame([(1, [(0, 2), (2, 3), (4, 6)]), (2, [(0, 0), (0, 2), (2, 2)]), (3, [])], "d int, o array<struct<a:int,b:int>>")
    assert candidates.span_candidates(s.where("d = 1"), ["d"], "o").count() == 6
    assert vals(candidates.span_candidates(s.where("d > 1"), ["d"], "o"), "first", "last", "begin", "end") == [(1, 1, 0, 2)]
    w = spark.createDataFrame([([(0, 3), (2, 5), (9, 9), (8, 10)],), ([],)], "s array<struct<a:int,b:int>>").select(candidates.union_width(F.col("s"))).collect()
    assert [r[0] for r in w] == [7, 0]


def test_role_product_size_and_members(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["p"], ["v", "w"], ["x"]), (2, ["a"], [], ["v"], []), (3, ["a"], ["p"], ["v"], [])], "d int, cn array<string>, pn array<string>, pv array<string>, cond array<string>")
    sizes = {r["d"]: r["n"] for r in df.select("d", candidates.role_product_size(*[F.col(c) for c in ("cn", "pn", "pv", "cond")]).alias("n")).collect()}
    got = candidates.role_product(df, "cn", "pn", "pv", "cond")
    assert {d: got.where(f"d = {d}").count() for d in (1, 2, 3)} == sizes == {1: 8, 2: 0, 3: 1}
    m = df.where("d = 1").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("i"), "cn", "pn", "pv", "cond").select(candidates.product_member(F.col("i"), *[F.col(c) for c in ("cn", "pn", "pv", "cond")]).alias("m")).select("m.*")
    assert {tuple(r) for r in m.collect()} == {tuple(r) for r in got.where("d = 1").select("cn", "pn", "pv", "cond").collect()}
    cov = candidates.covered_groups(spark.createDataFrame([(1, "g", ["a", "z"]), (1, "h", ["a", "b"]), (2, "k", ["q"])], "d int, k string, m array<string>"), spark.createDataFrame([(1, ["a", "b"]), (1, ["z"])], "d int, w array<string>"), "d", "k", "m", "w")
    assert vals(cov, "k", "covered") == [("g", False), ("h", True), ("k", False)]


def test_overlaps_against_brute_force(spark):
    rng = np.random.default_rng(1)
    a = [(int(k), int(x), int(x + w)) for k, x, w in zip(rng.integers(0, 2, 80), rng.integers(0, 900, 80), rng.integers(0, 700, 80), strict=True)] + [(0, 5, 5), (1, None, 3), (0, 9, 2)]
    b = [(int(k), int(x), int(x + w)) for k, x, w in zip(rng.integers(0, 2, 80), rng.integers(0, 900, 80), rng.integers(0, 9, 80), strict=True)]
    l, r = spark.createDataFrame(a, "k int, a int, b int"), spark.createDataFrame(b, "k int, c int, d int")  # noqa: E741
    want = sorted((k, x, y, c, d) for k, x, y in a if x is not None and y >= x for k2, c, d in b if k == k2 and x < d and y > c)
    assert vals(intervals.overlaps(l, r, ["k"], ("a", "b"), ("c", "d"), 64), "k", "a", "b", "c", "d") == sorted(want, key=repr)


# ---- duplicates, skew, prefix sums


def test_pairs_within_salts_hot_keys(spark):
    rows = [(1, i) for i in range(60)] + [(2, 100), (None, 101), (None, 102), (3, 103), (3, 104)]
    df = spark.createDataFrame(rows, "k int, uid int")
    got = vals(skew.pairs_within(df, ["k"], "uid", block=7), "left_uid", "right_uid")
    assert len(got) == len(set(got)) == 60 * 59 // 2 + 1
    between = skew.pairs_between(df, spark.createDataFrame([(1, 900 + i) for i in range(20)], "k int, uid int"), ["k"], "uid", block=6)
    assert between.count() == 1200 == between.distinct().count()
    at = skew.attach(spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "key int, v string"), "key", df, "k", "uid", "m", block=5)
    assert at.count() == 61
    keyed = df.groupBy("k").agg(F.count("*").alias("n"), F.lit("v").alias("v"))
    for most in (1, 4096):
        assert skew.lookup_join(df, keyed, ["k"], "n", 65, most).count() == 63 and skew.semi_join(df, keyed, ["k"], "n", 65, most).count() == 63


def test_hot_keys_spread_without_adaptive_execution(spark):
    """A third of the rows has one key: no task gets more than its share and a bound."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n, parts = 30_000, int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
        keyed = df.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("v"))
        got = skew.lookup_join(df, keyed, ["k"], "n", n, rows=1000)
        tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == n and max(tasks) < 1.2 * n / parts
        few = spark.range(40).select(F.lit(0).cast("long").alias("k"), F.col("id").alias("other"))
        cells = skew.grid_join(df, few, ["k"], block=500, rows=1000)
        tasks = [r["count"] for r in cells.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == n // 3 * 40 and max(tasks) < 2 * n // 3 * 40 / parts
        once = skew.pairs_within(df.where("id < 3000"), ["k"], "id", block=100, rows=100)
        tasks = [r["count"] for r in once.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 1000 * 999 // 2 and max(tasks) < 2 * 1000 * 999 // 2 / parts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_near_pairs_and_clusters(spark):
    sets = {1: range(20), 2: range(1, 21), 3: range(3, 23), 4: [100], 5: [100], 6: range(5000)}
    rows = [(u, f"g{v}") for u, s in sets.items() for v in s] + [(1, "g0"), (None, "g1"), (4, None)]
    got = vals(dedup.near_pairs(spark.createDataFrame(rows, "uid int, gram string"), "uid", "gram"), "left_uid", "right_uid", "intersection_count", "union_count")
    assert got == [(1, 2, 19, 21), (2, 3, 18, 22), (4, 5, 1, 1)]
    nodes = spark.createDataFrame([(i,) for i in range(40)] + [(3,), (None,)], "uid int")
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 25)] + [(30, 31), (31, 30), (5, 5), (6, 99), (None, 1)], "a int, b int")
    got = dict(vals(dedup.clusters(nodes, "uid", e, "a", "b"), "uid", "cluster"))
    assert got == {**{i: 0 for i in range(26)}, **{i: i for i in range(26, 40)}, 31: 30}


def test_clusters_of_a_long_chain(spark):
    """A chain whose neighbours' numbers are far apart, of which labels pass one link a round."""
    order = sorted(range(1, 400), key=lambda i: i * 7919 % 401) + [0]
    chain = [c for pair in zip(range(400, 800), range(1199, 799, -1), strict=True) for c in pair] + order
    e = spark.createDataFrame(list(zip(chain[:-1], chain[1:], strict=True)), "a int, b int")
    got = dict(vals(dedup.clusters(spark.createDataFrame([(i,) for i in range(1201)], "uid int"), "uid", e, "a", "b", 12), "uid", "cluster"))
    assert got == {**dict.fromkeys(range(1200), 0), 1200: 1200}


def test_exact_pairs_and_overlap(spark):
    u = spark.createDataFrame([(1, "s", "test", "x", None), (2, "s", "test", "x", ""), (3, "o", "train", "x", ""), (4, "o", None, "x", "d")], "uid int, corpus string, split string, a string, b string")
    assert vals(dedup.exact_pairs(u, "uid", {"A": "a", "B": "b"}, "s"), "kind", "left_uid", "right_uid") == [("A", 1, 2), ("A", 1, 3), ("A", 1, 4), ("A", 2, 3), ("A", 2, 4)]
    assert vals(dedup.split_overlap(u, "split", "a"), "left_split", "right_split", "shared") == [("test", "train", 1)]
    assert vals(dedup.conflicts(u, "a", ["corpus"]), "a", "corpus_values") == [("x", 2)]


@pytest.mark.parametrize("parts", [1, 4])
def test_prefix_sums(spark, parts):
    rows = [(k, i, (i * 7) % 5) for k in ("a", "b", None) for i in range(50)] + [("a", 99, None)]
    df = spark.createDataFrame(rows, "k string, i int, n int")
    got = prefix.prefix_sums(df, "k", ["i"], "n", parts).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [x for x in rows if x[0] == r["k"] and x[1] < r["i"]]
        assert (r["rank"], r["before"]) == (len(before), sum(x[2] or 0 for x in before))
    assert prefix.prefix_sums(df.limit(0), "k", ["i"], "n", parts).count() == 0


# ---- retrieval, selection, edits, sampling


def test_retrieval_ties_and_groups(spark):
    docs = spark.createDataFrame([(0, ["a", "b"], "g"), (1, ["a", "b"], "h"), (2, ["a", "b"], "h"), (3, ["a", "c"], None), (4, [], "h"), (5, None, "h"), (6, ["z"], "k")], "d int, t array<string>, g string")
    got = vals(retrieve.top_hits(retrieve.tfidf(docs, "d", "t"), "d", F.col("d") == 0, docs, "g", 2), "hit", "rank")
    assert got == [(1, 1), (3, 2)]


def test_selection_ties(spark):
    g = spark.createDataFrame([("s", 1, 1, 1, 0.5, 1), ("s", 2, 2, 2, 0.5, 2), ("s", 1, 1, 1, 0.7, 3), ("s", 1, 1, 1, 0.7, 2)], "s string, tp long, fp long, fn long, threshold double, epoch int")
    assert vals(select.best_threshold(g, ["s"]), "threshold", "epoch", "fp") == [(0.7, 2, 1)]
    e = g.selectExpr("s", "tp", "fp", "fn", "threshold", "1 as wrong_added", "epoch as correct_deleted", "0 as correct_added", "0 as wrong_deleted")
    assert vals(select.best_edit_threshold(e, ["s"]), "threshold", "correct_deleted") == [(0.5, 1)]
    names = spark.createDataFrame([("s", 0, 0, 0, "a"), ("s", 0, 0, 0, "b")], "s string, tp long, fp long, fn long, name string")
    assert vals(select.best_control(names, ["s"], "name"), "name") == [("b",)]
    assert select.hash_topological([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], ["d", "c", "b", "a"])[::3] == ["a", "d"]
    with pytest.raises(ValueError):
        select.hash_topological([("a", "b"), ("b", "a")], ["a", "b"])
    s = select.hash_subset(spark.range(100).withColumn("g", F.col("id") % 3), ["g"], F.col("id"), 4)
    assert s.count() == 12 and vals(s, "id") == vals(select.hash_subset(spark.range(100).repartition(7).withColumn("g", F.col("id") % 3), ["g"], F.col("id"), 4), "id")


def test_f1_keys_order_counts_of_any_size(spark):
    from fractions import Fraction

    big = 2**61
    rows_ = [(1, 1, 1), (2, 2, 2), (0, 0, 0), (0, 5, 5), (7, 0, 0), (big // 2, 3, 4), (big // 2 - 1, 3, 4), (big // 2, 3, 5), (big // 2 + 1, 4, 4), (10**9, 10**9 - 1, 1), (10**9 - 1, 10**9 - 1, 0), (3, 0, 0)]
    f1 = lambda t, p, n: Fraction(2 * t, 2 * t + p + n) if t + p + n else Fraction(0)
    df = spark.createDataFrame(rows_, "tp long, fp long, fn long")
    keys = [tuple(r) for r in df.select(*select.f1_key()).collect()]
    for i, j in itertools.product(range(len(rows_)), repeat=2):
        assert (keys[i] < keys[j]) == (f1(*rows_[i]) < f1(*rows_[j])) and (keys[i] == keys[j]) == (f1(*rows_[i]) == f1(*rows_[j])), (rows_[i], rows_[j])


def test_edits(spark):
    old, new = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string")
    diff = edits.graph_diff(old, new, ["k"])
    assert vals(diff, "k", "operation") == sorted([("c", "add"), ("a", "delete"), (None, "delete")], key=repr)
    assert edits.guarded(diff, F.lit(None).cast("boolean"), F.lit(True)).count() == 1
    c = spark.createDataFrame([("x", "add", 3, True, 1), ("x", "add", 5, True, 2), ("x", "add", 9, False, 2), ("y", "delete", 4, True, 1), ("y", "delete", 2, True, 2), ("y", "delete", 3, True, 2), ("z", "delete", 4, True, 1), ("z", "delete", 4, None, 2)], "k string, op string, c int, ok boolean, w int")
    assert vals(edits.document_pool(c, ["k"], "op", "c", "ok", "w"), "k", "op", "c") == [("x", "add", 5), ("y", "delete", 3)]
    v = spark.createDataFrame([("e1", "support", 5), ("e2", "support", 5), ("e2", "reject", 5), ("e3", "support", 3), ("e4", "uncertain", 5)], "e string, judgment string, confidence int")
    assert vals(edits.semantic_gate(spark.createDataFrame([(f"e{i}",) for i in range(1, 6)], "e string"), v, "e", 4, F.lit(True)), "e") == [("e1",)]
    q = edits.quote_gate(spark.createDataFrame([("a", "old", True), ("b", "old", False)], "k string, v string, valid boolean"), spark.createDataFrame([("a", "new", True), ("c", "new", False)], "k string, v string, quoted boolean"), ["k"], "valid", "quoted")
    assert vals(q, "k", "v") == [("a", "new")]


def test_sampling(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id", (F.col("id") % 100 < 2).alias("pos"))
    s = sample.with_negatives(df, ["g"], "pos", F.col("id"))
    assert vals(s.groupBy("g", "pos").count(), "g", "pos", "count") == [(0, False, 200), (0, True, 50), (1, False, 200), (1, True, 50)]
    p = sample.sha_permutation(50, b"x")
    assert sorted(p) == list(range(50)) and p == sample.sha_permutation(50, b"x") != sample.sha_permutation(50, b"y")
    assert len(set(sample.drawn_indices(b"s", 1000, 10))) == 10 and len(sample.drawn_indices(b"s", 3, 10)) == 3
    d = sample.permuted_within(spark.createDataFrame([(k, i, i * 10) for k in "ab" for i in range(9)], "k string, i int, v int"), ["k"], "i", "v", "s").collect()
    assert sorted(r["donor_v"] for r in d if r["k"] == "a") == [10 * i for i in range(9)]
    x = sample.sampled_product(spark.createDataFrame([(1, 10**9), (2, 3), (3, 0)], "k int, n long"), ["k"], "n", 5).groupBy("k").agg(F.countDistinct("index").alias("c"))
    assert vals(x, "k", "c") == [(1, 5), (2, 3)]
    pv, (lo, hi) = sample.permutation_and_bootstrap(np.array([[2, 0, 0], [3, 0, 0]]), np.array([[0, 2, 2], [0, 3, 3]]), 50)
    assert 1 / 51 <= pv <= 1 and lo <= hi


def test_sampled_product_of_little_more_than_the_wanted(spark):
    df = spark.range(4).select("id", (F.col("id") + 301).alias("n"))
    got = sample.sampled_product(df, ["id"], "n", 300).groupBy("id").agg(F.countDistinct("index").alias("c"), F.count("*").alias("all"), F.max(F.col("index") - F.col("n")).alias("over"))
    assert got.where("c = 300 and all = 300 and over < 0").count() == 4


# ---- checks, files, streams


def test_checks(spark):
    a, e = spark.createDataFrame([(1,), (1,), (2,), (9,)], "k int"), spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert vals(checks.population(a, e, ["k"]), "k", "fault") == [(1, "repeated"), (3, "missing"), (9, "unexpected")]
    with pytest.raises(checks.Broken):
        checks.require_empty(checks.covered_once(a, e, "k"), "map")
    checks.require_empty(checks.population(e, e, ["k"]), "same")
    c = spark.createDataFrame([("x", 1, 2), ("x", 2, 1), ("y", 1, 1), ("y", 2, 2)], "b string, tp long, fn long")
    assert vals(checks.constant_support(c, ["b"]), "b") == [("y",)]
    assert vals(checks.conservation(c, spark.createDataFrame([("x", 3, 3), ("y", 3, 4)], "b string, tp long, fn long"), ["b"], ["tp", "fn"]), "b") == [("y",)]
    p = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, float("nan")), (4, None), (7, 0.9)], "k int, p double")
    assert vals(checks.outside_candidates(p, spark.createDataFrame([(i,) for i in range(1, 5)], "k int"), ["k"], "p", 0.1), "k") == [(2,), (3,), (4,), (7,)]
    assert vals(checks.equal_within(p, p.withColumn("p", F.col("p") + 1e-3), ["k"], ["p"]), "k") == [(1,), (2,), (3,), (7,)]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_bytes("héé".encode())
    (tmp_path / "a/x.ann").write_bytes(b"T1\tSC 0 1\n\nT2\tS\xff 0 1\r\n")
    docs = files.annotation_documents(spark, str(tmp_path / "a"))
    assert docs.first()["text"] == "héé" and [bytes(r["raw"]) for r in files.annotation_lines(docs).orderBy("occurrence").collect()] == [b"T1\tSC 0 1", b"T2\tS\xff 0 1\r"]
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("top.txt", "top")
        z.writestr("in.zip", inner.getvalue())
    got = {r["member"]: bytes(r["content"]) for r in files.zip_members(spark, str(tmp_path / "o.zip")).collect()}
    assert got == {"top.txt": b"top", "in.zip!deep.txt": b"deep"}
    m = files.manifest(spark, str(tmp_path / "a"))
    assert {r["path"] for r in m.collect()} == {"x.txt", "x.ann"}
    content = spark.createDataFrame([("x.txt", bytearray(b"other")), ("new", bytearray(b""))], "path string, content binary")
    assert vals(checks.manifest_faults(content, m), "path", "fault") == [("new", "unlisted"), ("x.ann", "missing"), ("x.txt", "digest" if len("héé".encode()) == 5 else "size")]
    (tmp_path / "l.jsonl").write_text('{"a":1}\n\n{"a":2,"z":0}\n{"a":\n')
    assert vals(files.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").where("a is not null"), "a") == [(1,), (2,)]
    with pytest.raises(Exception):  # noqa: B017
        files.json_lines(spark, str(tmp_path / "l.jsonl"), "a int", gold=True).collect()
    (tmp_path / "d.json").write_text(json.dumps([{"a": 1, "b": {"c": "x"}, "big": "y" * 99}, {"a": 2}]))
    assert vals(files.json_array_projection(spark, str(tmp_path / "d.json"), "a int"), "a") == [(1,), (2,)]
    (tmp_path / "c.csv").write_bytes(b"\xef\xbb\xbfk,v\n1,x\n2,\n")
    assert vals(files.csv_table(spark, str(tmp_path / "c.csv"), "k int, v string", ["k"]), "k") == [(1,), (2,)]
    df = spark.range(5)
    assert files.write_once(df, str(tmp_path / "w")) == "written" and files.write_once(df, str(tmp_path / "w")) == "same"
    with pytest.raises(FileExistsError):
        files.write_once(spark.range(6), str(tmp_path / "w"))
    copy, digest = files.snapshot(df, str(tmp_path / "s"))
    assert digest == files.digest(df.repartition(3)) and copy.count() == 5
    ch = spark.createDataFrame([("f", 2, bytearray(b"cd")), ("f", 0, bytearray(b"ab"))], "k string, o long, c binary")
    assert bytes(files.reassembled(ch, "k", "o", "c").first()["c"]) == b"abcd"
    with pytest.raises(Exception):  # noqa: B017
        files.reassembled(ch.where("o > 0"), "k", "o", "c").collect()
    na = spark.createDataFrame([(1, ([1, 2], ["a", "b"]))], "d int, n struct<i:array<int>,v:array<string>>")
    assert vals(files.struct_of_arrays(na, "n", ["i", "v"], ["d"]), "d", "i", "v") == [(1, 1, "a"), (1, 2, "b")]


def test_pacing_by_hand():
    p = pacing.Pace(150_000, 30, 150_000)
    p.entries = [[100.0, 140_000]]
    assert p.wait(110, 20_000) == 50 and p.wait(160, 20_000) == 0
    p.cooldown_until = 170
    assert p.wait(110, 1) == 60
    big = pacing.Pace(100, 30, 100)
    assert big.wait(0, 500) == 0  # alone, an oversize request may go
    big.admit(0, 500)
    assert big.wait(1, 1) == 59
    big.done(2, 0, 40, rate_failure=True, retry_after=100)
    assert big.tokens == 50 and big.cooldown_until == 102
    grow = pacing.Pace(100, 30, 1000)
    grow.admit(300, 90)
    grow.done(301, 300, 90)
    assert grow.tokens == 125


def test_requests_in_flight_failures_and_growth(spark):
    rows_ = [  # event, now, tokens, used, lasts, failure, pause
        (0, 0.0, 10, None, 100.0, False, 0.0), (1, 1.0, 10, None, 100.0, False, 0.0), (2, 2.0, 10, None, 1.0, False, 0.0),  # two in flight: the third waits
        (3, 101.5, 60, 20, 5.0, False, 0.0), (4, 107.0, 70, 70, 1.0, True, 200.0),  # what was used counts: 20 + 70; the failure halves the budget
        (5, 120.0, 1, None, 0.0, False, 0.0), (6, 308.5, 40, 40, 0.5, False, 0.0),  # held by the cooldown until 308
        (7, 620.0, 40, 40, 0.5, False, 0.0), (8, 621.0, 1, None, 0.0, False, 0.0),  # healthy for 300 s with over half used: the budget grows
    ]
    df = spark.createDataFrame([("k", *r) for r in rows_], "key string, event_id long, now double, tokens long, used long, lasts double, rate_failure boolean, retry_after double")
    got = vals(pacing.paced_batch(df, 100, 30, 400), "event_id", "admitted", "wait_s", "budget")
    assert got == [(0, True, 0.0, 100), (1, True, 0.0, 100), (2, False, 1.0, 100), (3, True, 0.0, 100), (4, True, 0.0, 100), (5, False, 188.0, 50), (6, True, 0.0, 50), (7, True, 0.0, 50), (8, True, 0.0, 62)]


def test_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 36e8).alias("now"), F.coalesce(F.floor("value"), F.lit(0)).cast("long").alias("tokens"), (F.col("event_id") % 90).cast("double").alias("lasts"), (F.col("event_type") == "error").alias("rate_failure")).orderBy("now").limit(400)
    pdf = e.toPandas().sort_values(["now", "event_id"])
    for i, part in enumerate([pdf[:100], pdf[100:250], pdf[250:]]):
        spark.createDataFrame(part).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = pacing.paced_stream(s, 400, 3).writeStream.format("memory").queryName("paced").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    cols = ["key", "event_id", "admitted", "budget"]
    assert vals(spark.table("paced"), *cols) == vals(pacing.paced_batch(e, 400, 3), *cols)


def test_journal(spark, tmp_path):
    c = spark.createDataFrame([("a", 1, "x", False), ("a", 0, "w", None), ("a", 2, "", True), ("a", 1, "x", False), ("b", 0, "q", False), ("c", 0, "", True), ("c", 1, "z", False), (None, 0, "x", True)], "k string, o int, t string, e boolean")
    assert vals(journal.replies(c, "k", "o", "t", "e"), "k", "text", "status") == [("a", "wx", "complete"), ("b", None, "partial"), ("c", None, "over")]
    e = spark.createDataFrame([("2026-01-01 00:10:00", "x"), ("2026-01-01 00:50:00", "x"), ("2026-01-01 01:00:00", "y")], "s string, kind string").select(F.to_timestamp("s").alias("ts"), "kind")
    files.write_json_lines(e.coalesce(1), str(tmp_path / "j"))
    s = journal.event_counts(journal.journal_stream(spark, str(tmp_path / "j"), "ts timestamp, kind string"), "ts", "kind")
    q = s.writeStream.format("memory").queryName("journal").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert vals(spark.table("journal"), "start", "kind", "n") == vals(journal.event_counts(e, "ts", "kind"), "start", "kind", "n")


# ---- supervision of spans


def test_span_supervision_shuffles_no_candidates(spark):
    from pyspark.sql import Row

    one = [Row(a=i, b=i + 1) for i in range(4)]
    odd = [Row(a=0, b=0), Row(a=0, b=2), Row(a=0, b=2), Row(a=2, b=3)]
    docs = spark.createDataFrame([(1, one), (2, odd), (3, [])], "d int, o array<struct<a:int,b:int>>")
    gold = spark.createDataFrame([(1, 0, 2, "y"), (1, 0, 2, "x"), (1, 0, 4, "z"), (1, None, 2, "x"), (2, 0, 3, "x"), (2, 0, 0, "x"), (3, 0, 1, "x"), (9, 0, 1, "x")], "d int, begin int, end int, label string")
    labelled, lost = candidates.span_supervision(docs, gold, ["d"], "o", "begin", "end", "label", most=3)
    want = candidates.span_candidates(docs, ["d"], "o", most=3)
    cols = ("d", "first", "last", "begin", "end")
    assert vals(labelled, *cols) == vals(want, *cols)
    assert vals(labelled.where("label <> 'NONE'"), "d", "begin", "end", "label") == [(1, 0, 2, "x"), (2, 0, 3, "x")]
    assert vals(lost.fillna(-1), "d", "begin", "end") == [(1, -1, 2), (1, 0, 4), (2, 0, 0), (3, 0, 1), (9, 0, 1)]
    plan = labelled.groupBy("label").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # candidates meet no table; gold came to the documents


def test_top_hits_shuffle_no_pairs(spark, monkeypatch):
    """Every document is a query and holds one term; a pair of documents is never a row."""
    rng = np.random.default_rng(5)
    held = {i: {"all": 1.0} | {f"t{j}": float(rng.integers(1, 4)) for j in rng.choice(12, 3, replace=False)} for i in range(60)}
    group = {i: None if i % 7 == 0 else f"g{i % 5}" for i in held}
    w = spark.createDataFrame([(i, t, x) for i, m in held.items() for t, x in m.items()], "d long, term string, w double").repartition(5)
    monkeypatch.setattr(retrieve, "DENSE", 3)
    monkeypatch.setattr(retrieve, "BATCH", 4)
    df = retrieve.top_hits(w, "d", F.col("d") < 40, spark.createDataFrame(list(group.items()), "d long, g string"), "g", 3, block=16)
    want = []
    for q in range(40):
        best = {}
        for h in sorted(held):
            if h != q and (s := sum(x * held[h].get(t, 0) for t, x in held[q].items())):
                best.setdefault(group[h] or f"#{h}", []).append((-s, h))
        want += [(q, h, g, -s, r + 1) for r, (s, h, g) in enumerate(sorted((*min(v), g) for g, v in best.items())[:3])]
    assert vals(df, "query", "hit", "group", "score", "rank") == sorted(want, key=repr)
    assert "term" not in df._jdf.queryExecution().optimizedPlan().toString()
