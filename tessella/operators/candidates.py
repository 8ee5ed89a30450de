"""Candidate generation: windows, chunks, spans, pairs, role products, supervision and alignment.

Everything is generated where a document's row lies, by sequences and array functions; only what is stated to join does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize


def token_windows(df: DataFrame, tokens: str = "tokens", width: int = 1000, stride: int = 800) -> DataFrame:
    """Adds ``window_id, start, end, window_tokens`` of windows starting at every stride; a last one may lie within the one before.

    No tokens, no window.
    """
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    out = df.select("*", F.posexplode(starts).alias("window_id", "start")).withColumn("end", F.least(F.col("start") + width, n))
    return out.withColumn("window_tokens", F.slice(tokens, F.col("start") + 1, F.col("end") - F.col("start")))


def chunk_starts(n: Column, width: int = 510, stride: int = 384) -> Column:
    """``array<struct<a, b>>`` of chunks; the first to reach the end is the last. An empty text has one empty chunk."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda s: (s == 0) | (s - stride + width < n))
    return F.transform(at, lambda s: F.struct(s.alias("a"), F.least(s + width, n).alias("b")))


def owned(start: Column, ends: Column, overlap: int = 200) -> Column:
    """Whether a window emits a group: it is the first, or a part of the group lies past its overlap with the one before."""
    return (start == 0) | F.exists(ends, lambda e: e > start + overlap)


def role_product(df: DataFrame, cn: str, pn: str, pv: str, cond: str) -> DataFrame:
    """One row per CN x PN x PV x (condition or none), exploded role by role where the row lies."""
    out = df.withColumn(cn, F.explode(cn)).withColumn(pn, F.explode(pn)).withColumn(pv, F.explode(pv))
    return out.withColumn(cond, F.explode(F.concat(F.col(cond), F.array(F.lit(None)))))


def role_product_size(cn: Column, pn: Column, pv: Column, cond: Column) -> Column:
    """The number of rows of :func:`role_product`, without making them."""
    s = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    return s(cn) * s(pn) * s(pv) * (s(cond) + 1)


def product_member(index: Column, cn: Column, pn: Column, pv: Column, cond: Column) -> Column:
    """The index-th member of a role product, by mixed-radix decoding."""
    s = lambda c: F.size(c).cast("long")
    k = s(cond) + 1
    c, rest = F.pmod(index, k), F.floor(index / k)
    v, rest = F.pmod(rest, s(pv)), F.floor(rest / s(pv))
    p, rest = F.pmod(rest, s(pn)), F.floor(rest / s(pn))
    at = lambda arr, i: F.get(arr, i.cast("int"))
    return F.struct(at(cn, rest).alias("cn"), at(pn, p).alias("pn"), at(pv, v).alias("pv"), at(cond, c).alias("cond"))


def span_candidates(df: DataFrame, key: list[str], offsets: str, most: int = 32, skip_empty: bool = True) -> DataFrame:
    """Spans of up to ``most`` consecutive pieces as ``first, last, begin, end``; of equal character bounds the first stays.

    ``offsets`` is ``array<struct<a, b>>``. With ``skip_empty``, pieces of no width (special ones) start and end no span.
    """
    wide = lambda p: (p["b"] > p["a"]) if skip_empty else F.lit(True)
    n = F.size(offsets)
    i = df.where(n > 0).select(*key, offsets, F.posexplode(offsets).alias("first", "_p")).where(wide(F.col("_p")))
    j = i.withColumn("last", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + most, F.size(offsets)) - 1))).withColumn("_q", F.get(F.col(offsets), F.col("last"))).where(wide(F.col("_q")))
    spans = j.select(*key, F.col("_p.a").alias("begin"), F.col("_q.b").alias("end"), F.struct("first", "last").alias("_f"))
    return spans.groupBy(*key, "begin", "end").agg(F.min("_f").alias("_f")).select(*key, "_f.first", "_f.last", "begin", "end")


def directed_pairs(df: DataFrame, key: list[str], items: str) -> DataFrame:
    """All ordered pairs of a document's items, with themselves too: ``head, tail`` and their indices."""
    return df.select(*key, items, F.posexplode(items).alias("i", "head")).select(*key, "i", "head", F.posexplode(items).alias("j", "tail"))


def union_width(segments: Column) -> Column:
    """Covered length of ``array<struct<a, b>>``, overlaps counted once."""
    start = F.struct(F.lit(-(2**31)).cast("int").alias("hi"), F.lit(0).alias("sum"))

    def add(s: Column, x: Column) -> Column:
        return F.struct(F.greatest(s["hi"], x["b"]).alias("hi"), (s["sum"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["hi"]))).alias("sum"))

    return F.aggregate(F.array_sort(F.transform(segments, lambda x: F.struct(x["a"].cast("int").alias("a"), x["b"].cast("int").alias("b")))), start, add)["sum"]


def pair_geometry(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed log distance of two spans' begins, whether they overlap, and their log widths, as an array of doubles."""
    gap = (c - a).cast("double")
    return F.array(F.signum(gap) * F.log1p(F.abs(gap)), ((a < d) & (b > c)).cast("double"), F.log1p((b - a).cast("double")), F.log1p((d - c).cast("double")))


def one_hot(value: Column, values: list[str]) -> list[Column]:
    return [(value == v).cast("double") for v in values]


def fully_covered(members: Column, window: Column) -> Column:
    """Whether a window holds every member of a group."""
    return F.size(F.array_except(members, window)) == 0


def covered_groups(groups: DataFrame, windows: DataFrame, doc: str, key: str, members: str, window: str) -> DataFrame:
    """Groups with ``covered``: whether at least one window of the document holds all their endpoints.

    Members meet windows by document and member, and are counted; no group meets a window it shares nothing with. A group without members
    is covered where the document has a window.
    """
    m = groups.select(doc, key, F.size(F.array_distinct(members)).alias("_k"), F.explode(F.array_distinct(members)).alias("_x"))
    w = windows.select(doc, F.xxhash64(window).alias("_w"), F.explode(F.array_distinct(window)).alias("_x")).distinct()
    hit = m.join(w, [doc, "_x"]).groupBy(doc, key, "_w").agg(F.count("*").alias("_n"), F.max("_k").alias("_k")).where("_n = _k").select(doc, key).distinct().withColumn("_hit", F.lit(True))
    any_ = windows.select(doc).distinct().withColumn("_any", F.lit(True))
    out = groups.join(hit, [doc, key], "left").join(any_, doc, "left")
    none = F.coalesce(F.size(members) == 0, F.lit(False)) & F.col("_any").isNotNull()
    return out.withColumn("covered", F.col("_hit").isNotNull() | none).drop("_hit", "_any")


def role_groups(df: DataFrame, key: list[str], role: str, member: str, roles: list[str]) -> DataFrame:
    """One row per group with each role's sorted distinct members; a role without any is empty."""
    pick = lambda r: F.array_sort(F.collect_set(F.when(F.col(role) == r, F.col(member)))).alias(r)
    return df.groupBy(*key).agg(*[pick(r) for r in roles])


def span_supervision(df: DataFrame, gold: DataFrame, key: list[str], offsets: str, begin: str, end: str, label: str, most: int = 32, skip_empty: bool = True, none: str = "NONE") -> tuple[DataFrame, DataFrame]:
    """The spans of :func:`span_candidates` with the gold label at their bounds (else ``none``), and the gold spans no candidate reaches.

    Gold comes to its document's row, where candidates are made and labelled; they are never shuffled. A document is one row of ``df``. Null bounds reach nothing.
    """
    gold = materialize(gold.select(*key, begin, end, label), "gold")
    by = gold.where(F.col(begin).isNotNull() & F.col(end).isNotNull()).groupBy(*key, begin, end).agg(F.min(label).alias("label"))
    by = by.groupBy(*key).agg(F.collect_list(F.struct(F.col(begin).alias("begin"), F.col(end).alias("end"), "label")).alias("_gold"))
    wide = lambda p: (p["b"] > p["a"]) if skip_empty else F.lit(True)
    used = F.filter(offsets, wide)
    single = (F.size(F.array_distinct(F.transform(used, lambda p: p["a"]))) == F.size(used)) & (F.size(F.array_distinct(F.transform(used, lambda p: p["b"]))) == F.size(used))
    ends = F.transform(offsets, lambda p: F.when(wide(p), p["b"]))
    docs = df.where(F.size(offsets) > 0).select(*key, F.col(offsets).alias("_o"), single.alias("_single"), ends.alias("_ends"))
    docs = materialize(docs.join(by, key, "left"), "supervised")

    # higher-order functions at pieces only: they are interpreted, and there are most times as many candidates
    i = docs.select(*key, "_gold", "_single", "_o", "_ends", F.posexplode("_o").alias("first", "_p")).where(wide(F.col("_p")))
    upto = lambda k: F.least(k + most, F.size("_ends")) - 1
    earlier = F.filter(F.sequence(F.lit(0), F.col("first")), lambda k: wide(F.get("_o", k)) & (F.get("_o", k)["a"] == F.col("_p.a")))
    # whether bounds came before: from the same piece to a nearer one, or from an earlier one of the same begin
    seen = lambda last: F.exists(earlier, lambda k: F.exists(F.sequence(k, upto(k)), lambda m: (F.get("_ends", m) == F.get("_ends", last)) & ((k < F.col("first")) | (m < last))))
    every = F.sequence(F.col("first"), upto(F.col("first")))
    lasts = F.when(F.col("_single"), every).otherwise(F.filter(every, lambda last: F.get("_ends", last).isNotNull() & ~seen(last)))
    here = F.filter("_gold", lambda g: g["begin"] == F.col("_p.a"))
    labels = F.when(F.exists("_gold", lambda g: g["begin"] == F.col("_p.a")), F.map_from_entries(F.transform(here, lambda g: F.struct(g["end"].alias("k"), g["label"].alias("v")))))
    i = i.select(*key, "first", F.col("_p.a").alias(begin), "_ends", lasts.alias("_lasts"), labels.alias("_labels"))
    j = i.select(*key, "first", begin, "_ends", "_labels", F.explode("_lasts").alias("last")).withColumn(end, F.get("_ends", F.col("last"))).where(F.col(end).isNotNull())
    met = F.when(F.col("_labels").isNotNull(), F.try_element_at("_labels", F.col(end)))
    labelled = j.select(*key, "first", "last", begin, end, F.coalesce(met, F.lit(none)).alias(label))

    def reaches(g: Column) -> Column:
        at = lambda k: F.exists(F.slice("_o", k + 1, most), lambda q: wide(q) & (q["b"] == g["end"]))
        starts = F.transform("_o", lambda p: p["a"])
        one = F.array_position(starts, g["begin"]).cast("int") - 1
        anywhere = F.exists(F.sequence(F.lit(0), F.size("_o") - 1), lambda k: wide(F.get("_o", k)) & (F.get(starts, k) == g["begin"]) & at(k))
        sound = F.col("_single") & (F.size(F.filter("_o", wide)) == F.size("_o"))  # the first of a begin is the only one
        return F.when(sound, (one >= 0) & at(F.greatest(one, F.lit(0)))).otherwise(anywhere)

    reached = docs.where("_gold is not null").select(*key, F.explode(F.filter("_gold", reaches)).alias("_r")).select(*key, F.col("_r.begin").alias(begin), F.col("_r.end").alias(end)).distinct()
    return labelled, gold.join(reached, [*key, begin, end], "left_anti")


def pair_supervision(pairs: DataFrame, gold: DataFrame, key: list[str], head: str, tail: str, label: str, labels: list[str]) -> DataFrame:
    """Pairs with one 0/1 column per label; a pair may carry several."""
    wide = gold.groupBy(*key, head, tail).agg(*[F.max((F.col(label) == v).cast("int")).alias(v) for v in labels])
    return pairs.join(wide, [*key, head, tail], "left").fillna(0, labels)


def alignment(tokens: DataFrame, spans: DataFrame, doc: str, chunk: str | None = None) -> DataFrame:
    """Token-to-span overlaps within a document, with weight 1 / (pieces of the span), or with ``chunk`` 1 / (its pieces in the chunk times the chunks it is met in).

    ``tokens(doc, token, a, b)``, a row for each chunk of a token, and ``spans(doc, span, begin, end)``; joined by
    :func:`tessella.operators.intervals.overlaps`. The weights of a span that is met add up to 1.
    """
    from tessella.operators.intervals import overlaps

    hit = overlaps(spans, tokens, [doc], ("begin", "end"), ("a", "b"))
    pieces = hit.groupBy(doc, "span", *([chunk] if chunk else [])).agg(F.count("*").alias("pieces"))
    if not chunk:
        return hit.join(pieces, [doc, "span"]).withColumn("weight", 1.0 / F.col("pieces"))
    chunks = pieces.groupBy(doc, "span").agg(F.count("*").alias("chunks"))
    return hit.join(pieces.join(chunks, [doc, "span"]), [doc, "span", chunk]).withColumn("weight", 1.0 / (F.col("pieces") * F.col("chunks")))
