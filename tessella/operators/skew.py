"""Joins that hold up when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize

#: Members of a key that one task of a self-join handles.
BLOCK = 20_000
#: Rows of one key up to which they may meet in one task of a lookup.
ROWS = 100_000
#: Most keys that are ever broadcast as hot: some 25 MB of a few numbers each.
MAX_HOT = 500_000


def _salt(columns: list[str], n: Column) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(7)), n).cast("int")


def no_salt(columns: list[str]) -> Column:
    """0, but not as a constant: the optimizer would fold that into the join's condition and shuffle by the key alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1)).cast("int")


def _plain(df: DataFrame) -> list[str]:
    """Columns that can be hashed."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def _routed(probe: DataFrame, keyed: DataFrame, keys: list[str], n: str, total: int, max_hot: int, rows: int) -> tuple[DataFrame, list[str]]:
    """``probe`` left-joined with ``keyed`` in one pass: columns ``_hot``, ``_cold`` and the values of either, prefixed.

    Keys with more than ``rows`` and more than ``total / max_hot`` probe rows, of which there are at most ``max_hot``, are broadcast; their rows are
    dealt out by a salt that meets nothing, so they stay even over tasks. All others meet their key by shuffle.
    """
    least = max(1, rows, total // max_hot)
    values = [c for c in keyed.columns if c not in (*keys, n)]
    hot = keyed.where(F.col(n) > least).select(*keys, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in values])
    cold = (keyed.where(F.col(n) <= least) if total > least else keyed).select(*keys, no_salt(keys).alias("_salt"), F.lit(True).alias("_cold"), *[F.col(c).alias(f"_c_{c}") for c in values])
    x = probe.where(" and ".join(f"`{k}` is not null" for k in keys))
    if total <= least:  # no key can be hot
        x = x.withColumn("_hot", F.lit(None).cast("boolean")).select("*", *[F.lit(None).cast(keyed.schema[c].dataType).alias(f"_h_{c}") for c in values]).withColumn("_salt", F.lit(0))
    else:
        x = x.join(F.broadcast(hot), keys, "left")
        x = x.withColumn("_salt", F.when(F.col("_hot").isNotNull(), 1 + _salt(_plain(probe), F.lit(65_536))).otherwise(F.lit(0)))
    return x.join(cold, [*keys, "_salt"], "left").where("_hot or _cold"), values


def semi_join(probe: DataFrame, keyed: DataFrame, keys: list[str], n: str, total: int, max_hot: int = MAX_HOT, rows: int = ROWS) -> DataFrame:
    """``probe`` rows whose key is in ``keyed``, exact under any skew, with one pass over ``probe``.

    ``n`` says how many probe rows a key has, ``total`` their sum. Null keys match nothing.
    """
    return _routed(probe, keyed.select(*keys, n), keys, n, total, max_hot, rows)[0].select(*probe.columns)


def lookup_join(probe: DataFrame, keyed: DataFrame, keys: list[str], n: str, total: int, max_hot: int = MAX_HOT, rows: int = ROWS) -> DataFrame:
    """Inner join of ``probe`` with the one row per key of ``keyed``, exact under any skew, with one pass over ``probe``.

    As :func:`semi_join`; the columns of ``keyed`` are added, except ``n``.
    """
    out, values = _routed(probe, keyed, keys, n, total, max_hot, rows)
    return out.select(*probe.columns, *[F.when(F.col("_hot").isNotNull(), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in values])


def pairs_within(members: DataFrame, key: list[str], uid: str, extra: list[str] = (), differ: str | None = None, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """Pairs ``left_<uid> < right_<uid>`` of members with equal keys.

    Keys held by one member only never reach the join. A key of ``n`` members is cut into
    ``ceil(n / block)`` salts on the left and copied to each on the right, so no task gets more
    than ``block`` left rows of it. With ``differ`` set, only pairs that differ there come out, and
    keys with one value of it are dropped beforehand. Null keys match nothing.

    ``members`` are read twice, to count and to join: costly ones should be a table. Returns ``left_uid, right_uid`` and ``left_x, right_x`` for each of ``extra``.
    """
    cols = list(dict.fromkeys([*key, uid, *extra, *([differ] if differ else [])]))
    m = members.select(*cols).where(" and ".join(f"`{k}` is not null" for k in key))
    probe = differ or uid
    counts = m.groupBy(*key).agg(F.count("*").alias("_n"), F.min(probe).alias("_lo"), F.max(probe).alias("_hi"))
    many = materialize(counts.where("_lo <> _hi").select(*key, "_n", F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_salts")), "keys")
    total = many.agg(F.sum("_n")).first()[0] or 0
    m = materialize(lookup_join(m, many, key, "_n", total, rows=rows), "members")
    left = m.select(*key, _salt([uid], F.col("_salts")).alias("_salt"), *[F.col(c).alias(f"left_{c}") for c in cols if c not in key])
    right = m.select(*key, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), *[F.col(c).alias(f"right_{c}") for c in cols if c not in key])
    out = left.join(right, [*key, "_salt"]).where(F.col(f"left_{uid}") < F.col(f"right_{uid}"))
    if differ:
        out = out.where(F.col(f"left_{differ}") != F.col(f"right_{differ}"))
    return out.select(*[f"{s}_{c}" for c in [uid, *extra] for s in ("left", "right")])


def grid_join(left: DataFrame, right: DataFrame, key: list[str], counts: DataFrame | None = None, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """Inner join on ``key`` of frames in which a key may have very many rows on both sides; other columns mustn't clash.

    A key of ``nl`` and ``nr`` rows is cut in a grid of ``ceil(nl / block)`` by ``ceil(nr / block)`` cells, each a task's share; its rows find their
    counts by :func:`lookup_join`. ``counts``, if known, has ``key, nl, nr`` of the keys on both sides. Null keys match nothing.
    """
    if counts is None:
        n = lambda df, c: df.groupBy(*key).agg(F.count("*").alias(c))
        counts = n(left, "nl").join(n(right, "nr"), key)
    cut = lambda c: F.ceil(F.col(c) / F.lit(block)).cast("int")
    both = materialize(counts.select(*key, "nl", "nr", cut("nl").alias("_sl"), cut("nr").alias("_sr")), "keys")
    tl, tr, most = both.agg(F.sum("nl"), F.sum("nr"), F.max(F.greatest("nl", "nr"))).first()
    if (most or 0) <= min(block, rows):  # every key is one cell
        return left.join(right, key)
    grid = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    side = lambda df, n, t: lookup_join(df, both.select(*key, F.col(n).alias("_n"), "_sl", "_sr"), key, "_n", t, rows=rows)
    a = side(left, "nl", tl).select(*left.columns, _salt(_plain(left), F.col("_sl")).alias("_i"), grid("_sr").alias("_j"))
    b = side(right, "nr", tr).select(*right.columns, _salt(_plain(right), F.col("_sr")).alias("_j"), grid("_sl").alias("_i"))
    return a.join(b, [*key, "_i", "_j"]).drop("_i", "_j")


def pairs_between(left: DataFrame, right: DataFrame, key: list[str], uid: str, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """All ``(left_uid, right_uid)`` with equal keys between two frames, hot keys cut in a grid."""
    side = lambda df, name: df.select(*key, F.col(uid).alias(name)).where(" and ".join(f"`{k}` is not null" for k in key))
    return grid_join(side(left, f"left_{uid}"), side(right, f"right_{uid}"), key, block=block, rows=rows).drop(*key)


def attach(rows: DataFrame, key: str, members: DataFrame, member_key: str, uid: str, out: str, block: int = BLOCK) -> DataFrame:
    """Each row of ``rows`` once for each member of its key, as column ``out``; keys with many rows or members are cut in a grid."""
    m = members.select(F.col(member_key).alias("_k"), F.col(uid).alias(out))
    return grid_join(rows.withColumn("_k", F.col(key)), m, ["_k"], block=block).drop("_k")
