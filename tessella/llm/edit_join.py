"""Edit-distance segment join: pairs of texts across two sides within ``k`` edits.

An evaluation text is cut into ``k + 1`` segments of nearly equal length; of these at least one stands unchanged in a text within ``k`` edits,
moved by at most ``k`` places. Training texts are probed with their substrings at those places, for each evaluation length within ``k`` of
their own, and pairs that meet are verified by a banded dynamic programme that stops once a row exceeds ``k``.

For short texts, to which overlaps of word runs don't apply. Texts are compared once per distinct form; null texts match nothing, equal texts have
distance 0. Texts of ``k`` or fewer characters have an empty segment, which every text of nearly that length has: those are few by their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.skew import attach, grid_join
from tessella.session import materialize

K = 2


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """Begin and length of ``k + 1`` segments of a text of ``n`` characters; the later ones take what is left over."""
    base, more = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - more)
        out.append((at, size))
        at += size
    return out


def within(a: str, b: str, k: int) -> int | None:
    """Edit distance if it is at most ``k``, else None: dynamic programming in a band of 2k + 1."""
    if abs(len(a) - len(b)) > k:
        return None
    if a == b:
        return 0
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    big = k + 1
    row = [j if j <= k else big for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        left, right = max(1, i - k), min(len(b), i + k)
        new = [big] * (len(b) + 1)
        if i <= k:
            new[0] = i
        for j in range(left, right + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1, big)
        if min(new) > k:
            return None
        row = new
    return row[len(b)] if row[len(b)] <= k else None


def _key(n: int, i: int, piece: str) -> int:
    return xxhash.xxh64_intdigest(f"{n}|{i}|{piece}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _cut(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(t, _key(len(t), i, t[p : p + s])) for t in b["text"] for i, (p, s) in enumerate(segments(len(t), k))], columns=["etext", "h"])

    return run


def _probes(k: int, lengths: frozenset[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                m, keys = len(t), set()
                for n in range(max(0, m - k), m + k + 1):
                    if n in lengths:
                        for i, (p, s) in enumerate(segments(n, k)):
                            keys.update(_key(n, i, t[q : q + s]) for q in range(max(0, p - k), min(m - s, p + k) + 1))
                out += [(t, h) for h in keys]
            yield pd.DataFrame(out, columns=["ttext", "h"])

    return run


def _verified(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = [within(x, y, k) for x, y in zip(b["etext"], b["ttext"], strict=True)]
            yield b.assign(distance=pd.array(d, dtype="Int32")).dropna(subset=["distance"])

    return run


def near_texts(held: DataFrame, train: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """``etext, ttext, distance`` of distinct texts of the two sides within ``k`` edits."""
    e = materialize(held.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct(), "held")
    t = train.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    # as many as there are lengths of evaluation texts
    lengths = frozenset(r[0] for r in e.select(F.length("text")).distinct().collect())
    cut, probes = materialize(e.mapInPandas(_cut(k), "etext string, h long"), "cut"), t.mapInPandas(_probes(k, lengths), "ttext string, h long")
    # only probes that some segment answers are kept; a segment as common as an opening is cut in cells
    n = cut.groupBy("h").agg(F.count("*").alias("nl"))
    probes = materialize(probes.join(n.select("h"), "h", "left_semi"), "probes")
    met = grid_join(cut, probes, ["h"], n.join(probes.groupBy("h").agg(F.count("*").alias("nr")), "h")).select("etext", "ttext").distinct()
    return met.mapInPandas(_verified(k), "etext string, ttext string, distance int")


def near_short_pairs(units: DataFrame, words: int, k: int = K) -> DataFrame:
    """``eval_uid, train_uid, distance`` of units of plain forms under ``words`` words across splits. ``units(uid, split, plain_text)``."""
    u = units.where(F.size(F.split("plain_text", " ")) < words)
    train, held = u.where("split = 'train'"), u.where("split in ('dev', 'test')")
    pairs = materialize(near_texts(held, train, "plain_text", k), "near")
    return attach(attach(pairs, "etext", held, "plain_text", "uid", "eval_uid"), "ttext", train, "plain_text", "uid", "train_uid").select("eval_uid", "train_uid", "distance")
