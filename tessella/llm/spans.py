"""Problem 1: long exact spans shared between records.

Every window of ``width`` words gets a Rabin-Karp hash, rolled over the words of a text in one
vectorised pass. Spark counts the windows; those met in two different records are repeated. The
windows of a record that are repeated merge into maximal intervals.

A window's hash has 128 bits: two independent polynomials modulo 2^64 over well mixed 64-bit word
hashes. Two different windows of a corpus of 10^15 windows collide with a chance below 10^-8.

A null or empty text, and one of fewer than ``width`` words, has no window and no interval. A record
delivered twice is one record. Hot windows, as of a licence in a third of all texts, are aggregated
before the shuffle and, when their records are marked, joined without one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.skew import semi_join
from tessella.session import materialize

# Odd multipliers of the two polynomials, arbitrary.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SEEDS = (0x165667B1, 0x27D4EB2F)
#: Words that are hashed in one vectorised pass.
BATCH = 200_000
#: Distinct words remembered by a task before it starts anew.
REMEMBERED = 500_000


class Words(dict):
    """Words to numbers, in order of first sight, with their two hashes."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: tuple[list[int], list[int]] = ([], [])

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        for held, seed in zip(self.hashes, SEEDS, strict=True):
            held.append(xxhash.xxh64_intdigest(raw, seed))
        self[word] = number = len(self)
        return number


def rolling(h: np.ndarray, base: int, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width``: sums of h[i + j] * base^(width - 1 - j) modulo 2^64."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc, b = np.zeros(n, dtype=np.uint64), np.uint64(base)
    with np.errstate(over="ignore"):
        for j in range(width):
            acc *= b
            acc += h[j : j + n]
    return acc


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def _windows(width: int):
    schema = pa.schema([("uid", pa.int64()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        ids: list[int] = []
        uids: list[int] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            # all texts of the pass as one sequence; windows that run from one text into the next are left out
            n, size = np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64)
            starts = np.cumsum(size) - size
            at = np.arange(len(n)) - np.repeat(starts, size)
            whole = np.flatnonzero((at + width <= np.repeat(size, size))[: max(0, len(n) - width + 1)])
            hs = [_mix(rolling(np.array(h, dtype=np.uint64)[n], base, width))[whole].view(np.int64) for h, base in zip(known.hashes, BASES, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(uids, dtype=np.int64), size)[whole]), pa.array(at[whole].astype(np.int32)), *[pa.array(h) for h in hs]], schema=schema)

        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = [w for w in text.split(" ") if w]
                if len(words) < width:
                    continue
                ids += map(known.__getitem__, words)
                uids.append(uid)
                sizes.append(len(words))
                if len(ids) >= BATCH:
                    yield flush()
                    ids, uids, sizes = [], [], []
                    if len(known) > REMEMBERED:
                        known = Words()
        if ids:
            yield flush()

    return run


def windows(records: DataFrame, uid: str, text: str, width: int) -> DataFrame:
    """``uid, pos, h1, h2`` of every window of ``width`` words; words are maximal runs of characters other than U+0020."""
    src = records.where(F.col(uid).isNotNull() & F.col(text).isNotNull()).select(F.col(uid).cast("long").alias("uid"), F.col(text).alias("text"))
    return src.mapInArrow(_windows(width), "uid long, pos int, h1 long, h2 long")


def shared_spans(records: DataFrame, uid: str = "uid", text: str = "norm_text", width: int = 30) -> DataFrame:
    """Maximal runs of shared words: ``uid, first_word`` (from 0) ``, n_words``.

    A word is shared if it lies in a window of ``width`` words that also occurs in a different record.
    """
    w = windows(records, uid, text, width)
    met = w.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    repeated = materialize(met.where("lo <> hi").select("h1", "h2", "n"), "windows")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    marked = semi_join(w, repeated, ["h1", "h2"], "n", total).select("uid", "pos")
    order = W.partitionBy("uid").orderBy("pos")
    starts = marked.withColumn("new", (F.col("pos") > F.coalesce(F.lag("pos").over(order), F.lit(-width - 2)) + width).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(order))
    return runs.groupBy("uid", "run").agg(F.min("pos").alias("first_word"), (F.max("pos") - F.min("pos") + width).cast("int").alias("n_words")).select("uid", "first_word", "n_words")


def shared_shares(records: DataFrame, uid: str = "uid", text: str = "norm_text", width: int = 30) -> DataFrame:
    """One row per record: its words, those shared with others, their share and the number of intervals."""
    spans = shared_spans(records, uid, text, width).groupBy("uid").agg(F.sum("n_words").alias("shared_words"), F.count("*").alias("spans"))
    words = F.size(F.filter(F.split(F.col(text), " "), lambda x: x != ""))
    all_ = records.where(F.col(text).isNotNull()).select(F.col(uid).alias("uid"), words.alias("words"))
    out = all_.join(spans, "uid", "left").fillna(0, ["shared_words", "spans"])
    return out.withColumn("shared_share", F.when(F.col("words") > 0, F.col("shared_words") / F.col("words")).otherwise(F.lit(0.0)))
