"""Problem 3: the same or near-same records across splits.

A case joins a unit of dev or test to one of train if they print alike, if their sets of five consecutive
words overlap by four fifths, or if they have the same bare DOI.

The near-same are found by a segment join. An evaluation text that may differ in at most ``k`` of its
word 5-grams is cut into ``k + 1`` segments, of which at least one must stand in the partner. The segments are
chosen as the rarest 5-word substrings of the text, by their number in train; a segment that train doesn't
have is no probe. Training texts are probed with all their 5-word substrings, of any position, and pairs are verified exactly.

Positions and a banded alignment, as an edit-distance join has them, can't give the required result:
set overlap allows whole blocks to change places (see the README). For short texts, to which the overlap doesn't apply, see
:mod:`tessella.llm.edit_join`.

Texts are compared once per plain form and class, units are joined to them at the end; hot forms and DOIs are salted.
Units with a null or other split are in no case. Null and malformed DOIs match nothing. Empty texts print alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.keys import bare_doi, plain_key
from tessella.llm.plain_form import plain
from tessella.llm.spans import BASES, REMEMBERED, Words, _mix, rolling
from tessella.operators.skew import attach, grid_join, lookup_join, pairs_between, semi_join
from tessella.session import materialize, release

N, LEAST_WORDS, NUM, DEN = 5, 20, 4, 5
SCHEMA = pa.schema([("uid", pa.int64()), ("split", pa.string()), ("corpus", pa.string()), ("doi", pa.string()), ("key", pa.binary()), ("words", pa.int32()), ("grams", pa.list_(pa.int64()))])
DDL = "uid long, split string, corpus string, doi string, key binary, words int, grams array<long>"
#: Texts that are hashed in one vectorised pass.
BATCH = 2_000


def gram_lists(texts: list[list[str]], known: Words, n: int = N) -> pa.ListArray:
    """For each text, given as words, the 64-bit hashes of its distinct runs of ``n`` words, in order of first occurrence."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    ids = np.array([known[w] for t in texts for w in t], dtype=np.int64)
    starts = np.cumsum(size) - size
    at = np.arange(len(ids)) - np.repeat(starts, size)
    whole = np.flatnonzero((at + n <= np.repeat(size, size))[: max(0, len(ids) - n + 1)])
    h = _mix(rolling(np.array(known.hashes[0], dtype=np.uint64)[ids], BASES[0], n))[whole].view(np.int64)
    text = np.repeat(np.arange(len(texts)), size)[whole]
    order = np.lexsort((np.arange(len(h)), h, text))
    again = np.zeros(len(h), dtype=bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    h, text = h[~again], text[~again]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(h))


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Words()
    for whole in batches:
        for lo in range(0, whole.num_rows, BATCH):
            b = whole.slice(lo, BATCH)
            forms = [plain(t) for t in b.column("norm_text").to_pylist()]
            words = [f.split(" ") if f else [] for f in forms]
            cols = [
                *[b.column(c) for c in SCHEMA.names[:4]],
                pa.array([hashlib.sha256(f.encode("utf-8", "surrogatepass")).digest() for f in forms], pa.binary()),
                pa.array([len(w) for w in words], pa.int32()),
                gram_lists([w if len(w) >= LEAST_WORDS else [] for w in words], known),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=SCHEMA)
            if len(known) > REMEMBERED:
                known = Words()


def prepared(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units of the three splits with ``form``, the least uid of their plain form, and the forms with their 5-grams and sides.

    Forms without 5-grams, of fewer than 20 words, aren't among the second.
    """
    split = plain_key(F.col("split"))
    u = units.select("uid", split.alias("split"), "corpus", bare_doi(F.col("doi")).alias("doi"), "norm_text").where(F.col("split").isin("train", "dev", "test"))
    p = materialize(u.mapInArrow(_prepared, DDL), "prepared")
    side = (F.col("split") == "train").cast("int")
    forms = materialize(p.groupBy("key").agg(F.min("uid").alias("form"), F.count("*").alias("n"), F.max(side).alias("in_train"), F.max(1 - side).alias("in_eval")), "forms")
    total = forms.agg(F.sum("n")).first()[0] or 0
    members = materialize(lookup_join(p.select("uid", "split", "corpus", "doi", "key"), forms.select("key", "form", "n"), ["key"], "n", total).drop("key"), "members")
    texts = p.where(F.size("grams") > 0).select(F.col("uid").alias("form"), "grams").join(forms.select("form", "in_train", "in_eval"), "form")
    texts = materialize(texts, "texts")
    release(p)
    release(forms)
    return members, texts


def near_forms(texts: DataFrame) -> DataFrame:
    """Pairs ``eform, tform`` of different forms whose 5-gram sets overlap by four fifths.

    A gram that all copies of a licence hold is hot: rows find their counts by lookup, and segments meet the grams of train in cells.
    """
    flat = texts.select("form", "in_train", "in_eval", F.size("grams").alias("c"), F.explode("grams").alias("h"))
    counts = flat.groupBy("h").agg(F.sum("in_eval").alias("ne"), F.sum("in_train").alias("nt"))
    known = materialize(counts.where("ne > 0 and nt > 0"), "grams")
    in_eval, in_train = known.agg(F.sum("ne"), F.sum("nt")).first()
    ee = flat.where("in_eval = 1").select(F.col("form").alias("eform"), F.col("c").alias("ec"), "h")
    found = lookup_join(ee, known.select("h", "ne", "nt"), ["h"], "ne", in_eval or 0)
    # grams that train doesn't have come first by number, and are no probes; k = floor(c / 5) grams may be missing: of any k + 1 one is in the partner
    each = W.partitionBy("eform")
    ranked = found.withColumn("r", F.row_number().over(each.orderBy("nt", "h")) + F.col("ec") - F.count("*").over(each))
    segments = materialize(ranked.where(F.col("r") <= F.floor(F.col("ec") * (DEN - NUM) / DEN) + 1).select("eform", "ec", "h", "nt"), "segments")
    both = segments.groupBy("h").agg(F.count("*").alias("nl"), F.max("nt").alias("nr"))
    total = both.agg(F.sum("nr")).first()[0] or 0
    te = flat.where("in_train = 1").select(F.col("form").alias("tform"), F.col("c").alias("tc"), "h")
    te = materialize(semi_join(te, both.select("h", "nr"), ["h"], "nr", total), "probes")
    sized = (F.least("ec", "tc") * DEN >= F.greatest("ec", "tc") * NUM) & (F.col("eform") != F.col("tform"))
    met = grid_join(segments.select("eform", "ec", "h"), te, ["h"], both).where(sized).select("eform", "tform").distinct()
    side = lambda c, f, g: texts.where(f"{c} = 1").select(F.col("form").alias(f), F.col("grams").alias(g))
    paired = met.join(side("in_eval", "eform", "eg"), "eform").join(side("in_train", "tform", "tg"), "tform").withColumn("i", F.size(F.array_intersect("eg", "tg")))
    return paired.where(F.col("i") * DEN >= (F.size("eg") + F.size("tg") - F.col("i")) * NUM).select("eform", "tform")


def form_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``eform, tform, kind`` of forms met on either side; a form on both sides prints alike with itself."""
    train, held = members.where("split = 'train'"), members.where("split <> 'train'")
    alike = train.select("form").distinct().join(held.select("form").distinct(), "form").select(F.col("form").alias("eform"), F.col("form").alias("tform"), F.lit("prints_alike").alias("kind"))
    return materialize(alike.unionByName(near_forms(texts).withColumn("kind", F.lit("near_same"))), "keys")


def cross_split_pairs(units: DataFrame) -> DataFrame:
    """``eval_uid, train_uid, kind`` of every overlap; kinds are prints_alike, near_same and same_doi."""
    members, texts = prepared(units)
    train, held = members.where("split = 'train'"), members.where("split <> 'train'")
    pairs = form_pairs(members, texts)
    release(texts)
    both = attach(attach(pairs, "eform", held, "form", "uid", "eval_uid"), "tform", train, "form", "uid", "train_uid").select("eval_uid", "train_uid", "kind")
    doi = lambda df: df.where("doi is not null").select("doi", "uid")
    same = pairs_between(doi(held), doi(train), ["doi"], "uid").select(F.col("left_uid").alias("eval_uid"), F.col("right_uid").alias("train_uid"), F.lit("same_doi").alias("kind"))
    return both.unionByName(same)


def overlap_classes(units: DataFrame) -> DataFrame:
    """One row per unit of dev or test that overlaps train, with its classes instead of its partners: nothing is expanded.

    ``uid, split, corpus, class_uid`` (the least uid of its plain form), ``alike`` (train units of that form), ``near_classes`` and ``near``
    (forms near it in train, and their units), ``same_doi`` (train units under its bare DOI).
    """
    members, texts = prepared(units)
    train, held = members.where("split = 'train'"), members.where("split <> 'train'")
    pairs = form_pairs(members, texts)
    sizes = train.groupBy(F.col("form").alias("tform")).agg(F.count("*").alias("n"))
    per_form = pairs.join(sizes, "tform").groupBy(F.col("eform").alias("form")).agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, v)), F.lit(0)).cast("long").alias(c) for c, k, v in (("alike", "prints_alike", F.col("n")), ("near_classes", "near_same", F.lit(1)), ("near", "near_same", F.col("n")))]
    )
    per_form = materialize(held.groupBy("form").agg(F.count("*").alias("_n")).join(per_form, "form"), "forms")
    per_doi = train.where("doi is not null").groupBy("doi").agg(F.count("*").alias("same_doi"))
    per_doi = materialize(held.where("doi is not null").groupBy("doi").agg(F.count("*").alias("_n")).join(per_doi, "doi"), "dois")
    by_form = lookup_join(held.select("uid", "form"), per_form, ["form"], "_n", per_form.agg(F.sum("_n")).first()[0] or 0).drop("form")
    by_doi = lookup_join(held.select("uid", "doi"), per_doi, ["doi"], "_n", per_doi.agg(F.sum("_n")).first()[0] or 0).drop("doi")
    found = by_form.join(by_doi, "uid", "full").fillna(0)
    return held.select("uid", "split", "corpus", F.col("form").alias("class_uid")).join(found, "uid")


def overlap_report(units: DataFrame) -> DataFrame:
    """Overlaps and units in them, by split and corpus of the evaluation unit and by kind."""
    pairs = cross_split_pairs(units)
    of = units.select(F.col("uid").alias("eval_uid"), plain_key(F.col("split")).alias("split"), "corpus")
    return pairs.join(of, "eval_uid").groupBy("split", "corpus", "kind").agg(F.count("*").alias("overlaps"), F.countDistinct("eval_uid").alias("eval_units"), F.countDistinct("train_uid").alias("train_units"))


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("left_uid"), F.greatest(a, b).alias("right_uid")]
