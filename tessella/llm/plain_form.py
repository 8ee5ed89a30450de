"""Problem 4: one spelling for texts that print alike.

Compatibility normalisation in composed form, full case folding, all white space to single blanks,
removal of characters that show nothing, and look-alike letters and hyphens to the ordinary ones.
The work is vectorised per distinct value of an Arrow batch.

Characters whose compatibility form prints differently (superscripts, subscripts, fractions, circled
and squared signs) keep their own shape, for a reader sees ``10²`` and ``102`` as different lines.

Null gives null; an empty or blank text gives an empty text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.skew import lookup_join, pairs_within
from tessella.session import materialize

# Ranges of code points that show nothing (Unicode's Default_Ignorable_Code_Point).
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]

# Lower-case letters that print as a Latin one, after compatibility decomposition and case folding.
LOOK_ALIKE = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y", "ԍ": "g",
    # Greek: only those without a shape of their own
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Latin and Armenian
    "ɡ": "g", "ɑ": "a", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
    # hyphens
    "‐": "-", "‑": "-", "‒": "-", "⁃": "-", "﹣": "-", "˗": "-",
}

#: Compatibility decompositions of these kinds change what a reader sees.
SHAPED = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")


class _Chars(dict):
    """Code point to replacement, worked out when first met."""

    def __missing__(self, code: int) -> str:
        self[code] = out = self._of(chr(code), code)
        return out

    @staticmethod
    def _of(ch: str, code: int) -> str:
        if any(a <= code <= b for a, b in IGNORABLE):
            return ""
        if ch.isspace():
            return " "
        if unicodedata.category(ch) == "Cc":
            return ""
        if unicodedata.decomposition(ch).startswith(SHAPED):
            return ch
        wide = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).casefold())
        if wide != " " and wide.startswith(" "):  # a spacing accent keeps its shape
            return ch
        return "".join(LOOK_ALIKE.get(x, x) for x in wide if not any(a <= ord(x) <= b for a, b in IGNORABLE))


_chars = _Chars()


def plain(text: str) -> str:
    """The plain form of one text."""
    out = text.translate(_chars)
    if not out.isascii():
        out = unicodedata.normalize("NFC", out)
    return " ".join(out.split(" ")) if "  " not in out and out[:1] != " " and out[-1:] != " " else " ".join(out.split())


@F.pandas_udf(T.StringType())
def _plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        codes, values = pd.factorize(s, use_na_sentinel=True)
        done = [plain(v) for v in values]
        yield pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)


def plain_form(c: Column | str) -> Column:
    """The plain form of a text column; null for null."""
    return _plain(c)


def with_plain_form(df: DataFrame, text: str, out: str = "plain_text", sha: str = "plain_sha") -> DataFrame:
    """Adds the plain form and its SHA-256, by which equal texts compare equal."""
    return df.withColumn(out, plain_form(F.col(text))).withColumn(sha, F.sha2(F.col(out), 256))


def print_alike_pairs(units: DataFrame, uid: str = "uid", text: str = "norm_text") -> DataFrame:
    """Pairs of units that print alike while their strings differ: ``left_uid < right_uid``.

    Each text is normalised once; only digests are kept and shuffled. A group of units with one string meets no join; a hot group is salted.
    Null texts match nothing; empty and blank texts print alike.
    """
    keyed = units.where(F.col(text).isNotNull()).select(F.col(uid).alias("uid"), F.unhex(F.sha2(plain_form(text), 256)).alias("plain_key"), F.unhex(F.sha2(text, 256)).alias("text_key"))
    return pairs_within(materialize(keyed, "digests"), ["plain_key"], "uid", differ="text_key")


def alike_classes(units: DataFrame, uid: str = "uid", text: str = "norm_text") -> DataFrame:
    """One row per unit: its plain form's digest, the class (smallest uid of it), its members and its spellings."""
    keyed = units.where(F.col(text).isNotNull()).select(F.col(uid).alias("uid"), F.unhex(F.sha2(plain_form(text), 256)).alias("k"), F.xxhash64(text).alias("_t"))
    keyed = materialize(keyed, "digests")
    spelt = keyed.groupBy("k", "_t").agg(F.count("*").alias("n"), F.min("uid").alias("u"))
    classes = materialize(spelt.groupBy("k").agg(F.min("u").alias("class_uid"), F.sum("n").alias("members"), F.count("*").alias("spellings"), F.sum("n").alias("n")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    return lookup_join(keyed.select("uid", "k"), classes, ["k"], "n", total).select("uid", F.lower(F.hex("k")).alias("plain_sha"), "class_uid", "members", "spellings")
