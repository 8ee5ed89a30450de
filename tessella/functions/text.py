"""Text functions: folding, words and n-grams, occurrences, fences, citation ranges, JSON forms.

Native expressions unless said otherwise. Offsets count code points from 0. Null gives null.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapsed(c: Column) -> Column:
    """Lower case, white space runs to one blank, none outside. Java's ``lower`` leaves ß as it is."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", " "))


@F.pandas_udf(T.StringType())
def casefold_collapsed(s: pd.Series) -> pd.Series:
    """Full case folding (ß to ss), then as :func:`collapsed`; vectorised Python, for Spark has no case folding."""
    return s.map(lambda x: None if x is None else " ".join(x.casefold().split()))


@F.pandas_udf(T.StringType())
def nfkc_collapsed(s: pd.Series) -> pd.Series:
    """Compatibility composition, case folding, white space collapsed; vectorised Python."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def words(c: Column) -> Column:
    """Maximal runs of letters, digits and underscore, of any script."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), 1)


def latin_words(c: Column) -> Column:
    """Lower-case Latin words of three characters or more, hyphens and digits inside."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9-]{2,})"), 1)


def long_words(c: Column) -> Column:
    """Words of two characters or more."""
    return F.filter(words(F.lower(c)), lambda w: F.length(w) >= 2)


def bound(expression: Column, use) -> Column:
    """``use`` applied to the value of an expression, which is worked out once however often ``use`` names it, also within its lambdas."""
    return F.get(F.transform(F.array(expression), use), F.lit(0))


def word_grams(tokens: Column, n: int = 5) -> Column:
    """Distinct n-grams of a token array, joined by blanks; empty below n tokens."""

    def grams(t: Column) -> Column:
        last = F.size(t) - (n - 1)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(t.isNull(), None).when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    return bound(tokens, grams)


def occurrences(text: Column, quote: Column) -> Column:
    """Offsets at which ``quote`` stands in ``text``, overlapping ones too; none for an empty quote.

    Goes from hit to hit with ``locate``: one test of the text per hit, not per position.
    """

    def found(x: Column) -> Column:
        t, q = x["t"], x["q"]
        n = F.length(q)
        hops = F.aggregate(
            F.sequence(F.lit(1), F.greatest(count_occurrences(t, F.substring(q, 1, 1)) + 1, F.lit(1))),
            F.struct(F.array().cast("array<int>").alias("at"), F.when(n > 0, F.call_function("locate", q, t, F.lit(1))).otherwise(F.lit(0)).alias("next")),
            lambda s, _: F.when(s["next"] == 0, s).otherwise(F.struct(F.array_append(s["at"], s["next"] - 1).alias("at"), F.call_function("locate", q, t, s["next"] + 1).alias("next"))),
        )
        return F.when(t.isNull() | q.isNull(), None).otherwise(hops["at"])

    return bound(F.struct(text.alias("t"), quote.alias("q")), found)


def count_occurrences(text: Column, quote: Column) -> Column:
    """How often ``quote`` stands in ``text`` without overlap; 0 for an empty quote."""
    return F.when(F.length(quote) > 0, ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("int")).otherwise(F.lit(0))


def nth_occurrence(text: Column, quote: Column, n: Column) -> Column:
    """Offset of the n-th occurrence (from 0), null if there aren't so many."""
    return F.get(occurrences(text, quote), n)


def cue_positions(pattern: str):
    """A vectorised function giving ``array<struct<begin, end, literal>>`` of a regular expression's matches, overlapping ones too."""
    kind = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("literal", T.StringType())]))
    ahead = re.compile(f"(?=({pattern}))")

    @F.pandas_udf(kind)
    def found(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [{"begin": m.start(1), "end": m.end(1), "literal": m[1]} for m in ahead.finditer(x)])

    return found


def without_fence(c: Column) -> Column:
    """A reply without its surrounding code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def citation_numbers(c: Column) -> Column:
    """``1,3-5`` (hyphen or dash) to the array of numbers, in written order; a range backwards or another part gives null."""
    part = lambda p: F.split(F.regexp_replace(p, "[–—−]", "-"), "-")
    pieces = F.split(F.regexp_replace(c, r"\s", ""), ",")
    ok = F.forall(pieces, lambda p: p.rlike("^[0-9]{1,6}([-–—−][0-9]{1,6})?$") & (F.element_at(part(p), 1).try_cast("int") <= F.element_at(part(p), -1).try_cast("int")))
    return F.when(ok, F.flatten(F.transform(pieces, lambda p: F.sequence(F.element_at(part(p), 1).try_cast("int"), F.element_at(part(p), -1).try_cast("int")))))


def sha_prefix(c: Column, digits: int = 20) -> Column:
    """The first hex digits of an id's SHA-256: a content-addressed key."""
    return F.substring(F.sha2(c, 256), 1, digits)


def parity_coin(c: Column) -> Column:
    """Whether the SHA-256 is odd as a number: that of its last hex digit."""
    return F.conv(F.substring(F.sha2(c, 256), 64, 1), 16, 10).cast("int") % 2 == 1


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON with sorted keys, no blanks and ASCII only; null for what :func:`strict_json_fault` refuses."""
    return s.map(lambda x: None if x is None or _json_fault(x) else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False))


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate_key")
    return out


def _refuse(_: str):
    raise ValueError("not_finite")


def _json_fault(x: str) -> str | None:
    try:
        json.loads(x, object_pairs_hook=_unique, parse_constant=_refuse)
    except RecursionError:
        return "too_deep"
    except ValueError as e:
        return str(e) if str(e) in ("duplicate_key", "not_finite") else "malformed"
    return None


@F.pandas_udf(T.StringType())
def strict_json_fault(s: pd.Series) -> pd.Series:
    """Why a JSON text is refused: malformed, duplicate_key, not_finite or too_deep; null for a sound one and for null."""
    return s.map(lambda x: None if x is None else _json_fault(x))


def base_role(c: Column, roles: tuple[str, ...] = ("Dopant", "Site")) -> Column:
    """A role without its numeric suffix: ``Site2`` is ``Site``; other roles as they are."""
    hit = F.regexp_extract(c, rf"^({'|'.join(roles)})[0-9]*$", 1)
    return F.when(hit != "", hit).otherwise(c)


def native_id(c: Column) -> Column:
    return c.rlike(r"^([A-Z#][0-9]+|\*)$")


def plain_id(c: Column) -> Column:
    return c.rlike(r"^[TRE][1-9][0-9]*$")


def safe_path(c: Column) -> Column:
    """A relative path without empty, ``.`` or ``..`` parts, back-slashes and drive letters."""
    return c.rlike(r"^[^/\\:\x00]+(/[^/\\:\x00]+)*$") & ~c.rlike(r"(^|/)\.{1,2}(/|$)")


def holds_credential(c: Column) -> Column:
    """Whether a text holds what looks like a secret key; tested on the whole text, so no block boundary hides one."""
    return c.rlike(r"sk-[A-Za-z0-9]{32,}")


def signed_log(c: Column) -> Column:
    """sign(x) * ln(1 + |x|)."""
    return F.signum(c) * F.log1p(F.abs(c))


def warm_up_decay(step: Column, warm: int, total: int) -> Column:
    """Linear rise to 1 over ``warm`` steps, then linear fall to 0 at ``total``."""
    return F.when(step < warm, step / F.lit(max(1, warm))).otherwise(F.greatest(F.lit(0.0), (F.lit(total) - step) / F.lit(max(1, total - warm))))


def backoff_seconds(attempt: Column, retry_after: Column) -> Column:
    """5 * 2^min(n, 6), at most 300, and no less than a given wait."""
    return F.greatest(F.least(F.lit(300.0), F.lit(5.0) * F.pow(F.lit(2.0), F.least(attempt, F.lit(6)))), F.coalesce(retry_after.cast("double"), F.lit(0.0)))
