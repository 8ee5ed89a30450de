"""The annotation grammar: lines of T, R, E and other records, bulk-parsed.

A line is ``id TAB rest``. The reasons a line is refused for, in the order in which they are looked for, are
:data:`REASONS`. A blank is U+0020, digits are ASCII. A null line has no header. A text that is null
or missing has length 0, so nothing but ``0 0`` lies in it. A null declared family declares nothing.

The raw lines are parsed where they are read and never shuffled; only ids and the largest offset meet the text lengths.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.bulkparse import parser
from tessella.operators.skew import no_salt

# Reasons, in the order in which they are met.
REASONS = (
    "invalid_utf8", "embedded_line_break", "invalid_record_header", "declared_family_mismatch", "invalid_T_label",
    "invalid_segment_syntax", "invalid_offset_range", "overlapping_segments", "R_E_requires_two_tab_fields",
    "invalid_relation_syntax", "invalid_relation_argument", "relation_requires_Arg1_Arg2_once",
    "invalid_relation_endpoint_identifier", "missing_event_trigger", "invalid_event_trigger", "invalid_event_role_endpoint",
)
CODE = {r: i + 1 for i, r in enumerate(REASONS)}
RANGE, OVERLAP = CODE["invalid_offset_range"], CODE["overlapping_segments"]

_LABEL = r"[^\s\p{Z}\x1c-\x1f\x{85}:;]+"
_SPAN = r" *-?[0-9]{1,15} +-?[0-9]{1,15} *"
_SOUND = {
    "T": rf"^(?P<id>T[0-9]+)\t(?P<label>{_LABEL}) (?P<spans>{_SPAN}(?:;{_SPAN})*)(?:\t|$)",
    "R": rf"^(?P<id>R[0-9]+)\t *(?P<label>{_LABEL}) +(?P<k1>Arg[12]):(?P<v1>[TE][0-9]+) +(?P<k2>Arg[12]):(?P<v2>[TE][0-9]+) *$",
    "E": rf"^(?P<id>E[0-9]+)\t *(?P<label>{_LABEL}):(?P<trigger>T[0-9]+)(?P<roles>(?: +{_LABEL}:[TE][0-9]+)*) *$",
    "AUX": r"^(?P<id>[A-Z#][0-9]+|\*)\t",
}

#: What a parsed line is; ``high`` is the largest segment end, to be held against the text's length.
PARSED = pa.schema([
    ("row_id", pa.int64()), ("doc_id", pa.int64()), ("stamp", pa.timestamp("us")), ("code", pa.int32()), ("kind", pa.string()),
    ("id", pa.string()), ("label", pa.string()), ("spans", pa.string()), ("high", pa.int64()), ("arg1", pa.string()), ("arg2", pa.string()), ("trigger", pa.string()), ("roles", pa.string()),
])
PARSED_DDL = "row_id long, doc_id long, stamp timestamp_ntz, code int, kind string, id string, label string, spans string, high long, arg1 string, arg2 string, trigger string, roles string"
_ID = re.compile(r"(?:[A-Z#][0-9]+|\*)")
_PLAIN_LABEL = re.compile(r"[^\s:;]+")


def _overlap(segments: list[tuple[int, int]]) -> bool:
    """Whether two of them share ground: sorted, one begins before an earlier one of some length has ended."""
    high = None
    for a, b in sorted(s for s in segments if s[0] < s[1]):
        if high is not None and a < high:
            return True
        high = b if high is None else max(high, b)
    # an empty one strictly inside another shares nothing by the strict rule max(a, c) < min(b, d)
    return False


def _segments(spans: str) -> list[tuple[int, int]] | None:
    out = []
    for part in spans.split(";"):
        two = [x for x in part.split(" ") if x]
        if len(two) != 2 or not all(re.fullmatch(r"-?[0-9]+", x) for x in two):
            return None
        out.append((int(two[0]), int(two[1])))
    return out


def diagnose(raw: bytes | None, family: str | None, native: bool) -> dict:
    """One line, strictly: its first fault as ``code`` (0 for none) and its parts.

    A broken line keeps the family it was declared as, else that of its first character, so that it still counts there.
    """
    out: dict = dict.fromkeys(PARSED.names[4:])
    first = (raw or b"")[:1].decode("latin-1")
    out["kind"] = declared = family if not native and family is not None else first if first and first in "TRE" else "AUX"

    def fail(reason: str) -> dict:
        return out | {"code": CODE[reason]}

    if raw is None:
        return fail("invalid_record_header")
    if native and raw.endswith(b"\r"):
        raw = raw[:-1]
    try:
        line = raw.decode("utf-8", "strict")
    except UnicodeDecodeError:
        return fail("invalid_utf8")
    if "\r" in line or "\n" in line:
        return fail("embedded_line_break")
    fields = line.split("\t")
    if len(fields) < 2 or not _ID.fullmatch(fields[0]):
        return fail("invalid_record_header")
    out["id"] = fields[0]
    out["kind"] = kind = fields[0][0] if fields[0][0] in "TRE" else "AUX"
    if not native and family is not None and family != kind:
        return fail("declared_family_mismatch") | {"kind": declared}
    if kind == "AUX":
        return out | {"code": 0}
    if kind == "T":
        label, blank, spans = fields[1].partition(" ")
        if not blank or not _PLAIN_LABEL.fullmatch(label):
            return fail("invalid_T_label")
        segments = _segments(spans)
        if segments is None:
            return fail("invalid_segment_syntax")
        top = max(b for _, b in segments)
        out |= {"label": label, "spans": spans, "high": min(top, 2**62)}
        if any(a < 0 or b < a for a, b in segments):
            return fail("invalid_offset_range")
        return fail("overlapping_segments") if _overlap(segments) else out | {"code": 0}
    if len(fields) != 2:
        return fail("R_E_requires_two_tab_fields")
    tokens = [x for x in fields[1].split(" ") if x]
    if kind == "R":
        if len(tokens) != 3 or not _PLAIN_LABEL.fullmatch(tokens[0]):
            return fail("invalid_relation_syntax")
        args = [t.partition(":") for t in tokens[1:]]
        if not all(colon for _, colon, _ in args):
            return fail("invalid_relation_argument")
        if sorted(k for k, _, _ in args) != ["Arg1", "Arg2"]:
            return fail("relation_requires_Arg1_Arg2_once")
        if not all(re.fullmatch(r"[TE][0-9]+", v) for _, _, v in args):
            return fail("invalid_relation_endpoint_identifier")
        given = {k: v for k, _, v in args}
        return out | {"code": 0, "label": tokens[0], "arg1": given["Arg1"], "arg2": given["Arg2"]}
    if not tokens:
        return fail("missing_event_trigger")
    label, _, trigger = tokens[0].partition(":")
    if not _PLAIN_LABEL.fullmatch(label) or not re.fullmatch(r"T[0-9]+", trigger):
        return fail("invalid_event_trigger")
    for t in tokens[1:]:
        role, _, end = t.partition(":")
        if not _PLAIN_LABEL.fullmatch(role) or not re.fullmatch(r"[TE][0-9]+", end):
            return fail("invalid_event_role_endpoint")
    return out | {"code": 0, "label": label, "trigger": trigger, "roles": " ".join(tokens[1:])}


def _strict(native: bool):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [diagnose(raw, fam, native) for raw, fam in zip(b.column("raw").to_pylist(), b.column("family").to_pylist(), strict=True)]
        made = [pa.array([r[n] for r in rows], PARSED.field(n).type) for n in PARSED.names[3:]]
        return pa.RecordBatch.from_arrays([*[b.column(n).cast(PARSED.field(n).type) for n in PARSED.names[:3]], *made], schema=PARSED)

    return run


def _decode(native: bool):
    """Adds ``line``, the text without its final CR; fails unless the whole block is UTF-8."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        line = b.column("raw").cast(pa.string())
        if native:
            line = pc.if_else(pc.ends_with(line, "\r"), pc.utf8_slice_codeunits(line, 0, -1), line)
        return b.append_column("line", line)

    return run


def _load(native: bool):
    """The sound lines of a decoded block, and which lines aren't: each family's lines are matched and taken apart in one pass."""

    def run(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        line, n = b.column("line"), b.num_rows
        odd = pc.match_substring_regex(line, r"[\r\n]").fill_null(True).to_numpy(zero_copy_only=False)
        first = pc.utf8_slice_codeunits(line, 0, 1)
        kind = pc.if_else(pc.is_in(first, pa.array(["T", "R", "E"])), first, pa.scalar("AUX")).fill_null("AUX")
        if not native:
            odd = odd | pc.not_equal(b.column("family"), kind).fill_null(False).to_numpy(zero_copy_only=False)
        kinds = kind.to_numpy(zero_copy_only=False)
        cols: dict[str, np.ndarray] = {c: np.full(n, None, dtype=object) for c in ("id", "label", "spans", "arg1", "arg2", "trigger", "roles")}
        high = np.full(n, -1, dtype=np.int64)
        for k, pattern in _SOUND.items():
            at = np.flatnonzero((kinds == k) & ~odd)
            got = pc.extract_regex(line.take(pa.array(at)), pattern)
            fits = got.is_valid().to_numpy(zero_copy_only=False)
            odd[at[~fits]] = True
            got, at = got.filter(pa.array(fits)), at[fits]
            part = {f.name: got.field(i) for i, f in enumerate(got.type)}
            if not len(at):
                continue
            if k == "T":
                top, wrong = _ends(part["spans"])
                odd[at[wrong]] = True
                high[at] = top
            if k == "R":
                k1 = part.pop("k1")
                odd[at[pc.equal(k1, part.pop("k2")).to_numpy(zero_copy_only=False)]] = True
                straight, v1, v2 = pc.equal(k1, "Arg1"), part.pop("v1"), part.pop("v2")
                part |= {"arg1": pc.if_else(straight, v1, v2), "arg2": pc.if_else(straight, v2, v1)}
            if k == "E":
                part["roles"] = pc.utf8_trim(part["roles"], " ")
            for c, v in part.items():
                cols[c][at] = v.to_numpy(zero_copy_only=False)
        keep = ~odd
        m = int(keep.sum())
        made = [pa.array(np.zeros(m, np.int32)), kind.filter(pa.array(keep)), *[pa.array(cols[c][keep], pa.string()) for c in ("id", "label", "spans")]]
        made += [pa.array(high[keep], mask=high[keep] < 0), *[pa.array(cols[c][keep], pa.string()) for c in ("arg1", "arg2", "trigger", "roles")]]
        head = [b.column(c).filter(pa.array(keep)).cast(PARSED.field(c).type) for c in PARSED.names[:3]]
        return pa.RecordBatch.from_arrays([*head, *made], schema=PARSED), odd

    return run


def _ends(spans: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The largest end of each row's segments, and whether some lie out of order, below 0 or over each other."""
    lists = pc.split_pattern(spans, ";")
    starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    two = pc.extract_regex(lists.flatten(), r"^ *(?P<a>-?[0-9]+) +(?P<b>-?[0-9]+) *$")
    a, b = (two.field(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in (0, 1))
    wrong = np.logical_or.reduceat((a < 0) | (b < a), starts)
    row = np.repeat(np.arange(len(spans)), np.diff(np.append(starts, len(a))))
    several = np.flatnonzero((np.bincount(row)[row] > 1) & (a < b))  # empty segments overlap nothing
    if len(several):
        order = several[np.lexsort((b[several], a[several], row[several]))]
        r, x, y = row[order], a[order], b[order]
        # the furthest end so far of the same row; ends beyond any text, which are out of range anyway, are cut so that sums fit
        y, step = np.minimum(y, 1 << 40), (1 << 40) + 1
        reach = np.maximum.accumulate(y + r * step) - r * step
        wrong[r[1:][(r[1:] == r[:-1]) & (x[1:] < reach[:-1])]] = True
    return np.maximum.reduceat(b, starts), wrong


@cache
def _parser(native: bool):
    return parser(_decode(native), _load(native), _strict(native), PARSED)


def parsed_lines(lines: DataFrame, row_id: str, raw: str, native: bool, stamp: str | None = None, family: str = "family", doc: str = "doc_id") -> DataFrame:
    """Every line with its parts and its first fault, as ``code``; the length of the text isn't looked at yet."""
    src = lines.select(
        F.col(row_id).cast("long").alias("row_id"), F.col(doc).cast("long").alias("doc_id"), (F.col(stamp) if stamp else F.lit(None)).cast("timestamp_ntz").alias("stamp"),
        F.col(raw).cast("binary").alias("raw"), (F.lit(None) if native else F.col(family)).cast("string").alias("family"),
    )
    return src.mapInArrow(_parser(native), PARSED_DDL)


#: Documents with more than 1/4096 of all lines: their lengths are broadcast, so that their lines needn't meet in one task.
HOT_SHARE = 4096


def checked_lines(parsed: DataFrame, lines: DataFrame, documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds the offset check against the text's length and ``reason`` (null for sound lines).

    ``lines`` are the rows ``parsed`` was made from; their documents are counted to find the hot ones.
    """
    lengths = documents.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.length(text).cast("long").alias("len")).groupBy("doc_id").agg(F.max("len").alias("len"))
    per = lines.where(F.col(doc).isNotNull()).groupBy(F.col(doc).cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    total = lines.count()
    hot = per.where(F.col("n") > max(1, total // HOT_SHARE)).select("doc_id").join(lengths, "doc_id", "left").select("doc_id", F.coalesce("len", F.lit(0)).alias("hot_len"))
    p = parsed.join(F.broadcast(hot), "doc_id", "left")
    p = p.withColumn("salt", F.when(F.col("hot_len").isNull() & F.col("high").isNotNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("row_id"), F.lit(4096))).cast("int"))
    p = p.join(lengths.withColumn("salt", no_salt(["doc_id"])), ["doc_id", "salt"], "left")
    over = F.coalesce(F.col("high") > F.coalesce("hot_len", "len", F.lit(0)), F.lit(False)) & F.col("code").isin(0, OVERLAP)
    code = F.when(over, F.lit(RANGE)).otherwise(F.col("code"))
    return p.withColumn("code", code).withColumn("reason", reason(F.col("code"))).drop("salt", "len", "hot_len")


def reason(code: Column) -> Column:
    """The name of a code; null for 0."""
    return F.get(F.array(*[F.lit(r) for r in REASONS]), code - 1)


def segments(spans: Column) -> Column:
    """A sound line's segments as ``array<struct<a, b>>``, in written order."""
    words = lambda s: F.filter(F.split(s, " "), lambda x: x != "")
    return F.transform(F.split(spans, ";"), lambda s: F.struct(words(s)[0].cast("int").alias("a"), words(s)[1].cast("int").alias("b")))


def roles(text: Column) -> Column:
    """A sound event's roles as ``array<struct<role, target>>``; repeats kept."""
    return F.when(text == "", F.array().cast("array<struct<role:string,target:string>>")).otherwise(
        F.transform(F.split(text, " +"), lambda s: F.struct(F.substring_index(s, ":", 1).alias("role"), F.substring_index(s, ":", -1).alias("target")))
    )
