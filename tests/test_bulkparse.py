import random

import pytest

from tessella.operators import linegrammar as g

LINES = [
    (b"T1\tSC 0 2\tab", None), (b"T1\tSC 0 2", None), (b"T1\tSC 0 2\r", None), (None, "invalid_record_header"), (b"", "invalid_record_header"),
    (b"T1 SC 0 2", "invalid_record_header"), (b"t1\tSC 0 2", "invalid_record_header"), (b"#1\tfree: ; text", None), (b"*\tanything", None), (b"A7\t", None),
    (b"T1\tS\xff 0 2", "invalid_utf8"), (b"T1\tSC 0\n2", "embedded_line_break"), (b"T1\tSC 0 2\r\r", "embedded_line_break"), (b"T1\tS:C 0 2", "invalid_T_label"),
    (b"T1\tSC", "invalid_T_label"), (b"T1\t 0 2", "invalid_T_label"), ("T1\tS C 0 2".encode(), "invalid_T_label"), (b"T1\tSC 0", "invalid_segment_syntax"),
    (b"T1\tSC 0 2;", "invalid_segment_syntax"), (b"T1\tSC 0 +2", "invalid_segment_syntax"), (b"T1\tSC -1 2", "invalid_offset_range"), (b"T1\tSC 3 2", "invalid_offset_range"),
    (b"T1\tSC 0 11", "invalid_offset_range"), (b"T1\tSC 0 3;2 4", "overlapping_segments"), (b"T1\tSC 2 4;0 2", None), (b"T1\tSC 0 3;2 2", None), (b"T1\tSC 0 3;2 99", "invalid_offset_range"),
    (b"T1\tSC 0 99999999999999999999", "invalid_offset_range"), (b"T1\tSC 0 999999999999999;999999999999998 999999999999999", "invalid_offset_range"), (b"T1\tSC 0 9;1 2;3 4", "overlapping_segments"), (b"R1\tTarget Arg1:T1 Arg2:E2", None), (b"R1\tTarget Arg2:T1 Arg1:T2", None), (b"R1\tTarget Arg1:T1 Arg2:T2\t", "R_E_requires_two_tab_fields"),
    (b"R1\tTarget Arg1:T1", "invalid_relation_syntax"), (b"R1\tTa;rget Arg1:T1 Arg2:T2", "invalid_relation_syntax"), (b"R1\tTarget Arg1=T1 Arg2:T2", "invalid_relation_argument"),
    (b"R1\tTarget Arg1:T1 Arg1:T2", "relation_requires_Arg1_Arg2_once"), (b"R1\tTarget Arg1:R1 Arg2:T2", "invalid_relation_endpoint_identifier"), (b"E1\tDoping:T1", None),
    (b"E1\tDoping:T1 Site:T2 Site:E3", None), (b"E1\t", "missing_event_trigger"), (b"E1\tDoping:E1", "invalid_event_trigger"), (b"E1\tDoping:T1 Site:R2", "invalid_event_role_endpoint"),
]


def found(spark, rows, native=True, docs=((1, "x" * 10), (2, None), (2, "abc"))):
    ddl = "record_id long, doc_id long, family string, raw binary, high string, text string"
    lines = spark.createDataFrame(rows, ddl)
    d = spark.createDataFrame(list(docs), "doc_id long, text string")
    c = g.checked_lines(g.parsed_lines(lines, "record_id", "raw", native), lines, d)
    return {r["row_id"]: r["reason"] for r in c.collect()}


def test_each_reason(spark):
    rows = [(i, 1, None, raw, "clash", "clash") for i, (raw, _) in enumerate(LINES)]
    assert found(spark, rows) == {i: want for i, (_, want) in enumerate(LINES)}


def test_bulk_equals_strict_whatever_stands_near(spark):
    rng = random.Random(3)
    good = [x for x in LINES if x[1] is None]
    rows = [(rng.choice(LINES) if rng.random() < 0.02 else rng.choice(good)) for _ in range(3000)]
    got = found(spark, [(i, 1, None, raw, None, None) for i, (raw, _) in enumerate(rows)])
    assert got == {i: want for i, (_, want) in enumerate(rows)}


def test_families_and_missing_texts(spark):
    rows = [(1, 1, "T", b"R1\tX Arg1:T1 Arg2:T2"), (2, 1, None, b"R1\tX Arg1:T1 Arg2:T2"), (3, 1, "AUX", b"#1\tx"), (4, None, "T", b"T1\tSC 0 1"), (5, 9, "T", b"T1\tSC 0 0"), (6, 2, "T", b"T1\tSC 0 3"), (7, 1, "T", b"T1\tSC 0 3\r")]
    got = found(spark, [(*r, None, None) for r in rows], native=False)
    assert got == {1: "declared_family_mismatch", 2: None, 3: None, 4: "invalid_offset_range", 5: None, 6: None, 7: "embedded_line_break"}


def test_broken_lines_keep_their_family(spark):
    rows = [(1, 1, "R", b"T1\tSC 0 1"), (2, 1, "E", None), (3, 1, None, b"R1"), (4, 1, None, b"\xff")]
    lines = spark.createDataFrame(rows, "record_id long, doc_id long, family string, raw binary")
    assert {r["row_id"]: r["kind"] for r in g.parsed_lines(lines, "record_id", "raw", False).collect()} == {1: "R", 2: "E", 3: "R", 4: "AUX"}


def test_empty_and_one_hot_document(spark):
    assert found(spark, []) == {}
    rows = [(i, 1, None, b"T1\tSC 0 11" if i % 100 == 0 else b"T1\tSC 0 10", None, None) for i in range(5000)]
    assert sum(v is not None for v in found(spark, rows).values()) == 50


@pytest.mark.parametrize("raw,parts", [(b"E1\tDoping:T1 Site:T2 Site:E3", {"label": "Doping", "trigger": "T1", "roles": "Site:T2 Site:E3"}), (b"R1\tX Arg2:T1 Arg1:T2", {"arg1": "T2", "arg2": "T1"})])
def test_parts(spark, raw, parts):
    lines = spark.createDataFrame([(1, 1, None, raw)], "record_id long, doc_id long, family string, raw binary")
    row = g.parsed_lines(lines, "record_id", "raw", True).first()
    assert {k: row[k] for k in parts} == parts
