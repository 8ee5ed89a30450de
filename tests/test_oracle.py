"""Every query with SQL gives the same rows in DuckDB; every query runs."""

import oracle
import pytest

import __spark_entry__ as entry
from tessella.plans import queries as core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.views(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf, name):
    diff, _ = oracle.differs(spark, con, sf, core.queries()[name], SQL[name])
    assert diff is None, diff


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert core.queries()[name](spark, sf).count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(SQL) <= set(entry.queries())


def test_broken_lines_equal_strict_reading(spark, sf):
    """p6_found against the strict diagnosis of every line, one by one."""
    from tessella.operators.linegrammar import OVERLAP, RANGE, REASONS, diagnose

    length = {r["doc_id"]: len(r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = set()
    for src, key, raw in (("native_records", "record_id", "raw"), ("emissions", "emission_id", "payload")):
        for r in spark.read.parquet(f"{sf}/{src}.parquet").collect():
            d = diagnose(None if r[raw] is None else bytes(r[raw]), r["family"], src == "native_records")
            code = RANGE if d["code"] in (0, OVERLAP) and d["high"] is not None and d["high"] > length.get(r["doc_id"], 0) else d["code"]
            if code:
                want.add((src, r[key], REASONS[code - 1]))
    got = [tuple(r) for r in core.queries()["p6_found"](spark, sf).select("src", "row_id", "reason").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_library_stands_without_the_training_data_part():
    import pathlib
    import re

    root = pathlib.Path(core.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"tessella\.llm|from \.+llm", p.read_text()), p
