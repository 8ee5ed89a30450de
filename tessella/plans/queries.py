"""All core queries over the test tables, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["scoring", "annotations", "inference", "texts", "provenance", "native", "metrics", "oracles"]


def _modules() -> list:
    return [import_module(f"tessella.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _modules():
        out |= m.SQL
    return out
