"""Readers and writers of the file forms: JSON, JSON lines, CSV, annotation pairs, ZIP members, manifests.

Schemas are given, never inferred. Gold is read with FAILFAST; predictions keep what doesn't parse in ``_corrupt_record``.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINARY = "path string, member string, depth int, size long, content binary"


def _with_corrupt(schema: str | T.StructType) -> str:
    ddl = schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")
    return f"{ddl}, _corrupt_record string"


def json_documents(spark: SparkSession, path: str, schema: str, gold: bool = False) -> DataFrame:
    """One JSON document per file; fields outside the schema are skipped by the parser."""
    r = spark.read.option("multiLine", True).option("mode", "FAILFAST" if gold else "PERMISSIVE")
    return r.schema(schema if gold else _with_corrupt(schema)).json(path)


def json_lines(spark: SparkSession, path: str, schema: str, gold: bool = False) -> DataFrame:
    """One JSON object per line, blank lines skipped."""
    r = spark.read.option("mode", "FAILFAST" if gold else "PERMISSIVE")
    return r.schema(schema if gold else _with_corrupt(schema)).json(path)


def json_array_projection(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Rows of files that hold one JSON array of objects; only the named fields are decoded."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(fields).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines, one writer per partition; appending adds files and never rewrites one."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def csv_table(spark: SparkSession, path: str, schema: str, keep: list[str] | None = None) -> DataFrame:
    """CSV with a header, a byte-order mark dropped, the allowed fields only."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("enforceSchema", True).option("mode", "FAILFAST").schema(schema).csv(path)
    return df.select(*keep) if keep else df


def nested_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named (also nested) columns only; pruning reaches into structs."""
    return spark.read.parquet(path).select(*columns)


def struct_of_arrays(df: DataFrame, column: str, fields: list[str], keep: list[str]) -> DataFrame:
    """One row per entry of a struct of equally long arrays; unequal lengths raise."""
    sizes = [F.size(F.col(f"{column}.{f}")) for f in fields]
    even = F.lit(True)
    for s in sizes[1:]:
        even = even & (s == sizes[0])
    checked = F.when(even, F.arrays_zip(*[F.col(f"{column}.{f}").alias(f) for f in fields])).otherwise(F.raise_error(F.lit(f"unequal lengths in {column}")))
    return df.select(*keep, F.inline(checked))


def annotation_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc, text, lines``: pairs of ``.txt`` and ``.ann`` files by stem, the lines split at LF with their bytes; blank lines are dropped.

    A text without annotations has no lines; annotations without text have a null text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,ann}").load(folder)
    f = files.select(F.regexp_extract("path", r"([^/]+)\.(txt|ann)$", 1).alias("doc"), F.regexp_extract("path", r"\.(txt|ann)$", 1).alias("kind"), "content")
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("content")))
    return f.groupBy("doc").agg(one("txt").cast("string").alias("text"), one("ann").alias("annotations"))


def annotation_lines(documents: DataFrame) -> DataFrame:
    """``doc, occurrence, raw``: the annotation lines of :func:`annotation_documents`, bytes kept; a batch-wise split, as a line may be no UTF-8."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, line) for d, a in zip(b["doc"], b["annotations"], strict=True) if a is not None for i, line in enumerate(x for x in bytes(a).split(b"\n") if x.strip())]
            yield pd.DataFrame(rows, columns=["doc", "occurrence", "raw"])

    return documents.select("doc", "annotations").mapInPandas(split, "doc string, occurrence int, raw binary")


def _members(path: str, data: bytes, depth: int, most: int, name: str = "") -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            if info.is_dir():
                continue
            full = f"{name}!{info.filename}" if name else info.filename
            if info.filename.startswith("/") or ".." in info.filename.split("/"):
                raise ValueError(f"unsafe member {full}")
            content = z.read(info)
            if info.filename.lower().endswith(".zip"):
                if depth + 1 >= most:
                    raise ValueError(f"archives nested {most} deep: {full}")
                yield from _members(path, content, depth + 1, most, full)
            else:
                yield path, full, depth, len(content), content


def zip_members(spark: SparkSession, path: str, most_depth: int = 8) -> DataFrame:
    """Members of archives, of archives within them too (their names joined by ``!``), one at a time; a corrupt one raises."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                for row in _members(p, bytes(c), 0, most_depth):
                    yield pd.DataFrame([row], columns=["path", "member", "depth", "size", "content"])

    return files.mapInPandas(run, BINARY)


def reassembled(chunks: DataFrame, key: str, offset: str, content: str) -> DataFrame:
    """Chunks joined in order of offset; a gap, an overlap or a repeat raises."""
    c = F.sort_array(F.collect_list(F.struct(F.col(offset).cast("long").alias("o"), F.col(content).alias("c"))))
    g = chunks.groupBy(key).agg(c.alias("_c"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("ok"))
    walk = F.aggregate("_c", start, lambda s, x: F.struct((s["at"] + F.length(x["c"])).alias("at"), (s["ok"] & (x["o"] == s["at"])).alias("ok")))
    whole = F.aggregate("_c", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["c"]))
    return g.select(key, F.when(walk["ok"], whole).otherwise(F.raise_error(F.lit("chunks don't join"))).alias(content))


def write_once(df: DataFrame, path: str) -> str:
    """Writes a table where there is none. If there is one already, it must hold the same rows: else it raises. Says which it was."""
    spark = df.sparkSession
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        df.write.mode("errorifexists").parquet(path)
        return "written"
    there = spark.read.parquet(path)
    if there.columns != df.columns or there.exceptAll(df).take(1) or df.exceptAll(there).take(1):
        raise FileExistsError(f"{path} holds other rows")
    return "same"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256, size_bytes`` of files below a folder, names relative to it."""
    root = path.rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select(F.element_at(F.split("path", f"{os.path.basename(root)}/", 2), -1).alias("path"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size_bytes"))


def snapshot(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """A copy of a source as a table, and an order-free digest of its rows that a later check can repeat."""
    df.write.mode("errorifexists").parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    return copy, digest(copy)


def digest(df: DataFrame) -> int:
    """An order-free digest of rows: the sum of their 64-bit hashes."""
    return int(df.agg(F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first()[0])
