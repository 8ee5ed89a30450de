"""Problem 8: encoding with a public tokenizer, over Arrow batches.

The vocabulary file's folder is a parameter, else the environment's ``TOKENIZERS``, else ``/opt/tokenizers``.
Special tokens' strings in a text are ordinary text, and none is added.

A null text and an empty text both give an empty list. Texts are encoded whole, a batch of about
``BATCH_CHARS`` characters at a time; a longer text is a batch of its own.

Decoding reverses the byte table: the characters of a byte-level vocabulary stand for single bytes.
A token may hold part of a character's bytes only; its offsets then cover that character, and so do its
neighbours'.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH_CHARS = 400_000
DEFAULT = "byte_bpe_50k"


def vocabulary(name: str = DEFAULT, folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("TOKENIZERS", "/opt/tokenizers"), f"{name}.json")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def byte_table() -> dict[str, int]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id of a byte-level vocabulary; a special token's are those of its string."""
    table = byte_table()
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    return {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in vocab.items()}


def decode(ids: list[int] | np.ndarray, path: str) -> str:
    """The text of ids; bytes that make no whole character become U+FFFD."""
    table = token_bytes(path)
    return b"".join(table[int(i)] for i in ids).decode("utf-8", "replace")


def char_offsets(ids: list[int] | np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end, in code points, of the characters of which each token holds a byte."""
    table = token_bytes(path)
    parts = [table[int(i)] for i in ids]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    starts = ends - np.array([len(p) for p in parts], dtype=np.int64)
    lead = (data & 0xC0) != 0x80
    char = np.cumsum(lead) - 1  # the character each byte belongs to
    return (char[starts].astype(np.int32), (char[ends - 1] + 1).astype(np.int32)) if len(parts) else (np.empty(0, np.int32), np.empty(0, np.int32))


def _runs(texts: list[str | None]) -> Iterator[list[str]]:
    run, size = [], 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > BATCH_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def _encode(texts: list[str | None], path: str) -> Iterator[list[int]]:
    t = _tokenizer(path)
    for run in _runs(texts):
        for e in t.encode_batch_fast(run, add_special_tokens=False):
            yield e.ids


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).astype(np.int32) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _arrow(df: DataFrame, key: str, text: str, made: list[T.StructField], work) -> DataFrame:
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = work(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, *[f.name for f in made]])

    return df.select(key, text).mapInArrow(run, schema)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """``key, ids``: the token ids of each row's text, whole."""
    path = vocabulary(name, folder)
    field = T.StructField("ids", T.ArrayType(T.IntegerType(), True))
    return _arrow(df, key, text, [field], lambda texts: [_lists([np.array(i, dtype=np.int32) for i in _encode(texts, path)])])


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """``key, n_tokens`` only; the ids never leave Python."""
    path = vocabulary(name, folder)
    return _arrow(df, key, text, [T.StructField("n_tokens", T.LongType())], lambda texts: [pa.array([len(i) for i in _encode(texts, path)], pa.int64())])


def offsets(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """``key, begins, ends`` of each token in code points, and ``exact``: decoding gives the text again."""
    path = vocabulary(name, folder)

    def work(texts: list[str | None]) -> list[pa.Array]:
        b, e, ok = [], [], []
        for t, ids in zip(texts, _encode(texts, path), strict=True):
            x, y = char_offsets(ids, path)
            b.append(x)
            e.append(y)
            ok.append(decode(ids, path) == (t or ""))
        return [_lists(b), _lists(e), pa.array(ok, pa.bool_())]

    ints = T.ArrayType(T.IntegerType(), True)
    return _arrow(df, key, text, [T.StructField("begins", ints), T.StructField("ends", ints), T.StructField("exact", T.BooleanType())], work)


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """``key, text`` from ids; null ids give null."""
    path = vocabulary(name, folder)

    def work(rows: list) -> list[pa.Array]:
        return [pa.array([None if r is None else decode(r, path) for r in rows], pa.string())]

    return _arrow(df, key, ids, [T.StructField("text", T.StringType())], work)
