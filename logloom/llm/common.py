"""Shared column expressions and Arrow helpers of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, the class [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def utf8(col: Column | str) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t): only these two columns travel, so other columns cannot clash with internal ones."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_of_id(col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def batches(parts: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many rows, so that Python copies of a batch stay small."""
    for part in parts:
        for start in range(0, part.num_rows, rows):
            yield part.slice(start, rows)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def release() -> None:
    """Gives free memory back to the system; Arrow and the C library keep it otherwise, and a worker lives for many tasks."""
    pa.default_memory_pool().release_unused()
    _trim(0)


_kept: dict[str, object] = {}


def keep(name: str, make=None):
    """What a worker process keeps from task to task: one thing, made when first asked for.

    Asking for another thing, or for nothing, lets the last one go, so that a worker that serves several
    operators never holds the tables of all.
    """
    if name not in _kept:
        _kept.clear()
        release()
        if make is not None:
            _kept[name] = make()
    return _kept.get(name)
