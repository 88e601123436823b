"""Row-wise text work in Arrow batches, and small shared expressions."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pixtab.functions.lineage import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows turned into Python objects at once, and rows of one output batch: what is held beside Spark's batch is small.
ROWS_IN, ROWS_OUT = 256, 1000


def per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, kept for later tasks of the same Python worker; functions themselves are shipped anew with each task."""
    store = sys.modules.setdefault("_pixtab_worker", types.ModuleType("_pixtab_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again: for wide tables of texts."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def whole_rows(docs: DataFrame, **own: Column) -> DataFrame:
    """``own`` columns beside each row of ``docs`` as the struct ``_r``, so that no name of ``docs`` can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_r"), *[c.alias(n) for n, c in own.items()])


def rows_back(df: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``_r``, with some changed."""
    names = df.schema["_r"].dataType.names
    return df.select(*[changed.get(n, F.col(f"_r.`{n}`")).alias(n) for n in names])


def ascii_lower(c: Column) -> Column:
    """Only A-Z become a-z."""
    return F.translate(c, UPPER, LOWER)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str | StructType) -> DataFrame:
    """``make()`` runs once a task and returns ``f(*columns of a row) -> rows out``.

    Batches come in as Spark cuts them (by rows and bytes) and go out at ``ROWS_OUT`` rows.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    # The Arrow schema is made in the task: nothing of the driver's session is needed there.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(schema)
        f, held = make(), []

        def flush() -> pa.RecordBatch:
            columns = zip(*held, strict=True) if held else ([] for _ in shape)
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, shape, strict=True)], schema=shape)
            held.clear()
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_IN):
                part = batch.slice(lo, ROWS_IN)
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    held.extend(f(*row))
                    if len(held) >= ROWS_OUT:
                        yield flush()
        yield flush()

    return df.mapInArrow(run, schema)


def map_all(df: DataFrame, f: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """``f`` gets the rows of a task, one after the other, and returns its rows out; for work on many rows at once (see ``map_rows``)."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(schema)
        parts = (batch.slice(lo, ROWS_IN) for batch in batches for lo in range(0, batch.num_rows, ROWS_IN))
        rows = iter(f(row for part in parts for row in zip(*(c.to_pylist() for c in part.columns), strict=True)))
        while held := list(islice(rows, ROWS_OUT)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), shape, strict=True)], schema=shape)

    return df.mapInArrow(run, schema)
