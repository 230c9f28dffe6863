"""Small helpers around mapInArrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tesserine.runtime import ship


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[tuple], Iterator[tuple]]], flush: int = 20_000) -> DataFrame:
    """Stream df's rows (as tuples) through make()'s function and yield its tuples under schema.

    make runs once per task, so it may build caches; the generator it returns
    gets one row at a time. Batches of at most `flush` rows go back to the JVM.
    """
    ship(df.sparkSession)
    kind = _parse_datatype_string(schema)
    target = to_arrow_schema(kind)
    names = [f.name for f in kind.fields]

    def run(batches):
        step = make()
        out: list[tuple] = []

        def packed():
            columns = list(zip(*out)) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, target)], schema=target)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                out.extend(step(row))
                if len(out) >= flush:
                    yield packed()
                    out.clear()
        tail = getattr(step, "close", None)
        if tail is not None:
            out.extend(tail())
        if out:
            yield packed()

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, schema: str, make: Callable[[], Callable[[list], Iterator[list]]]) -> DataFrame:
    """Stream df's batches (as Arrow columns) through make()'s function, which yields batches as lists of columns under schema."""
    ship(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        step = make()
        for batch in batches:
            for columns in step(batch.columns):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

    return df.mapInArrow(run, schema)
