"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

#: Keys that a counting task holds before it passes them on.
HELD = 200_000
#: Values that replaced_batches() hands over at a time.
CHUNK = 256


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def replaced_batches(df: DataFrame, source: str, new: str, ddl: str, make: Callable[[list], list]) -> DataFrame:
    """df with ``source`` replaced by ``new`` of type ``ddl``; ``make`` turns a list of values into the list of results.

    Lists are cut at CHUNK values, so that no more than those are Python objects at a time.
    """
    rest = [c for c in df.columns if c not in (source, new)]
    n, names, kind = len(rest), [*rest, new], to_arrow_type(_parse_datatype_string(ddl))
    schema = df.select(*rest).limit(0).withColumn(new, F.lit(None).cast(ddl)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(make(part.column(n).to_pylist()), kind)], names=names)

    return df.select(*rest, source).mapInArrow(run, schema)


def replaced(df: DataFrame, source: str, new: str, ddl: str, one: Callable) -> DataFrame:
    """replaced_batches() with a function of one value (None for null)."""
    return replaced_batches(df, source, new, ddl, lambda values: list(map(one, values)))


def in_fold(id: str, parts: int, fold: int):
    """Whether crc32 of the id's text leaves ``fold`` modulo ``parts``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % parts == fold, F.lit(False))
