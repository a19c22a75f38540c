"""Documents as structs or maps: merge, keep, unset, zip, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fields(df: DataFrame, name: str) -> list[str]:
    return df.schema[name].dataType.fieldNames()


def attributes(df: DataFrame, name: str, internal: bool = True, sort: bool = False) -> Column:
    """The field names of a struct column; without those that start with "_" unless ``internal``."""
    names = [n for n in _fields(df, name) if internal or not n.startswith("_")]
    return F.array(*[F.lit(n) for n in (sorted(names) if sort else names)])


def has(df: DataFrame, name: str, attribute: str) -> Column:
    """Whether a struct has the field and a value in it."""
    return F.col(name)[attribute].isNotNull() if attribute in _fields(df, name) else F.lit(False)


def merge(df: DataFrame, *names: str) -> Column:
    """One struct of several struct columns; later ones win."""
    source = {f: n for n in names for f in _fields(df, n)}
    return F.struct(*[F.col(n)[f].alias(f) for f, n in source.items()])


def keep(df: DataFrame, name: str, *fields: str) -> Column:
    return F.struct(*[F.col(name)[f].alias(f) for f in _fields(df, name) if f in fields])


def unset(df: DataFrame, name: str, *fields: str) -> Column:
    return F.struct(*[F.col(name)[f].alias(f) for f in _fields(df, name) if f not in fields])


def zipped(keys: Column, values: Column) -> Column:
    """A map of two lists."""
    return F.map_from_arrays(keys, values)


def value(column: Column, *path: str | int) -> Column:
    """What lies at a path of field names and 0-based places."""
    for step in path:
        column = F.get(column, step) if isinstance(step, int) else column[step]
    return column


def values(df: DataFrame, name: str, internal: bool = True) -> Column:
    """A struct's values as texts, in order."""
    return F.array(*[F.col(name)[f].cast("string") for f in _fields(df, name) if internal or not f.startswith("_")])


def flatten(xs: Column, depth: int = 1) -> Column:
    for _ in range(depth):
        xs = F.flatten(xs)
    return xs


def parse_identifier(id: Column) -> Column:
    """A struct (collection, key) of "collection/key"."""
    return F.struct(F.split_part(id, F.lit("/"), F.lit(1)).alias("collection"), F.split_part(id, F.lit("/"), F.lit(2)).alias("key"))


def lookup(df: DataFrame, id: str, documents: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the document (a struct) whose ``key`` equals ``id``; null if there is none."""
    other = documents.select(F.col(key).alias("_key_value"), F.struct(*documents.columns).alias(name))
    return df.join(other, F.col(id) == F.col("_key_value"), "left").drop("_key_value")
