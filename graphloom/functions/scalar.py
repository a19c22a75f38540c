"""Scalar functions of graph query languages as Column expressions; null in, null out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_integer(x: Column) -> Column:
    """Text or number to a whole number, truncated; null if it is none."""
    return x.try_cast("double").cast("bigint")


def to_float(x: Column) -> Column:
    return x.try_cast("double")


def to_boolean(x: Column) -> Column:
    return x.try_cast("boolean")


def to_string(x: Column) -> Column:
    return x.cast("string")


def divide(a: Column, b: Column, whole: bool) -> Column:
    """a / b; whole numbers (``whole``) are divided without remainder towards zero.  Null for a zero divisor."""
    if whole:
        return F.when(b != 0, (a - a % b) / b).cast("bigint")
    return F.try_divide(a, b)


def substring(s: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """From a 0-based start, to the end without a length."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.length(s) if length is None else F.lit(length) if isinstance(length, int) else length
    return F.substring(s, start + 1, length)


def split(s: Column, delimiter: str = ",") -> Column:
    """Parts of s at a delimiter that is text, not a pattern."""
    return F.split(s, "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E")


def matches(s: Column, pattern: str) -> Column:
    """Whether the whole of s matches a regular expression."""
    return s.rlike(f"^(?:{pattern})$")


def head(xs: Column) -> Column:
    return F.get(xs, 0)


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def tail(xs: Column) -> Column:
    return F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0)))


def item(xs: Column, i: int) -> Column:
    """The element at a 0-based place, from the end if negative; null beyond the list."""
    return F.get(xs, i) if i >= 0 else F.get(xs, F.size(xs) + i)


def part(xs: Column, a: int, b: int) -> Column:
    """The elements from place a to before b, both not negative."""
    return F.slice(xs, F.lit(a + 1), F.lit(max(0, b - a)))


def number_range(a: Column | int, b: Column | int, step: int = 1) -> Column:
    """Whole numbers from a to b, both included; empty if b lies against the step."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (a, b))
    fits = a <= b if step > 0 else a >= b
    return F.when(fits, F.sequence(a, b, F.lit(step))).otherwise(F.array().cast("array<bigint>"))


def size(df: DataFrame, name: str) -> Column:
    """Elements of a list or characters of a text, by the column's type."""
    kind = df.schema[name].dataType.typeName()
    return F.size(name) if kind in ("array", "map") else F.length(name)


def list_of(xs: Column, where=None, value=None) -> Column:
    """[x IN xs WHERE where | value]"""
    xs = F.filter(xs, where) if where else xs
    return F.transform(xs, value) if value else xs


def every(xs: Column, test) -> Column:
    return F.forall(xs, test)


def some(xs: Column, test) -> Column:
    return F.exists(xs, test)


def none(xs: Column, test) -> Column:
    return ~F.exists(xs, test)


def single(xs: Column, test) -> Column:
    return F.size(F.filter(xs, test)) == 1


def xor(a: Column, b: Column) -> Column:
    return a.cast("boolean") != b.cast("boolean")


def pi() -> Column:
    return F.lit(math.pi)


def e() -> Column:
    return F.lit(math.e)


def timestamp() -> Column:
    """Milliseconds since 1970."""
    return F.unix_millis(F.current_timestamp())


def iso(t: Column) -> Column:
    """A timestamp as ISO text in UTC with milliseconds."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def properties(df: DataFrame, var: str) -> Column:
    """A struct of the variable's properties without system fields (those that start with "_")."""
    start = f"{var}__"
    return F.struct(*[F.col(c).alias(c[len(start) :]) for c in df.columns if c.startswith(start) and not c.startswith(f"{start}_")])


def distinct_list(x: Column) -> Column:
    """collect(DISTINCT x), sorted."""
    return F.array_sort(F.collect_set(x))
