"""Small column helpers shared by the text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case-blind and Unicode-aware, as text patterns are meant throughout.
FLAGS = "(?iU)"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, '' where there is none."""
    return F.regexp_extract(text, pattern, group)


def present(array: Column) -> Column:
    """An array without its nulls."""
    return F.filter(array, lambda x: x.isNotNull())


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_by(array: Column, key: str) -> Column:
    """An array of structs without later elements of a key seen before."""
    return F.filter(array, lambda x, i: ~F.exists(F.slice(array, F.lit(1), i), lambda y: y[key] == x[key]))


def empty(ddl: str) -> Column:
    """An empty array of a type."""
    return F.array().cast(ddl)
