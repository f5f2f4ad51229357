"""Joins whose left side may have keys that hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a key from which it is split, and rows of each of its parts.
HOT_ROWS = 200_000
#: Keys that can be split: larger tables have larger parts, so that the list of hot keys, which every task gets, never grows beyond this.
MOST_HOT = 100_000


def hot_keys(keys: DataFrame, key: str, hot_rows: int = HOT_ROWS, most: int = MOST_HOT) -> DataFrame:
    """_hot and _salts: the keys with ``hot_rows`` rows or more and into how many parts each is split.

    A part has at most ``max(hot_rows, rows / most)`` rows and a hot key at
    least as many, so there are ``most`` of them at most, whatever the size of
    the table. Counts are combined before the shuffle. Null counts as a key.
    """
    counts = keys.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    part = F.greatest(F.lit(hot_rows), F.ceil(keys.agg(F.count(F.lit(1))).scalar() / most))
    return counts.where(F.col("_n") >= part).select("_hot", F.ceil(F.col("_n") / part).cast("int").alias("_salts"))


def skewed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS, salts: int | None = None, counted: DataFrame | None = None, spread_by: list[str] | None = None) -> DataFrame:
    """Join ``left`` with ``right``, which has one row per key at most.

    The rows of a hot key (see :func:`hot_keys`) are dealt out over ``salts``
    parts, or as many as their number asks for, by a hash of ``spread_by`` (all columns but
    maps, if not given), so that a task that is run again deals alike; its right
    row, one per key, is copied to each part. Other keys are not touched. Null
    keys join nothing; with ``how="left"`` they are kept and dealt out as well.
    ``counted`` may have the keys of ``left`` from where they are cheaper to
    count; some more rows do no harm.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    hot = hot_keys(left if counted is None else counted, key, hot_rows)
    hot = F.broadcast(hot if salts is None else hot.withColumn("_salts", F.lit(salts)))
    by = spread_by or [f.name for f in left.schema.fields if not isinstance(f.dataType, T.MapType)]
    salt = F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.col("_salts")).cast("int"), F.lit(0))
    marked = left.join(hot, left[key].eqNullSafe(hot["_hot"]), "left").withColumn("_salt", salt).drop("_hot", "_salts")
    copies = right.where(F.col(key).isNotNull()).join(hot, F.col(key) == hot["_hot"], "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_hot", "_salts")
    return marked.join(copies, [key, "_salt"], how).drop("_salt")
