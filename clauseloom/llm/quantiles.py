"""Percentiles with a bounded relative error from counts that can be added.

A value falls into the bucket ``ceil(log(|v|) / log(g))`` of its sign, with ``g
= (1 + e) / (1 - e)``; zero has a bucket of its own. Counts of the same bucket
are added across partitions, days or files, and a percentile is the middle of
the bucket that holds its rank: never off by more than a share ``e`` of the
exact value of that rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ERROR = 0.01
#: Rows of the largest group up to which groups are taken together before copies are told and counted.
GROUP_ROWS = 200_000
#: Added to a bucket so that it is positive: more than the bucket of any double at errors down to 1e-6.
_SPAN = 1 << 29

Keep = Callable[[Column], Column]


def _log_base(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    return math.log((1 + error) / (1 - error))


def _code(value: Column, base: float, keep: Keep | None) -> Column:
    """Sign and bucket of a value as one number: 0 for zero, null for what is no measurement."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(math.inf))
    place = F.ceil(F.log(F.abs(value)) / F.lit(base)).cast("int") + F.lit(_SPAN)
    return F.when(finite if keep is None else finite & keep(value), F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("int") * place))


def _same(columns: list[str]) -> list[Column]:
    """Each column equal to the one of its name with a stroke before it, nulls included."""
    return [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]


def sketch(df: DataFrame, by: list[str], values: list[str], error: float = ERROR, keep: Keep | None = None, once: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (by, metric, sign, bucket, n): the counts of all finite values of the columns ``values``.

    Null, NaN and infinite values are no measurements and count nowhere; ``keep``
    is a further condition on a value. Null keys form a group of their own.
    Exact copies of a row, with the same ``once``, count once: to find them only
    the keys and buckets are shuffled. If no group has more than ``group_rows``
    rows (one pass counts them), that shuffle goes by group and is the only one,
    also for the percentiles; else copies are told by their whole rows and
    counting happens before the next shuffle, so that a group that holds a third
    of all rows leaves each task as some hundred buckets. The counts are the same.
    """
    base = _log_base(error)
    rows = df.select(*by, *([once] if once else []), *[_code(F.col(v).cast("double"), base, keep).alias(f"_{k}") for k, v in enumerate(values)])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("code")) for k in range(len(values))])
    if once:
        largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] if by else None
        rows = (rows.repartition(*by) if largest is not None and largest <= group_rows else rows).distinct()
    long = rows.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*").where(F.col("code").isNotNull())
    counts = long.groupBy(*by, "k", "code").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(v) for v in values])
    bucket = F.when(F.col("code") == 0, F.lit(0)).otherwise(F.abs("code") - F.lit(_SPAN))
    return counts.select(*by, F.get(names, F.col("k")).alias("metric"), F.signum("code").cast("int").alias("sign"), bucket.cast("int").alias("bucket"), "n")


def merge(counts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of parts combined to those of ``by``: counts of equal buckets are added."""
    return counts.groupBy(*by, "metric", "sign", "bucket").agg(F.sum("n").alias("n"))


def _at_ranks(counts: DataFrame, by: list[str], at: list[float], error: float) -> DataFrame:
    """by, metric, p, n, estimate and where it was found: sign, bucket, rank and the number of values below the bucket."""
    base = _log_base(error)
    group = W.partitionBy(*by, "metric")
    upto = F.sum("n").over(group.orderBy("sign", F.col("sign") * F.col("bucket")).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counts.withColumns({"_upto": upto, "_all": F.sum("n").over(group)})
    rank = lambda p: F.greatest(F.lit(1), F.ceil(p * F.col("_all") - 1e-9))
    wanted = F.filter(F.array(*[F.lit(float(p)) for p in at]), lambda p: (rank(p) <= F.col("_upto")) & (rank(p) > F.col("_upto") - F.col("n")))
    middle = F.exp(F.col("bucket") * F.lit(base) + F.lit(math.log(2 / (math.exp(base) + 1))))  # one exponent: no overflow at the top of the range
    found = ranked.select(*by, "metric", F.explode(wanted).alias("p"), "_all", "sign", "bucket", (F.col("_upto") - F.col("n")).alias("below"))
    estimate = F.col("sign") * F.when(F.col("sign") == 0, 0.0).otherwise(middle)
    return found.select(*by, "metric", "p", F.col("_all").alias("n"), estimate.alias("estimate"), "sign", "bucket", rank(F.col("p")).alias("rank"), "below")


def percentiles(counts: DataFrame, by: list[str], at: list[float], error: float = ERROR) -> DataFrame:
    """by, metric, p, n and estimate: the value of rank ``ceil(p * n)`` (the first for p = 0) within a relative error ``error``.

    A group has as many buckets as its values' range allows, some thousands for
    the whole range of doubles, however many values they count.
    """
    return _at_ranks(counts, by, at, error).select(*by, "metric", "p", "n", "estimate")


def exact_percentiles(df: DataFrame, by: list[str], values: list[str], at: list[float], error: float = ERROR, keep: Keep | None = None, once: str | None = None) -> DataFrame:
    """by, metric, p, n, estimate and exact: the percentiles of :func:`percentiles` beside the true values of the same ranks.

    A second pass takes only the rows in the buckets that hold a rank. Equal
    values are counted before the shuffle, so no group is sorted as a whole.
    """
    base = _log_base(error)
    found = _at_ranks(sketch(df, by, values, error, keep, once), by, at, error)
    code = F.when(F.col("sign") == 0, F.lit(0)).otherwise(F.col("sign") * (F.col("bucket") + F.lit(_SPAN)))
    found = found.withColumn("code", code.cast("int")).drop("sign", "bucket")
    key = [*by, "metric", "code"]
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("exact"), _code(F.col(v).cast("double"), base, keep).alias("code")) for v in values])
    long = df.select(*by, *([once] if once else []), F.explode(pairs).alias("_p")).select(*by, *([once] if once else []), "_p.*")
    asked = found.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    inside = long.where(F.col("code").isNotNull()).join(asked, _same(key), "left_semi")
    counted = (inside.distinct() if once else inside).groupBy(*key, "exact").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*key).orderBy("exact").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counted.select(*[F.col(c).alias(f"_{c}") for c in key], "exact", upto.alias("_to"), (upto - F.col("_n")).alias("_from"))
    rank = F.col("rank") - F.col("below")
    return found.join(placed, [*_same(key), rank <= F.col("_to"), rank > F.col("_from")]).select(*by, "metric", "p", "n", "estimate", "exact")
