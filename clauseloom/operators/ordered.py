"""Numbers, ranks and exact percentiles of groups of any size: no group is sorted by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseloom.tables import cut


def ordered_index(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """Number rows from ``start`` in a global order without one task for all of them.

    Rows are range-partitioned and sorted, partitions are counted, and each
    adds its offset: two passes over a checkpoint, as the partitions must not
    change in between.
    """
    placed = cut(df.orderBy(*order).withColumn("_pid", F.spark_partition_id()))
    counts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(F.col("_pid").alias("_p"), (F.sum("_n").over(W.orderBy("_pid")) - F.col("_n")).alias("_before"))  # a row per partition
    within = F.row_number().over(W.partitionBy("_pid").orderBy(*order)) - 1
    return placed.join(F.broadcast(offsets), placed["_pid"] == offsets["_p"]).withColumn(name, within + F.col("_before") + F.lit(start)).drop("_pid", "_p", "_before")


def running_counts(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, upto, total: each value of a group, its rows, the rows up to it, and all rows of the group.

    Equal values are counted before the shuffle. The rest is cut into ranges
    over all groups, each range is summed in its own task and adds what the
    ranges before it hold, so a group that has most of the rows is in many
    tasks. The ranges are cut through a checkpoint, as they must not move.
    """
    counts = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    placed = cut(counts.repartitionByRange(*by, value).withColumn("_pid", F.spark_partition_id()))
    parts = placed.groupBy(*by, "_pid").agg(F.sum("n").alias("_m"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))  # a row for each group and range
    before = F.sum("_m").over(group.orderBy("_pid")) - F.col("_m")
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_pid").alias("_p"), before.alias("_before"), F.sum("_m").over(group).alias("total"))
    upto = F.sum("n").over(W.partitionBy(*by, "_pid").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = placed.withColumn("_upto", upto).join(parts, [F.col("_pid") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]])
    return joined.select(*by, value, "n", (F.col("_upto") + F.col("_before")).alias("upto"), "total")


def average_ranks(values: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by, value and its rank from 1, ties at their mean."""
    return running_counts(values, by, value).select(*by, value, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(name))


def interpolated_percentiles(values: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """by, n and a column for each name in ``at``: exact percentiles, between two values in proportion. Null and NaN are no values."""
    kept = values.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias(value))
    counts = running_counts(kept, by, value)
    found = [F.max("total").alias("n")]
    for name, p in at.items():
        place = F.col("total") * p - p
        holds = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)
        found += [F.max(F.when(holds(end(place)), F.col(value))).alias(f"_{side}_{name}") for side, end in (("low", F.floor), ("high", F.ceil))]
    rows = counts.groupBy(*by).agg(*found)
    for name, p in at.items():
        place = (F.col("n") - 1) * p
        part = place - F.floor(place)
        rows = rows.withColumn(name, F.col(f"_low_{name}") * (1 - part) + F.col(f"_high_{name}") * part)
    return rows.select(*by, "n", *at)
