"""Statistics as column builders, usable plain or grouped, and the operators around them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseloom.operators.ordered import average_ranks

# Normal quantiles of the usual confidence levels.
Z = {0.95: 1.95996398454, 0.90: 1.64485362695, 0.99: 2.57582930355}
#: Rows of a group up to which its values travel as one array, and rows of a table of draws up to which it is sent to all tasks.
ARRAY_ROWS, FEW_DRAWS = 1_000_000, 500_000


def normal_quantile(confidence: float) -> float:
    """Two-sided quantile: tabulated, else from an approximation of the inverse error function."""
    if confidence in Z:
        return Z[confidence]
    a, tail = 0.147, math.log(1 - confidence**2)
    middle = 2 / (math.pi * a) + tail / 2
    return math.sqrt(2) * math.sqrt(math.sqrt(middle**2 - tail / a) - middle)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def wilson(successes: Column, total: Column, confidence: float = 0.95) -> Column:
    """STRUCT<lower, upper>: Wilson's interval of a share, four decimals, within 0 and 1; (0, 0) without trials."""
    z = normal_quantile(confidence)
    n, p = total.cast("double"), F.try_divide(successes.cast("double"), total.cast("double"))
    middle, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (middle - width) / scale), F.least(F.lit(1.0), (middle + width) / scale)
    some = total > 0
    return F.struct(F.when(some, F.round(low, 4)).otherwise(0.0).alias("lower"), F.when(some, F.round(high, 4)).otherwise(0.0).alias("upper"))


def confusion_counts(truth: Column, predicted: Column) -> list[Column]:
    """Aggregates tp, fp, fn, tn of two boolean columns; rows with a null are left out."""
    return [
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"),
    ]


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column, confidence: float = 0.95) -> dict[str, Column]:
    """accuracy, recall, precision, specificity, f1 and balanced_accuracy, each with _lower and _upper; 0 where undefined.

    The interval of f1 is the harmonic mean of the bounds of precision and
    recall, that of the balanced accuracy the mean of those of recall and
    specificity.
    """
    shares = {"accuracy": (tp + tn, tp + fp + fn + tn), "recall": (tp, tp + fn), "precision": (tp, tp + fp), "specificity": (tn, tn + fp)}
    point = {k: ratio(a, b) for k, (a, b) in shares.items()}
    bounds = {k: wilson(a, b, confidence) for k, (a, b) in shares.items()}
    harmonic = lambda a, b: ratio(2 * a * b, a + b)
    out: dict[str, Column] = {}
    for k in shares:
        out |= {k: F.round(point[k], 4), f"{k}_lower": bounds[k]["lower"], f"{k}_upper": bounds[k]["upper"]}
    out["f1"] = F.round(harmonic(point["precision"], point["recall"]), 4)
    out["balanced_accuracy"] = F.round((point["recall"] + point["specificity"]) / 2, 4)
    for side in ("lower", "upper"):
        out[f"f1_{side}"] = F.round(harmonic(bounds["precision"][side], bounds["recall"][side]), 4)
        out[f"balanced_accuracy_{side}"] = F.round((bounds["recall"][side] + bounds["specificity"][side]) / 2, 4)
    return out


def confusion_by(df: DataFrame, truth: Column, predicted: Column, by: list[str], total: bool = False) -> DataFrame:
    """Counts and metrics of each group, and with ``total`` of all rows (group null), in one pass."""
    grouped = df.rollup(*by) if total and len(by) == 1 else df.groupBy(*by)
    return grouped.agg(*confusion_counts(truth, predicted)).withColumns(confusion_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def cohen_kappa(df: DataFrame, a: str, b: str, by: list[str], rule: str = "categories") -> DataFrame:
    """by, n, observed, expected, kappa of two raters' columns; rows with a null are left out.

    ``rule`` says what a lack of variety means: "categories" gives 1 with one
    category in all or certain chance agreement; "observed" gives 1 or 0 as the
    raters agree or not where chance agreement is certain.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    cells = F.collect_list(F.struct("_a", "_b", "_n"))
    # one row a pair of categories: the contingency table, not the ratings
    grouped = pairs.groupBy(*by).agg(cells.alias("_cells"), F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_same"))
    names = F.array_distinct(F.concat(F.transform("_cells", lambda c: c["_a"]), F.transform("_cells", lambda c: c["_b"])))
    side = lambda k, x: F.aggregate(F.filter("_cells", lambda c: c[k] == x), F.lit(0).cast("bigint"), lambda acc, c: acc + c["_n"])
    chance = F.aggregate(names, F.lit(0.0), lambda acc, x: acc + side("_a", x) / F.col("n") * (side("_b", x) / F.col("n")))
    rows = grouped.select(*by, "n", (F.col("_same") / F.col("n")).alias("observed"), chance.alias("expected"), F.size(names).alias("_kinds"))
    plain = (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))
    certain = F.col("expected") >= 1 - 1e-12
    if rule == "categories":
        kappa = F.when((F.col("_kinds") <= 1) | certain, 1.0).otherwise(plain)
    else:
        kappa = F.when(certain, F.when(F.col("observed") >= 1 - 1e-12, 1.0).otherwise(0.0)).otherwise(plain)
    return rows.withColumn("kappa", kappa).drop("_kinds")


def fleiss_kappa(df: DataFrame, item: list[str], category: str, by: list[str], raters: int) -> DataFrame:
    """by, n_items, observed, expected, kappa over ratings in long form; ``raters`` is the fixed number of ratings an item has.

    One rater or certain chance agreement gives 1.
    """
    cells = df.groupBy(*by, *item, category).agg(F.count(F.lit(1)).alias("_n"))
    items = cells.groupBy(*by, *item).agg(F.sum(F.col("_n") * F.col("_n")).alias("_squares"))
    observed = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), (F.sum((F.col("_squares") - raters) / F.lit(float(raters * (raters - 1) or 1))) / F.count(F.lit(1))).alias("observed"))
    kinds = cells.groupBy(*by, category).agg(F.sum("_n").alias("_k"))
    total = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    shares = kinds.withColumn("_p", F.col("_k") / F.sum("_k").over(total))
    expected = shares.groupBy(*by).agg(F.sum(F.col("_p") * F.col("_p")).alias("expected"))
    joined = observed.join(expected, by) if by else observed.crossJoin(expected)  # without groups both have one row
    kappa = F.when((F.col("expected") >= 1 - 1e-9) | F.lit(raters <= 1), 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return joined.withColumn("kappa", kappa)


def fleiss_kappa_of_first(df: DataFrame, item: list[str], category: str, by: list[str]) -> DataFrame:
    """:func:`fleiss_kappa` where the number of ratings is that of each group's first item, whatever the others have."""
    cells = df.groupBy(*by, *item, category).agg(F.count(F.lit(1)).alias("_n"))
    items = cells.groupBy(*by, *item).agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") * F.col("_n")).alias("_squares"))
    groups = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), F.min_by("_m", F.struct(*item)).alias("raters"), F.sum("_squares").alias("_s"))
    groups = groups.select(*[F.col(c).alias(f"_{c}") for c in by], "n_items", "raters", "_s")
    kinds = cells.groupBy(*by, category).agg(F.sum("_n").alias("_k")).join(groups, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    share = F.col("_k") / (F.col("n_items") * F.col("raters"))
    rows = kinds.groupBy(*by).agg(F.first("n_items").alias("n_items"), F.first("raters").alias("raters"), F.first("_s").alias("_s"), F.sum(share * share).alias("expected"))
    r = F.col("raters")
    rows = rows.withColumn("observed", F.when(r > 1, (F.col("_s") / F.col("n_items") - r) / (r * (r - 1))))
    kappa = F.when((r <= 1) | (F.col("expected") >= 1 - 1e-9), 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return rows.select(*by, "n_items", "raters", "observed", "expected", kappa.alias("kappa"))


def ratio_to(df: DataFrame, by: list[str], level: str, base, value: str) -> DataFrame:
    """by, level, value and ratio: a level's value as a share of the group's value at the level ``base``; null without one or if it is 0."""
    at_base = df.where(F.col(level) == F.lit(base)).groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max(value).alias("_base"))
    rows = df.join(at_base, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left") if by else df.crossJoin(at_base)  # one row
    return rows.select(*by, level, value, F.try_divide(F.col(value), F.col("_base")).alias("ratio"))


def correlations(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, pearson, spearman, mae, rmse (four decimals) of paired values; correlations are 0 without variance or with one pair."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ranked = pairs
    for c in ("_x", "_y"):
        ranks = average_ranks(pairs, by, c, f"_r{c}").withColumnsRenamed({k: f"_k{k}" for k in [*by, c]})
        ranked = ranked.join(ranks, [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in [*by, c]]).drop(*[f"_k{k}" for k in [*by, c]])
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    gap = F.col("_x") - F.col("_y")
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), zero(F.corr("_x", "_y")).alias("pearson"), zero(F.corr("_r_x", "_r_y")).alias("spearman"),
        F.round(F.avg(F.abs(gap)), 4).alias("mae"), F.round(F.sqrt(F.avg(gap * gap)), 4).alias("rmse"),
    )


def stability(df: DataFrame, case: list[str], value: str) -> DataFrame:
    """case, n, mean, variance, sd, cv (sample; 0 with one draw or mean 0) and self_consistency, the share of pairs of draws that agree."""
    counts = df.groupBy(*case, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    v, n = F.col("_v").cast("double"), F.col("_n")
    sums = counts.groupBy(*case).agg(F.sum(n).alias("n"), F.sum(v * n).alias("_s"), F.sum(v * v * n).alias("_ss"), F.sum(n * (n - 1) / 2.0).alias("_same"))
    mean = F.col("_s") / F.col("n")
    variance = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (F.col("_ss") - F.col("_s") * mean) / (F.col("n") - 1))).otherwise(0.0)
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    return sums.select(
        *case, "n", mean.alias("mean"), variance.alias("variance"), F.sqrt(variance).alias("sd"), ratio(F.sqrt(variance), mean).alias("cv"),
        F.coalesce(F.try_divide(F.col("_same"), pairs), F.lit(1.0)).alias("self_consistency"),
    )


def threshold_sweep(df: DataFrame, score: Column, truth: Column, thresholds: list[float], by: list[str]) -> DataFrame:
    """by, threshold and confusion metrics for predictions ``score >= threshold``; all thresholds in one pass."""
    swept = df.withColumns({"_score": score, "_truth": truth}).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return confusion_by(swept, F.col("_truth"), F.col("_score") >= F.col("threshold"), [*by, "threshold"])


def bootstrap(
    df: DataFrame, by: list[str], metric: Callable[[Column], Column], key: list[str], resamples: int = 1000, confidence: float = 0.95, seed: int = 42
) -> DataFrame:
    """by, estimate, lower, upper of a weighted metric by Poisson resampling, which needs no table of draws.

    ``metric`` builds an aggregate from a weight column (1 for the estimate);
    each row gets an independent weight per resample from a hash of its ``key``
    (unique columns) and the resample's number, so all resamples are computed in one pass with
    partial aggregation. The bounds are the ordered statistics at
    ``int(alpha * B)`` and ``min(int((1 - alpha) * B), B - 1)``, four decimals.
    NaN statistics are dropped.
    """
    alpha = (1 - confidence) / 2
    cumulative, steps, p = 0.0, [], math.exp(-1)
    while 1 - cumulative > 2.0**-30:  # quantiles of the Poisson distribution of mean 1, as far as the hash can tell
        cumulative += p
        steps.append(cumulative)
        p /= len(steps)
    drawn = df.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    u = F.pmod(F.xxhash64(*key, "_b", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    stats = drawn.withColumn("_w", weight).where("_w > 0").groupBy(*by, "_b").agg(metric(F.col("_w")).alias("_stat")).where(F.col("_stat").isNotNull() & ~F.isnan("_stat"))
    ordered = stats.groupBy(*by).agg(F.sort_array(F.collect_list("_stat")).alias("_all"))  # one number a resample
    n = F.size("_all")
    low, high = F.floor(n * alpha).cast("int"), F.least(F.floor(n * (1 - alpha)).cast("int"), n - 1)
    bounds = ordered.select(*by, F.round(F.get("_all", low), 4).alias("lower"), F.round(F.get("_all", high), 4).alias("upper"))
    point = df.groupBy(*by).agg(F.round(metric(F.lit(1)), 4).alias("estimate"))
    return point.join(bounds, by, "left") if by else point.crossJoin(bounds)


def bootstrap_indexed(
    df: DataFrame, by: list[str], position: str, value: str, draws: DataFrame | Callable[[Column, Column, Column], Column], confidence: float = 0.95, resamples: int = 1000
) -> DataFrame:
    """by, estimate, lower, upper of the mean under given draws: exact resampling.

    ``position`` numbers a group's rows from 0. ``draws`` is a rule that gives the
    position drawn from n, the resample's number (from 0, below ``resamples``) and
    the place in it (from 0), all BIGINT; or a table (n, b, pos, idx) from any
    generator (:func:`draw_table`), of which a group of n rows uses the draws of
    that n. There are ``resamples`` times as many draws as rows, so values go to
    the draws: under a rule no draw is shuffled or sent, and a table of more than
    ``FEW_DRAWS`` is met in a sorted join, however small the planner takes it for.
    """
    alpha = (1 - confidence) / 2
    four = lambda c: F.round(F.round(c, 9), 4)  # noqa: E731  means of values with two decimals often end in half a fourth one, and sums in another order differ in their last digits
    stats = _stats_of_rule(df, by, position, value, draws, resamples) if callable(draws) else _stats_of_table(_sized(df, by), by, position, value, draws)
    ordered = stats.groupBy(*by).agg(F.sort_array(F.collect_list("_stat")).alias("_all"))
    n = F.size("_all")
    low, high = F.floor(n * alpha).cast("int"), F.least(F.floor(n * (1 - alpha)).cast("int"), n - 1)
    bounds = ordered.select(*by, four(F.get("_all", low)).alias("lower"), four(F.get("_all", high)).alias("upper"))
    return df.groupBy(*by).agg(four(F.avg(value)).alias("estimate")).join(bounds, by)


def _sized(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by)))


def _stats_of_table(sized: DataFrame, by: list[str], position: str, value: str, draws: DataFrame) -> DataFrame:
    """by, b and _stat, the mean of each resample. Tables made by ``explode`` look small to the planner, so their rows are counted as far as the bound."""
    near = F.broadcast(draws) if draws.limit(FEW_DRAWS + 1).count() <= FEW_DRAWS else draws.hint("merge")
    return sized.join(near, (sized["_n"] == draws["n"]) & (sized[position] == draws["idx"])).groupBy(*by, "b").agg(F.avg(value).alias("_stat"))


def _stats_of_rule(df: DataFrame, by: list[str], position: str, value: str, rule: Callable[[Column, Column, Column], Column], resamples: int) -> DataFrame:
    """by, b and _stat, the mean of each resample.

    A group's values travel as one array, once for each part of its resamples;
    a group has parts in proportion to its share of all rows. Groups of more
    than ``ARRAY_ROWS`` rows meet a table made from the rule.
    """
    session, long = df.sparkSession, lambda v: F.lit(v).cast("bigint")
    largest, total = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    tasks = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    sized = None if (largest or 0) <= ARRAY_ROWS else _sized(df, by)
    short = df if sized is None else sized.where(F.col("_n") <= ARRAY_ROWS)
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v")))), lambda x: x["v"])
    groups = short.groupBy(*by).agg(listed.alias("_values")).withColumn("_n", F.size("_values").cast("bigint"))
    groups = groups.withColumn("_parts", F.least(long(resamples), F.ceil(F.col("_n") * tasks / F.lit(total))))
    dealt = groups.withColumn("_part", F.explode(F.sequence(long(0), F.col("_parts") - 1))).repartition(tasks, *by, "_part")
    each = dealt.withColumn("b", F.explode(F.sequence("_part", long(resamples - 1), "_parts"))).withColumn("_pos", F.explode(F.sequence(long(0), F.col("_n") - 1)))
    drawn = F.get("_values", rule(F.col("_n"), F.col("b"), F.col("_pos")).cast("int"))
    stats = each.groupBy(*by, "_part", "b").agg(F.avg(drawn).alias("_stat")).drop("_part")  # where the part is
    if sized is None:
        return stats
    large = sized.where(F.col("_n") > ARRAY_ROWS)
    draws = large.select(F.col("_n").alias("n")).distinct().withColumn("b", F.explode(F.sequence(long(0), long(resamples - 1)))).repartition(tasks, "n", "b")
    draws = draws.withColumn("pos", F.explode(F.sequence(long(0), F.col("n") - 1)))
    return stats.unionByName(_stats_of_table(large, by, position, value, draws.withColumn("idx", rule(F.col("n"), F.col("b"), F.col("pos")))))


def draw_table(spark, sizes: list[int], resamples: int, seed: int = 42) -> DataFrame:
    """n, b, pos, idx drawn resample by resample with a Mersenne Twister seeded per size. Meant for small sizes."""
    import random

    rows = []
    for n in sizes:
        rng = random.Random(seed)
        rows += [(n, b, pos, rng.randint(0, n - 1)) for b in range(resamples) for pos in range(n)]
    return spark.createDataFrame(rows, "n INT, b INT, pos INT, idx INT")
