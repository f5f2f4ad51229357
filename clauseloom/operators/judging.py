"""Judged drafts: averages, outcome classes, and how far jurisdictions lie apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseloom.functions import stats

CRITERIA = ("correctness", "completeness", "executability")


def classify(df: DataFrame, hit: int = 4) -> Column:
    """TP, FP, FN, TN of a judged draft; null where the judge failed (a negative score).

    A hit is a generated rule whose correctness and completeness reach ``hit``;
    a missing ``expects_no_rule`` counts as false.
    """
    good = F.col("generated").isNotNull() & (F.col("correctness") >= hit) & (F.col("completeness") >= hit)
    none = F.coalesce(F.col("expects_no_rule"), F.lit(False))
    outcome = F.when(none & good, "FP").when(none, "TN").when(good, "TP").otherwise("FN")
    return F.when(F.col("correctness") >= 0, outcome)


def averages(df: DataFrame, by: list[str]) -> DataFrame:
    """by, valid and the mean of each criterion and of all, without the rows where the judge failed; null without valid rows."""
    valid = F.col("correctness") >= 0
    means = [F.avg(F.when(valid, F.col(c))).alias(c) for c in CRITERIA]
    return df.groupBy(*by).agg(F.count_if(valid).alias("valid"), *means).withColumn("overall", sum((F.col(c) for c in CRITERIA), F.lit(0.0)) / len(CRITERIA))


def outcome_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, tn, skipped, precision, recall, f1 of judged drafts."""
    o = classify(df)
    counted = df.withColumn("_o", o).groupBy(*by).agg(*[F.count_if(F.col("_o") == x).alias(x.lower()) for x in ("TP", "FP", "FN", "TN")], F.count_if(F.col("_o").isNull()).alias("skipped"))
    m = stats.confusion_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counted.withColumns({k: m[k] for k in ("precision", "recall", "f1")})


def simulated_candidates(gold: DataFrame, key: str, error_rate: float, seed: int, property_name: str = "property_name") -> DataFrame:
    """Reference rules as candidates, a share of them with another property, told by a hash of key and seed; for tests of a pipeline, no evidence."""
    share = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    wrong = share < error_rate
    return gold.withColumns({property_name: F.when(wrong, F.concat(F.col(property_name), F.lit("_alt"))).otherwise(F.col(property_name)), "is_match": ~wrong})


def generalisation(pairs: DataFrame, jurisdiction: str, gap: float = 0.05) -> DataFrame:
    """jurisdiction, rules, entity and operator accuracy, f1, its distance to the best jurisdiction, and whether that is below ``gap``.

    ``pairs`` has a reference rule's target and operator and the candidate's
    (c_target, c_operator; null if there is none).
    """
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    right = same("target", "c_target") & same("operator", "c_operator")
    has = F.col("c_target").isNotNull()
    g = pairs.groupBy(jurisdiction).agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(same("target", "c_target")).alias("_e"), F.count_if(same("operator", "c_operator")).alias("_o"), F.count_if(right).alias("_tp"), F.count_if(has & ~right).alias("_fp"), F.count_if(~has).alias("_fn")
    )
    p, r = stats.ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")), stats.ratio(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    g = g.withColumn("f1", F.round(stats.ratio(2 * p * r, p + r), 4))
    delta = F.round(F.max("f1").over(W.partitionBy(F.lit(1))) - F.col("f1"), 4)  # one row a jurisdiction
    return g.withColumn("delta_f1", delta).select(
        jurisdiction, "rules", F.round(F.col("_e") / F.col("rules"), 4).alias("entity_accuracy"), F.round(F.col("_o") / F.col("rules"), 4).alias("operator_accuracy"), "f1", "delta_f1", F.when(F.col("delta_f1") < gap, "PASS").otherwise("WARN").alias("status")
    )
