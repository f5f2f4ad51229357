"""Elements against threshold rules, and findings against people's verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import stats

# What a tool's verdict is called by reviewers.
REVIEW_NAMES = {"PASS": "PASS", "FAIL": "FAIL", "MISSING": "INDETERMINATE", "WAIVED": "NOT_APPLICABLE", "NOT_APPLICABLE": "NOT_APPLICABLE"}


def evaluate(values: DataFrame, rules: DataFrame) -> DataFrame:
    """element_id, status, n_checks, n_failed: FAIL if any of an element's rules fails.

    values: element_id, property_name, value; rules: property_name, operator
    (<=, >=, ==, <, >), check_value. A null value fails; equality passes.
    Elements none of whose properties has a rule are left out.
    """
    joined = values.join(rules.select("property_name", "operator", "check_value"), "property_name")
    v, c = F.col("value"), F.col("check_value")
    holds = F.when(F.col("operator") == "<=", v <= c).when(F.col("operator") == ">=", v >= c).when(F.col("operator") == "<", v < c).when(F.col("operator") == ">", v > c).when(F.col("operator") == "==", v == c)
    failed = ~F.coalesce(holds, F.lit(False))
    counted = joined.groupBy("element_id").agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(failed).alias("n_failed"))
    return counted.withColumn("status", F.when(F.col("n_failed") > 0, "FAIL").otherwise("PASS"))


def unpivot(elements: DataFrame, key: str, properties: list[str]) -> DataFrame:
    """element_id, property_name, value of the named columns, nulls kept."""
    return elements.unpivot([key], properties, "property_name", "value").withColumnRenamed(key, "element_id").withColumn("value", F.col("value").cast("double"))


def verdict_pairs(findings: DataFrame, tool: str = "tool_verdict", human: str = "human_verdict") -> DataFrame:
    """Reviewed findings with ``tool_name`` (the tool's verdict as reviewers call it, unknown ones as they are) and ``human_name``."""
    from clauseloom.functions.rules import lookup

    said = F.upper(F.coalesce(F.nullif(F.col(tool), F.lit("")), F.lit("NOT_APPLICABLE")))
    reviewed = findings.where(F.coalesce(F.col(human), F.lit("")) != "")
    return reviewed.withColumns({"raw": said, "tool_name": F.coalesce(lookup(REVIEW_NAMES, said), said), "human_name": F.upper(human)})


def score_findings(findings: DataFrame, by: list[str], tool: str = "tool_verdict", human: str = "human_verdict") -> DataFrame:
    """by, reviewed, agreed, tp, fp, fn, tn, other, metrics and Cohen's kappa over all verdicts; violations are positive."""
    pairs = verdict_pairs(findings, tool, human)
    truth = F.when(F.col("human_name") == "FAIL", True).when(F.col("human_name") == "PASS", False)
    predicted = F.when(F.col("raw") == "FAIL", True).when(F.col("raw") == "PASS", False)
    counts = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("tool_name") == F.col("human_name")).alias("agreed"), *stats.confusion_counts(truth, predicted))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    counts = counts.withColumn("other", F.col("reviewed") - tp - fp - fn - tn).withColumns(stats.confusion_metrics(tp, fp, fn, tn))
    kappa = stats.cohen_kappa(pairs, "tool_name", "human_name", by, rule="observed").select(*by, F.col("kappa"))
    return counts.join(kappa, by) if by else counts.crossJoin(kappa)


def property_shares(cells: DataFrame, grades: DataFrame, include: list[str] | None = None) -> DataFrame:
    """property_name, level, n, right of audited cells (property_name, actual, predicted, n) with the properties' grades; ``include`` narrows them."""
    rows = cells.join(grades.select("property_name", "level"), "property_name", "left")
    if include is not None:
        rows = rows.where(F.col("property_name").isin(*include))
    return rows.groupBy("property_name", "level").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("right"))


def merge_sheets(runs: DataFrame) -> DataFrame:
    """place, drafts, found, missed, invented, all_right, precision, recall of runs of several sheets, put together by their place; the shortest sheet decides.

    runs: sheet, ord, gold, drafts, correct, missed, all_fields_right.
    """
    from pyspark.sql import Window as W

    placed = runs.withColumn("place", F.row_number().over(W.partitionBy("sheet").orderBy("ord")))
    n_sheets = runs.agg(F.countDistinct("sheet").alias("_sheets"))  # one row
    summed = placed.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("drafts", "correct", "missed", "all_fields_right")], F.count(F.lit(1)).alias("_have"))
    whole = summed.crossJoin(n_sheets).where("_have = _sheets")
    return whole.select(
        "place", "drafts", F.col("correct").alias("found"), "missed", (F.col("drafts") - F.col("correct")).alias("invented"), F.col("all_fields_right").alias("all_right"),
        stats.ratio(F.col("correct"), F.col("drafts")).alias("precision"), stats.ratio(F.col("correct"), F.col("correct") + F.col("missed")).alias("recall"),
    )
