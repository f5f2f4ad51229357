"""The pN_ queries of the llm operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import canonical, consensus, mixing, quantiles, stuffing, tokens
from clauseloom.tables import table

CHOICES = ("deontic_strength", "ifc_entity")


def _consensus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    votes = consensus.task_votes(table(spark, sf_dir, "sample_tasks"), CHOICES, table(spark, sf_dir, "canonical_terms"))
    return consensus.consensus(votes, ["task_id", "superseded", "from_name"], "from_name", order="annotation_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _consensus(spark, sf_dir)[0]
    return labels.where(F.col("superseded").isNull() & (F.col("n_annotators") >= 3)).select("task_id", "from_name", "label")


def p3_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each annotator, by choice."""
    return _consensus(spark, sf_dir)[1]


def p3_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance-corrected agreement, by choice."""
    return _consensus(spark, sf_dir)[2]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_typed_fields(table(spark, sf_dir, "sample_rule_drafts"), table(spark, sf_dir, "canonical_terms"))


AT = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
TIMES = ["total_s", "parse_s"]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "halo_benchmark_raw_repeats").select("run_id", "scenario", F.to_date("run_ts").alias("day"), *TIMES)


def _measured(value: Column) -> Column:
    """Negative times are no measurements."""
    return value >= 0


def _daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of single days. Copies of a run count once."""
    return quantiles.sketch(_runs(spark, sf_dir), ["scenario", "day"], TIMES, keep=_measured, once="run_id")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each scenario: of every day, and of all days from the days' added counts (day is null)."""
    daily = _daily_sketches(spark, sf_dir)
    total = quantiles.merge(daily, ["scenario"])
    days = quantiles.percentiles(daily, ["scenario", "day"], AT).withColumn("scope", F.lit("day"))
    over_all = quantiles.percentiles(total, ["scenario"], AT).withColumns({"scope": F.lit("all"), "day": F.lit(None).cast("date")})
    return days.unionByName(over_all).select("scope", "scenario", "day", "metric", "p", "n", F.round("estimate", 6).alias("estimate"))


def p2_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts themselves, by scenario: what days and files are combined from."""
    return quantiles.merge(_daily_sketches(spark, sf_dir), ["scenario"])


def p2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact percentiles of each scenario, and whether the estimates are within the stated error of them."""
    both = quantiles.exact_percentiles(_runs(spark, sf_dir).drop("day"), ["scenario"], TIMES, AT, keep=_measured, once="run_id")
    within = F.abs(F.col("estimate") - F.col("exact")) <= F.abs("exact") * (quantiles.ERROR + 1e-9)
    return both.select("scenario", "metric", "p", "n", "exact", within.alias("within"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and whether its ids decode to its text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tokens.token_ids(F.col("text")).alias("ids"))
    same = tokens.token_texts(F.col("ids")) == F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.size("ids").alias("n_tokens"), same.alias("same"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source of each mix."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


def p7_shortage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of mixes twice as large as their targets allow: what some sources cannot fill, others of their domain do first."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, sf_dir, "documents"), targets, stretch=2.0), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (p2_percentiles, p2_sketches, p2_exact, p3_found, p3_annotators, p3_agreement, p5_found, p6_ids, p6_round_trip, p7_mix, p7_shares, p7_shortage, p8_found)
}
_SKETCH = """
WITH runs AS (SELECT DISTINCT run_id, scenario, CAST(run_ts AS DATE) AS day, total_s, parse_s FROM halo_benchmark_raw_repeats),
long AS (SELECT scenario, day, 'total_s' AS metric, total_s AS v FROM runs UNION ALL SELECT scenario, day, 'parse_s', parse_s FROM runs),
good AS (SELECT scenario, day, metric, v FROM long WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AND v >= 0),
daily AS (SELECT scenario, day, metric, CAST(sign(v) AS INTEGER) AS sign,
  CASE WHEN v = 0 THEN 0 ELSE CAST(ceil(ln(v) / ln(1.01 / 0.99)) AS INTEGER) END AS bucket, count(*) AS n FROM good GROUP BY ALL)
"""
ORACLE_SQL: dict[str, str] = {
    "p2_sketches": _SKETCH + "SELECT scenario, metric, sign, bucket, CAST(sum(n) AS BIGINT) AS n FROM daily GROUP BY ALL",
    # exact ranks from sorted values: nothing of the operator's buckets is repeated here
    "p2_exact": """
WITH runs AS (SELECT DISTINCT run_id, scenario, total_s, parse_s FROM halo_benchmark_raw_repeats),
long AS (SELECT scenario, 'total_s' AS metric, total_s AS v FROM runs UNION ALL SELECT scenario, 'parse_s', parse_s FROM runs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scenario, metric ORDER BY v) AS r, count(*) OVER (PARTITION BY scenario, metric) AS n
  FROM long WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AND v >= 0)
SELECT scenario, metric, p, n, v AS exact, TRUE AS within
FROM ranked, (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.75), (0.9), (0.95), (0.99)) AS q(p) WHERE r = greatest(1, ceil(p * n - 1e-9))""",
    "p2_percentiles": _SKETCH
    + """,
parts AS (SELECT 'day' AS scope, * FROM daily UNION ALL SELECT 'all', scenario, NULL, metric, sign, bucket, CAST(sum(n) AS BIGINT) FROM daily GROUP BY scenario, metric, sign, bucket),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY scope, scenario, day, metric ORDER BY sign, sign * bucket) AS upto,
  sum(n) OVER (PARTITION BY scope, scenario, day, metric) AS total FROM parts)
SELECT scope, scenario, day, metric, p, CAST(total AS BIGINT) AS n,
  round(CASE WHEN sign = 0 THEN 0.0 ELSE exp(bucket * ln(1.01 / 0.99) + ln(2 / (1.01 / 0.99 + 1))) END, 6) AS estimate
FROM ranked, (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.75), (0.9), (0.95), (0.99)) AS q(p)
WHERE greatest(1, ceil(p * total - 1e-9)) <= upto AND greatest(1, ceil(p * total - 1e-9)) > upto - n""",
}
