"""Evaluation runs: results, baselines, regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import stats
from clauseloom.operators import runs as R
from clauseloom.plans.nested_queries import run_tables
from clauseloom.plans.stat_queries import _COUNT, _metrics_sql
from clauseloom.tables import table


def _results(spark: SparkSession, sf_dir: str, later: int = 0) -> DataFrame:
    """Results of every year: an evaluation per supplier, a check per order line; ``later`` moves them to be the baseline of a later year."""
    lines = table(spark, sf_dir, "lineitem")
    checks = lines.select(F.concat("l_suppkey", F.lit("/"), F.year("l_shipdate") + later).alias("eval_id"), F.concat(F.lit("c"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey") % 10).alias("label"), (F.col("l_discount") < 0.09).alias("passed"), F.col("l_tax").alias("d"))
    seconds = checks.groupBy("eval_id").agg(F.round(F.sum("d"), 4).alias("duration_s"))
    return R.build_results(checks, ["eval_id"]).join(seconds, "eval_id")


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("eval_id", "passed", "failed", "total", F.round("score", 6).alias("score"), "status", F.array_join("failing", ",").alias("failing"))


def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's results against the year before."""
    rows = R.compare(_results(spark, sf_dir), _results(spark, sf_dir, later=1))
    return rows.select("eval_id", F.round("score_delta", 6).alias("score_delta"), F.round("duration_ratio", 6).alias("duration_ratio"), F.array_join("regressed_checks", ",").alias("regressed_checks"), F.array_join("improved_checks", ",").alias("improved_checks"), "regressed")


def regression_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why results are worse, in words."""
    return R.compare(_results(spark, sf_dir), _results(spark, sf_dir, later=1)).where("regressed").select("eval_id", "reason")


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each evaluation and tier; runs that arrived twice count once."""
    rows = table(spark, sf_dir, "score_arch_engines").select(F.concat("eval_id", F.lit("/"), F.coalesce(F.col("tier").cast("string"), F.lit(""))).alias("eval_id"), "run_id", "status", "score").distinct()
    return R.latest(rows)


def known_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("eval_id"))
    return R.known_ids(a, table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("eval_id")))


def tier_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("tier"), F.when(F.col("p_partkey") % 5 == 0, True).alias("simulated"))
    return R.select_tier(rows, 2).select("p_partkey", "tier")


def draft_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creation times of drafts in their several notations, as one."""
    rows = table(spark, sf_dir, "sample_rule_drafts").select("id", "created_at").distinct()
    return rows.select("id", F.date_format(R.run_time(F.col("created_at")), "yyyy-MM-dd HH:mm:ss").alias("created"))


def engine_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of the engines' verdicts by check type and in all, from the nested exports."""
    cases = run_tables(table(spark, sf_dir, "score_arch_engines").select("run_id", "eval_id", "details"))["runs.cases"]
    rows = cases.select("check_type", (F.col("expected_status") == "FAIL").alias("truth"), (F.col("predicted_status") == "FAIL").alias("said")).where("check_type IS NOT NULL")
    out = stats.confusion_by(rows, F.col("truth"), F.col("said"), ["check_type"], total=True)
    return out.select("check_type", "tp", "fp", "fn", "tn", "accuracy", "accuracy_lower", "accuracy_upper", "recall", "precision", "f1")


QUERIES = {f.__name__: f for f in (run_results, baseline_compare, regression_reasons, latest_runs, known_evals, tier_selection, draft_times, engine_confusion)}

_R = """WITH c AS (SELECT year(l_shipdate) AS y, l_suppkey AS eval_id, concat('c', l_linenumber, '-', l_partkey % 10) AS label, l_discount < 0.09 AS ok, l_tax AS d FROM lineitem),
 r AS (SELECT y, eval_id, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS total, count(*) FILTER (WHERE ok) * 1.0 / count(*) AS score, coalesce(list_sort(list_distinct(list(label) FILTER (WHERE NOT ok))), []) AS failing, round(sum(d), 4) AS s FROM c GROUP BY ALL) """
# every case of a run's export, in any of its shapes, by DuckDB's JSON functions
_CASES = """WITH r AS (SELECT DISTINCT run_id, details FROM score_arch_engines WHERE details IS NOT NULL), j AS (SELECT run_id, CASE WHEN json_type(details) = 'VARCHAR' THEN json_extract_string(details, '$') ELSE details END AS d FROM r),
 k AS (SELECT run_id, json_extract(d, '$.details') AS d FROM j), m AS (SELECT run_id, CASE WHEN json_type(d) = 'VARCHAR' THEN CAST(json_extract_string(d, '$') AS JSON) ELSE d END AS d FROM k),
 e AS (SELECT run_id, unnest(CASE json_type(d) WHEN 'ARRAY' THEN CAST(d AS JSON[]) WHEN 'OBJECT' THEN [d] ELSE [] END) AS e FROM m),
 x AS (SELECT run_id, unnest(CASE WHEN json_exists(e, '$.cases') THEN list_transform(CASE WHEN json_type(e, '$.cases') = 'ARRAY' THEN CAST(json_extract(e, '$.cases') AS JSON[]) ELSE [] END, lambda q: [q, json_extract(e, '$.check_type')]) ELSE [[e, NULL]] END) AS q FROM e),
 c AS (SELECT run_id, coalesce(json_extract_string(q[1], '$.check_type'), json_extract_string(q[2], '$')) AS check_type, json_extract_string(q[1], '$.expected_status') AS ex, json_extract_string(q[1], '$.predicted_status') AS pr FROM x) """
ORACLE_SQL = {
    "run_results": _R + "SELECT concat(eval_id, '/', y) AS eval_id, passed, failed, total, round(score, 6) AS score, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status, array_to_string(failing, ',') AS failing FROM r",
    "baseline_compare": _R + """, p AS (SELECT concat(a.eval_id, '/', a.y) AS eval_id, a.score - b.score AS delta, CASE WHEN b.s > 0 THEN a.s / b.s WHEN b.s IS NOT NULL THEN 1 END AS ratio, b.s AS bs, list_sort(list_filter(a.failing, lambda v: NOT list_contains(coalesce(b.failing, []), v))) AS reg, list_sort(list_filter(b.failing, lambda v: NOT list_contains(a.failing, v))) AS imp, b.eval_id IS NOT NULL AS has
  FROM r a LEFT JOIN r b ON a.eval_id = b.eval_id AND a.y = b.y + 1)
 SELECT eval_id, round(delta, 6) AS score_delta, round(ratio, 6) AS duration_ratio, CASE WHEN has THEN array_to_string(reg, ',') END AS regressed_checks, array_to_string(imp, ',') AS improved_checks, coalesce(delta < -0.05, false) OR coalesce(bs > 0.05 AND ratio > 1.5, false) OR (has AND len(reg) > 0) AS regressed FROM p""",
    "latest_runs": """WITH r AS (SELECT DISTINCT concat(eval_id, '/', coalesce(CAST(tier AS VARCHAR), '')) AS eval_id, run_id, status, score FROM score_arch_engines) SELECT eval_id, max(run_id) AS run_id, max_by(status, run_id) AS status, arg_max_null(score, run_id) AS score FROM r GROUP BY 1""",
    "draft_times": r"""WITH r AS (SELECT DISTINCT id, created_at AS t FROM sample_rule_drafts), p AS (SELECT id, t, CASE WHEN regexp_full_match(t, '\d{8}T\d{6}Z') THEN strptime(t, '%Y%m%dT%H%M%SZ') WHEN regexp_matches(t, '^\d{4}-') THEN strptime(substr(t, 1, 19), '%Y-%m-%dT%H:%M:%S') END AS stated,
  CASE WHEN regexp_matches(t, '[+]\d\d:\d\d$') THEN CAST(substr(right(t, 5), 1, 2) AS INTEGER) ELSE 0 END AS ahead FROM r) SELECT id, strftime(stated - to_hours(ahead), '%Y-%m-%d %H:%M:%S') AS created FROM p""",
    "known_evals": "SELECT o_orderpriority AS eval_id FROM orders UNION SELECT c_mktsegment FROM customer",
    "tier_selection": "SELECT p_partkey, p_size % 4 AS tier FROM part WHERE p_size % 4 <= 2 AND p_partkey % 5 <> 0",
    "engine_confusion": _CASES + _metrics_sql("SELECT check_type, " + _COUNT.format(t="ex = 'FAIL'", p="pr = 'FAIL'") + " FROM c WHERE check_type IS NOT NULL GROUP BY ROLLUP (check_type)", "check_type", ["accuracy", "accuracy_lower", "accuracy_upper", "recall", "precision", "f1"]),
}
