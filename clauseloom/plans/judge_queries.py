"""Judged drafts, jurisdictions, quoted values, positional joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import rules
from clauseloom.operators import judging as J
from clauseloom.operators.matching import zip_rows
from clauseloom.operators.runs import environment
from clauseloom.plans.stat_queries import _metrics_sql
from clauseloom.tables import table


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    score = lambda m: (F.col("o_custkey") % m % 6).cast("int")
    failed = F.col("o_orderkey") % 13 == 0
    return o.select(
        "o_orderpriority", F.when(failed, -1).otherwise(score(7)).alias("correctness"), F.when(failed, -1).otherwise(score(11)).alias("completeness"), F.when(failed, -1).otherwise(score(5)).alias("executability"),
        F.when(F.col("o_orderkey") % 4 > 0, "rule").alias("generated"), F.when(F.col("o_orderkey") % 5 == 0, True).alias("expects_no_rule"),
    )


def judge_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.averages(_judged(spark, sf_dir), ["o_orderpriority"])
    return rows.select("o_orderpriority", "valid", *[F.round(c, 6).alias(c) for c in (*J.CRITERIA, "overall")])


def judge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.outcome_scores(_judged(spark, sf_dir), ["o_orderpriority"])


def jurisdiction_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well candidates repeat reference rules, per nation's customers as jurisdictions."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    pairs = c.select("c_nationkey", F.lit("IfcDoor").alias("target"), F.lit(">=").alias("operator"), F.when(k % 9 == 0, None).when(k % 7 == 0, "IfcWall").otherwise("IfcDoor").alias("c_target"), F.when(k % 9 == 0, None).when(k % 8 == 0, "<=").otherwise(">=").alias("c_operator"))
    return J.generalisation(pairs, "c_nationkey")


def quoted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sentences quote a value, in several ways of writing it."""
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey") % 4, F.col("p_size") + 1000
    text = F.when(k == 0, F.concat(F.lit("at least "), n.cast("string"), F.lit(" mm"))).when(k == 1, F.concat(F.lit("at least 1 "), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" mm"))).when(k == 2, F.concat(F.lit("at least 9"), n.cast("string"), F.lit(".5 mm"))).otherwise("only one handrail")
    values = F.when(k == 3, F.array(F.lit(1.0), F.lit(None).cast("double"))).otherwise(F.array(n.cast("double"), F.lit(0.0)))
    written = rules.written_values(values)
    return p.select("p_partkey", F.array_join(written, "|").alias("written"), rules.quotes_value(text, written).alias("quoted"))


def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of a nation side by side, in key order; the shorter side decides."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return zip_rows(c, s, "c_custkey", "s_suppkey", ["nation"]).select("nation", "place", "c_custkey", "s_suppkey")


def run_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return environment(spark)


QUERIES = {f.__name__: f for f in (judge_averages, judge_outcomes, jurisdiction_gap, quoted_values, positional_join, run_environment)}

_J = """WITH j AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_custkey % 7 % 6 END AS c, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_custkey % 11 % 6 END AS d, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_custkey % 5 % 6 END AS x, o_orderkey % 4 > 0 AS made, o_orderkey % 5 = 0 AS none FROM orders) """
ORACLE_SQL = {
    "judge_averages": _J + "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS valid, round(avg(c), 6) AS correctness, round(avg(d), 6) AS completeness, round(avg(x), 6) AS executability, round((avg(c) + avg(d) + avg(x)) / 3, 6) AS overall FROM j WHERE c >= 0 GROUP BY 1",
    "judge_outcomes": _J + ", o AS (SELECT o_orderpriority, CASE WHEN c < 0 THEN NULL WHEN none AND made AND c >= 4 AND d >= 4 THEN 'FP' WHEN none THEN 'TN' WHEN made AND c >= 4 AND d >= 4 THEN 'TP' ELSE 'FN' END AS o FROM j), s AS (SELECT o_orderpriority AS p, CAST(count(*) FILTER (WHERE o IS NULL) AS BIGINT) AS skipped FROM o GROUP BY 1), m AS ("
    + _metrics_sql("SELECT o_orderpriority, " + ", ".join(f"CAST(count(*) FILTER (WHERE o = '{x}') AS BIGINT) AS {x.lower()}" for x in ("TP", "FP", "FN", "TN")) + " FROM o GROUP BY 1", "o_orderpriority", ["precision", "recall", "f1"])
    + ") SELECT m.*, skipped FROM m JOIN s ON p = o_orderpriority",
    "jurisdiction_gap": """WITH p AS (SELECT c_nationkey, c_custkey % 9 = 0 AS gone, c_custkey % 7 = 0 AS t, c_custkey % 8 = 0 AS o FROM customer), g AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE NOT gone AND NOT t) AS e, count(*) FILTER (WHERE NOT gone AND NOT o) AS op, count(*) FILTER (WHERE NOT gone AND NOT t AND NOT o) AS tp, count(*) FILTER (WHERE NOT gone AND (t OR o)) AS fp, count(*) FILTER (WHERE gone) AS fn FROM p GROUP BY 1),
 f AS (SELECT *, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM g) SELECT c_nationkey, CAST(n AS BIGINT) AS rules, round(e * 1.0 / n, 4) AS entity_accuracy, round(op * 1.0 / n, 4) AS operator_accuracy, f1, round(max(f1) OVER () - f1, 4) AS delta_f1, CASE WHEN round(max(f1) OVER () - f1, 4) < 0.05 THEN 'PASS' ELSE 'WARN' END AS status FROM f""",
    "quoted_values": "SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN '1' ELSE concat(p_size + 1000, '|1 ', lpad(CAST(p_size AS VARCHAR), 3, '0')) END AS written, p_partkey % 4 <> 2 AS quoted FROM part",
    "positional_join": """WITH c AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer), s AS (SELECT s_nationkey AS nation, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
 SELECT c.nation, CAST(c.r AS INTEGER) AS place, c_custkey, s_suppkey FROM c JOIN s ON c.nation = s.nation AND c.r = s.r""",
}
