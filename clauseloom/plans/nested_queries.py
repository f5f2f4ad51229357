"""Problem 4: the project's nested tables as flat related ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.columns import let
from clauseloom.operators.nested import nested_tables, parse_merged, ungroup
from clauseloom.tables import table

#: What the flat tables of P4 need of the nested ones; nothing else is read.
TASK_COLUMNS = "id STRING, data STRUCT<section_ref: STRING>, annotations ARRAY<STRUCT<id: BIGINT, result: ARRAY<STRUCT<id: STRING>>>>"


def task_tables(tasks: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of the annotation tasks; the task id is the surrogate key of the root. Re-delivered tasks are exact copies and count once."""
    return nested_tables(
        tasks.distinct(), F.col("id"), "tasks",
        carry={"tasks": {"id": "task_id", "data_section_ref": "section_ref"}, "tasks.annotations": {"id": "annotation_id"}},
    )


def result_ids(annotations: Column) -> Column:
    """The annotations with the ids of their results, and whether an earlier annotation of the same id has the same result in the same place."""
    shown = lambda x: F.coalesce(x.cast("string"), F.lit(""))

    def results(a: Column, i: Column) -> Column:
        earlier = F.filter(F.slice(annotations, F.lit(1), i), lambda b: shown(b["id"]) == shown(a["id"]))
        again = lambda twins, r, p: F.exists(twins, lambda b: (F.coalesce(F.size(b["result"]), F.lit(0)) > p) & (shown(F.get(b["result"], p)["id"]) == shown(r["id"])))
        flagged = lambda twins: F.transform(a["result"], lambda r, p: F.struct(r["id"].alias("id"), again(twins, r, p).alias("repeated")))
        return F.struct(a["id"].alias("id"), let(earlier, flagged).alias("result"))

    return F.transform(annotations, results)


def run_tables(runs: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of the engine runs; ``runs.cases`` has the cases in stored order, those of groups included."""
    parsed = parse_merged(runs.distinct(), "details", ["details"], "cases", shapes=runs.select("details")).drop("details")
    cases = ungroup(parsed, "cases", "cases", ["check_type"])
    return nested_tables(cases, F.col("run_id"), "runs", carry={"runs": {"run_id": "run", "eval_id": "eval"}})


def _shown(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias


def nested_children(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """record, root_id, root_ref, parent_id, child_pos, child_id of each result and each case; missing parts are ''.

    Equal rows come once: they can only arise within a task, from annotations
    without ids of their own, and are told there, before anything is exploded.
    So the tasks' ids are all that is shuffled, to find re-delivered ones.
    """
    ids = tasks.select("id", F.struct("data.section_ref").alias("data"), result_ids(F.col("annotations")).alias("annotations"))
    results = task_tables(ids)["tasks.annotations.result"].where(~F.coalesce("repeated", F.lit(False)))
    cases = run_tables(runs.select("run_id", "eval_id", "details")).get("runs.cases")
    out = results.select(
        F.lit("sample_tasks").alias("record"), _shown("task_id")("root_id"), _shown("section_ref")("root_ref"),
        _shown("annotation_id")("parent_id"), F.col("_ordinal").alias("child_pos"), _shown("id")("child_id"),
    )
    if cases is not None and {"id", "check_type"} <= set(cases.columns):
        out = out.union(
            cases.select(
                F.lit("score_arch_engines").alias("record"), _shown("run")("root_id"), _shown("eval")("root_ref"),
                _shown("check_type")("parent_id"), F.col("_ordinal").alias("child_pos"), _shown("id")("child_id"),
            )
        )
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_children(table(spark, sf_dir, "sample_tasks", TASK_COLUMNS), table(spark, sf_dir, "score_arch_engines"))


QUERIES = {"p4_found": p4_found}

ORACLE_SQL = {
    "p4_found": """WITH t AS (SELECT DISTINCT id, data.section_ref AS ref, annotations FROM sample_tasks), b AS (SELECT id AS tid, ref, unnest(annotations) AS n FROM t),
 s AS (SELECT tid AS id, ref, n.id AS aid, unnest(range(len(n.result))) AS p, unnest(n.result) AS r FROM b),
 q AS (SELECT DISTINCT run_id, eval_id, details FROM score_arch_engines WHERE details IS NOT NULL), j AS (SELECT run_id, eval_id, CASE WHEN json_type(details) = 'VARCHAR' THEN json_extract_string(details, '$') ELSE details END AS d FROM q),
 k AS (SELECT run_id, eval_id, json_extract(d, '$.details') AS d FROM j), m AS (SELECT run_id, eval_id, CASE WHEN json_type(d) = 'VARCHAR' THEN CAST(json_extract_string(d, '$') AS JSON) ELSE d END AS d FROM k),
 l AS (SELECT run_id, eval_id, CASE json_type(d) WHEN 'ARRAY' THEN CAST(d AS JSON[]) WHEN 'OBJECT' THEN [d] ELSE [] END AS l FROM m), e AS (SELECT run_id, eval_id, unnest(range(len(l))) AS i, unnest(l) AS e FROM l),
 g AS (SELECT run_id, eval_id, i, e, CASE WHEN json_exists(e, '$.cases') THEN CASE WHEN json_type(e, '$.cases') = 'ARRAY' THEN CAST(json_extract(e, '$.cases') AS JSON[]) ELSE [] END ELSE [e] END AS c FROM e),
 c AS (SELECT run_id, eval_id, i, e, unnest(range(len(c))) AS n, unnest(c) AS c FROM g)
 SELECT DISTINCT 'sample_tasks' AS record, coalesce(id, '') AS root_id, coalesce(ref, '') AS root_ref, coalesce(CAST(aid AS VARCHAR), '') AS parent_id, CAST(p AS INTEGER) AS child_pos, coalesce(r.id, '') AS child_id FROM s
 UNION ALL SELECT DISTINCT 'score_arch_engines', run_id, coalesce(eval_id, ''), coalesce(json_extract_string(c, '$.check_type'), json_extract_string(e, '$.check_type'), ''), CAST(row_number() OVER (PARTITION BY run_id ORDER BY i, n) - 1 AS INTEGER), coalesce(json_extract_string(c, '$.id'), '') FROM c"""
}
