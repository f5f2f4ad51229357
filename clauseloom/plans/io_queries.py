"""Round trips through files in the shared folder, lenient rule loading, page ranges, and a streaming run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.operators import graph as G
from clauseloom.plans.graph_queries import _edges, _nodes
from clauseloom.sources import files, sinks
from clauseloom.streaming import incremental
from clauseloom.tables import shared_dir, table


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def io_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as JSON lines and GraphML, and read again: elements by kind."""
    folder = _folder(spark)
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir).drop("p", "s")
    sinks.write_graph(nodes, edges, folder)
    n, e = spark.read.schema(nodes.schema).json(f"{folder}/nodes"), spark.read.schema(edges.schema).json(f"{folder}/edges")
    lines = spark.read.text(f"{folder}/graphml")
    count = lambda df, what: df.groupBy(F.lit(what).alias("what"), "kind").agg(F.count(F.lit(1)).alias("n"))
    xml = lines.select(F.when(F.col("value").startswith("<node"), "node").when(F.col("value").startswith("<edge"), "edge").alias("kind")).where("kind IS NOT NULL")
    return count(n, "node").unionByName(count(e, "edge")).unionByName(count(xml, "graphml"))


def io_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review queue through CSV: quotes, line breaks and blanks survive."""
    folder = _folder(spark)
    queue = G.review_queue(_nodes(spark, sf_dir), _edges(spark, sf_dir)).withColumn("clause_heading", F.concat(F.lit('"a", b\n'), "clause_heading"))
    sinks.write_queue(queue, folder)
    back = files.read_queue(spark, f"{folder}/csv", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queue.schema))
    return back.select("edge_key", "clause_heading", "term_name", "llm_confidence")


def io_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written by run, promoted to a baseline, and read again."""
    from clauseloom.operators import runs as R

    folder = _folder(spark)
    checks = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("eval_id"), F.col("o_orderstatus").alias("label"), (F.col("o_totalprice") > 1000).alias("passed"))
    results = R.build_results(checks, ["eval_id"])
    sinks.write_results(results, f"{folder}/results", "20310106T004724Z")
    back = spark.read.parquet(f"{folder}/results/run=20310106T004724Z")
    sinks.promote_baseline(back, f"{folder}/baseline")
    return spark.read.parquet(f"{folder}/baseline").select("eval_id", "run_id", "passed", "failed", "status")


def io_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a run, written and read: its evaluations with their status."""
    from clauseloom.operators import runs as R

    folder = _folder(spark)
    checks = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("eval_id"), F.col("o_orderstatus").alias("label"), (F.col("o_totalprice") > 1000).alias("passed"))
    sinks.manifest(R.build_results(checks, ["eval_id"]), folder, "20310106T004724Z")
    back = spark.read.schema("run_id STRING, evals ARRAY<STRUCT<eval_id: STRING, status: STRING>>, passed BOOLEAN").json(folder)
    return back.select("run_id", "passed", F.explode("evals").alias("e")).select("run_id", "passed", "e.eval_id", "e.status")


def rule_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of JSON texts of several shapes, flattened."""
    p = table(spark, sf_dir, "part")
    num, name = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    one = F.concat(F.lit('{"ref": "9.'), num, F.lit('", "target": "IfcDoor", "operator": ">=", "check_value": '), name, F.lit("}"))
    two = F.concat(F.lit('{"section_ref": "9.'), num, F.lit('", "rule": {"target": "IfcDoor", "operator": ">=", "value": '), name, F.lit("}}"))
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("["), one, F.lit("]"))).when(k == 1, F.concat(F.lit('{"rules": ['), two, F.lit("]}"))).when(k == 2, F.concat(F.lit('{"n": 1, "items": ['), one, F.lit("]}"))).otherwise(F.lit('{"none": 1}'))
    return files.flatten_rules(p.select(text.alias("text")), strict=False).select("ref", "target", "operator", "value")


def rule_loading_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose values, bounds and nulls stand at several levels: a key that is present blocks those further in."""
    p = table(spark, sf_dir, "part")
    num, size, k = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 6
    made = lambda *parts: F.concat(F.lit('[{"clause_ref": "", "citation": "9.'), num, F.lit('", '), *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("}]"))
    text = (
        F.when(k == 0, made('"rule": {"target": "IfcDoor", "check_value": ', size, "}"))
        .when(k == 1, made('"target": "IfcDoor", "value": null, "rule": {"value": ', size, "}"))
        .when(k == 2, made('"ifc_entity": "IfcDoor", "value": null, "check": {"value": 1, "check_value": ', size, "}"))
        .when(k == 3, made('"ifc_class": "IfcDoor", "logic": {"value_min_property": "Rise", "value_min_offset": ', size, ', "value_max_property": "Run", "value_max_offset": -1.5}'))
        .when(k == 4, made('"target": null, "ifc_class": "IfcWall", "rule_json": {"ref": "8.1", "value": ', size, '}, "rule": {"value": 7}'))
        .otherwise(made('"rule": {"ifc_class": "IfcWall", "value": "', size, '"}'))
    )
    return files.flatten_rules(p.select(text.alias("text"))).select("ref", "target", "value", "value_min_property", "value_min_offset", "value_max_property", "value_max_offset")


def io_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation tasks written as JSON and loaded: annotations, results and choices of each."""
    folder = _folder(spark)
    table(spark, sf_dir, "sample_tasks").distinct().drop("exported_at").write.json(folder)
    tasks = files.read_tasks(spark, folder, lines=True)
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    results = F.flatten(F.transform("annotations", lambda a: F.coalesce(a["result"], F.array().cast(files._RESULT))))
    return tasks.select("id", F.col("data.section_ref").alias("section_ref"), count(F.col("annotations")).alias("n_annotations"), count(results).alias("n_results"))


def io_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts in an object with a list of them, as a service hands them out, loaded by status."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "sample_rule_drafts").select("id", "status", "source_snippet", "original_proposed_rule").distinct()
    rows.select(F.array(F.struct("*")).alias("drafts")).write.json(folder)
    loaded = files.read_drafts(spark, folder, status="edited", lines=True)
    return loaded.select("id", "source_snippet", F.col("original_proposed_rule.check_value").alias("check_value"), F.col("original_proposed_rule.value_min").alias("value_min"))


def io_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a tool and a reviewer, written and loaded."""
    folder = _folder(spark)
    said = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS")
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("element_id"), F.col("o_orderpriority").alias("check_id"), said.alias("tool_verdict"), F.lit(1).alias("count")).write.json(folder)
    return files.read_findings(spark, folder, lines=True).groupBy("check_id", "tool_verdict").agg(F.sum("count").alias("n"))


def io_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grounding index written and read again: the terms of each clause with their scores."""
    folder = _folder(spark)
    index = G.grounding(_nodes(spark, sf_dir), _edges(spark, sf_dir, refs=True))
    sinks.write_grounding(index, folder)
    back = files.read_grounding(spark, folder, index.schema)
    shown = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast(index.schema[c].dataType)), lambda e: F.concat(e["uri"], F.lit(":"), F.round(e["score"], 2), F.lit(":"), e["source"])), ",").alias(c)
    return back.select("id", "ref", shown("classes"), shown("properties"))


def status_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers of a service: whether each status is one of those expected."""
    from clauseloom.operators import runs as R

    code = F.when(F.col("o_orderkey") % 7 == 0, 404).when(F.col("o_orderkey") % 11 == 0, 500).when(F.col("o_orderkey") % 13 != 0, 200)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("label"), code.alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(404), F.lit(200))).otherwise(F.array(F.lit(200))).alias("expected"), F.col("o_orderpriority").alias("text"))
    return R.status_checks(rows)


def simulated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clauseloom.operators.judging import simulated_candidates as simulate

    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("property_name"))
    return simulate(rows, "p_partkey", 0.1, 42)


def limited_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as chunks: one model gets the first hundred, the other all."""
    from clauseloom.operators.documents import limited_chunks as limited

    limits = spark.createDataFrame([("small", 100), ("large", None)], "model STRING, limit INT")
    return limited(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), limits, ["p_brand", "p_partkey"]).select("model", "p_partkey")


def clause_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat(F.lit("  9."), "p_partkey", F.lit(".(2) "), "p_name")).when(k == 1, F.concat(F.lit("Table under 9."), "p_partkey", F.lit(" "), "p_name")).otherwise("no reference here")
    return files.clause_index(p.select("p_partkey", line.alias("value")), order="p_partkey")


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(files.page_ranges(F.col("p_size"), 20)).alias("r"))
    return rows.select("p_partkey", "r.first", "r.last")


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type, counted by a streaming run over everything there."""
    folder = _folder(spark)
    stream = incremental.parquet_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    incremental.run_once(incremental.event_windows(stream), f"{folder}/out", f"{folder}/state", mode="complete")
    return spark.read.parquet(f"{folder}/out").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("value_sum", 2).alias("value_sum"))


QUERIES = {f.__name__: f for f in (io_graph, io_review_queue, io_results, io_manifest, rule_loading, rule_loading_nested, io_tasks, io_drafts, io_findings, io_grounding, status_checks, simulated_candidates, limited_chunks, clause_index, page_ranges, stream_event_windows)}

from clauseloom.plans.graph_queries import _W  # noqa: E402
from clauseloom.plans.graph_queries import ORACLE_SQL as _GRAPH_SQL  # noqa: E402

GROUNDING = _GRAPH_SQL["graph_grounding"]

ORACLE_SQL = {
    "io_graph": _W + """SELECT 'node' AS what, 'clause' AS kind, CAST(count(*) AS BIGINT) AS n FROM part UNION ALL SELECT 'node', CASE WHEN s_suppkey % 2 = 0 THEN 'class' ELSE 'property' END, count(*) FROM supplier GROUP BY 2 UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY 2
 UNION ALL SELECT 'graphml', 'node', (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'graphml', 'edge', count(*) FROM e""",
    "io_review_queue": _W + "SELECT key AS edge_key, concat('\"a\", b', chr(10), p_name) AS clause_heading, s_name AS term_name, llm_confidence FROM e JOIN part ON p_partkey = p JOIN supplier ON s_suppkey = s WHERE llm_verdict = 'uncertain'",
    "io_results": "SELECT o_orderpriority AS eval_id, '20310106T004724Z' AS run_id, CAST(count(*) FILTER (WHERE o_totalprice > 1000) AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE NOT o_totalprice > 1000) AS BIGINT) AS failed, CASE WHEN count(*) FILTER (WHERE NOT o_totalprice > 1000) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders GROUP BY 1",
    "rule_loading": "SELECT concat('9.', p_partkey) AS ref, 'IfcDoor' AS target, '>=' AS operator, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_partkey % 4 < 3",
    "io_manifest": """WITH r AS (SELECT o_orderpriority AS eval_id, CASE WHEN bool_and(o_totalprice > 1000) THEN 'PASS' ELSE 'FAIL' END AS status FROM orders GROUP BY 1)
 SELECT '20310106T004724Z' AS run_id, (SELECT bool_and(status = 'PASS') FROM r) AS passed, eval_id, status FROM r""",
    "rule_loading_nested": """SELECT CASE WHEN p_partkey % 6 = 4 THEN '8.1' ELSE concat('9.', p_partkey) END AS ref, CASE WHEN p_partkey % 6 < 4 THEN 'IfcDoor' END AS target,
 CASE WHEN p_partkey % 6 IN (0, 2, 4, 5) THEN CAST(p_size AS DOUBLE) END AS value, CASE WHEN p_partkey % 6 = 3 THEN 'Rise' END AS value_min_property, CASE WHEN p_partkey % 6 = 3 THEN CAST(p_size AS DOUBLE) END AS value_min_offset,
 CASE WHEN p_partkey % 6 = 3 THEN 'Run' END AS value_max_property, CASE WHEN p_partkey % 6 = 3 THEN CAST(-1.5 AS DOUBLE) END AS value_max_offset FROM part""",
    "io_tasks": """WITH t AS (SELECT DISTINCT id, data, annotations, predictions FROM sample_tasks) SELECT id, data.section_ref AS section_ref, CAST(coalesce(len(annotations), 0) AS INTEGER) AS n_annotations,
 CAST(coalesce(list_sum(list_transform(annotations, lambda a: coalesce(len(a.result), 0))), 0) AS INTEGER) AS n_results FROM t""",
    "io_drafts": "SELECT DISTINCT id, source_snippet, original_proposed_rule.check_value AS check_value, original_proposed_rule.value_min AS value_min FROM sample_rule_drafts WHERE status = 'edited'",
    "io_findings": "SELECT o_orderpriority AS check_id, CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' END AS tool_verdict, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL",
    "io_grounding": GROUNDING.replace(", CASE WHEN p_partkey % 4 = 0 THEN 'shall' END AS modality,", "", 1).split(" CASE WHEN p_partkey % 10 < 3 AND n.t", 1)[0].rstrip() + " FROM part LEFT JOIN g a ON a.src" + GROUNDING.split(" FROM part LEFT JOIN g a ON a.src", 1)[1],
    "status_checks": """WITH s AS (SELECT o_orderkey AS label, CASE WHEN o_orderkey % 7 = 0 THEN 404 WHEN o_orderkey % 11 = 0 THEN 500 WHEN o_orderkey % 13 <> 0 THEN 200 END AS c, o_orderpriority AS t FROM orders),
 p AS (SELECT *, coalesce(c = 200 OR (label % 2 = 0 AND c = 404), false) AS ok FROM s)
 SELECT label, ok AS passed, CASE WHEN NOT ok THEN concat('expected ', CASE WHEN label % 2 = 0 THEN '200 or 404' ELSE '200' END, ', got ', coalesce(CAST(c AS VARCHAR), 'none'), ': ', t) END AS detail FROM p""",
    "simulated_candidates": """WITH h AS (SELECT *, CAST(concat('0x', substr(md5(concat(p_partkey, ':42')), 1, 8)) AS BIGINT) / 4294967296.0 < 0.1 AS wrong FROM part)
 SELECT p_partkey, CASE WHEN wrong THEN concat(p_brand, '_alt') ELSE p_brand END AS property_name, NOT wrong AS is_match FROM h""",
    "limited_chunks": "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) AS r FROM part) SELECT 'small' AS model, p_partkey FROM r WHERE r <= 100 UNION ALL SELECT 'large', p_partkey FROM r",
    "clause_index": "SELECT p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN concat('9.', p_partkey, '.(2)') ELSE concat('Table under 9.', p_partkey) END AS ref, p_name AS text FROM part WHERE p_partkey % 3 < 2",
    "page_ranges": "SELECT p_partkey, f AS first, least(f + 19, p_size) AS last FROM (SELECT p_partkey, p_size, CAST(unnest(range(1, p_size + 1, 20)) AS INTEGER) AS f FROM part)",
    "stream_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(round(sum(value), 4), 2) AS value_sum FROM events GROUP BY 1, 2",
}
