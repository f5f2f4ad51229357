"""Annotation tasks as annotations, rules and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import annotate, obligations, spans
from clauseloom.operators import labels as L
from clauseloom.operators import matching as M
from clauseloom.plans.text_queries import _CONDITIONS, _DEONTICS, _DIMENSIONS, _REFS, _WITH
from clauseloom.sources.clauses import clauses
from clauseloom.tables import distinct_by, table


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_by(table(spark, sf_dir, "sample_tasks"), "id")


def current_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.is_current(_tasks(spark, sf_dir)).select("id", F.col("data.code").alias("code"))


def task_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each task's latest answer says, counted by kind."""
    rows = L.task_annotations(_tasks(spark, sf_dir))
    return rows.select("task_id", *[F.size(c).alias(f"n_{c}") for c in ("deontics", "conditions", "dimensions", "cross_refs", "dependencies", "ifc_hints")], "subject")


def task_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, units and properties of the dimensions labelled in each task."""
    return L.task_annotations(_tasks(spark, sf_dir)).select("task_id", F.posexplode("dimensions").alias("pos", "d")).select("task_id", "pos", F.col("d.constraint").alias("bound"), "d.span", "d.value", "d.unit", "d.property_name")


def task_gold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.gold_rules(_tasks(spark, sf_dir))
    return rows.select("task_id", "dim", "ref", "target", "property_name", "operator", "value", "value_min", "value_max", "unit", "building_use", F.array_join("conditions", " / ").alias("conditions"), F.array_join("exceptions", " / ").alias("exceptions"))


def annotator_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.annotator_choices(_tasks(spark, sf_dir))


def annotator_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of each pair of annotators on each question."""
    choices = L.annotator_choices(_tasks(spark, sf_dir)).withColumn("choice", F.upper(F.trim("choice")))
    rows = M.choice_agreement(choices)
    return rows.select("a", "b", "from_name", "n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


def annotator_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.annotator_spans(_tasks(spark, sf_dir)).groupBy("annotator", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("bigint").alias("chars"))


def span_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span F1 of each pair of annotators, by label and in all."""
    return M.span_agreement(L.annotator_spans(_tasks(spark, sf_dir)))


def preannotated_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted spans of the generated clauses with their places."""
    c = clauses(spark, sf_dir)
    rows = c.withColumns({"_s": spans.spans(F.col("text")), "_p": obligations.parse_conditions(F.col("text")), "_h": annotate.element_hints(F.col("text"))})
    rows = rows.withColumn("annotation", annotate.paragraph(F.col("text"), F.col("_s"), F.col("_p"), F.col("_h"))).select(F.lit("parts").alias("doc_id"), F.col("clause_id").alias("ord"), "text", F.col("sec").alias("section_number"), "annotation")
    out = L.preannotate(rows).select(F.col("ord").alias("clause_id"), F.explode("result").alias("r"))
    return out.select("clause_id", F.get("r.value.labels", F.lit(0)).alias("label"), F.col("r.value.text").alias("span"), F.col("r.value.start").alias("start"), F.col("r.value.end").alias("end"))


def rules_as_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rules = p.select(F.concat(F.lit("9."), "p_size").alias("ref"), F.col("p_name").alias("desc"), F.when(F.col("p_partkey") % 4 == 0, ">=").when(F.col("p_partkey") % 4 == 1, "<=").when(F.col("p_partkey") % 4 == 2, "==").otherwise("between").alias("operator"), F.lit("IfcDoor").alias("target"), F.when(F.col("p_partkey") % 2 == 0, "Width").alias("property_name"), F.lit("mm").alias("unit"))
    return L.rules_to_tasks(rules).select("ref", "text", "label", F.array_join(F.transform("choices", lambda x: F.concat(x["from_name"], F.lit("="), x["choice"])), ",").alias("choices"))


def task_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes that take the annotation of a task by id, else by text; of several the last."""
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.lit("d").alias("doc_id"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("e"), "p_partkey")).alias("element_id"), F.concat("p_name", F.lit(" "), "p_partkey").alias("text"))
    tasks = p.where("p_partkey % 4 < 2").withColumn("order", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("e"), "p_partkey")).alias("element_id"), F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(" "), "p_partkey")).otherwise("other").alias("text"), "order", F.concat("p_partkey", F.lit(":"), "order").alias("annotation"),
    )
    return L.tasks_to_nodes(nodes, tasks.where("text <> 'other' OR element_id IS NOT NULL")).select("p_partkey", "annotation")


QUERIES = {
    f.__name__: f
    for f in (
        current_tasks, task_annotations, task_dimensions, task_gold_rules, annotator_choices, annotator_kappa, annotator_spans, span_agreement, preannotated_clauses, rules_as_tasks, task_nodes,
    )
}

_T = "WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY exported_at) AS n FROM sample_tasks) WHERE n = 1), "
_ANSWERS = _T + """a AS (SELECT id AS task, unnest(annotations) AS a FROM t), r AS (SELECT task, a.completed_by AS annotator, a.id AS aid, unnest(range(len(a.result))) AS p, unnest(a.result) AS r FROM a),
 c AS (SELECT task, annotator, r.from_name AS from_name, max_by(r.value.choices[1], aid * 10000 + p) AS choice FROM r WHERE r.type = 'choices' AND r.from_name <> 'dim_property' AND r.value.start IS NULL AND r.value.choices[1] IS NOT NULL AND annotator IS NOT NULL GROUP BY ALL)"""
_LATEST = _T + """l AS (SELECT id AS task_id, CASE WHEN len(annotations) > 0 THEN annotations[len(annotations)].result ELSE predictions[len(predictions)].result END AS rs FROM t), r AS (SELECT task_id, unnest(range(len(rs))) AS p, unnest(rs) AS r FROM l),
 b AS (SELECT task_id, p, r, upper(unnest(r.value.labels)) AS label FROM r WHERE r.type = 'labels')"""
ORACLE_SQL = {
    # the pairs of spans of a task are taken in order; each step keeps what has been taken
    "span_agreement": """WITH RECURSIVE t AS (SELECT DISTINCT id, annotations FROM sample_tasks), n AS (SELECT id AS task, unnest(annotations) AS n FROM t),
 r AS (SELECT task, n.completed_by AS annotator, n.id AS nid, unnest(range(len(n.result))) AS p, unnest(n.result) AS r FROM n),
 l AS (SELECT task, annotator, nid, p, coalesce(r.value.start, 0) AS s, coalesce(r.value.end, 0) AS e, unnest(range(len(r.value.labels))) AS q, unnest(r.value.labels) AS label FROM r WHERE r.type = 'labels'),
 sp AS (SELECT *, row_number() OVER (PARTITION BY annotator, task ORDER BY nid, p, q) AS ord FROM l),
 pr AS (SELECT x.annotator AS a, y.annotator AS b, x.label, x.task, x.ord AS ao, y.ord AS bo FROM sp x JOIN sp y ON x.task = y.task AND x.label = y.label AND x.annotator < y.annotator
  WHERE greatest(x.e, y.e) > least(x.s, y.s) AND greatest(0, least(x.e, y.e) - greatest(x.s, y.s)) * 1.0 / (greatest(x.e, y.e) - least(x.s, y.s)) >= 0.5),
 g AS (SELECT a, b, label, task, list([ao, bo] ORDER BY ao, bo) AS ps FROM pr GROUP BY ALL),
 d AS (SELECT a, b, label, task, ps, 0 AS i, CAST([] AS BIGINT[]) AS ta, CAST([] AS BIGINT[]) AS tb FROM g UNION ALL
  SELECT a, b, label, task, ps, i + 1, CASE WHEN free THEN list_append(ta, ps[i + 1][1]) ELSE ta END, CASE WHEN free THEN list_append(tb, ps[i + 1][2]) ELSE tb END
  FROM (SELECT *, NOT list_contains(ta, ps[i + 1][1]) AND NOT list_contains(tb, ps[i + 1][2]) AS free FROM d WHERE i < len(ps))),
 m AS (SELECT a, b, label, sum(len(ta)) AS tp FROM d WHERE i = len(ps) GROUP BY ALL), who AS (SELECT DISTINCT task, annotator FROM sp),
 w AS (SELECT x.task, x.annotator AS a, y.annotator AS b FROM who x JOIN who y ON x.task = y.task AND x.annotator < y.annotator),
 c AS (SELECT a, b, label, count(*) FILTER (WHERE annotator = a) AS na, count(*) FILTER (WHERE annotator = b) AS nb FROM w JOIN sp ON w.task = sp.task AND (annotator = a OR annotator = b) GROUP BY ALL),
 k AS (SELECT c.a, c.b, c.label, na, nb, coalesce(tp, 0) AS tp FROM c LEFT JOIN m ON c.a = m.a AND c.b = m.b AND c.label = m.label),
 u AS (SELECT a, b, label, tp, na, nb FROM k UNION ALL SELECT a, b, NULL, sum(tp), sum(na), sum(nb) FROM k GROUP BY a, b),
 f AS (SELECT *, coalesce(tp * 1.0 / nullif(nb, 0), 0) AS pc, coalesce(tp * 1.0 / nullif(na, 0), 0) AS rc FROM u)
 SELECT a, b, label, CAST(tp AS BIGINT) AS tp, CAST(nb - tp AS BIGINT) AS fp, CAST(na - tp AS BIGINT) AS fn, round(pc, 4) AS precision, round(rc, 4) AS recall, round(coalesce(2 * pc * rc / nullif(pc + rc, 0), 0), 4) AS f1 FROM f""",
    "current_tasks": _T.rstrip(", ") + " SELECT id, data.code AS code FROM t WHERE coalesce(data.meta.superseded, '') = ''",
    "task_annotations": _LATEST + """, n AS (SELECT task_id, count(*) FILTER (WHERE label IN ('MANDATORY', 'PROHIBITED', 'RECOMMENDED', 'PERMITTED')) AS d, count(*) FILTER (WHERE label IN ('APPLICABILITY', 'EXCEPTION', 'QUALIFICATION')) AS c, count(*) FILTER (WHERE label LIKE 'DIM\\_%' ESCAPE '\\') AS m,
  count(*) FILTER (WHERE label IN ('CROSS_REF', 'REFERENCE')) AS x, count(*) FILTER (WHERE label = 'EXCEPTION') AS e FROM b GROUP BY 1), h AS (SELECT task_id, count(*) AS h, min_by(r.value.choices[1], p) AS s FROM r WHERE r.type = 'choices' AND r.from_name = 'ifc_entity' AND r.value.choices[1] IS NOT NULL GROUP BY 1)
 SELECT id AS task_id, CAST(coalesce(d, 0) AS INTEGER) AS n_deontics, CAST(coalesce(c, 0) AS INTEGER) AS n_conditions, CAST(coalesce(m, 0) AS INTEGER) AS n_dimensions, CAST(coalesce(x, 0) AS INTEGER) AS n_cross_refs, CAST(coalesce(e, 0) AS INTEGER) AS n_dependencies, CAST(coalesce(h, 0) AS INTEGER) AS n_ifc_hints, s AS subject
 FROM t LEFT JOIN n ON t.id = n.task_id LEFT JOIN h ON t.id = h.task_id""",
    "annotator_choices": _ANSWERS + " SELECT task, annotator, from_name, choice FROM c",
    "annotator_kappa": _ANSWERS + """, u AS (SELECT task, annotator, from_name, upper(trim(choice, ' ')) AS choice FROM c), w AS (SELECT DISTINCT task, annotator FROM u), q AS (SELECT DISTINCT from_name FROM u), p AS (SELECT x.task, x.annotator AS a, y.annotator AS b FROM w x JOIN w y ON x.task = y.task AND x.annotator < y.annotator),
 z AS (SELECT a, b, q.from_name, coalesce(ua.choice, 'NONE') AS ca, coalesce(ub.choice, 'NONE') AS cb FROM p CROSS JOIN q LEFT JOIN u ua ON ua.task = p.task AND ua.annotator = a AND ua.from_name = q.from_name LEFT JOIN u ub ON ub.task = p.task AND ub.annotator = b AND ub.from_name = q.from_name),
 k AS (SELECT a, b, from_name, count(*) AS n, avg(CASE WHEN ca = cb THEN 1.0 ELSE 0 END) AS o, count(*) FILTER (WHERE ca <> 'NONE' OR cb <> 'NONE') AS given FROM z GROUP BY ALL), l AS (SELECT a, b, from_name, ca AS g, count(*) AS x FROM z GROUP BY ALL), m AS (SELECT a, b, from_name, cb AS g, count(*) AS y FROM z GROUP BY ALL),
 e AS (SELECT a, b, from_name, sum(x * 1.0 / n * y / n) AS e FROM k JOIN l USING (a, b, from_name) JOIN m USING (a, b, from_name, g) GROUP BY ALL), v AS (SELECT a, b, from_name, count(DISTINCT g) AS kinds FROM (SELECT a, b, from_name, g FROM l UNION SELECT a, b, from_name, g FROM m) GROUP BY ALL)
 SELECT a, b, from_name, CAST(n AS BIGINT) AS n, round(o, 6) AS observed, round(coalesce(e, 0), 6) AS expected, round(CASE WHEN kinds <= 1 OR coalesce(e, 0) >= 1 - 1e-12 THEN 1 ELSE (o - coalesce(e, 0)) / (1 - coalesce(e, 0)) END, 6) AS kappa FROM k LEFT JOIN e USING (a, b, from_name) JOIN v USING (a, b, from_name) WHERE given > 0""",
    "annotator_spans": _ANSWERS + """, s AS (SELECT annotator, unnest(r.value.labels) AS label, coalesce(r.value.start, 0) AS s, coalesce(r.value.end, 0) AS e FROM r WHERE r.type = 'labels') SELECT annotator, label, CAST(count(*) AS BIGINT) AS n, CAST(sum(e - s) AS BIGINT) AS chars FROM s GROUP BY ALL""",
    "preannotated_clauses": _WITH + f""", x AS (SELECT clause_id, upper(strength) AS label, span FROM ({_DEONTICS}) UNION ALL SELECT clause_id, upper(type), text FROM ({_CONDITIONS}) UNION ALL SELECT clause_id, concat('DIM_', upper(bound)), span FROM ({_DIMENSIONS}) UNION ALL SELECT clause_id, 'CROSS_REF', raw FROM ({_REFS}))
 SELECT x.clause_id, label, span, CAST(instr(c.text, span) - 1 AS INTEGER) AS start, CAST(instr(c.text, span) - 1 + length(span) AS INTEGER) AS end FROM x JOIN c ON x.clause_id = c.clause_id""",
    "rules_as_tasks": """SELECT concat('9.', p_size) AS ref, p_name AS text, CASE p_partkey % 4 WHEN 0 THEN 'DIM_MIN' WHEN 1 THEN 'DIM_MAX' WHEN 2 THEN 'DIM_EXACT' ELSE 'DIM_RANGE' END AS label,
 concat('ifc_entity=IfcDoor,', CASE WHEN p_partkey % 2 = 0 THEN 'property_name=Width,' ELSE '' END, 'unit=mm') AS choices FROM part""",
    "task_nodes": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 OR (p_partkey % 4 = 1 AND p_partkey % 3 = 0) THEN concat(p_partkey, ':2') END AS annotation FROM part",
}
