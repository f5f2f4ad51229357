"""Matching of extracted rules with reference rules, sheet scoring, drafts' corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.operators import compliance as C
from clauseloom.operators import matching as M
from clauseloom.tables import distinct_by, table

# Reference rules from parts and extracted rules that repeat them with faults by key; the same SQL in both engines.
_GOLD = """SELECT p_partkey AS gold_id, concat(1 + p_partkey % 97, '.', 1 + p_partkey % 5, '.', p_partkey, '.(', 1 + p_partkey % 3, ')') AS ref, CASE WHEN p_partkey % 2 = 0 THEN 'IfcStair' ELSE 'IfcRamp' END AS target,
 CASE p_partkey % 3 WHEN 0 THEN 'Width' WHEN 1 THEN 'Slope' ELSE 'Height' END AS property_name, CASE p_partkey % 4 WHEN 3 THEN 'between' WHEN 0 THEN '>=' WHEN 1 THEN '<=' ELSE '==' END AS operator,
 CASE WHEN p_partkey % 4 <> 3 THEN 1000.0E0 + p_size END AS value, CASE WHEN p_partkey % 4 = 3 THEN 1000.0E0 + p_size END AS value_min, CASE WHEN p_partkey % 4 = 3 THEN 2000.0E0 + p_size END AS value_max, 'mm' AS unit, p_partkey, p_size FROM part"""
_EXTRACTED = """SELECT p_partkey * 10 + d AS rule_id, CASE p_partkey % 10 WHEN 3 THEN concat(1 + p_partkey % 97, '.', 1 + p_partkey % 5, '.', p_partkey) ELSE concat(1 + p_partkey % 97, '.', 1 + p_partkey % 5, '.', p_partkey, '(', 1 + p_partkey % 3, ')') END AS ref,
 CASE WHEN p_partkey % 10 = 4 THEN concat(CASE WHEN p_partkey % 2 = 0 THEN 'IfcStair' ELSE 'IfcRamp' END, 'Flight') WHEN p_partkey % 2 = 0 THEN 'IfcStair' ELSE 'IfcRamp' END AS target,
 CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 10 = 5 THEN 'ClearWidth' ELSE 'Width' END WHEN 1 THEN 'Slope' ELSE 'Height' END AS property_name,
 CASE WHEN p_partkey % 10 = 7 THEN 'max' ELSE CASE p_partkey % 4 WHEN 3 THEN 'range' WHEN 0 THEN 'min' WHEN 1 THEN 'at_most' ELSE 'eq' END END AS operator,
 CASE WHEN p_partkey % 4 <> 3 THEN CASE WHEN p_partkey % 10 = 6 THEN 3000.0E0 WHEN p_partkey % 10 = 1 THEN (1000.0E0 + p_size) / 1000 ELSE 1000.0E0 + p_size END END AS value, CASE WHEN p_partkey % 4 = 3 THEN 1000.0E0 + p_size END AS value_min,
 CASE WHEN p_partkey % 4 = 3 THEN 2000.0E0 + p_size END AS value_max, CASE WHEN p_partkey % 10 = 1 AND p_partkey % 4 <> 3 THEN 'm' ELSE 'mm' END AS unit, p_partkey, d
 FROM part, (VALUES (0), (1)) AS v(d) WHERE p_partkey % 10 <> 8 AND (d = 0 OR p_partkey % 10 = 9)"""
_RELATIVE = {"value_min_property": "string", "value_min_offset": "double", "value_max_property": "string", "value_max_offset": "double"}


def _rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    out = []
    for sql in (_GOLD, _EXTRACTED):
        rows = spark.sql(sql.replace("FROM part", "FROM {part}"), part=part)
        out.append(rows.withColumns({c: F.lit(None).cast(t) for c, t in _RELATIVE.items()}))
    return out[0], out[1]


def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule's part in the three modes: pair, missed, redundant or false positive."""
    t = M.match_rules(*_rules(spark, sf_dir))
    null = F.lit(None).cast("bigint")
    rows = t["pairs"].select("mode", F.lit("pair").alias("outcome"), F.col("gold_id").cast("bigint").alias("gold_id"), F.col("rule_id").cast("bigint").alias("rule_id"))
    rows = rows.unionByName(t["missed"].select("mode", F.lit("missed").alias("outcome"), "gold_id", null.alias("rule_id")))
    for name in ("redundant", "false_positives"):
        rows = rows.unionByName(t[name].select("mode", F.lit(name).alias("outcome"), null.alias("gold_id"), "rule_id"))
    return rows


def rule_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_scores(M.match_rules(*_rules(spark, sf_dir)))


def operator_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.operator_confusion(*_rules(spark, sf_dir))
    return rows.withColumnsRenamed({">=": "ge", "<=": "le", "==": "eq", "?": "unknown"})


def clause_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, extracted = _rules(spark, sf_dir)
    return M.clause_confusion(gold.select("ref"), gold.where("p_partkey % 7 < 5"), extracted)[0]


def clauses_out_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, extracted = _rules(spark, sf_dir)
    return M.clause_confusion(gold.where("p_partkey % 2 = 0").select("ref"), gold, extracted)[1]


def recall_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gold rule, ranges among them, against every extracted rule."""
    return M.recall_match(*_rules(spark, sf_dir))[0]


def recall_extra_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.recall_match(*_rules(spark, sf_dir))[1]


def sheet_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, drafts = _sheets(spark, sf_dir)
    return M.sheet_match(gold, drafts)[0]


def sheet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, drafts = _sheets(spark, sf_dir)
    return M.sheet_match(gold, drafts)[1]


def _sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    gold = p.where("p_partkey % 5 < 4").select(
        F.concat(F.lit("R"), "p_partkey").alias("rule_id"), F.lit("IfcDoor").alias("target"), F.lit("Width").alias("property"), F.array(F.lit("ClearWidth")).alias("names"), F.lit("=").alias("operator"),
        F.col("p_size").cast("string").alias("value"), F.lit("m²").alias("unit"), F.when(F.col("p_partkey") % 2 == 0, "external doors").otherwise("").alias("applicability"),
    )
    drafts = p.where("p_partkey % 7 <> 0").withColumn("d", F.explode(F.when(F.col("p_partkey") % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        F.concat(F.lit(" R"), "p_partkey").alias("rule_id"), F.lit("ifcdoor").alias("target_ifc_class"), F.when(F.col("p_partkey") % 3 == 0, "clearwidth").when(F.col("p_partkey") % 3 == 1, "Width").otherwise("Depth").alias("property_name"),
        F.lit("==").alias("operator"), F.concat((F.col("p_size") + F.col("d")).cast("string"), F.lit(".0")).alias("check_value"), F.when(F.col("p_partkey") % 4 == 0, "mm").otherwise("m2").alias("unit"),
        F.when(F.col("p_partkey") % 8 == 0, "x=1").alias("applies_when"), F.col("d").alias("ord"),
    )
    return gold, drafts


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_by(table(spark, sf_dir, "sample_rule_drafts").select("id", "original_proposed_rule", "proposed_rule"), "id").where("proposed_rule IS NOT NULL")


def draft_field_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural fields that reviewers changed."""
    return M.field_diffs(_drafts(spark, sf_dir)).where("changed").select("draft_id", "field", "original", "corrected")


def draft_field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.field_accuracy(M.field_diffs(_drafts(spark, sf_dir)))


def draft_most_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.most_changed(M.field_diffs(_drafts(spark, sf_dir)))


def order_field_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field differences of rule bodies made from orders, with faults by key."""
    o = table(spark, sf_dir, "orders")

    def body(fixed: bool):
        values = {f: F.lit(None).cast("string") for f in M.STRUCTURAL}
        values |= {"target_ifc_class": F.lit("IfcDoor"), "operator": F.when((F.col("o_orderkey") % 5 == 0) & F.lit(fixed), "<=").otherwise(">="), "unit": F.lit("mm"), "severity": F.when(F.lit(fixed), F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))}
        values["check_value"] = (F.round("o_totalprice") + F.when((F.col("o_orderkey") % 3 == 0) & F.lit(fixed), 10).when(F.lit(fixed), 0.25).otherwise(0)).cast("string")
        return F.struct(*[v.alias(k) for k, v in values.items()], F.when(F.col("o_custkey") % 2 == 0, "x").otherwise("").alias("kg_candidate_used"))

    rows = o.select(F.col("o_orderkey").alias("id"), body(False).alias("original_proposed_rule"), body(True).alias("proposed_rule"))
    return M.field_accuracy(M.field_diffs(rows))


def clause_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clause each draft (made from the customers) came from, against an index of the rule sources, which are fixed in number."""
    sources = table(spark, sf_dir, "rule_sources")
    title = F.concat("title", F.lit(" of "), "jurisdiction")
    index = sources.select(F.col("source_document_id").alias("ord"), F.concat(F.lit("9."), "source_document_id", F.lit(".1.(2)")).alias("ref"), title.alias("text"))
    named = sources.select((F.col("source_document_id") - 1).alias("_s"), title.alias("_title"))
    c = table(spark, sf_dir, "customer").withColumn("_s", F.col("c_custkey") % 30).join(F.broadcast(named), "_s")  # 30 rows, fixed
    k = F.col("c_custkey") % 5
    drafts = c.select(
        F.col("c_custkey").alias("draft_id"), F.when(k == 0, F.concat(F.lit("C"), "c_custkey")).alias("clause_id"), F.when(k == 1, F.concat(F.lit("9."), F.col("_s") + 1, F.lit(".1-2b"))).otherwise(F.lit("own")).alias("rule_id"),
        F.when(k == 2, F.concat(F.lit("  "), F.regexp_replace("_title", " ", "  "))).otherwise(F.lit("")).alias("snippet"), F.when(k == 3, F.array_join(F.reverse(F.split(F.upper("_title"), " ")), " ")).otherwise(F.lit("nothing known")).alias("description"),
    )
    return M.resolve_clause(drafts, index)


def clause_resolution_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts (parts) whose rule ids count list items, against articles of four sentences, a table and a note, made from the parts."""
    p = table(spark, sf_dir, "part")
    art, s = F.floor(F.col("p_partkey") / 4), F.col("p_partkey") % 4 + 1
    article = F.concat(F.lit("9."), art, F.lit(".1"))
    text = F.concat(F.lit("sentence on "), "p_name", F.lit(" of at least "), 1000 + F.col("p_partkey") % 4 * 50, F.lit(" mm"))
    k = F.col("p_partkey") * 10
    sentences = p.select(k.alias("ord"), F.concat(article, F.lit(".("), s, F.lit(")")).alias("ref"), text.alias("text"))
    first = p.where("p_partkey % 4 = 0")
    tables = first.select((k + 1).alias("ord"), F.concat(F.lit("Table under "), article, F.lit(".")).alias("ref"), F.lit("values of 2 050 and 0.75").alias("text"))
    notes = first.select((k + 2).alias("ord"), F.concat(F.lit("Note to Table "), article, F.lit(".")).alias("ref"), F.lit("note for 3000").alias("text"))
    # the number in the id is that of a list item: right for one in five, beside the sentence or past the article's end for others
    item = F.when(F.col("p_partkey") % 5 == 0, s).when(F.col("p_partkey") % 5 == 1, 9).otherwise(s % 4 + 1)
    value = F.when(F.col("p_partkey") % 5 == 3, 2050.0).when(F.col("p_partkey") % 5 == 4, 3000.0).otherwise(F.lit(1000.0) + F.col("p_partkey") % 4 * 50)
    drafts = p.select(
        F.col("p_partkey").alias("draft_id"), F.lit("").alias("clause_id"), F.concat(article, F.lit("-"), item).alias("rule_id"), F.lit("").alias("snippet"), F.col("p_name").alias("description"), F.array(value).alias("values")
    )
    return M.resolve_clause(drafts, sentences.unionByName(tables).unionByName(notes))


def findings_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool's verdicts against reviewers', per priority."""
    o = table(spark, sf_dir, "orders")
    tool = F.when(F.col("o_orderkey") % 9 == 0, "MISSING").when(F.col("o_orderkey") % 3 == 0, "fail").otherwise("PASS")
    human = F.when(F.col("o_orderkey") % 18 == 0, "INDETERMINATE").when(F.col("o_custkey") % 11 == 0, "").when((F.col("o_orderkey") % 3 == 0) != (F.col("o_custkey") % 7 == 0), "FAIL").otherwise("PASS")
    rows = C.score_findings(o.select("o_orderpriority", tool.alias("tool_verdict"), human.alias("human_verdict")), ["o_orderpriority"])
    return rows.select("o_orderpriority", "reviewed", "agreed", "tp", "fp", "fn", "tn", "other", "accuracy", "recall", "precision", F.round("kappa", 6).alias("kappa"))


def threshold_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines against threshold rules, all of which must hold."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", F.when(F.col("l_linenumber") != 4, F.col("l_discount")).alias("l_discount"), "l_tax")
    rules = spark.createDataFrame([("l_quantity", ">=", 10.0), ("l_discount", "<=", 0.08), ("l_discount", ">=", 0.01)], "property_name STRING, operator STRING, check_value DOUBLE")
    return C.evaluate(C.unpivot(lines, "id", ["l_quantity", "l_discount", "l_tax"]), rules)


def property_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").substr(1, 4).alias("property_name"), F.col("l_returnflag").alias("actual"), F.col("l_linestatus").alias("predicted")).agg(F.count(F.lit(1)).alias("n")).withColumn("predicted", F.when(F.col("predicted") == "F", "R").otherwise("N"))
    grades = spark.createDataFrame([("1994", "high"), ("1995", "low")], "property_name STRING, level STRING")
    return C.property_shares(cells, grades)


def merged_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two sheets put together by place."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 < 2").select((F.col("s_suppkey") % 3).alias("sheet"), F.col("s_suppkey").alias("ord"), F.lit(20).alias("drafts"), (F.col("s_suppkey") % 20).alias("correct"), (F.col("s_suppkey") % 5).alias("missed"), (F.col("s_suppkey") % 4).alias("all_fields_right"))
    rows = C.merge_sheets(s)
    return rows.select("place", "drafts", "found", "missed", "invented", "all_right", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


QUERIES = {
    f.__name__: f
    for f in (
        rule_match, rule_match_scores, operator_confusion, clause_confusion, clauses_out_of_scope, recall_match_all, recall_extra_all, sheet_match, sheet_totals, draft_field_diffs, draft_field_accuracy,
        draft_most_changed, order_field_diffs, clause_resolution, clause_resolution_articles, findings_scored, threshold_evaluation, property_shares, merged_sheets,
    )
}

from clauseloom.plans.stat_queries import _COUNT, _metrics_sql  # noqa: E402

# what the faults by key lead to: 3 article reference, 4 target synonym, 5 property synonym, 6 wrong value, 7 wrong operator, 8 missing, 9 doubled
_HIT = "p_partkey % 10 <> 8 AND NOT (p_partkey % 10 = 6 AND p_partkey % 4 <> 3) AND NOT (p_partkey % 10 = 7 AND p_partkey % 4 <> 1)"
_OUTCOMES = f"""WITH g AS ({_GOLD}), e AS ({_EXTRACTED}), m AS (SELECT * FROM (VALUES ('lenient'), ('normalized'), ('strict')) AS v(mode)),
 x AS (SELECT mode, g.*, {_HIT} AND CASE mode WHEN 'strict' THEN p_partkey % 10 <> 4 AND NOT (p_partkey % 10 = 5 AND p_partkey % 3 = 0) ELSE true END AS hit FROM g, m),
 dim AS (SELECT * FROM e WHERE NOT (p_partkey % 10 = 7 AND p_partkey % 4 = 3)),
 o AS (SELECT mode, 'pair' AS outcome, gold_id, p_partkey * 10 AS rule_id FROM x WHERE hit UNION ALL SELECT mode, 'missed', gold_id, NULL FROM x WHERE NOT hit
  UNION ALL SELECT x.mode, CASE WHEN hit AND d = 1 THEN 'redundant' ELSE 'false_positives' END, NULL, rule_id FROM x JOIN dim ON x.p_partkey = dim.p_partkey WHERE NOT hit OR d = 1)"""
_STATES = "lower(g.target) = lower(e.target) AND lower(g.property_name) = lower(e.property_name) AND CASE WHEN g.operator = 'between' THEN abs(g.value_min - e.value_min) <= 0.5 AND abs(g.value_max - e.value_max) <= 0.5 ELSE abs(g.value - e.value) <= 0.5 END"
_D = "WITH d AS (SELECT DISTINCT id, original_proposed_rule AS o, proposed_rule AS n FROM sample_rule_drafts WHERE proposed_rule IS NOT NULL), "


def _norm(c: str) -> str:
    return f"regexp_replace(lower(coalesce(CAST({c} AS VARCHAR), '')), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _changed(f: str) -> str:
    a, b = _norm(f"o.{f}"), _norm(f"n.{f}")
    if f not in M.NUMERIC:
        return f"{a} <> {b}"
    x, y = f"try_cast({a} AS DOUBLE)", f"try_cast({b} AS DOUBLE)"
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN abs({x} - {y}) > 0.5 ELSE {a} <> {b} END"


_FIELDS = _D + "f AS (" + " UNION ALL ".join(f"SELECT id, o.kg_candidate_used AS kg, '{f}' AS field, CAST(o.{f} AS VARCHAR) AS original, CAST(n.{f} AS VARCHAR) AS corrected, {_changed(f)} AS changed FROM d" for f in M.STRUCTURAL) + ")"
_SHEET = """WITH g AS (SELECT *, concat('R', p_partkey) AS id FROM part WHERE p_partkey % 5 < 4), d AS (SELECT *, concat('R', p_partkey) AS id, CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS dup FROM part WHERE p_partkey % 7 <> 0),
 r AS (SELECT coalesce(g.id, d.id) AS rule_id, CASE WHEN g.id IS NULL THEN 'invented' WHEN d.id IS NULL THEN 'missed' ELSE 'found' END AS status, CAST(coalesce(dup, 0) AS BIGINT) AS duplicates, g.id IS NOT NULL AND d.id IS NOT NULL AS both_, coalesce(g.p_partkey, d.p_partkey) AS k FROM g FULL JOIN d ON g.id = d.id),
 s AS (SELECT rule_id, status, duplicates, CASE WHEN both_ THEN true END AS target_right, CASE WHEN both_ THEN k % 3 < 2 END AS property_right, CASE WHEN both_ THEN true END AS operator_right, CASE WHEN both_ THEN k % 6 <> 0 END AS value_right, CASE WHEN both_ THEN k % 4 <> 0 END AS unit_right,
  CASE WHEN both_ THEN k % 2 = 0 END AS conditional, CASE WHEN both_ THEN k % 8 = 0 END AS executable FROM r) """
ORACLE_SQL = {
    "rule_match": _OUTCOMES + " SELECT * FROM o",
    "rule_match_scores": _OUTCOMES + """, c AS (SELECT mode, CAST(count(*) FILTER (WHERE outcome = 'pair') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE outcome = 'missed') AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE outcome = 'false_positives') AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE outcome = 'redundant') AS BIGINT) AS redundant FROM o GROUP BY 1)
 SELECT mode, tp, fn, fp, redundant, round(tp * 1.0 / (tp + fp), 4) AS precision, round(tp * 1.0 / (tp + fn), 4) AS recall, round(2 * (tp * 1.0 / (tp + fp)) * (tp * 1.0 / (tp + fn)) / (tp * 1.0 / (tp + fp) + tp * 1.0 / (tp + fn)), 4) AS f1 FROM c""",
    "operator_confusion": f"""WITH g AS ({_GOLD}), x AS (SELECT operator AS gold_op, CASE WHEN p_partkey % 10 = 7 THEN '<=' ELSE operator END AS op FROM g WHERE p_partkey % 10 <> 8 AND NOT (p_partkey % 10 = 6 AND p_partkey % 4 <> 3) AND NOT (p_partkey % 10 = 7 AND p_partkey % 4 = 3))
 SELECT gold_op, CAST(count(*) FILTER (WHERE op = '>=') AS BIGINT) AS ge, CAST(count(*) FILTER (WHERE op = '<=') AS BIGINT) AS le, CAST(count(*) FILTER (WHERE op = '==') AS BIGINT) AS eq, CAST(count(*) FILTER (WHERE op = 'between') AS BIGINT) AS between, CAST(0 AS BIGINT) AS unknown FROM x GROUP BY 1""",
    "clause_confusion": f"WITH g AS ({_GOLD}) SELECT DISTINCT ref, p_partkey % 7 < 5 AS truth, p_partkey % 10 <> 8 AS predicted FROM g",
    "clauses_out_of_scope": f"WITH g AS ({_GOLD}) SELECT CASE WHEN p_partkey % 10 = 3 THEN regexp_replace(ref, '\\.\\(.*$', '') ELSE ref END AS ref FROM g WHERE p_partkey % 2 = 1 AND p_partkey % 10 <> 8",
    "recall_match_all": f"WITH g AS ({_GOLD}), e AS ({_EXTRACTED}), h AS (SELECT gold_id, min(rule_id) AS rule_id FROM g JOIN e ON {_STATES} GROUP BY 1) SELECT g.gold_id, rule_id FROM g LEFT JOIN h ON g.gold_id = h.gold_id",
    "recall_extra_all": f"WITH g AS ({_GOLD}), e AS ({_EXTRACTED}) SELECT rule_id FROM e WHERE rule_id NOT IN (SELECT rule_id FROM g JOIN e ON {_STATES})",
    "sheet_match": _SHEET + "SELECT * FROM s",
    "sheet_totals": _SHEET + "SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE status = '{x}') AS BIGINT) AS {x}" for x in ("found", "missed", "invented")) + ", CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(count(*) FILTER (WHERE property_right AND value_right AND unit_right) AS BIGINT) AS all_fields_right, "
    + ", ".join(f"CAST(count(*) FILTER (WHERE {x}) AS BIGINT) AS {x}" for x in ("target_right", "property_right", "operator_right", "value_right", "unit_right", "conditional", "executable")) + " FROM s",
    "draft_field_diffs": _FIELDS + " SELECT id AS draft_id, field, original, corrected FROM f WHERE changed",
    "draft_field_accuracy": _FIELDS + """, p AS (SELECT id, trim(coalesce(kg, '')) <> '' AS g, count(*) FILTER (WHERE NOT changed) AS r, count(*) AS a FROM f GROUP BY ALL),
 s AS (SELECT 'all' AS split, * FROM p UNION ALL SELECT CASE WHEN g THEN 'kg_grounded' ELSE 'blind' END, * FROM p)
 SELECT split, CAST(count(*) AS BIGINT) AS drafts, CAST(sum(r) AS BIGINT) AS field_correct, CAST(sum(a) AS BIGINT) AS field_total, round(sum(r) * 1.0 / sum(a), 4) AS field_accuracy, CAST(count(*) FILTER (WHERE r = a) AS BIGINT) AS unchanged_drafts FROM s GROUP BY 1""",
    "draft_most_changed": _FIELDS + " SELECT field, CAST(count(*) AS BIGINT) AS drafts FROM f WHERE changed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "order_field_diffs": """WITH p AS (SELECT o_custkey % 2 = 0 AS g, 20 - CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END - CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS r FROM orders), s AS (SELECT 'all' AS split, r FROM p UNION ALL SELECT CASE WHEN g THEN 'kg_grounded' ELSE 'blind' END, r FROM p)
 SELECT split, CAST(count(*) AS BIGINT) AS drafts, CAST(sum(r) AS BIGINT) AS field_correct, CAST(count(*) * 20 AS BIGINT) AS field_total, round(sum(r) / (count(*) * 20.0), 4) AS field_accuracy, CAST(count(*) FILTER (WHERE r = 20) AS BIGINT) AS unchanged_drafts FROM s GROUP BY 1""",
    "clause_resolution": """SELECT c_custkey AS draft_id, CASE c_custkey % 5 WHEN 0 THEN concat('C', c_custkey) WHEN 4 THEN 'own' ELSE concat('9.', c_custkey % 30 + 1, '.1.(2)') END AS ref,
 CASE c_custkey % 5 WHEN 0 THEN 'clause_id' WHEN 1 THEN 'rule_id' WHEN 2 THEN 'snippet' WHEN 3 THEN 'description_words' ELSE 'rule_id_text' END AS step FROM customer""",
    "findings_scored": "WITH f AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 9 = 0 THEN 'MISSING' WHEN o_orderkey % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS raw, CASE WHEN o_orderkey % 9 = 0 THEN 'INDETERMINATE' WHEN o_orderkey % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS t, CASE WHEN o_orderkey % 18 = 0 THEN 'INDETERMINATE' WHEN o_custkey % 11 = 0 THEN '' WHEN (o_orderkey % 3 = 0) <> (o_custkey % 7 = 0) THEN 'FAIL' ELSE 'PASS' END AS h FROM orders), r AS (SELECT * FROM f WHERE h <> ''), n AS (SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS reviewed, CAST(count(*) FILTER (WHERE t = h) AS BIGINT) AS agreed FROM r GROUP BY 1), a AS (SELECT o_orderpriority, t AS g, count(*) AS c FROM r GROUP BY ALL), b AS (SELECT o_orderpriority, h AS g, count(*) AS c FROM r GROUP BY ALL), e AS (SELECT o_orderpriority, sum(a.c * 1.0 / reviewed * b.c / reviewed) AS e FROM a JOIN b USING (o_orderpriority, g) JOIN n USING (o_orderpriority) GROUP BY 1), m AS ("
    + _metrics_sql("SELECT o_orderpriority, " + _COUNT.format(t="h = 'FAIL'", p="raw = 'FAIL'") + " FROM r WHERE raw IN ('FAIL', 'PASS') AND h IN ('FAIL', 'PASS') GROUP BY 1", "o_orderpriority", ["accuracy", "recall", "precision"])
    + ") SELECT o_orderpriority, reviewed, agreed, tp, fp, fn, tn, reviewed - tp - fp - fn - tn AS other, accuracy, recall, precision, round((agreed * 1.0 / reviewed - e) / (1 - e), 6) AS kappa FROM m JOIN n USING (o_orderpriority) JOIN e USING (o_orderpriority)",
    "threshold_evaluation": """WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS element_id, CASE WHEN l_quantity >= 10 THEN 0 ELSE 1 END + CASE WHEN l_linenumber <> 4 AND l_discount <= 0.08 THEN 0 ELSE 1 END + CASE WHEN l_linenumber <> 4 AND l_discount >= 0.01 THEN 0 ELSE 1 END AS f FROM lineitem)
 SELECT element_id, CAST(count(*) * 3 AS BIGINT) AS n_checks, CAST(sum(f) AS BIGINT) AS n_failed, CASE WHEN sum(f) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM x GROUP BY 1""",
    "property_shares": """SELECT y AS property_name, CASE y WHEN '1994' THEN 'high' WHEN '1995' THEN 'low' END AS level, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE l_returnflag = CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END) AS BIGINT) AS right
 FROM (SELECT left(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 4) AS y, l_returnflag, l_linestatus FROM lineitem) GROUP BY 1, 2""",
    "merged_sheets": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS place FROM supplier WHERE s_suppkey % 3 < 2), q AS (SELECT place, 40 AS drafts, sum(s_suppkey % 20) AS f, sum(s_suppkey % 5) AS m, sum(s_suppkey % 4) AS a FROM p GROUP BY 1 HAVING count(*) = 2)
 SELECT CAST(place AS INTEGER) AS place, CAST(drafts AS BIGINT) AS drafts, CAST(f AS BIGINT) AS found, CAST(m AS BIGINT) AS missed, CAST(drafts - f AS BIGINT) AS invented, CAST(a AS BIGINT) AS all_right, round(f * 1.0 / drafts, 6) AS precision, round(coalesce(f * 1.0 / nullif(f + m, 0), 0), 6) AS recall FROM q""",
}
