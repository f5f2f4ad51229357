"""Text annotation over generated clauses, with expectations derived from their columns, and over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import annotate, obligations, rules, spans, stats, terms
from clauseloom.sources.clauses import CLAUSES, clauses
from clauseloom.tables import spread, table

_WITH = f"WITH c AS ({CLAUSES}) "


def deontic_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clauses(spark, sf_dir).select("clause_id", F.explode(obligations.deontics(F.col("text"))).alias("d"))
    return rows.select("clause_id", "d.operator", "d.strength", "d.negated", "d.span")


def deontic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("clause_id", obligations.deontic_summary(F.col("text")).alias("summary"))


def condition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clauses(spark, sf_dir).select("clause_id", obligations.parse_conditions(F.col("text")).alias("p"))
    parts = F.concat(F.col("p.conditions"), F.col("p.exceptions"), F.transform("p.requirements", lambda r: F.struct(F.lit("requirement").alias("type"), F.lit("").alias("marker"), r.alias("text"))))
    return rows.select("clause_id", F.explode(parts).alias("x")).select("clause_id", "x.type", "x.marker", "x.text")


def condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clauses(spark, sf_dir).select("clause_id", obligations.condition_summaries(obligations.parse_conditions(F.col("text"))).alias("s"))
    return rows.select("clause_id", "s.conditions", "s.exceptions")


def cross_ref_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("clause_id", F.explode(spans.cross_refs(F.col("text"))).alias("r")).select("clause_id", "r.*")


def dimension_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clauses(spark, sf_dir).select("clause_id", F.explode(spans.dimensions(F.col("text"))).alias("d"))
    return rows.select("clause_id", "d.value", "d.unit", F.col("d.constraint").alias("bound"), "d.value_min", "d.value_max", "d.span")


def dependency_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clauses(spark, sf_dir).select("clause_id", F.explode(spans.dependencies(F.col("text"))).alias("d"))
    return rows.select("clause_id", "d.dep_type", "d.marker", "d.text", F.array_join(F.transform("d.refs", lambda r: r["normalized"]), ",").alias("refs"))


def element_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clauses(spark, sf_dir).withColumn("h", annotate.element_hints(F.col("text")))
    return rows.select("clause_id", annotate.subject(F.col("text"), F.col("h")).alias("subject"), F.array_join(F.transform("h", lambda x: F.concat(x["surface"], F.lit("="), x["ifc_class"])), ",").alias("hints"))


def paragraph_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of everything found in each clause, from the whole annotation record."""
    from clauseloom.operators.documents import annotated

    a = F.col("annotation")
    rows = annotated(clauses(spark, sf_dir).select("clause_id", "text"))
    return rows.select("clause_id", *[F.size(a[k]).alias(f"n_{k}") for k in ("deontics", "conditions", "requirements", "cross_refs", "dimensions", "dependencies", "ifc_hints")], a["subject"].alias("subject"))


def paragraph_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each clause says with its exceptions apart from its conditions."""
    rows = clauses(spark, sf_dir).withColumns({"s": spans.spans(F.col("text")), "p": obligations.parse_conditions(F.col("text")), "h": annotate.element_hints(F.col("text"))})
    rows = rows.select("clause_id", annotate.paragraph(F.col("text"), F.col("s"), F.col("p"), F.col("h"), keep_exceptions_apart=True).alias("a"))
    joined = lambda c: F.array_join(F.transform(f"a.{c}", lambda x: x["text"]), " / ").alias(c)
    refs = F.array_join(F.flatten(F.transform("a.dependencies", lambda d: F.transform(d["refs"], lambda r: r["normalized"]))), ",")
    return rows.select("clause_id", joined("conditions"), joined("exceptions"), joined("dependencies"), refs.alias("refs"), F.array_join("a.deontics.operator", ",").alias("deontics"))


def clause_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes of the clauses, with what was found in each rolled up."""
    from clauseloom.operators import graph as G
    from clauseloom.operators.documents import annotated

    a = F.col("annotation")
    rows = annotated(clauses(spark, sf_dir)).select(
        F.col("clause_id").cast("string").alias("ref"), F.col("p_brand").alias("heading"), F.lit(1).alias("level"), F.array("sec").alias("section_path"), "text", F.array(F.col("clause_id").cast("string")).alias("element_ids"),
        *[a[c].alias(c) for c in ("deontics", "conditions", "dimensions", "ifc_hints")],
    )
    out = G.clause_nodes(rows)
    return out.select("id", "heading", "char_count", F.array_join("deontic_operators", ",").alias("operators"), "has_conditions", "dimension_count", F.array_join("ifc_hints", ",").alias("hints"))


def interval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares with their intervals in words."""
    p = table(spark, sf_dir, "part")
    share = F.col("p_size") / 100.0
    return p.select("p_partkey", rules.confidence_text(share, share / 2, (share + 1) / 2).alias("percent"), rules.confidence_text(share, share / 2, (share + 1) / 2, percent=False).alias("plain"))


def paragraph_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each clause depends on, with the references named there, also short ones."""
    from clauseloom.operators.documents import annotated

    section = F.concat(F.lit("9."), F.col("p_size"))
    text = F.concat(F.lit("Subject to "), section, F.lit(", stairs shall comply.")).alias("text")
    rows = annotated(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("clause_id"), F.when(F.col("p_partkey") % 2 == 0, text).otherwise(F.concat(F.lit("Subject to Article "), section, F.lit(".1, stairs shall comply."))).alias("text")))
    found = rows.select("clause_id", F.explode("annotation.dependencies").alias("d"))
    return found.select("clause_id", "d.dep_type", "d.marker", "d.text", F.array_join("d.refs.normalized", ",").alias("refs"))


def chunk_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis block of each clause."""
    rows = clauses(spark, sf_dir).withColumns({"s": spans.spans(F.col("text")), "p": obligations.parse_conditions(F.col("text")), "h": annotate.element_hints(F.col("text"))})
    return rows.select("clause_id", annotate.preamble(F.col("text"), F.col("s"), F.col("p"), F.col("h"), F.col("p_brand")).alias("preamble"))


def clause_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per brand, how clauses oblige and bound, and how well that agrees with what their templates say."""
    c = clauses(spark, sf_dir).withColumns({"d": obligations.deontics(F.col("text")), "dims": spans.dimensions(F.col("text"))})
    said = F.exists("d", lambda x: x["strength"] == "mandatory")
    meant = F.col("k").isin(0, 1, 4)
    rows = c.select("p_brand", said.alias("mandatory"), meant.alias("meant"), F.exists("dims", lambda x: x["constraint"] == "min").alias("has_min"), F.size("dims").alias("n_dims"))
    counted = rows.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("mandatory").alias("n_mandatory"), F.count_if("has_min").alias("n_min"), F.sum("n_dims").alias("n_dims"), *stats.confusion_counts(F.col("meant"), F.col("mandatory"))
    )
    w = stats.wilson(F.col("n_mandatory"), F.col("n"))
    m = stats.confusion_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return counted.withColumns({"share_lower": w["lower"], "share_upper": w["upper"], "accuracy": m["accuracy"], "recall": m["recall"]})


def document_deontics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators found in each document that has any."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(obligations.deontics(F.col("text"))).alias("d"))
    return rows.groupBy("doc_id", F.col("d.operator").alias("operator"), F.col("d.strength").alias("strength")).agg(F.count(F.lit(1)).alias("n"))


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, dimensions and dependencies of each document, counted; whole texts."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", spans.spans(F.col("text")).alias("s"))
    return rows.select("doc_id", *[F.size(F.coalesce(f"s.{k}", F.array())).alias(f"n_{k}") for k in ("cross_refs", "dimensions", "dependencies")])


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.coalesce(obligations.sentences(F.col("text")), F.array())).alias("n_sentences"))


def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token overlap and containment of neighbouring part names."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    tok = lambda c: F.array_distinct(terms.tokenize(F.col(c)))
    return p.select("p_partkey", F.round(terms.jaccard(tok("a"), tok("b")), 6).alias("jaccard"), terms.exact_substring(F.col("a"), F.col("b")).alias("substring"))


def fuzz_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-sort similarity of each part's type and name with its name and brand."""
    p = table(spark, sf_dir, "part")
    words = lambda *c: F.lower(F.concat_ws(" ", *c))
    return p.select("p_partkey", F.round(terms.fuzz_ratio(words("p_type", "p_name"), words("p_name", "p_brand")), 6).alias("fuzz"))


def rule_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, units and ranges of limits in words, made from the part table."""
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("not less than 2 "), F.lpad(s, 3, "0"), F.lit(" mm"))).when(k == 1, F.concat(F.lit("between "), s, F.lit(" and "), (F.col("p_size") + 7).cast("string"), F.lit(" degrees")))
        .when(k == 2, F.concat(F.lit("1 in "), s)).when(k == 3, F.concat(s, F.lit(" mm per person"))).otherwise(F.lit("at least three risers"))
    )
    return p.select("p_partkey", rules.numeric_value(text).alias("v")).select("p_partkey", "v.value", "v.unit", "v.value_min", "v.value_max")


def reference_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised references of the generated clauses' section numbers in several notations."""
    c = clauses(spark, sf_dir).withColumn("m", F.col("clause_id") % 4)
    raw = F.when(F.col("m") == 0, F.concat(F.lit("Sentence "), "sec", F.lit(".(2)(a)"))).when(F.col("m") == 1, F.concat(F.lit("Table under "), "sec")).when(F.col("m") == 2, F.concat("sec", F.lit("(3)"))).otherwise(F.concat(F.lit("Note to Table "), "sec", F.lit(".")))
    return c.select("clause_id", rules.normalize_ref(raw).alias("ref"), rules.cross_ref(raw)["ref_type"].alias("ref_type"), rules.cross_ref(raw)["normalized"].alias("normalized"))


def unit_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in base units, with their operator's one spelling."""
    p = table(spark, sf_dir, "part").withColumns({"unit": F.element_at(F.array(*[F.lit(u) for u in ("mm", "cm", "m", "kN", "%", "furlong")]), (F.col("p_partkey") % 6 + 1).cast("int")), "op": F.element_at(F.array(*[F.lit(o) for o in ("min", "≤", "exact", "in_range", "near")]), (F.col("p_partkey") % 5 + 1).cast("int"))})
    return p.select("p_partkey", F.round(rules.to_base(F.col("p_size"), F.col("unit")), 6).alias("base"), rules.unit_family(F.col("unit")).alias("family"), rules.normalize_op(F.col("op")).alias("op"))


def other_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds by other elements' dimensions and building uses, from made spans."""
    p = table(spark, sf_dir, "part")
    span = F.when(F.col("p_partkey") % 3 == 0, "the required width of the stair or ramp").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("width "), F.col("p_size"), F.lit(" of the door"))).otherwise("the height of the guard")
    scope = F.when(F.col("p_partkey") % 2 == 0, "for ramps not serving a house").otherwise("serving an individual dwelling unit")
    return p.select("p_partkey", rules.other_element_property(span).alias("property"), rules.building_use(scope).alias("building_use"))


QUERIES = {
    f.__name__: f
    for f in (
        clause_profile, deontic_extract, deontic_summary, condition_parse, condition_summary, cross_ref_extract, dimension_extract, dependency_extract, element_hints, paragraph_annotation, paragraph_dependencies, paragraph_apart, clause_nodes, interval_texts,
        chunk_preamble, document_deontics, document_spans, document_sentences, token_jaccard, fuzz_similarity, rule_numbers, reference_forms, unit_scaling, other_elements,
    )
}

_DEONTICS = """SELECT clause_id, operator, strength, negated, span FROM c, (VALUES
 (0,'SHALL','mandatory',false,'shall'), (1,'SHALL NOT','prohibited',true,'shall not'), (1,'SHALL','mandatory',false,'shall'), (2,'SHOULD','recommended',false,'should'),
 (3,'MAY','permitted',false,'may'), (4,'MUST NOT','prohibited',true,'must not'), (4,'MUST','mandatory',false,'must'),
 (5,'IS PERMITTED TO','permitted',false,'is permitted to'), (5,'IS PERMITTED','permitted',false,'is permitted')) AS v(t, operator, strength, negated, span) WHERE k = t"""
_CONDITIONS = """
 SELECT clause_id, 'applicability' AS type, 'Where' AS marker, concat('the floor area exceeds ', p_size, ' m2') AS text FROM c WHERE k = 0
 UNION ALL SELECT clause_id, 'exception', 'except where', concat('permitted by Section ', sec) FROM c WHERE k = 0
 UNION ALL SELECT clause_id, 'exception', 'unless', concat('Article ', sec, ' applies') FROM c WHERE k = 1
 UNION ALL SELECT clause_id, 'qualification', 'subject to', concat('Table ', sec) FROM c WHERE k = 2"""
_REQUIREMENTS = """
 SELECT clause_id, 'requirement' AS type, '' AS marker, CASE k WHEN 0 THEN concat('every door shall have a clear width of not less than ', n, ' mm') WHEN 1 THEN concat('Guards shall not be less than ', n, ' mm')
  WHEN 2 THEN concat('A handrail should extend between ', n, ' and ', n + 150, ' mm') WHEN 3 THEN concat('ramps may have a slope of 1 in ', 8 + p_size % 12) ELSE left(text, length(text) - 1) END AS text FROM c"""
_DIMENSIONS = """
 SELECT clause_id, CAST(n AS DOUBLE) AS value, 'mm' AS unit, 'min' AS bound, CAST(n AS DOUBLE) AS value_min, CAST(NULL AS DOUBLE) AS value_max, concat('not less than ', n, ' mm') AS span FROM c WHERE k = 0
 UNION ALL SELECT clause_id, p_size, 'm2', 'exact', NULL, NULL, concat(p_size, ' m2') FROM c WHERE k = 0
 UNION ALL SELECT clause_id, n, 'mm', 'min', n, NULL, concat('not be less than ', n, ' mm') FROM c WHERE k = 1
 UNION ALL SELECT clause_id, NULL, 'mm', 'range', n, n + 150, concat('between ', n, ' and ', n + 150, ' mm') FROM c WHERE k = 2
 UNION ALL SELECT clause_id, p_size, 'm2', 'max', NULL, p_size, concat('not exceed ', p_size, ' m2') FROM c WHERE k = 4
 UNION ALL SELECT clause_id, 30 + p_size, 'min', 'min', 30 + p_size, NULL, concat('at least ', 30 + p_size, ' minutes') FROM c WHERE k = 5"""
_REFS = """
 SELECT clause_id, CASE k WHEN 0 THEN concat('Section ', sec) WHEN 1 THEN concat('Article ', sec) WHEN 2 THEN concat('Table ', sec) WHEN 3 THEN concat('Sentence ', sec, '.(', 1 + p_size % 4, ')')
   WHEN 4 THEN sec ELSE concat('CAN/ULC-S', 500 + p_size) END AS raw,
  CASE k WHEN 2 THEN 'table' WHEN 3 THEN 'sentence' WHEN 5 THEN 'standard' ELSE 'section' END AS ref_type,
  CASE k WHEN 3 THEN concat(sec, '.(', 1 + p_size % 4, ')') WHEN 5 THEN concat('CAN/ULC-S', 500 + p_size) ELSE sec END AS normalized, CASE k WHEN 4 THEN 'conforming to' ELSE '' END AS context FROM c"""
_DEPENDENCIES = """
 SELECT clause_id, CASE k WHEN 2 THEN 'subject_to' WHEN 3 THEN 'override' ELSE 'exception' END AS dep_type, CASE k WHEN 0 THEN 'except' WHEN 1 THEN 'unless' WHEN 2 THEN 'subject to' ELSE 'notwithstanding' END AS marker,
  CASE k WHEN 0 THEN concat('except where permitted by Section ', sec, '.') WHEN 1 THEN concat('unless Article ', sec, ' applies.') WHEN 2 THEN concat('subject to Table ', sec, '.')
   ELSE concat('Notwithstanding Sentence ', sec, '.(', 1 + p_size % 4, '),') END AS text, CASE k WHEN 3 THEN concat(sec, '.(', 1 + p_size % 4, ')') ELSE sec END AS refs FROM c WHERE k < 4"""
_HINTS = """SELECT clause_id, subject, hints FROM c, (VALUES (0,'door','door=IfcDoor,floor=IfcSlab'), (1,'Guards','guard=IfcRailing'), (2,'handrail','handrail=IfcRailing'), (3,'ramp','ramp=IfcRamp'),
 (4,'Windows','window=IfcWindow'), (5,'detector','detector=IfcSensor')) AS v(t, subject, hints) WHERE k = t"""
_WILSON = """CASE WHEN {n} > 0 THEN round({f}(({s}*1.0/{n} + 1.95996398454*1.95996398454/(2*{n}) {sign} 1.95996398454*sqrt(({s}*1.0/{n})*(1-{s}*1.0/{n})/{n} + 1.95996398454*1.95996398454/(4*{n}*{n}*1.0)))/(1+1.95996398454*1.95996398454/{n}), {b}), 4) ELSE 0 END"""


def wilson_sql(s: str, n: str) -> tuple[str, str]:
    """SQL of Wilson's bounds at 95 %."""
    return _WILSON.format(s=s, n=n, f="greatest", sign="-", b="0.0"), _WILSON.format(s=s, n=n, f="least", sign="+", b="1.0")


_LOW, _HIGH = wilson_sql("n_mandatory", "n")
_BOUNDARY = r"(?:^|[^\p{L}\p{N}\p{M}\p{Pc}])"


def _document_deontics_sql() -> str:
    parts = []
    for operator, strength in obligations.OPERATORS:
        words = r"[\s\p{Z}]+".join(r"[\p{L}\p{N}_]+" if w == "…" else w.lower() for w in operator.split())
        # the word before is consumed, the one after is looked at by cutting the text there
        pattern = rf"(?i){_BOUNDARY}{words}(?:$|[^\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}])"
        parts.append(f"SELECT doc_id, '{operator}' AS operator, '{strength}' AS strength, CAST(len(regexp_extract_all(text, '{pattern}')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


ORACLE_SQL = {
    "deontic_extract": _WITH + _DEONTICS,
    "deontic_summary": _WITH + """SELECT clause_id, summary FROM c, (VALUES (0,'SHALL x1 (mandatory)'), (1,'SHALL NOT x1 (prohibited), SHALL x1 (mandatory)'), (2,'SHOULD x1 (recommended)'), (3,'MAY x1 (permitted)'),
 (4,'MUST NOT x1 (prohibited), MUST x1 (mandatory)'), (5,'IS PERMITTED TO x1 (permitted), IS PERMITTED x1 (permitted)')) AS v(t, summary) WHERE k = t""",
    "condition_parse": _WITH + _CONDITIONS + " UNION ALL " + _REQUIREMENTS,
    "condition_summary": _WITH + """SELECT clause_id, CASE k WHEN 0 THEN concat('"the floor area exceeds ', p_size, ' m2"') WHEN 2 THEN concat('"Table ', sec, '"') ELSE '' END AS conditions,
 CASE k WHEN 0 THEN concat('"permitted by Section ', sec, '"') WHEN 1 THEN concat('"Article ', sec, ' applies"') ELSE '' END AS exceptions FROM c""",
    "cross_ref_extract": _WITH + _REFS,
    "dimension_extract": _WITH + _DIMENSIONS,
    "dependency_extract": _WITH + _DEPENDENCIES,
    "element_hints": _WITH + _HINTS,
    "paragraph_dependencies": """SELECT p_partkey AS clause_id, 'subject_to' AS dep_type, 'subject to' AS marker, concat('Subject to ', CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'Article ' END, '9.', p_size, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '.1' END, ',') AS text,
 concat('9.', p_size, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '.1' END) AS refs FROM part""",
    "paragraph_apart": _WITH + """SELECT clause_id, CASE k WHEN 0 THEN concat('the floor area exceeds ', p_size, ' m2') WHEN 2 THEN concat('Table ', sec) ELSE '' END AS conditions,
 CASE k WHEN 0 THEN concat('permitted by Section ', sec) WHEN 1 THEN concat('Article ', sec, ' applies') ELSE '' END AS exceptions,
 CASE k WHEN 0 THEN concat('except where permitted by Section ', sec, '.') WHEN 1 THEN concat('unless Article ', sec, ' applies.') WHEN 2 THEN concat('subject to Table ', sec, '.') WHEN 3 THEN concat('Notwithstanding Sentence ', sec, '.(', 1 + p_size % 4, '),') ELSE '' END AS dependencies,
 CASE WHEN k < 3 THEN sec WHEN k = 3 THEN concat(sec, '.(', 1 + p_size % 4, ')') ELSE '' END AS refs,
 CASE k WHEN 0 THEN 'SHALL' WHEN 1 THEN 'SHALL NOT,SHALL' WHEN 2 THEN 'SHOULD' WHEN 3 THEN 'MAY' WHEN 4 THEN 'MUST NOT,MUST' ELSE 'IS PERMITTED TO,IS PERMITTED' END AS deontics FROM c""",
    "clause_nodes": _WITH + """SELECT concat('clause::', clause_id) AS id, p_brand AS heading, CAST(length(text) AS INTEGER) AS char_count, CASE k WHEN 0 THEN 'SHALL' WHEN 1 THEN 'SHALL,SHALL NOT' WHEN 2 THEN 'SHOULD' WHEN 3 THEN 'MAY' WHEN 4 THEN 'MUST,MUST NOT' ELSE 'IS PERMITTED,IS PERMITTED TO' END AS operators,
 k < 3 AS has_conditions, CASE k WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS dimension_count, CASE k WHEN 0 THEN 'IfcDoor,IfcSlab' WHEN 1 THEN 'IfcRailing' WHEN 2 THEN 'IfcRailing' WHEN 3 THEN 'IfcRamp' WHEN 4 THEN 'IfcWindow' ELSE 'IfcSensor' END AS hints FROM c""",
    "interval_texts": """SELECT p_partkey, printf('%.1f%% [95%% CI: %.1f%% – %.1f%%]', p_size * 1.0, p_size / 2.0, (p_size + 100) / 2.0) AS percent,
 printf('%.3f [95%% CI: %.3f – %.3f]', p_size / 100.0, p_size / 200.0, (p_size + 100) / 200.0) AS plain FROM part""",
    "paragraph_annotation": _WITH + """SELECT clause_id, n_deontics, n_conditions, 1 AS n_requirements, 1 AS n_cross_refs, n_dimensions, n_dependencies, n_ifc_hints, subject FROM c, (VALUES
 (0,1,2,2,1,2,'door'), (1,2,1,1,1,1,'Guards'), (2,1,1,1,1,1,'handrail'), (3,1,0,0,1,1,'ramp'), (4,2,0,1,0,1,'Windows'), (5,2,0,1,0,1,'detector'))
 AS v(t, n_deontics, n_conditions, n_dimensions, n_dependencies, n_ifc_hints, subject) WHERE k = t""",
    "chunk_preamble": _WITH + r"""SELECT clause_id, concat('[NLP PRE-ANALYSIS - ', p_brand, ']', chr(10), replace(CASE k
 WHEN 0 THEN concat('  Deontic: SHALL x1 (mandatory)\n  Cross-refs: ', sec, '\n  Dimensions: ', n, '.0 mm (min), ', p_size, '.0 m2\n  Conditions: "the floor area exceeds ', p_size, ' m2"\n  Exceptions: "permitted by Section ', sec, '"\n  Dependencies: exception: "except where permitted by Section ', sec, '."\n  IFC targets: IfcDoor, IfcSlab')
 WHEN 1 THEN concat('  Deontic: SHALL NOT x1 (prohibited), SHALL x1 (mandatory)\n  Cross-refs: ', sec, '\n  Dimensions: ', n, '.0 mm (min)\n  Exceptions: "Article ', sec, ' applies"\n  Dependencies: exception: "unless Article ', sec, ' applies."\n  IFC targets: IfcRailing')
 WHEN 2 THEN concat('  Deontic: SHOULD x1 (recommended)\n  Cross-refs: Table ', sec, '\n  Dimensions: ', n, '.0-', n + 150, '.0 mm (range)\n  Conditions: "Table ', sec, '"\n  Dependencies: subject_to: "subject to Table ', sec, '."\n  IFC targets: IfcRailing')
 WHEN 3 THEN concat('  Deontic: MAY x1 (permitted)\n  Cross-refs: ', sec, '.(', 1 + p_size % 4, ')\n  Dependencies: override: "Notwithstanding Sentence ', sec, '.(', 1 + p_size % 4, '),"\n  IFC targets: IfcRamp')
 WHEN 4 THEN concat('  Deontic: MUST NOT x1 (prohibited), MUST x1 (mandatory)\n  Cross-refs: ', sec, '\n  Dimensions: ', p_size, '.0 m2 (max)\n  IFC targets: IfcWindow')
 ELSE concat('  Deontic: IS PERMITTED TO x1 (permitted), IS PERMITTED x1 (permitted)\n  Cross-refs: CAN/ULC-S', 500 + p_size, '\n  Dimensions: ', 30 + p_size, '.0 min (min)\n  IFC targets: IfcSensor') END, '\n', chr(10)), chr(10), '[END PRE-ANALYSIS]') AS preamble FROM c""",
    "document_sentences": r"""SELECT doc_id, CAST(CASE WHEN text IS NULL OR regexp_full_match(text, '[\x{09}-\x{0d}\x{85}\p{Z}]*') THEN 0 ELSE 1 + len(regexp_extract_all(text, '\.[\x{09}-\x{0d}\x{85}\p{Z}]+[A-Z]')) END AS INTEGER) AS n_sentences FROM documents""",
    "clause_profile": _WITH + f""", g AS (SELECT p_brand, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE k IN (0,1,4)) AS BIGINT) AS n_mandatory, CAST(count(*) FILTER (WHERE k IN (0,1,5)) AS BIGINT) AS n_min,
 CAST(sum(CASE k WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END) AS BIGINT) AS n_dims FROM c GROUP BY p_brand)
 SELECT p_brand, n, n_mandatory, n_min, n_dims, n_mandatory AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, n - n_mandatory AS tn, {_LOW} AS share_lower, {_HIGH} AS share_upper,
 CAST(1 AS DOUBLE) AS accuracy, CASE WHEN n_mandatory > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS recall FROM g""",
    "document_deontics": _document_deontics_sql(),
    "token_jaccard": """WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS x, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS y, lower(trim(p_name)) AS a, lower(trim(p_type)) AS b FROM part)
 SELECT p_partkey, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))) ELSE 0 END, 6) AS jaccard,
 CASE WHEN a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) THEN CAST(1 AS DOUBLE) ELSE 0 END AS substring FROM t""",
    # longest common subsequences by rows: the best so far of each place, and one more where the characters agree
    "fuzz_similarity": """WITH RECURSIVE s AS (SELECT p_partkey, array_to_string(list_sort(string_split(lower(concat(p_type, ' ', p_name)), ' ')), ' ') AS x, array_to_string(list_sort(string_split(lower(concat(p_name, ' ', p_brand)), ' ')), ' ') AS y FROM part),
 d AS (SELECT p_partkey, x, y, 0 AS i, list_transform(range(length(y) + 1), lambda k: CAST(0 AS BIGINT)) AS best FROM s
  UNION ALL SELECT p_partkey, x, y, i + 1, list_transform(range(length(y) + 1), lambda k: list_max(c[1:k + 1])) FROM (
   SELECT *, list_transform(range(length(y) + 1), lambda k: greatest(best[k + 1], CASE WHEN k > 0 AND substr(x, i + 1, 1) = substr(y, k, 1) THEN best[k] + 1 ELSE 0 END)) AS c FROM d WHERE i < length(x)))
 SELECT p_partkey, round(2.0 * best[length(y) + 1] / (length(x) + length(y)), 6) AS fuzz FROM d WHERE i = length(x)""",
    "rule_numbers": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 2000.0 + p_size WHEN 2 THEN round(1.0 / p_size, 6) WHEN 3 THEN p_size WHEN 4 THEN 3 END AS value,
 CASE p_partkey % 5 WHEN 0 THEN 'mm' WHEN 1 THEN 'degrees' WHEN 2 THEN 'ratio' WHEN 3 THEN 'mm/person' END AS unit, CASE WHEN p_partkey % 5 = 1 THEN CAST(p_size AS DOUBLE) END AS value_min,
 CASE WHEN p_partkey % 5 = 1 THEN CAST(p_size + 7 AS DOUBLE) END AS value_max FROM part""",
    "reference_forms": _WITH + """SELECT clause_id, CASE clause_id % 4 WHEN 0 THEN concat(sec, '.(2)') WHEN 1 THEN concat('table:', sec) WHEN 2 THEN concat(sec, '.(3)') ELSE concat('note:', sec) END AS ref,
 CASE clause_id % 4 WHEN 0 THEN 'sentence' WHEN 2 THEN 'clause' ELSE 'table' END AS ref_type, CASE clause_id % 4 WHEN 0 THEN concat(sec, '.(2)') ELSE sec END AS normalized FROM c""",
    "unit_scaling": """SELECT p_partkey, round(p_size * CASE p_partkey % 6 WHEN 1 THEN 10.0 WHEN 2 THEN 1000.0 WHEN 4 THEN 0.01 ELSE 1.0 END, 6) AS base,
 CASE p_partkey % 6 WHEN 3 THEN 'force' WHEN 4 THEN 'ratio' WHEN 5 THEN NULL ELSE 'length' END AS family, CASE p_partkey % 5 WHEN 0 THEN '>=' WHEN 1 THEN '<=' WHEN 2 THEN '==' WHEN 3 THEN 'between' END AS op FROM part""",
    "other_elements": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'RequiredStairOrRampWidth' WHEN 2 THEN 'GuardHeight' END AS property, CASE p_partkey % 2 WHEN 0 THEN 'non_dwelling_unit' ELSE 'dwelling_unit' END AS building_use FROM part""",
}
