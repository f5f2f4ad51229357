"""Reading of markup, archives, graphs, rules, queues and results from files. All lazy; schemas are given, not guessed."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions.columns import strip

# Where rules and their fields may stand, and what else some fields may be called on the outside.
RULE_LISTS = ("rules", "drafts", "items", "data")
NESTED_IN = ("rule_json", "rule", "check", "logic")
RULE_TEXTS = ("ref", "target", "property_name", "operator", "unit", "desc", "value_min_property", "value_max_property")
RULE_NUMBERS = ("value", "value_min", "value_max", "value_min_offset", "value_max_offset")
OUTER_NAMES = {
    "ref": ["source_ref", "section_ref", "clause_ref", "section", "citation"],
    "target": ["ifc_class", "ifc_entity", "target_entity"],
    "property_name": ["property", "attribute"],
    "desc": ["description"],
}
EDGE = "source STRING, target STRING, key BIGINT, kind STRING, label STRING, property_set STRING, composite_score DOUBLE, llm_verdict STRING, llm_confidence DOUBLE"
NODE = "id STRING, kind STRING, doc_id STRING, ref STRING, heading STRING, name STRING, uri STRING, text_excerpt STRING, definition STRING"


def _document_part(archive: zipfile.ZipFile) -> str | None:
    """The part of an archive that holds the document: document.xml, else a relation's target, else the first top-level XML part."""
    names = archive.namelist()
    exact = [n for n in names if n.lower().rsplit("/", 1)[-1] == "document.xml"]
    if exact:
        return min(exact, key=lambda n: (n.count("/"), n))
    if "_rels/.rels" in names:
        for target in re.findall(r'Target="([^"]+)"', archive.read("_rels/.rels").decode("utf-8", "replace")):
            if "document" in target.lower() and target.lstrip("/") in names:
                return target.lstrip("/")
    top = sorted(n for n in names if "/" not in n and n.lower().endswith(".xml") and not n.startswith("["))
    return top[0] if top else None


@F.arrow_udf(T.StringType())
def archive_document(content: pa.Array) -> pa.Array:
    """The document part of zipped archives as text; fails if an archive has none."""

    def read(data: bytes | None) -> str | None:
        if data is None:
            return None
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            part = _document_part(archive)
            if part is None:
                raise ValueError("an archive without a document part")
            return archive.read(part).decode("utf-8")

    return pa.array([read(x) for x in content.to_pylist()], type=pa.string())


def read_markup(spark: SparkSession, path: str, archives: str = "dclx") -> DataFrame:
    """doc_id (the file's name without its ending), xml, digest (SHA-256 of the file) of markup files and archives in a folder."""
    files = spark.read.format("binaryFile").load(path).withColumn("_name", F.substring_index("path", "/", -1))
    zipped = F.lower("_name").endswith("." + archives)
    plain = files.where(~zipped).withColumn("xml", F.decode("content", "UTF-8"))
    packed = files.where(zipped).withColumn("xml", archive_document(F.col("content")))
    return plain.unionByName(packed).select(F.regexp_replace("_name", r"\.[^.]*$", "").alias("doc_id"), "xml", F.sha2("content", 256).alias("digest"))


def read_graph(spark: SparkSession, path: str, node: str = NODE, edge: str = EDGE) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of node-link JSON files; edges may be listed as ``edges`` or ``links``."""
    kind = f"nodes ARRAY<STRUCT<{_fields(node)}>>, edges ARRAY<STRUCT<{_fields(edge)}>>, links ARRAY<STRUCT<{_fields(edge)}>>"
    raw = spark.read.schema(kind).json(path, multiLine=True)
    edges = raw.select(F.explode(F.coalesce("edges", "links")).alias("e")).select("e.*").withColumnsRenamed({"source": "src", "target": "dst"})
    return raw.select(F.explode("nodes").alias("n")).select("n.*"), edges


def _fields(ddl: str) -> str:
    return ", ".join(": ".join(x.split(" ", 1)) for x in ddl.split(", "))


def flatten_rules(texts: DataFrame, text: str = "text", strict: bool = True) -> DataFrame:
    """One row per rule of JSON texts: a list, or an object with a list under one of several names; ``ord`` is the place in its list.

    A rule's own keys count first, then those of ``rule_json``, ``rule``,
    ``check`` and ``logic``: a key that is present is taken, even if it is null.
    A key that is nowhere may have another name on the outside, the first that
    is not empty. A null value is that of ``check_value``, wherever it stands. A
    text that is no list of rules is an error, or gives nothing without
    ``strict``. Columns: texts ref, target, property_name, operator, unit, desc
    and the properties of relative bounds; numbers value, value_min, value_max
    and the offsets.
    """
    v = F.expr(f"try_parse_json(`{text}`)")
    lists = [F.try_variant_get("_v", "$", "array<variant>"), *[F.try_variant_get("_v", f"$.{n}", "array<variant>") for n in RULE_LISTS]]
    error = [F.raise_error(F.concat(F.lit("expected a list of rules or an object with one: "), F.substring(F.coalesce(F.col(text), F.lit("null")), 1, 80)))] if strict else []
    rows = texts.withColumn("_v", v).select(F.posexplode(F.coalesce(*lists, *[e.cast("array<variant>") for e in error])).alias("ord", "_r"))
    level = lambda path: F.try_variant_get("_r", path, "map<string, variant>")
    rows = rows.select("ord", level("$").alias("_0"), *[level(f"$.{n}").alias(f"_{k}") for k, n in enumerate(NESTED_IN, 1)])
    levels = [f"_{k}" for k in range(len(NESTED_IN) + 1)]

    def stated(key: str, kind: str) -> tuple[Column, Column]:
        """(whether a key is present at any level, its value at the first level that has it)"""
        there = [F.coalesce(F.map_contains_key(F.col(m), key), F.lit(False)) for m in levels]
        value = F.lit(None).cast(kind)
        for has, m in reversed(list(zip(there, levels))):
            value = F.when(has, F.try_variant_get(F.element_at(m, key), "$", kind)).otherwise(value)
        return F.greatest(*there), value

    def outer(name: str) -> Column:
        return F.nullif(F.try_variant_get(F.try_element_at("_0", F.lit(name)), "$", "string"), F.lit(""))

    out = []
    for key in RULE_TEXTS:
        present, value = stated(key, "string")
        others = OUTER_NAMES.get(key)
        out.append((F.when(present, value).otherwise(F.coalesce(*map(outer, others))) if others else value).alias(key))
    for key in RULE_NUMBERS:
        value = stated(key, "double")[1]
        out.append((F.coalesce(value, stated("check_value", "double")[1]) if key == "value" else value).alias(key))
    return rows.select("ord", *out)


def clause_index(lines: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """ref and text of the lines '<ref> <text>' of a clause list; other lines are left out."""
    pattern = r"^((?:Table under |Note to Table )?\d+(?:\.\d+)+[A-Z]?\.?(?:\(\w+\))*)\s+(.*)$"
    text = strip(F.col(line))
    rows = lines.where(text.rlike(pattern))
    return rows.select(*([F.col(order).alias("ord")] if order else []), F.regexp_extract(text, pattern, 1).alias("ref"), F.regexp_extract(text, pattern, 2).alias("text"))


def read_queue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A review queue or decisions from CSV with a header, or from JSON, by the path's ending."""
    reader = spark.read.schema(schema)
    return reader.json(path, multiLine=True) if path.rstrip("/").endswith(".json") else reader.csv(path, header=True, multiLine=True, escape='"')


_VALUE = "STRUCT<start: INT, end: INT, text: STRING, labels: ARRAY<STRING>, choices: ARRAY<STRING>>"
_RESULT = f"ARRAY<STRUCT<id: STRING, from_name: STRING, to_name: STRING, type: STRING, value: {_VALUE}>>"
_META = "STRUCT<element_id: STRING, tag: STRING, level: STRING, section_number: STRING, section_name: STRING, section_path: ARRAY<STRING>, superseded: STRING>"
TASK = (
    f"id STRING, data STRUCT<section_ref: STRING, text: STRING, code: STRING, clause_id: STRING, meta: {_META}>, "
    f"annotations ARRAY<STRUCT<id: BIGINT, completed_by: INT, annotator_role: STRING, result: {_RESULT}>>, predictions ARRAY<STRUCT<model_version: STRING, result: {_RESULT}>>"
)
_BODY = "STRUCT<" + ", ".join(
    f"{n}: DOUBLE" if n in ("value_min", "value_max", "value_min_offset", "value_max_offset") else f"{n}: STRING"
    for n in "rule_type target_ifc_class property_set property_name operator check_value value_min value_max unit value_min_property value_min_offset value_max_property value_max_offset severity applies_when overridden_by description".split()
) + ">"
DRAFT = f"id BIGINT, status STRING, source_snippet STRING, clause STRUCT<clause_id: STRING>, original_proposed_rule {_BODY}, proposed_rule {_BODY}"
FINDING = "element_id STRING, check_id STRING, tool_verdict STRING, human_verdict STRING, count BIGINT"


def read_tasks(spark: SparkSession, path: str, lines: bool = False, schema: str = TASK) -> DataFrame:
    """Annotation tasks of JSON files, each a list of tasks or a single one, or with ``lines`` a task a line. Numeric ids become text."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_drafts(spark: SparkSession, path: str, status: str | None = None, lines: bool = False, schema: str = DRAFT) -> DataFrame:
    """Rule drafts of JSON files: a list of drafts, one draft, or an object with a list ``drafts``; of one ``status`` if given."""
    fields = [f.name for f in T.StructType.fromDDL(schema).fields]
    listed = "drafts ARRAY<STRUCT<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields) + ">>"
    raw = spark.read.schema(f"{schema}, {listed}").json(path, multiLine=not lines)
    rows = raw.select(F.explode(F.coalesce("drafts", F.array(F.struct(*fields)))).alias("d")).select("d.*")
    return rows if status is None else rows.where(F.col("status") == status)


def read_findings(spark: SparkSession, path: str, lines: bool = False, schema: str = FINDING) -> DataFrame:
    """Findings of JSON files, each a list of findings or a single one."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_grounding(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A grounding index as the sink wrote it."""
    return spark.read.schema(schema).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of files named <eval>_<run>.json with their run id."""
    kind = "eval_id STRING, tier INT, status STRING, passed INT, failed INT, total INT, score DOUBLE, duration_s DOUBLE, details ARRAY<STRUCT<label: STRING, passed: BOOLEAN>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_name"))
    failing = F.array_sort(F.array_distinct(F.transform(F.filter("details", lambda d: d["label"].isNotNull() & ~F.coalesce(d["passed"], F.lit(False))), lambda d: d["label"])))
    run = F.regexp_extract("_file", r"_([^_]+)\.json$", 1)
    return rows.where(~F.startswith("_file", F.lit("manifest"))).select("*", run.alias("run_id"), F.coalesce(failing, F.array().cast("array<string>")).alias("failing")).drop("_file")


def page_ranges(pages: Column, size: int) -> Column:
    """ARRAY<STRUCT<first, last>>: a document's pages in ranges of ``size``; empty for none."""
    starts = F.when(pages > 0, F.sequence(F.lit(1), pages, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + size - 1, pages).alias("last")))
