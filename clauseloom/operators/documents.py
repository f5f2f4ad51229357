"""Marked-up documents as nodes, chunks and clauses.

XML is read by a vectorised function (Spark has no pre-order walk); everything
after that is windows and aggregates over an explicit document order.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_type

from clauseloom.functions import annotate, obligations, spans
from clauseloom.functions.columns import or_null, strip
from clauseloom.operators.ordered import ordered_index
from clauseloom.tables import spread

NODE = T.StructType(
    [
        T.StructField("ord", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("text", T.StringType()), T.StructField("element_id", T.StringType()),
        T.StructField("level", T.IntegerType()), T.StructField("section_number", T.StringType()), T.StructField("section_name", T.StringType()),
        T.StructField("section_path", T.ArrayType(T.StringType())),
    ]
)
# Tags that hold text, and the tags that may stand at an element's head, in their order.
TEXT_TAGS = ("text", "paragraph", "p")
HEAD_TAGS = ("label", "thread", "xref", "href", "layer", "location", "caption", "description", "summary", "custom")
# Names of the element's mark and of the annotation's record in a custom child.
ID_MARK, RECORD = "bg_element_id", "bg_nlp"
_HEADING = re.compile(r"^(\d+(?:\.\d+)*)(?:[.)\s]+(.*))?$")
_DECLARED = re.compile(r"<!(?:DOCTYPE|ENTITY)", re.I)


def local_name(tag) -> str:
    """A tag in lower case without its namespace; '' for comments and instructions."""
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def inner_text(element: ET.Element) -> str:
    return "".join(element.itertext()).strip()


def element_id(element: ET.Element) -> str | None:
    """The id in a custom child's mark, else the element's own id attribute."""
    for custom in element:
        for mark in custom if local_name(custom.tag) == "custom" else ():
            named = mark.get("value") or mark.get("id") if local_name(mark.tag) == ID_MARK else None
            if named:
                return named
    return element.get("id")


def table_rows(table: ET.Element, strict: bool = False) -> list[list[str]]:
    """Rows of a table whose cells and rows are ended by empty elements.

    By default only ``fcel`` starts a cell, so header cells run together and a
    caption becomes a cell, as documents in use are read; ``strict`` lets every
    cell element (``ched``, ``ecel`` and others ending in ``el``/``ed``) start one.
    """
    rows: list[list[str]] = [[]]
    cell: list[str] = []

    def close_cell() -> None:
        text = " ".join("".join(cell).split())
        cell.clear()
        if text:
            rows[-1].append(text)

    for child in table:
        name = local_name(child.tag)
        if name == "custom":
            continue
        if name == "nl":
            close_cell()
            rows.append([])
        else:
            if name == "fcel" or (strict and name in ("ched", "ecel", "rhed", "srow", "lcel", "ucel", "xcel")):
                close_cell()
            cell.append(inner_text(child))
        cell.append((child.tail or "").strip())
    close_cell()
    return [r for r in rows if r]


def table_text(table: ET.Element, strict: bool = False) -> str:
    """A table in pipe notation, rows padded to one width; without cells its lines."""
    rows = table_rows(table, strict) or [[line.strip()] for line in inner_text(table).splitlines() if line.strip()]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def parse(xml: str | None) -> ET.Element | None:
    """The root of safe markup; None for blank or malformed text and for anything that declares a type or an entity."""
    if not xml or not xml.strip() or _DECLARED.search(xml):
        return None
    try:
        return ET.fromstring(xml)
    except ET.ParseError:
        return None


def walk(root: ET.Element, strict_tables: bool = False) -> list[tuple[dict, ET.Element]]:
    """Nodes with their elements in document order; texts inherit the number, name and path of the section they stand in."""
    found: list[tuple[dict, ET.Element]] = []
    open_levels: dict[int, str] = {}
    section: tuple[str | None, str | None] = (None, None)

    def add(element: ET.Element, tag: str, text: str, level: int) -> None:
        path = [open_levels[k] for k in sorted(open_levels)]
        node = {"ord": len(found), "tag": tag, "text": text, "element_id": element_id(element), "level": level}
        found.append((node | {"section_number": section[0], "section_name": section[1], "section_path": path}, element))

    for element in root.iter():
        tag = local_name(element.tag)
        if tag == "heading":
            text = inner_text(element)
            try:
                level = int(element.get("level", "1"))
            except ValueError:
                level = 1
            numbered = _HEADING.match(text)
            section = (numbered[1], (numbered[2] or "").strip() or text) if numbered else (None, text)
            open_levels = {k: v for k, v in open_levels.items() if k < level} | {level: section[0] or text}
            add(element, "heading", text, level)
        elif tag in TEXT_TAGS:
            if text := inner_text(element):
                add(element, tag, text, 1)
        elif tag == "table":
            if (text := table_text(element, strict_tables)).strip():
                add(element, "table", text, 1)
    return found


def nodes_of(xml: str | None, strict_tables: bool = False) -> list[dict]:
    root = parse(xml)
    return [] if root is None else [n for n, _ in walk(root, strict_tables)]


def node_array(xml: Column, strict_tables: bool = False) -> Column:
    """ARRAY of the nodes of markup in document order; empty for null, malformed or entity-bearing text."""
    kind = T.ArrayType(NODE)

    @F.arrow_udf(kind)
    def read(batch: pa.Array) -> pa.Array:
        return pa.array([nodes_of(x, strict_tables) for x in batch.to_pylist()], type=to_arrow_type(kind))

    return read(xml)


@udtf(returnType=NODE)
class DocumentNodes:
    """``LATERAL document_nodes(xml)`` in SQL: one row per node."""

    def eval(self, xml: str):
        for n in nodes_of(xml):
            yield tuple(n.values())


def nodes(documents: DataFrame, key: str = "doc_id", xml: str = "xml", strict_tables: bool = False) -> DataFrame:
    """key and one row per node; documents without nodes give none."""
    return documents.select(key, F.explode(node_array(F.col(xml), strict_tables)).alias("_n")).select(key, "_n.*")


def annotated(rows: DataFrame, text: str = "text", pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Add ``annotation`` to rows of text: one Python pass for what needs offsets, the rest in Catalyst."""
    found = spread(rows).withColumns({"_spans": spans.spans(F.col(text)), "_parsed": obligations.parse_conditions(F.col(text)), "_hints": annotate.element_hints(F.col(text), pairs)})
    return found.withColumn("annotation", annotate.paragraph(F.col(text), F.col("_spans"), F.col("_parsed"), F.col("_hints"))).drop("_spans", "_parsed", "_hints")


def annotate_kept(paragraphs: DataFrame, decision: str = "final_decision", text: str = "text") -> DataFrame:
    """Paragraph rows with ``annotation``; those decided to be skipped keep a null one."""
    return annotated(paragraphs, text).withColumn("annotation", F.when(F.coalesce(F.col(decision), F.lit("")) != "SKIP", F.col("annotation")))


def _section(key: str) -> Column:
    """Running number of headings: 0 before the first."""
    return F.sum(F.when(F.col("tag") == "heading", 1).otherwise(0)).over(W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int")


#: Models that chunks may be limited for at once.
MOST_MODELS = 1000


def limited_chunks(chunk_rows: DataFrame, limits: DataFrame, order: list[str]) -> DataFrame:
    """The chunks each model is given: the first ``limit`` of all in order, or all where its limit is null or 0.

    ``limits`` has model and limit, for ``MOST_MODELS`` models at most. Chunks
    are numbered once, in ranges, so that no task sorts them all.
    """
    models = limits.select("model", F.coalesce("limit", F.lit(0)).cast("bigint").alias("limit")).limit(MOST_MODELS + 1).collect()
    if len(models) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    wanted = F.array(*[F.struct(F.lit(m).cast("string").alias("model"), F.lit(n).alias("limit")) for m, n in models]).cast("array<struct<model: string, limit: bigint>>")
    given = F.filter(wanted, lambda w: (w["limit"] == 0) | (F.col("_place") < w["limit"]))
    numbered = ordered_index(chunk_rows, order, "_place")
    return numbered.withColumn("model", F.explode(F.transform(given, lambda w: w["model"]))).drop("_place")


def document_text(node_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and text: a document's node texts with a blank line between them."""
    kept = node_rows.where(strip(F.col("text")) != "")
    return kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def chunks(node_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per section with text: number, name, path, annotated paragraphs, text, text with its preamble, characters.

    A heading without text gives no chunk; text before the first heading gives
    one without a section.
    """
    numbered = node_rows.withColumn("section_seq", _section(key))
    body = annotated(numbered.where(F.col("tag") != "heading"))
    part = F.struct("ord", "text", "element_id", "annotation", F.lit("KEEP").alias("final_decision"))
    grouped = body.groupBy(key, "section_seq").agg(
        F.sort_array(F.collect_list(F.struct("ord", F.col("section_number").alias("n"), F.col("section_name").alias("m"), F.col("section_path").alias("p"))))[0].alias("_s"),
        F.array_sort(F.collect_list(part), lambda x, y: (x["ord"] - y["ord"])).alias("paragraphs"),
    )
    text = F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n\n")
    block = annotate.collected_preamble(F.transform("paragraphs", lambda p: p["annotation"]), F.col("_s.m"))
    grouped = grouped.withColumns({"text": text, "_block": block})
    return grouped.select(
        key, "section_seq", F.col("_s.n").alias("section_number"), F.col("_s.m").alias("section_name"), F.col("_s.p").alias("section_path"), "paragraphs", "text",
        F.when(F.col("_block") == "", F.col("text")).otherwise(F.concat("_block", F.lit("\n\n"), "text")).alias("filtered_text"), F.length("text").alias("char_count"),
    )


def annotate_chunks(chunk_rows: DataFrame, text: str = "filtered_text", section: str = "section_name") -> DataFrame:
    """Prepend the analysis block to chunk texts; empty texts stay. Their paragraphs are annotated by :func:`annotate_kept`."""
    found = spread(chunk_rows).withColumns(
        {"_t": strip(F.coalesce(F.col(text), F.lit(""))), "_spans": spans.spans(strip(F.coalesce(F.col(text), F.lit("")))), "_parsed": obligations.parse_conditions(strip(F.coalesce(F.col(text), F.lit(""))))}
    )
    found = found.withColumn("_block", annotate.preamble(F.col("_t"), F.col("_spans"), F.col("_parsed"), annotate.element_hints(F.col("_t")), F.col(section)))
    return found.withColumn(text, F.when((F.col("_t") != "") & (F.col("_block") != ""), F.concat("_block", F.lit("\n\n"), "_t")).otherwise(F.col("_t"))).drop("_t", "_spans", "_parsed", "_block")


def derive_ref(heading: Column, number: Column) -> Column:
    """STRUCT<ref, heading>: a heading's leading clause number in capitals, else H and the heading's number in its document."""
    h = strip(heading)
    pattern = r"(?iU)^([A-Z]?-?\d+(?:\.\d+)*(?:\.\(\d+\))*(?:\([a-z0-9]+\))*)\.?\s*(.*)$"
    ref, rest = F.regexp_extract(h, pattern, 1), F.regexp_extract(h, pattern, 2)
    return F.when(ref != "", F.struct(F.upper(F.regexp_replace(ref, r"\.+$", "")).alias("ref"), F.coalesce(or_null(strip(rest)), h).alias("heading"))).otherwise(
        F.struct(F.concat(F.lit("H"), number.cast("string")).alias("ref"), h.alias("heading"))
    )


def numeric_suffix(ref: Column) -> Column:
    """A reference without a leading letter part: 'A-1.1.2' as '1.1.2'."""
    return F.regexp_replace(ref, r"^[^-]*-", "")


def dedupe_refs(rows: DataFrame, key: str, ref: str, order: str) -> DataFrame:
    """Make references unique within a document: the n-th repeat gets '#n'."""
    nth = F.row_number().over(W.partitionBy(key, ref).orderBy(order)) - 1
    return rows.withColumn("_nth", nth).withColumn(ref, F.when(F.col("_nth") > 0, F.concat(F.col(ref), F.lit("#"), F.col("_nth"))).otherwise(F.col(ref))).drop("_nth")


def clauses(node_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per heading, with or without text, in order: ref, heading, level, path, text, element ids and its texts' annotations.

    Text before the first heading is a clause PREAMBLE-1.
    """
    numbered = node_rows.withColumn("clause_seq", _section(key))
    heads = numbered.where(F.col("tag") == "heading").select(
        key, "clause_seq", derive_ref(F.col("text"), F.col("clause_seq")).alias("_d"), "section_path", "level"
    )
    heads = heads.select(key, "clause_seq", "_d.ref", "_d.heading", "section_path", "level")
    body = annotated(numbered.where((F.col("tag") != "heading") & (strip(F.col("text")) != "")))
    lists = ("deontics", "conditions", "dimensions", "cross_refs", "dependencies", "ifc_hints")
    item = F.struct("ord", "text", "element_id", *[F.col(f"annotation.{k}").alias(k) for k in lists])
    grouped = body.groupBy(key, "clause_seq").agg(F.array_sort(F.collect_list(item), lambda x, y: (x["ord"] - y["ord"])).alias("_items"))
    all_rows = heads.join(grouped, [key, "clause_seq"], "full_outer")
    preface = F.col("clause_seq") == 0
    of = lambda name: F.coalesce(F.transform("_items", lambda x: x[name]), F.array())
    out = all_rows.select(
        key, "clause_seq", F.when(preface, "PREAMBLE-1").otherwise(F.col("ref")).alias("ref"), F.when(preface, "").otherwise(F.col("heading")).alias("heading"),
        F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path"), F.coalesce("level", F.lit(0)).alias("level"),
        F.array_join(of("text"), "\n\n").alias("text"), F.filter(of("element_id"), lambda x: x.isNotNull()).alias("element_ids"), *[F.flatten(of(k)).alias(k) for k in lists],
    )
    return dedupe_refs(out, key, "ref", "clause_seq")


def _attributes(annotation: dict) -> list[tuple[str, dict[str, str]]]:
    """Tags and attributes that record an annotation."""
    text = lambda v: "" if v is None else str(v)
    fields = {
        "deontic": ("deontics", ("operator", "strength", "negated", "span")), "condition": ("conditions", ("type", "marker", "text")),
        "dimension": ("dimensions", ("value", "unit", "constraint", "span")), "cross_ref": ("cross_refs", ("raw", "ref_type", "normalized")),
        "dependency": ("dependencies", ("dep_type", "marker", "text")), "ifc_hint": ("ifc_hints", ("surface", "ifc_class")),
    }
    out = []
    for tag, (group, names) in fields.items():
        for record in annotation.get(group) or ():
            values = {n: ("true" if record.get(n) else "false") if n == "negated" else text(record.get(n)) for n in names}
            if tag in ("condition", "dependency"):
                values["text"] = values["text"][:120]
            out.append((tag, values))
    return out


def mark_up(xml: str, annotations: dict[int, dict]) -> str:
    """Markup with each node's annotation (by node order) written into a ``custom`` child at a valid place of its head.

    Nodes without a signal are left alone; markup that cannot be parsed comes
    back unchanged.
    """
    root = parse(xml)
    if root is None:
        return xml
    if root.tag.startswith("{"):
        ET.register_namespace("", root.tag[1:].partition("}")[0])
    for node, element in walk(root):
        annotation = annotations.get(node["ord"]) or {}
        records = _attributes(annotation)
        if not records:
            continue
        custom = next((c for c in element if local_name(c.tag) == "custom"), None)
        if custom is None:
            custom = ET.Element(element.tag.rpartition("}")[0] + "}custom" if "}" in element.tag else "custom")
            head = 0
            while head < len(element) and local_name(element[head].tag) in HEAD_TAGS:
                head += 1
            custom.tail, element.text = (element.text, None) if head == 0 else (None, element.text)
            element.insert(head, custom)
        record = ET.SubElement(custom, RECORD, {"subject": annotation["subject"]} if annotation.get("subject") else {})
        for tag, values in records:
            ET.SubElement(record, tag, values)
    return ET.tostring(root, encoding="unicode")


def inject(documents: DataFrame, node_rows: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """key and xml with the annotations of its nodes injected; documents without annotated nodes keep their markup."""
    item = F.struct("ord", F.to_json("annotation").alias("a"))
    per_doc = annotated(node_rows).groupBy(F.col(key).alias("_k")).agg(F.collect_list(item).alias("_a"))

    @F.pandas_udf("string")
    def write(texts, notes):
        import json

        import pandas as pd

        return pd.Series([t if t is None else mark_up(t, {r["ord"]: json.loads(r["a"]) for r in (() if n is None else n)}) for t, n in zip(texts, notes)])

    return documents.join(per_doc, documents[key] == per_doc["_k"], "left").select(key, write(F.col(xml), F.col("_a")).alias(xml))


def stitch(parts: DataFrame, key: str, order: str, xml: str = "xml") -> DataFrame:
    """key and xml: single-root documents put under one root in order; fails if a part has no single root."""
    pattern = r"(?s)^\s*(?:<\?xml.*?\?>\s*)?<(\w[\w:.-]*)([^>]*)>(.*)</\1>\s*$"
    checked = F.when(F.col(xml).rlike(pattern), F.col(xml)).otherwise(F.raise_error(F.lit("a part has no single root")))
    rows = parts.select(key, order, checked.alias("_x"))
    piece = F.struct(order, F.regexp_extract("_x", pattern, 1).alias("tag"), F.regexp_extract("_x", pattern, 2).alias("attrs"), F.regexp_extract("_x", pattern, 3).alias("body"))
    grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list(piece)).alias("_p"))
    first = F.get("_p", F.lit(0))
    return grouped.select(
        key, F.concat(F.lit("<"), first["tag"], first["attrs"], F.lit(">"), F.array_join(F.transform("_p", lambda p: p["body"]), ""), F.lit("</"), first["tag"], F.lit(">")).alias(xml)
    )
