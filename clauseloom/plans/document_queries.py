"""Documents from markup to nodes, chunks, clauses and edges, with expectations derived from the columns they are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.operators import documents as D
from clauseloom.operators import graph as G
from clauseloom.sources.clauses import PLACED, markup
from clauseloom.tables import table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.nodes(markup(spark, sf_dir))


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).withColumn("section_path", F.array_join("section_path", "/"))


def document_nodes_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same nodes through a table function joined laterally."""
    spark.udtf.register("document_nodes", D.DocumentNodes)
    rows = spark.sql("SELECT doc_id, t.* FROM {docs}, LATERAL document_nodes(xml) AS t", docs=markup(spark, sf_dir))
    return rows.withColumn("section_path", F.array_join("section_path", "/"))


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.document_text(_nodes(spark, sf_dir)).select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.chunks(_nodes(spark, sf_dir))
    return rows.select("doc_id", "section_seq", "section_number", "section_name", F.array_join("section_path", "/").alias("section_path"), F.size("paragraphs").alias("paragraphs"), "text", "char_count")


def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks' texts with their analysis block."""
    return D.chunks(_nodes(spark, sf_dir)).select("doc_id", "section_seq", "filtered_text")


def annotated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other form of block, computed over a chunk's whole text."""
    rows = D.chunks(_nodes(spark, sf_dir)).select("doc_id", "section_seq", "section_name", F.col("text").alias("filtered_text"))
    return D.annotate_chunks(rows)


def kept_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with the number of their dimensions; every third is skipped."""
    body = _nodes(spark, sf_dir).where("tag = 'text'").withColumn("final_decision", F.when(F.substring("element_id", 2, 9).cast("int") % 3 == 0, "SKIP").otherwise("KEEP"))
    return D.annotate_kept(body).select("element_id", F.size("annotation.dimensions").alias("n")).select("element_id", F.when(F.col("n") >= 0, F.col("n")).alias("n_dimensions"))


def document_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.clauses(_nodes(spark, sf_dir))
    return rows.select("doc_id", "clause_seq", "ref", "heading", "level", F.array_join("section_path", "/").alias("section_path"), "text", F.array_join("element_ids", ",").alias("element_ids"), F.size("dimensions").alias("n_dimensions"))


def clause_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the clauses of a document."""
    return G.clause_edges(D.clauses(_nodes(spark, sf_dir))).select("doc_id", "source_ref", "target_ref", "edge_type", "label")


def dedupe_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("ref"))
    return D.dedupe_refs(rows, "l_orderkey", "ref", "l_linenumber")


def heading_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References derived from headings of several kinds, and their numeric part."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    heading = F.when(k == 0, F.concat(F.lit("a-1."), "p_size", F.lit(".2.  Limit of use."))).when(k == 1, F.concat("p_size", F.lit(".1 Scope"))).when(k == 2, F.lit("General matters")).otherwise(F.concat("p_size", F.lit(".3.(1)(b)")))
    rows = p.select("p_partkey", D.derive_ref(heading, F.col("p_size")).alias("d"))
    return rows.select("p_partkey", "d.ref", "d.heading", D.numeric_suffix(F.col("d.ref")).alias("suffix"))


def markup_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with injected annotations: they still parse to the same nodes, and the records are counted."""
    docs = markup(spark, sf_dir)
    out = D.inject(docs, D.nodes(docs))
    count = lambda tag: F.regexp_count("xml", F.lit(f"<{tag} ")).alias(tag)
    return out.select("doc_id", F.size(D.node_array(F.col("xml"))).alias("nodes"), *[count(t) for t in ("deontic", "dimension", "cross_ref", "dependency", "condition")])


def stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a brand under one root."""
    docs = markup(spark, sf_dir).withColumn("brand", F.substring_index("doc_id", "/", 1))
    one = D.stitch(docs, "brand", "doc_id")
    return one.select("brand", F.size(D.node_array(F.col("xml"))).alias("nodes"))


QUERIES = {
    f.__name__: f
    for f in (
        document_nodes, document_nodes_lateral, document_text, document_chunks, chunk_blocks, annotated_chunks, kept_paragraphs, document_clauses, clause_references, dedupe_refs, heading_refs, markup_injection, stitched,
    )
}

_TABLE = "concat('| size | ', p_size, ' mm |', chr(10), '| --- | --- |', chr(10), '| width | ', n, ' |')"
_NODES = f"""WITH p AS ({PLACED}), h AS (SELECT DISTINCT doc_id, h1, h2, hsec, level FROM p),
 hp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h1, h2) AS seq, max(CASE WHEN level = 1 THEN h1 * 100 + h2 END) OVER (PARTITION BY doc_id ORDER BY h1, h2) AS above FROM h),
 hh AS (SELECT *, CASE WHEN level = 1 THEN hsec WHEN above IS NULL THEN hsec ELSE concat('9.', above // 100, '.', above % 100, '/', hsec) END AS path FROM hp),
 e AS (SELECT doc_id, h1, h2, CAST(0 AS BIGINT) AS c, 0 AS o, 'heading' AS tag, concat(hsec, ' Sizes ', h2) AS text, NULL AS element_id, level FROM h
  UNION ALL SELECT doc_id, h1, h2, clause_id, 1, 'text', text, concat('e', clause_id), 1 FROM p UNION ALL SELECT doc_id, h1, h2, clause_id, 2, 'table', {_TABLE}, NULL, 1 FROM p WHERE clause_id % 7 = 0),
 nodes AS (SELECT e.doc_id, CAST(row_number() OVER (PARTITION BY e.doc_id ORDER BY e.h1, e.h2, c, o) - 1 AS INTEGER) AS ord, tag, text, element_id, e.level, hsec AS section_number, concat('Sizes ', e.h2) AS section_name,
  path AS section_path, CAST(seq AS INTEGER) AS seq FROM e JOIN hh USING (doc_id, h1, h2)) """
_DIMS = "CASE k WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END + CASE WHEN clause_id % 7 = 0 THEN 1 ELSE 0 END"
_EDGES = f"""WITH p AS ({PLACED}), h AS (SELECT DISTINCT doc_id, hsec FROM p), m AS (SELECT p.* FROM p JOIN h ON p.doc_id = h.doc_id AND p.sec = h.hsec WHERE p.sec <> p.hsec)
 SELECT doc_id, hsec AS source_ref, sec AS target_ref, 'cross_ref' AS edge_type, CASE k WHEN 0 THEN concat('Section ', sec) WHEN 1 THEN concat('Article ', sec) WHEN 2 THEN concat('Table ', sec) ELSE sec END AS label FROM m WHERE k IN (0, 1, 2, 4)
 UNION ALL SELECT doc_id, hsec, sec, CASE k WHEN 2 THEN 'depends_on:subject_to' ELSE 'depends_on:exception' END, CASE k WHEN 0 THEN 'except' WHEN 1 THEN 'unless' ELSE 'subject to' END FROM m WHERE k IN (0, 1, 2)"""
ORACLE_SQL = {
    "document_nodes": _NODES + "SELECT doc_id, ord, tag, text, element_id, level, section_number, section_name, section_path FROM nodes",
    "document_nodes_lateral": _NODES + "SELECT doc_id, ord, tag, text, element_id, level, section_number, section_name, section_path FROM nodes",
    "document_text": _NODES + "SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM (SELECT doc_id, string_agg(text, concat(chr(10), chr(10)) ORDER BY ord) AS t FROM nodes GROUP BY 1)",
    "document_chunks": _NODES + """, g AS (SELECT doc_id, seq, section_number, section_name, section_path, count(*) AS n, string_agg(text, concat(chr(10), chr(10)) ORDER BY ord) AS t FROM nodes WHERE tag <> 'heading' GROUP BY ALL)
 SELECT doc_id, seq AS section_seq, section_number, section_name, section_path, CAST(n AS INTEGER) AS paragraphs, t AS text, CAST(length(t) AS INTEGER) AS char_count FROM g""",
    "document_clauses": _NODES + f""", g AS (SELECT doc_id, seq, section_number, any_value(section_path) AS path, string_agg(text, concat(chr(10), chr(10)) ORDER BY ord) AS t, string_agg(element_id, ',' ORDER BY ord) AS ids FROM nodes WHERE tag <> 'heading' GROUP BY ALL),
 d AS (SELECT doc_id, hsec, sum({_DIMS}) AS dims FROM p GROUP BY ALL)
 SELECT g.doc_id, seq AS clause_seq, section_number AS ref, hd.heading, hd.level, path AS section_path, t AS text, ids AS element_ids, CAST(dims AS INTEGER) AS n_dimensions
 FROM g JOIN d ON g.doc_id = d.doc_id AND g.section_number = d.hsec JOIN (SELECT doc_id, section_number AS s, section_name AS heading, level FROM nodes WHERE tag = 'heading') hd ON hd.doc_id = g.doc_id AND hd.s = g.section_number""",
    "kept_paragraphs": f"WITH p AS ({PLACED}) SELECT concat('e', clause_id) AS element_id, CASE WHEN clause_id % 3 > 0 THEN CASE k WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END END AS n_dimensions FROM p",
    "clause_references": _EDGES,
    "dedupe_refs": """SELECT l_orderkey, l_linenumber, CASE WHEN r > 1 THEN concat(l_returnflag, '#', r - 1) ELSE l_returnflag END AS ref
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS r FROM lineitem)""",
    "heading_refs": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('A-1.', p_size, '.2') WHEN 1 THEN concat(p_size, '.1') WHEN 2 THEN concat('H', p_size) ELSE concat(p_size, '.3.(1)(B)') END AS ref,
 CASE p_partkey % 4 WHEN 0 THEN 'Limit of use.' WHEN 1 THEN 'Scope' WHEN 2 THEN 'General matters' ELSE concat(p_size, '.3.(1)(b)') END AS heading,
 CASE p_partkey % 4 WHEN 0 THEN concat('1.', p_size, '.2') WHEN 1 THEN concat(p_size, '.1') WHEN 2 THEN concat('H', p_size) ELSE concat(p_size, '.3.(1)(B)') END AS suffix FROM part""",
    "markup_injection": _NODES + f""", x AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE tag = 'heading') AS heads FROM nodes GROUP BY 1) SELECT doc_id, CAST(x.n AS INTEGER) AS nodes, CAST(sum(CASE WHEN k IN (1, 4, 5) THEN 2 ELSE 1 END) AS INTEGER) AS deontic, CAST(sum({_DIMS}) AS INTEGER) AS dimension,
 CAST(count(*) + x.heads AS INTEGER) AS cross_ref, CAST(count(*) FILTER (WHERE k < 4) AS INTEGER) AS dependency, CAST(sum(CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END) AS INTEGER) AS condition FROM p JOIN x USING (doc_id) GROUP BY doc_id, x.n, x.heads""",
    "stitched": _NODES + "SELECT split_part(doc_id, '/', 1) AS brand, CAST(count(*) AS INTEGER) AS nodes FROM nodes GROUP BY 1",
}
