"""Clause sentences made from the part table, with every family of wording, so that expectations can be derived from its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauseloom.tables import spread, table

#: Six templates by ``p_partkey % 6``; the same SQL runs in Spark and DuckDB.
CLAUSES = """
SELECT p_partkey AS clause_id, p_brand, p_size, p_partkey % 6 AS k, 800 + p_size * 10 AS n, concat('9.', 1 + p_size % 9, '.', 1 + p_partkey % 7) AS sec,
 CASE p_partkey % 6
  WHEN 0 THEN concat('Where the floor area exceeds ', p_size, ' m2, every door shall have a clear width of not less than ', 800 + p_size * 10,
    ' mm, except where permitted by Section 9.', 1 + p_size % 9, '.', 1 + p_partkey % 7, '.')
  WHEN 1 THEN concat('Guards shall not be less than ', 800 + p_size * 10, ' mm, unless Article 9.', 1 + p_size % 9, '.', 1 + p_partkey % 7, ' applies.')
  WHEN 2 THEN concat('A handrail should extend between ', 800 + p_size * 10, ' and ', 950 + p_size * 10, ' mm, subject to Table 9.', 1 + p_size % 9, '.', 1 + p_partkey % 7, '.')
  WHEN 3 THEN concat('Notwithstanding Sentence 9.', 1 + p_size % 9, '.', 1 + p_partkey % 7, '.(', 1 + p_size % 4, '), ramps may have a slope of 1 in ', 8 + p_size % 12, '.')
  WHEN 4 THEN concat('Windows must not exceed ', p_size, ' m2 in buildings conforming to 9.', 1 + p_size % 9, '.', 1 + p_partkey % 7, '.')
  ELSE concat('It is permitted to use ', p_size, ' detectors in accordance with CAN/ULC-S', 500 + p_size, ' for at least ', 30 + p_size, ' minutes.') END AS text
FROM part
"""


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clause_id, p_brand, p_size, k (template), n, sec, text."""
    return spark.sql(CLAUSES.replace("FROM part", "FROM {part}"), part=spread(table(spark, sf_dir, "part")))


#: The clauses with the document and heading they are put under; headings are numbered apart from what the clauses refer to.
PLACED = f"""
SELECT c.*, concat(p_brand, '/', CAST(floor(clause_id / 500) AS INT)) AS doc_id, 1 + clause_id % 9 AS h1, 1 + p_size % 7 AS h2, concat('9.', 1 + clause_id % 9, '.', 1 + p_size % 7) AS hsec,
 CASE WHEN 1 + clause_id % 9 IN (1, 4, 7) THEN 1 ELSE 2 END AS level FROM ({CLAUSES}) AS c
"""


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and xml: the clauses as marked-up documents of some twenty clauses each, with headings and, for every seventh clause, a table."""
    from pyspark.sql import functions as F

    rows = spark.sql(PLACED.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    body = F.concat(F.lit('<text id="e'), F.col("clause_id"), F.lit('">'), F.col("text"), F.lit("</text>"))
    cells = F.concat(F.lit("<table><fcel/>size<fcel/>"), F.col("p_size"), F.lit(" mm<nl/><fcel/>width<fcel/>"), F.col("n"), F.lit("<nl/></table>"))
    rows = rows.withColumn("body", F.concat(body, F.when(F.col("clause_id") % 7 == 0, cells).otherwise(F.lit(""))))
    joined = lambda item, name: F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x[name]), "")
    sections = rows.groupBy("doc_id", "h1", "h2", "hsec", "level").agg(joined(F.struct("clause_id", "body"), "body").alias("inner"))
    head = F.concat(F.lit('<heading level="'), F.col("level"), F.lit('">'), F.col("hsec"), F.lit(" Sizes "), F.col("h2"), F.lit("</heading>"), F.col("inner"))
    docs = sections.withColumn("part", head).groupBy("doc_id").agg(joined(F.struct("h1", "h2", "part"), "part").alias("body"))
    return docs.select("doc_id", F.concat(F.lit("<doc>"), "body", F.lit("</doc>")).alias("xml"))
