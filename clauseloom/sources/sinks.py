"""Writing of graphs, queues, results, baselines and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _as_text(df: DataFrame, name: str) -> Column:
    """A column as the text of a graph attribute: lists joined, null as ''."""
    kind = df.schema[name].dataType.simpleString()
    value = F.array_join(name, ", ") if kind.startswith("array") else F.col(name).cast("string")
    return F.coalesce(value, F.lit(""))


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML document, ``part`` giving their order: header, keys, nodes, edges, end. Every attribute is text."""
    spark = nodes.sparkSession
    attrs = {"node": [c for c in nodes.columns if c != "id"], "edge": [c for c in edges.columns if c not in ("src", "dst", "key")]}
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{k}_{c}" for="{k}" attr.name="{c}" attr.type="string"/>' for k, cs in attrs.items() for c in cs]
    data = lambda df, k: F.concat(*[F.concat(F.lit(f'<data key="{k}_{c}">'), _xml(_as_text(df, c)), F.lit("</data>")) for c in attrs[k]]) if attrs[k] else F.lit("")
    q = lambda c: _xml(F.col(c).cast("string"))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), q("id"), F.lit('">'), data(nodes, "node"), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge id="'), q("key"), F.lit('" source="'), q("src"), F.lit('" target="'), q("dst"), F.lit('">'), data(edges, "edge"), F.lit("</edge>")).alias("value"))
    first = spark.createDataFrame([(0, "\n".join([*head, '<graph edgedefault="directed">']))], "part INT, value STRING")
    last = spark.createDataFrame([(3, "</graph></graphml>")], "part INT, value STRING")
    return first.unionByName(n).unionByName(e).unionByName(last)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge rows as JSON lines under ``path``, and GraphML text ordered by part."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    graphml_rows(nodes, edges).orderBy("part", "value").select("value").write.mode("overwrite").text(f"{path}/graphml")


def write_grounding(grounding: DataFrame, path: str) -> None:
    """The grounding index: a JSON object a line, with the clause's id and all it is grounded in."""
    grounding.write.mode("overwrite").json(path)


def write_queue(rows: DataFrame, path: str) -> None:
    """A review queue as JSON lines, and as CSV with a header unless it is empty."""
    rows.write.mode("overwrite").json(f"{path}/json")
    if not rows.isEmpty():
        rows.write.mode("overwrite").csv(f"{path}/csv", header=True, escape='"')


def write_results(results: DataFrame, path: str, run_id: str) -> None:
    """Results of a run, partitioned by evaluation and run; a run that is there already is an error."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("errorifexists").partitionBy("eval_id").parquet(f"{path}/run={run_id}")


def promote_baseline(results: DataFrame, path: str) -> None:
    """Results as the new baseline of their evaluations, stamped; other evaluations keep theirs."""
    stamped = results.withColumn("baseline_created", F.current_timestamp())
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("eval_id").parquet(path)


def manifest(results: DataFrame, path: str, run_id: str) -> None:
    """One JSON row: the run and its evaluations with their status."""
    row = results.agg(F.lit(run_id).alias("run_id"), F.sort_array(F.collect_list(F.struct("eval_id", "status"))).alias("evals"), F.every(F.col("status") == "PASS").alias("passed"))
    row.write.mode("overwrite").json(path)


def report(title: str, sections: dict[str, DataFrame], notes: dict[str, str] | None = None, limit: int = 1000) -> str:
    """A Markdown report: a title, then each section's note and table, in order."""
    body = []
    for name, rows in sections.items():
        heading, rest = markdown(rows, name, limit).split("\n", 1)
        note = (notes or {}).get(name)
        body.append(f"{heading}\n\n{note}\n{rest}" if note else f"{heading}\n{rest}")
    return "\n".join([f"# {title}", "", *body])


def markdown(table: DataFrame, title: str, limit: int = 1000) -> str:
    """A small result as a Markdown table; more than ``limit`` rows are an error, as a report is for people."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows in a report")
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join([*lines, *["| " + " | ".join(map(cell, r)) + " |" for r in rows], ""])
