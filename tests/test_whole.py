"""Queries that do the whole job, and what they need from the operators, against brute force."""

import random

from clauseloom.operators import matching
from clauseloom.plans import registry
from clauseloom.plans.graph_queries import _edges
from clauseloom.tables import table
from conftest import rows


def test_recall_match_covers_every_rule(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    got = rows(registry.QUERIES["recall_match_all"](spark, sf_dir))
    assert sorted(g for g, _ in got) == sorted(r[0] for r in part.select("p_partkey").collect())
    between = {r[0] for r in part.where("p_partkey % 4 = 3 AND p_partkey % 10 NOT IN (4, 5, 8)").select("p_partkey").collect()}
    assert between <= {g for g, r in got if r is not None}


def test_recall_match_equals_all_pairs(spark):
    rng = random.Random(5)
    number = lambda: rng.choice([None, 0.5, 1.0, 1.5, 2.0, -0.5, 3.25, 1e300])
    rule = lambda k, ops: (k, rng.choice(["IfcDoor", " ifcdoor", "IfcStair", None]), rng.choice(["Width", "width ", "ClearWidth", "Slope", "", None]), rng.choice(ops), number(), number(), number(), rng.choice([None, None, None, "P"]), rng.choice([None, None, None, "Q"]))
    gold, extracted = [rule(k, ["between", ">=", None]) for k in range(120)], [rule(k, ["=="]) for k in range(100)]
    schema = "{} INT, target STRING, property_name STRING, operator STRING, value DOUBLE, value_min DOUBLE, value_max DOUBLE, value_min_property STRING, value_max_property STRING"
    low = lambda s: (s or "").strip().lower()
    near = lambda a, b: a is None and b is None or a is not None and b is not None and abs(a - b) <= 0.5

    def states(g, e):
        names = {low(g[2]), low(e[2])}
        if low(g[1]) != low(e[1]) or "" in names or not (len(names) == 1 or names <= {"width", "clearwidth"}):
            return False
        if g[7] is not None:
            return e[7] is not None or e[8] is not None
        return near(g[5], e[5]) and near(g[6], e[6]) if g[3] == "between" else near(g[4], e[4])

    first, extra = matching.recall_match(spark.createDataFrame(gold, schema.format("gold_id")), spark.createDataFrame(extracted, schema.format("rule_id")), aliases=["width, clearwidth"])
    assert sorted(rows(first)) == [(g[0], min((e[0] for e in extracted if states(g, e)), default=None)) for g in gold]
    assert sorted(r[0] for r in rows(extra)) == [e[0] for e in extracted if not any(states(g, e) for g in gold)]


def test_every_candidate_edge_is_assembled(spark, sf_dir):
    edges = registry.QUERIES["graph_assemble_all_edges"](spark, sf_dir).cache()
    candidates = edges.where("kind LIKE '%candidate%'")
    assert candidates.count() == _edges(spark, sf_dir).count()
    assert {int(r[0].removeprefix("clause::")) % 4 for r in candidates.select("src").distinct().collect()} == {0, 1, 2, 3}
    assert sorted(r[0] for r in edges.select("key").collect()) == list(range(edges.count()))


def test_sentences_are_ranked_within_the_article(spark):
    index = [(1, "9.8.5.4.(1)", "handrails on both sides of a ramp 865 mm"), (2, "9.8.5.4.(2)", "guards and doors near stairs of houses"), (3, "9.8.5.4.(3)", "only one landing is needed"), (4, "Table under 9.8.5.4.", "rise 2 050 run 0.75"), (5, "9.8.6.1.(1)", "ramp handrails both sides 10.5 mm")]
    drafts = [
        (1, "9.8.5.4-2", "handrails both sides ramp", [865.0]), (2, "9.8.5.4-7", "guards near stairs", [5.5]), (3, "9.8.5.4-3a", "", [1.0]), (4, "9.8.5.4-1", "handrails both sides ramp", [2050.0]),
        (5, "9.8.5.4-2", "guards doors near stairs landing", []), (6, "9.8.7.1-2", "handrails both sides ramp", [865.0]), (7, "9.8.5.4-3", "guards doors near stairs", []), (8, "9.8.6.1-1", "x", [0.5]),
    ]
    df = spark.createDataFrame([(k, "", r, "", d, v) for k, r, d, v in drafts], "draft_id INT, clause_id STRING, rule_id STRING, snippet STRING, description STRING, values ARRAY<DOUBLE>")
    got = matching.resolve_clause(df, spark.createDataFrame(index, "ord INT, ref STRING, text STRING"))
    assert sorted(rows(got)) == [
        (1, "9.8.5.4.(1)", "article"), (2, "9.8.5.4.(2)", "article"), (3, "9.8.5.4.(3)", "rule_id"), (4, "Table under 9.8.5.4.", "article"),
        (5, "9.8.5.4.(2)", "rule_id"), (6, "9.8.7.1.(2)", "rule_id"), (7, "9.8.5.4.(2)", "article"), (8, "9.8.6.1.(1)", "rule_id"),
    ]


def test_drafts_find_their_clause_in_articles(spark, sf_dir):
    got = {k: (ref, step) for k, ref, step in rows(registry.QUERIES["clause_resolution_articles"](spark, sf_dir))}
    for k, (ref, step) in got.items():
        article, own = f"9.{k // 4}.1", f"9.{k // 4}.1.({k % 4 + 1})"
        if k % 5 < 3:
            assert (ref, step) == (own, "rule_id" if k % 5 == 0 else "article"), k
        elif k // 4 * 4 in got:  # the article has its table and note
            assert ref == f"{'Table under' if k % 5 == 3 else 'Note to Table'} {article}.", k
