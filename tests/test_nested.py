import json

from pyspark.sql import functions as F

from clauseloom.operators import nested as N
from conftest import rows

SCHEMA = "id STRING, _sk STRING, data STRUCT<ref: STRING, Ref: STRING>, anns ARRAY<STRUCT<id: BIGINT, res: ARRAY<STRUCT<id: STRING, v: STRUCT<labels: ARRAY<STRING>>>>>>, grid ARRAY<ARRAY<INT>>"


def tables(spark, data, **kw):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame(data, SCHEMA)
        return {k: (v.columns, rows(v)) for k, v in N.nested_tables(df, F.col("id"), "t", **kw).items()}
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_levels_ordinals_and_clashes(spark):
    data = [("a", "own", ("r", "R"), [(1, [("x", (["L"],)), None]), None, (2, [])], [[1, 2], None]), ("b", None, None, None, [])]
    t = tables(spark, data, carry={"t": {"id": "root"}})
    columns, top = t["t"]
    assert columns[0] == "_sk" and len({c.lower() for c in columns}) == len(columns) and len(top) == 2
    assert [r[:4] for r in t["t.anns"][1]] == [("a/0", "a", 0, "a"), ("a/1", "a", 1, "a"), ("a/2", "a", 2, "a")]
    assert [(r[0], r[1], r[2], r[4]) for r in t["t.anns.res"][1]] == [("a/0/0", "a/0", 0, "x"), ("a/0/1", "a/0", 1, None)]
    assert [r[0] for r in t["t.grid"][1]] == ["a/0", "a/1"]


def test_empty_table(spark):
    assert all(v[1] == [] for v in tables(spark, []).values())


def test_json_of_many_shapes(spark):
    inner = [{"id": 1, "k": "a"}, {"k": "g", "cases": [{"id": "x"}, {"id": None, "k": "own"}]}, {"k": "e", "cases": None}]
    texts = [
        json.dumps({"details": inner}), json.dumps(json.dumps({"details": json.dumps(inner)})), json.dumps({"details": {"id": "solo", "k": "s"}}), json.dumps({"details": None}), json.dumps({}), "not json", "", None,
        json.dumps({"details": [{"id": "long", "k": "z" * 50000}]}),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "n INT, details STRING")
    parsed = N.ungroup(N.parse_merged(df, "details", ["details"], "recs").drop("details"), "recs", "cases", ["k"])
    got = rows(N.nested_tables(parsed, F.col("n"), "r", carry={"r": {"n": "n"}})["r.recs"].select("n", "_ordinal", F.col("id").cast("string"), F.substring("k", 1, 3)).orderBy("n", "_ordinal"))
    three = [(0, "1", "a"), (1, "x", "g"), (2, None, "own")]
    assert got == [(0, *r) for r in three] + [(1, *r) for r in three] + [(2, 0, "solo", "s"), (8, 0, "long", "zzz")]


def test_no_records_at_all(spark):
    df = spark.createDataFrame([(1, "{}"), (2, None)], "n INT, details STRING")
    assert N.nested_tables(N.parse_merged(df, "details", ["details"], "recs"), F.col("n"))["root.recs"].count() == 0


def test_annotations_without_ids_repeat_no_rows(spark):
    from clauseloom.plans.nested_queries import TASK_COLUMNS, nested_children

    res = lambda *ids: [(i,) for i in ids]
    data = [
        ("t", ("s",), [(None, res("x", None, "y")), (None, res("x", "", "z", "w")), (7, res("x")), (None, None), None]),
        ("t", ("s",), [(None, res("x", None, "y")), (None, res("x", "", "z", "w")), (7, res("x")), (None, None), None]), ("u", None, []), ("v", None, None), (None, None, [(1, [None])]),
    ]
    runs = spark.createDataFrame([], "run_id STRING, eval_id STRING, details STRING")
    got = rows(nested_children(spark.createDataFrame(data, TASK_COLUMNS), runs).select("root_id", "parent_id", "child_pos", "child_id"))
    assert sorted(got) == sorted([("t", "", 0, "x"), ("t", "", 1, ""), ("t", "", 2, "y"), ("t", "", 2, "z"), ("t", "", 3, "w"), ("t", "7", 0, "x"), ("", "1", 0, "")])
