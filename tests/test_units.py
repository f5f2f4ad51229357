import math

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import units as U
from conftest import rows

CASES = [
    ("12in.", 12, "in"), ("3 ft. 5-3/4 in.", 41.75, "in"), ("1'-10 1/2\"", 22.5, "in"), ("99¼", 99.25, None), ("10 226 SF", 10226, "sf"), ("3.500e+00", 3.5, None), ("1 in 16.0", 0.0625, "ratio"),
    ("one in 8", 0.125, "ratio"), ("1 : 1.25", 0.8, "ratio"), ("~26", 26, None), ("21,9", 21.9, None), ("1,050mm", 1050, "mm"), ("two hours", 2, "hours"), ("forty-five minutes or more", 45, "minutes"),
    ("a ratio of 0.05", 0.05, "ratio"), ("138.2℉", 138.2, "°f"), ("11′ 7 3/4″", 139.75, "in"), ("0.295′", 0.295, "'"), ("min 7.85\xa0m² or more", 7.85, "m2"), ("-5 °C", -5, "°c"), ("6 ft ⅝ in", 72.625, "in"),
    ("TRUE", None, None), ("", None, None), (None, None, None), ("1 in 0", None, "ratio"), ("x" * 20000 + " 3 mm", 3, "mm"),
]


def test_quantities_in_many_notations(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(CASES)], "k INT, t STRING")
    got = {r["k"]: (r["number"], r["unit"]) for r in df.select("k", U.quantity(F.col("t")).alias("q")).select("k", "q.*").collect()}
    for k, (text, number, unit) in enumerate(CASES):
        assert got[k][1] == unit, text
        assert got[k][0] == pytest.approx(number) if number is not None else got[k][0] is None, text


def test_prose_needs_a_unit(spark):
    df = spark.createDataFrame([("The dimension is limited by Article 4.17.6.2.",), ("Sentence 8.17.9.5: stair flight, rate 3024m³/h.",), ("shall be 3.51 ft under Article 4.12.3.9.",)], "t STRING")
    assert rows(df.select(U.quantity(F.col("t"), True)["number"])) == [(None,), (3024.0,), (3.51,)]


def test_conversion(spark):
    df = spark.createDataFrame([(212.0, "°f"), (1.0, "ft2"), (180.0, "deg"), (1.0, "psi"), (1.0, "unknown"), (None, "mm")], "n DOUBLE, u STRING")
    got = {r["u"]: r["v_value"] for r in U.normalise(df, "n", "u", "v").collect()}
    assert got["°f"] == pytest.approx(100) and got["ft2"] == pytest.approx(0.09290304) and got["psi"] == pytest.approx(6894.757, rel=1e-6)
    assert got["unknown"] is None and got["mm"] is None
    assert math.isclose(spark.range(1).select(U.as_ratio(F.lit("angle"), F.lit(45.0))).first()[0], 1.0)


DRAFT = "id BIGINT, dim_id BIGINT, source_document_id BIGINT, original_proposed_rule STRUCT<check_value: STRING, unit: STRING>, source_snippet STRING, draft_value STRING"
DIM = "dim_id BIGINT, source_document_id BIGINT, value DOUBLE, unit STRING, span STRING, constraint_kind STRING"
SRC = "source_document_id BIGINT, declared_length_unit STRING, declared_area_unit STRING, declared_time_unit STRING"


def found(spark, drafts, dims, sources=((1, "mm", "m2", "h"),)):
    tables = [spark.createDataFrame(list(r), s) for r, s in ((drafts, DRAFT), (dims, DIM), (sources, SRC))]
    return sorted(r[0] for r in rows(U.deviating_drafts(*tables)))


def test_deviating_drafts(spark):
    dims = [
        (1, 1, 0.9, "m", "at least 0.9 m", "min"), (2, 1, None, None, "between 1 and 2 m", "range"), (3, 1, 40.0, "deg C", "40 deg C", "max"), (4, 1, 0.25, "ratio", "1 in 4", "max"), (5, 1, None, " ", "900 mm or more", "min"), (5, 1, None, " ", "900 mm or more", "min"),
    ]
    drafts = [
        (1, 1, 1, ("900", "mm"), None, "clash"), (2, 1, 1, ("95", "cm"), None, None), (3, 1, 1, ("901", None), None, None), (4, 1, 1, ("3 ft", "-"), None, None), (5, 2, 1, ("9", "m"), None, None), (6, 3, 1, ("104", "F"), None, None),
        (7, 3, 1, ("42", "C"), None, None), (8, 4, 1, ("25", "%"), None, None), (9, 4, 1, ("0.30", "n/a"), None, None), (10, 1, 1, ("TRUE", "mm"), None, None), (11, 1, 1, None, None, None), (12, None, 1, ("1", "m"), None, None),
        (13, 5, 1, ("1.2", None), "the width shall be 1.2 m.", None), (13, 5, 1, ("1.2", None), "the width shall be 1.2 m.", None), (14, 1, 1, ("900.0", "in"), None, None),
    ]
    assert found(spark, drafts, dims) == [2, 7, 9, 13, 14]
    assert found(spark, [], dims) == [] and found(spark, drafts, []) == []


def test_hot_key_is_split(spark):
    from clauseloom.operators.skew import skewed_join

    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k BIGINT, id BIGINT"))
    right = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = rows(left.join(right, "k").orderBy("id", "k"))
    assert rows(skewed_join(left, right, "k", hot_rows=100, salts=8).select("k", "id", "v").orderBy("id", "k")) == plain
    kept = skewed_join(left, right, "k", "left", hot_rows=100)
    assert kept.count() == left.count()


def test_units_are_listed_once_and_drafts_come_once(spark):
    assert len({u[0] for u in U.UNITS}) == len(U.UNITS)
    drafts = spark.createDataFrame([(1, 1, 1, ("1.75 sq m", None), None, "")] * 3, DRAFT)
    dims = spark.createDataFrame([(1, 1, 1.75, "sqm", "1.75 sqm", "min")] * 2, DIM)
    assert U.compare_drafts(drafts, dims, spark.createDataFrame([(1, "mm", "m2", "h")], SRC)).count() == 1


# units and notations that no test table has
OTHERS = [("5 lbf/in2", 5, "lbf/in2"), ("90 litres per second", 90, "litrespersecond"), ("3 KN/M2", 3, "kn/m2"), ("2 rads", 2, "rads"), ("7 square inches", 7, "squareinches"), ("12 Cubic Metres Per Hour", 12, "cubicmetresperhour"), ("1e3 pascals", 1000, "pascals"), ("4 furlongs", 4, None), ("\x01\x01 6 yd", 6, "yd"), ("1:8 and 3 mm", 0.125, "ratio")]


def test_units_beyond_the_tables(spark):
    df = spark.createDataFrame([(t, float(n), u) for t, n, u in OTHERS], "t STRING, n DOUBLE, u STRING")
    for r in df.select("*", U.quantity(F.col("t")).alias("q")).collect():
        assert r["q"]["number"] == pytest.approx(r["n"]) and r["q"]["unit"] == r["u"], r["t"]


def test_parts_of_hot_keys_grow_with_their_rows(spark):
    from clauseloom.operators.skew import hot_keys

    keys = spark.range(1000).select(F.when(F.col("id") < 600, 1).when(F.col("id") < 700, None).otherwise(F.col("id")).alias("k"))
    assert sorted(rows(hot_keys(keys, "k", hot_rows=50)), key=str) == [(1, 12), (None, 2)]
    assert rows(hot_keys(keys, "k", hot_rows=50, most=2)) == [(1, 2)]
