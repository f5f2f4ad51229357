"""Annotation of clause text: known values, and the quirks that are kept on purpose."""

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import annotate, obligations, rules, spans, terms
from conftest import rows


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t STRING").select(column(F.col("t")).alias("x")).first()["x"]


def test_operators_do_not_consume(spark):
    got = [(d["operator"], d["negated"]) for d in one(spark, "No door shall open. It shall not lock and is permitted to swing.", obligations.deontics)]
    assert got == [("SHALL NOT", True), ("NO … SHALL", True), ("SHALL", False), ("SHALL", False), ("IS PERMITTED TO", False), ("IS PERMITTED", False)]
    assert one(spark, None, obligations.deontics) is None and one(spark, "", obligations.deontics) == []
    assert one(spark, "It shall, it SHALL, it may.", obligations.deontic_summary) == "SHALL x2 (mandatory), MAY x1 (permitted)"


def test_conditions(spark):
    p = one(spark, "Where a building exceeds 3 storeys, stairs shall be 1100 mm wide. Guards shall not be less than 900 mm, except where the guard is on a stairway.", obligations.parse_conditions)
    assert [tuple(c) for c in p["conditions"]] == [("applicability", "Where", "a building exceeds 3 storeys")]
    assert [tuple(c) for c in p["exceptions"]] == [("exception", "except where", "the guard is on a stairway")]
    assert p["requirements"] == ["stairs shall be 1100 mm wide.".rstrip("."), "Guards shall not be less than 900 mm"]
    empty = one(spark, "", obligations.parse_conditions)
    assert empty["conditions"] == [] and empty["requirements"] == []
    # a scope needs a comma and a verb of requirement after it
    assert one(spark, "Where it rains, people leave.", obligations.parse_conditions)["conditions"] == []


def test_references_and_their_quirks(spark):
    norm = lambda t: [r["normalized"] for r in spans.find_refs(t)]
    assert norm("See Table 9.8.4.1.A and Table 9.8.4.1.") == ["9.8.4.1"]
    assert norm("Section 9.85 mm") == ["9.8"]
    assert norm("to EN 1992-1-1 clause 6.4.3 and ASTM C62") == ["EN 1992-1-1 cl.6.4.3", "ASTM C62"]
    assert norm("as required here, 9.8 only, but 9.8.1 yes") == ["9.8.1"]
    assert norm("§ 1009.1, cl. 2.3, Reg. 7, Approved Document B, Part 3") == ["1009.1", "2.3", "7", "Approved Document B", "Part 3"]
    assert [spans.label_type(x) for x in ("Table", "Clause", "Sub-clause", "Part", "Division", "Div")] == ["table", "section", "section", "article", "article", "section"]
    assert spans.find_refs("") == []


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("between 125 and 200 mm", [("range", None, "mm", 125.0, 200.0)]), ("not less than 860 mm and not more than 1,100 mm", [("min", 860.0, "mm", 860.0, None), ("max", 1.1, "mm", None, 1.1)]),
        ("2 050 mm", [("exact", 50.0, "mm", None, None)]), ("3 handrails", [("exact", 3.0, "h", None, None)]), ("from 1 m to 2 m", [("range", None, "m", 1.0, 2.0)]), ("no number", []), ("", []),
    ],
)
def test_dimensions(text, expected):
    assert [(d["constraint"], d["value"], d["unit"], d["value_min"], d["value_max"]) for d in spans.find_dimensions(text)] == expected


def test_dependencies():
    d = spans.find_dependencies("Notwithstanding Sentence 9.8.2.1.(1), guards apply unless Article 3.1.2 governs.")
    assert [(x["dep_type"], [r["normalized"] for r in x["refs"]]) for x in d] == [("override", ["9.8.2.1.(1)"]), ("exception", ["3.1.2"])]


def test_hints_and_subject(spark):
    hints = one(spark, "Stairs and handrails near the doors.", annotate.element_hints)
    assert [tuple(h) for h in hints] == [("stair", "IfcStairFlight"), ("door", "IfcDoor"), ("handrail", "IfcRailing")]
    subject = lambda t: annotate.subject(t, annotate.element_hints(t))
    assert one(spark, "Exit doors shall open.", subject) == "Exit doors" and one(spark, "the roof", subject) == "roof" and one(spark, "nothing", subject) is None
    assert one(spark, "my gadget", lambda t: annotate.element_hints(t, [("gadget", "IfcX")]))[0]["ifc_class"] == "IfcX"


def test_numbers_of_limits(spark):
    cases = {
        "not less than 2 050 mm": (2050.0, "mm", None, None), "865 mm to 1 070 mm": (None, "mm", 865.0, 1070.0), "1 in 50": (0.02, "ratio", None, None), "8 mm per person": (8.0, "mm/person", None, None),
        "30-45 degrees": (None, "degrees", 30.0, 45.0), "0.5 kN applied over 300 mm": (0.5, "kN", None, None), "handrails on both sides": (2.0, None, None, None), "a 5 b 7": (7.0, None, None, None), "none": (None, None, None, None),
        "2 050 mm": (2050.0, "mm", None, None),
    }
    for text, expected in cases.items():
        assert tuple(one(spark, text, rules.numeric_value)) == expected, text


def test_reference_forms(spark):
    for raw, expected in {"9.8.2.1(1)": "9.8.2.1.(1)", "Table under 9.8.8.2": "table:9.8.8.2", "Sentence 9.8.2.1.(1)(a)": "9.8.2.1.(1)", "Note to Table 9.8.4.1.": "note:9.8.4.1", "Foo": "foo", "": ""}.items():
        assert one(spark, raw, rules.normalize_ref) == expected


def agree(spark, a, b):
    return spark.createDataFrame([(a, b)], "a STRING, b STRING").select(rules.refs_agree(F.col("a"), F.col("b"))).first()[0]


def test_covering_is_the_same_as_agreeing(spark):
    pairs = [("9.8.2.1.(1)", "9.8.2.1"), ("9.8.2.1.(1)", "9.8"), ("9.8.2.1.(1)", "9"), ("9.8.2.1.(1)", "9.8.2.1.(2)"), ("9.8.2.1", "9.8.2.1.(1)"), ("table:9.8", "9"), ("9.8", "table:9.8"), ("19.8", "9")]
    for a, b in pairs:
        assert agree(spark, a, b) == (b in one(spark, a, rules.covering_refs)), (a, b)


def test_closeness_and_names(spark):
    df = spark.createDataFrame([(3700.0, 3700.4), (100.0, 101.5), (None, 1.0)], "a DOUBLE, b DOUBLE")
    assert [r[0] for r in rows(df.select(rules.close(F.col("a"), F.col("b"))))] == [True, False, False]
    names = spark.createDataFrame([("Width", "ClearWidth"), ("Width", "ClearWidthBetweenHandrails"), ("", ""), ("a", "A ")], "a STRING, b STRING")
    assert [r[0] for r in rows(names.select(rules.same_name(F.col("a"), F.col("b"), rules.SAME_PROPERTIES)))] == [True, False, False, True]


def test_token_sort_similarity():
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _step(row, x, b)
        return row[-1]

    def _step(row, x, b):
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        return new

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert terms.common_length(a, b) == lcs(a, b)
    assert terms.token_sort_similarity("clear width", "width clear") == 1 and terms.token_sort_similarity("abc", "xyz") == 0
    assert terms.token_sort_similarity("Width", "width") == 0.8 and terms.token_sort_similarity("", "") == 0 and terms.token_sort_similarity(None, "a") is None


def test_model_replies(spark):
    from clauseloom.operators.graph import read_replies

    df = spark.createDataFrame([(1, '```json\n{"results": [{"index": 0, "verdict": "correct", "confidence": 0.9}]}\n```'), (2, "sorry"), (3, None), (4, '{"results": [{"verdict": "correct"}]}')], "k INT, reply STRING")
    assert rows(read_replies(df)) == [(1, 0, "correct", 0.9, "")]
