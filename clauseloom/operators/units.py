"""Quantities in mixed units and notations, brought to one unit per kind.

Everything is Spark SQL: numbers and units are taken out of text with
``regexp_extract``, aliases are normalised by a join with :data:`UNITS`, the
unit field, the text's unit and the source's default are coalesced, then factor
and offset are applied.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.columns import let, or_null
from clauseloom.operators.skew import skewed_join

# Kind, factor to the common unit, offset added after it, accepted spellings.
# Common units: m, m2, Pa, N, s, degrees Celsius, plain ratio, degrees of angle, litres per second.
_UNIT_ROWS: list[tuple[str, float, float, list[str]]] = [
    ("length", 0.001, 0.0, ["mm", "millim", "millimetre", "millimetres", "millimeter", "millimeters"]),
    ("length", 0.01, 0.0, ["cm", "centimetre", "centimetres", "centimeter", "centimeters"]),
    ("length", 1.0, 0.0, ["m", "mtr", "metre", "metres", "meter", "meters"]),
    ("length", 1000.0, 0.0, ["km", "kilometre", "kilometres", "kilometer", "kilometers"]),
    ("length", 0.0254, 0.0, ["in", "inch", "inches", '"']),
    ("length", 0.3048, 0.0, ["ft", "foot", "feet", "'"]),
    ("length", 0.9144, 0.0, ["yd", "yard", "yards"]),
    ("area", 1e-6, 0.0, ["mm2", "sq mm", "square millimetre", "square millimetres", "square millimeter", "square millimeters"]),
    ("area", 1e-4, 0.0, ["cm2", "sq cm", "square centimetre", "square centimetres", "square centimeter", "square centimeters"]),
    ("area", 1.0, 0.0, ["m2", "sq m", "sqm", "square metre", "square metres", "square meter", "square meters"]),
    ("area", 0.09290304, 0.0, ["ft2", "sq ft", "sf", "square foot", "square feet"]),
    ("area", 0.00064516, 0.0, ["in2", "sq in", "square inch", "square inches"]),
    ("pressure", 1.0, 0.0, ["pa", "pascal", "pascals", "n/m2"]),
    ("pressure", 1000.0, 0.0, ["kpa", "kilopascal", "kilopascals", "kn/m2"]),
    ("pressure", 1e6, 0.0, ["mpa", "megapascal", "megapascals", "n/mm2"]),
    ("pressure", 6894.757293168361, 0.0, ["psi", "lbf/in2", "lb/in2", "lb/sq in"]),
    ("pressure", 47.88025898033584, 0.0, ["psf", "lb/ft2", "lb/sq ft", "lbf/ft2"]),
    ("force", 1.0, 0.0, ["n", "newton", "newtons"]),
    ("force", 1000.0, 0.0, ["kn", "kilonewton", "kilonewtons"]),
    ("force", 4.4482216152605, 0.0, ["lbf", "lb", "lbs", "pound force", "pounds force"]),
    ("time", 1.0, 0.0, ["s", "sec", "secs", "second", "seconds"]),
    ("time", 60.0, 0.0, ["min", "mins", "minute", "minutes"]),
    ("time", 3600.0, 0.0, ["h", "hr", "hrs", "hour", "hours"]),
    ("temperature", 1.0, 0.0, ["°c", "c", "celsius", "deg c", "degree celsius", "degrees celsius"]),
    ("temperature", 5.0 / 9.0, -160.0 / 9.0, ["°f", "f", "fahrenheit", "deg f", "degree fahrenheit", "degrees fahrenheit"]),
    ("ratio", 1.0, 0.0, ["ratio"]),
    ("ratio", 0.01, 0.0, ["%", "pct", "percent", "per cent"]),
    ("angle", 1.0, 0.0, ["°", "deg", "degree", "degrees"]),
    ("angle", 180.0 / math.pi, 0.0, ["rad", "rads", "radian", "radians"]),
    ("flow", 1.0, 0.0, ["l/s", "lps", "litre per second", "litres per second", "liters per second"]),
    ("flow", 1.0 / 3.6, 0.0, ["m3/h", "cmh", "cubic metre per hour", "cubic metres per hour", "cubic meters per hour"]),
    ("flow", 0.47194745, 0.0, ["cfm", "ft3/min", "cu ft per min", "cubic feet per minute"]),
]
#: Spelling without spaces and full stops, kind, factor, offset: the table joined with.
UNITS: list[tuple[str, str, float, float]] = list(dict.fromkeys((a.replace(" ", ""), kind, f, o) for kind, f, o, names in _UNIT_ROWS for a in names))

# Number words found in limits.
NUMBER_WORDS: dict[str, int] = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "forty-five": 45, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}
# Fraction characters.
FRACTIONS: dict[str, str] = {
    "¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5",
    "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8",
}

_NUMBER = r"(?:\d{1,3}(?:[ ,]\d{3})+(?!\d)(?:\.\d+)?|\d+(?:[.,]\d+)?(?:e[+-]?\d+)?)"


def _unit_pattern() -> str:
    """All spellings, longest first, with optional full stops and spaces between their words."""
    names = sorted((a for *_, row in _UNIT_ROWS for a in row), key=len, reverse=True)
    alternatives = [r"\.? ?".join(re.escape(w) for w in a.replace("°", "° ").split()) for a in names]
    return r"(?:" + "|".join(alternatives) + r")(?![a-z0-9])"


_UNIT = _unit_pattern()
_WORD = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
_A_TO_B = r"(?<![\d.])(\d+(?:\.\d+)?|one) ?(?:in|:) ?(\d+(?:\.\d+)?)(?![\d/])"
_RATIO_OF = rf"ratio of ({_NUMBER})"
_FEET_INCHES = r"(?<![\d.])(\d+) ?(?:'|ft\.?|feet|foot) ?-? ?(?:(\d+(?:\.\d+)?)(?![\d/]))?[ -]*(?:(\d+)/(\d+))? ?(?:\"|inches|inch|in(?![a-z]))"
_MIXED = r"(?<![\d.])(?:(\d+)[ -]+)?(\d+)/(\d+)"
_PLAIN = rf"(?<![\d.])((?:(?<=^|\s)-)?{_NUMBER})"
_WORDED = rf"(?<![a-z])({_WORD})(?![a-z])"




def _all_in_one(unit_required: bool) -> tuple[str, str]:
    """The notations as one pattern over the whole text, tried in order, and what it is replaced by: its groups, separated.

    Each notation is looked for in all of the text before the next one is tried,
    so the text is walked once for all that follows from it.
    """
    tail = rf" ?({_UNIT})" + ("" if unit_required else "?")
    notations = [_A_TO_B, _RATIO_OF, _FEET_INCHES, _MIXED + tail, _PLAIN + tail, _WORDED + tail]
    return "(?s)^(?:" + "|".join(f".*?{n}" for n in notations) + ").*$", _MARK + _MARK.join(f"${k}" for k in range(1, 16))


_MARK = "\x01"


def clean(text: Column) -> Column:
    """Lower case, plain spaces, quotes and fractions, one spelling of composed unit characters."""
    t = F.lower(F.translate(text, "   \t′″’”²³−^" + _MARK, "    '\"'\"23-"))
    for mark, plain in (("㎜", "mm"), ("℃", "°c"), ("℉", "°f")):
        t = F.replace(t, F.lit(mark), F.lit(plain))
    fractions = t
    for mark, plain in FRACTIONS.items():
        fractions = F.replace(fractions, F.lit(mark), F.lit(" " + plain))
    t = F.when(t.rlike("[" + "".join(FRACTIONS) + "]"), fractions).otherwise(t)
    return F.trim(F.regexp_replace(t, " {2,}", " "))


def unit_key(unit: Column) -> Column:
    """What a unit field may be called in :data:`UNITS`; whether it is there, the join tells."""
    return or_null(F.regexp_replace(clean(unit), r"[ .]", ""))


def to_number(text: Column) -> Column:
    """A cleaned number: a comma before exactly three digits and a space group thousands, another comma is decimal."""
    t = F.regexp_replace(text, r"(?<=\d)[ ,](?=\d{3}(?!\d))", "")
    return F.replace(t, F.lit(","), F.lit(".")).try_cast("double")


def quantity(text: Column, unit_required: bool = False) -> Column:
    """STRUCT<number DOUBLE, unit STRING> of the first quantity stated in a text.

    ``unit`` is a key of :data:`UNITS` or null. Understood are slopes (``1 in
    12``, ``1:12``, ``a ratio of 0.08``), feet and inches, mixed and plain
    fractions, grouped and decimal numbers, exponents and number words. With
    ``unit_required`` a number counts only where a unit follows it, as in prose
    full of article numbers. Null, empty or numberless text gives nulls.
    """
    pattern, groups = _all_in_one(unit_required)
    return let(clean(text), lambda t: let(F.split(F.regexp_replace(t, pattern, groups), _MARK), _stated))


def _stated(group: Column) -> Column:
    """The quantity of the groups of :func:`_all_in_one`; the first entry is '' if there was a match, else the text."""
    made = lambda number, unit: F.struct(number.alias("number"), unit.alias("unit"))
    at = lambda k: F.get(group, F.lit(k))
    num = lambda k: at(k).try_cast("double")
    key = lambda k: or_null(F.regexp_replace(at(k), r"[ .]", ""))
    slope = F.try_divide(F.when(at(1) == "one", F.lit(1.0)).otherwise(num(1)), num(2))
    feet_inches = num(4) * 12 + F.coalesce(num(5), F.lit(0.0)) + F.coalesce(F.try_divide(num(6), num(7)), F.lit(0.0))
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in (kv[0], float(kv[1]))])
    return (
        F.when(group.isNull() | (F.size(group) < 16), made(F.lit(None).cast("double"), F.lit(None).cast("string")))
        .when(at(1) != "", made(slope, F.lit("ratio")))
        .when(at(3) != "", made(to_number(at(3)), F.lit("ratio")))
        .when(at(4) != "", made(feet_inches, F.lit("in")))
        .when(at(9) != "", made(F.coalesce(num(8), F.lit(0.0)) + F.try_divide(num(9), num(10)), key(11)))
        .when(at(12) != "", made(to_number(at(12)), key(13)))
        .otherwise(made(F.try_element_at(words, at(14)), key(15)))
    )


def units_table(spark: SparkSession) -> DataFrame:
    """:data:`UNITS` as rows: a fixed table of some hundred rows, small enough for any executor."""
    return spark.createDataFrame(UNITS, "unit_key STRING, kind STRING, factor DOUBLE, shift DOUBLE")


def normalise(df: DataFrame, number: str, key: str, prefix: str) -> DataFrame:
    """Add ``{prefix}_kind`` and ``{prefix}_value`` in the kind's common unit; null where number or unit is unknown."""
    units = units_table(df.sparkSession).select(
        F.col("unit_key").alias(f"_{prefix}_key"), F.col("kind").alias(f"{prefix}_kind"), F.col("factor").alias("_factor"), F.col("shift").alias("_shift")
    )
    joined = df.join(units, df[key] == units[f"_{prefix}_key"], "left")
    return joined.withColumn(f"{prefix}_value", F.col(number) * F.col("_factor") + F.col("_shift")).drop("_factor", "_shift", f"_{prefix}_key")


def as_ratio(kind: Column, value: Column) -> Column:
    """A slope given as an angle, as the ratio it stands for."""
    return F.when(kind == "angle", F.tan(F.radians(value))).otherwise(value)


def _known(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the unit ``key`` made null where :data:`UNITS` does not have it."""
    units = units_table(df.sparkSession).select(F.col("unit_key").alias("_unit_key"))
    return df.join(units, df[key] == units["_unit_key"], "left").drop(key).withColumnRenamed("_unit_key", key)


def _compared(drafts: DataFrame, dimensions: DataFrame, sources: DataFrame) -> DataFrame:
    """:func:`compare_drafts` with the copies of re-delivered drafts still in it."""
    rule = F.col("original_proposed_rule")
    # quantities are taken out where the rows are read: what is shuffled after it is numbers and keys
    draft_rows = drafts.select(
        F.col("id").alias("draft_id"), "dim_id", "source_document_id", rule["check_value"].alias("_text"),
        quantity(rule["check_value"]).alias("_q"), quantity(F.col("source_snippet"), unit_required=True)["unit"].alias("_near"), unit_key(rule["unit"]).alias("_f"),
    )
    draft_rows = _known(draft_rows, "_f").select(
        "draft_id", "dim_id", "source_document_id", F.col("_q.number").alias("_number"),
        # a slope or feet and inches carry their unit in the notation itself
        F.coalesce(F.when(F.col("_f").isNotNull() & F.col("_text").rlike(r"\d *[:'′]|\bin +\d|\d *(ft|feet|foot)\b.*\d"), F.col("_q.unit")), F.col("_f"), F.col("_q.unit")).alias("_own"), "_near",
    )
    dim_rows = dimensions.select("dim_id", F.col("constraint_kind"), "value", quantity(F.col("span")).alias("_q"), unit_key(F.col("unit")).alias("_f"))
    dim_rows = _known(dim_rows, "_f").select(
        "dim_id", "constraint_kind",
        # without a unit of its own the value is taken together with the unit from the span
        F.when(F.col("_f").isNull() & F.col("_q.unit").isNotNull(), F.col("_q.number")).otherwise(F.coalesce("value", "_q.number")).alias("_dim_number"),
        F.when(F.col("value").isNull(), F.coalesce("_q.unit", "_f")).otherwise(F.coalesce("_f", "_q.unit")).alias("_dim_key"),
    )
    dim_rows = normalise(dim_rows.distinct(), "_dim_number", "_dim_key", "dim").drop("_dim_key")
    pairs = skewed_join(draft_rows, dim_rows, "dim_id", counted=drafts.select("dim_id"), spread_by=["draft_id"])
    declared = sources.select(
        F.col("source_document_id"),
        F.explode(
            F.create_map(
                F.lit("length"), F.col("declared_length_unit"), F.lit("area"), F.col("declared_area_unit"), F.lit("time"), F.col("declared_time_unit")
            )
        ).alias("dim_kind", "_declared"),
    ).dropDuplicates(["source_document_id", "dim_kind"])
    declared = _known(declared.withColumn("_declared", unit_key(F.col("_declared"))), "_declared")
    pairs = pairs.join(declared, ["source_document_id", "dim_kind"], "left")
    pairs = pairs.withColumns(
        {
            # a bare number for a share or slope is the ratio itself
            "_key": F.coalesce("_own", "_near", "_declared", F.when(F.col("dim_kind") == "ratio", "ratio")),
            "draft_unit_from": F.when(F.col("_own").isNotNull(), "field")
            .when(F.col("_near").isNotNull(), "snippet")
            .when(F.col("_declared").isNotNull(), "source")
            .when(F.col("dim_kind") == "ratio", "kind"),
        }
    )
    pairs = normalise(pairs, "_number", "_key", "draft")
    mixed = F.col("draft_kind") != F.col("dim_kind")
    a = F.when(mixed, as_ratio(F.col("draft_kind"), F.col("draft_value"))).otherwise(F.col("draft_value"))
    b = F.when(mixed, as_ratio(F.col("dim_kind"), F.col("dim_value"))).otherwise(F.col("dim_value"))
    slopes = F.col("draft_kind").isin("ratio", "angle") & F.col("dim_kind").isin("ratio", "angle")
    comparable = ~mixed | slopes
    larger = F.greatest(F.abs(a), F.abs(b))
    return pairs.select(
        "draft_id", "dim_id", "draft_value", "draft_kind", "draft_unit_from", "dim_value", "dim_kind", "constraint_kind",
        F.when(comparable, F.when(larger == 0, F.lit(0.0)).otherwise(F.abs(a - b) / larger)).alias("rel_diff"),
    )


def compare_drafts(drafts: DataFrame, dimensions: DataFrame, sources: DataFrame) -> DataFrame:
    """Each draft's limit beside the dimension it was drawn from, both in common units.

    Columns: draft_id, dim_id, draft_value, draft_kind, draft_unit_from (field,
    snippet, source, kind or null), dim_value, dim_kind, constraint_kind and
    rel_diff, the difference as a share of the larger of the two. One row per
    draft whose dimension exists. Null numbers, unknown units and kinds that
    cannot be compared give a null rel_diff. Re-delivered rows are exact copies
    and count once. Slopes stated as an angle are compared as ratios. Ids that
    are null are no ids.
    """
    return _compared(drafts, dimensions, sources).distinct()


def deviating_drafts(drafts: DataFrame, dimensions: DataFrame, sources: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """draft_id of each draft that differs from its dimension by more than ``tolerance``; ranges and drafts without a number are left out."""
    compared = _compared(drafts, dimensions, sources)
    return compared.where((F.col("rel_diff") > tolerance) & (F.col("constraint_kind").isNull() | (F.col("constraint_kind") != "range"))).select("draft_id").distinct()
