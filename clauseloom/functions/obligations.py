"""Obligations, sentences and their conditions, read from clause text by Catalyst expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions.columns import FLAGS, found, let, or_null, present, strip

# Operators and their strength, in the order they are reported; '…' stands for one word.
OPERATORS: list[tuple[str, str]] = [
    ("SHALL NOT", "prohibited"), ("MUST NOT", "prohibited"), ("IS PROHIBITED", "prohibited"), ("ARE PROHIBITED", "prohibited"),
    ("NO … SHALL", "prohibited"), ("SHALL", "mandatory"), ("MUST", "mandatory"), ("IS REQUIRED TO", "mandatory"),
    ("ARE REQUIRED TO", "mandatory"), ("IS TO BE", "mandatory"), ("ARE TO BE", "mandatory"), ("SHOULD NOT", "recommended"),
    ("SHOULD", "recommended"), ("OUGHT TO", "recommended"), ("IS RECOMMENDED", "recommended"), ("MAY NOT", "prohibited"),
    ("MAY", "permitted"), ("IS PERMITTED TO", "permitted"), ("ARE PERMITTED TO", "permitted"), ("IS PERMITTED", "permitted"),
    ("ARE PERMITTED", "permitted"), ("IS ALLOWED", "permitted"), ("ARE ALLOWED", "permitted"),
]
# What opens a scope, an exception, a qualification, an override; the verbs of a requirement.
SCOPE_OPENERS = [
    r"where\b", r"when\b", r"if\b", r"in\s+(?:the\s+case\s+of|buildings?\s+of|occupancies?\s+of|areas?\s+where)",
    r"for\s+(?:buildings?|occupancies?|purposes?\s+of|the\s+purposes?\s+of)", r"in\s+buildings?\s+(?:of|where|that)", r"where\s+a\s+building",
]
EXCEPTION_MARKERS = [r"except\s+(?:where|as|that|when|if)\b", r"unless\b", r"other\s+than\b", r"provided\s+that\b", r"on\s+condition\s+that\b"]
QUALIFICATION_MARKERS = [r"(?:subject\s+to|in\s+addition\s+to)\b"]
OVERRIDE_OPENERS = [r"notwithstanding", r"subject\s+to"]
REQUIREMENT_VERBS = [r"shall", r"must", r"may", r"is\s+required", r"are\s+required", r"is\s+to\s+be", r"are\s+to\s+be"]

CONDITION = "STRUCT<type: STRING, marker: STRING, text: STRING>"


def _any(options: list[str]) -> str:
    return "(?:" + "|".join(options) + ")"


def _operator_pattern(operator: str) -> str:
    words = [r"\w+" if w == "…" else w.lower() for w in operator.split()]
    return FLAGS + r"\b" + r"\s+".join(words) + r"\b"


def deontics(text: Column, operators: list[tuple[str, str]] = OPERATORS) -> Column:
    """ARRAY<STRUCT<operator, strength, negated, span>>: each match of each operator, by operator, then by place.

    Operators do not consume: "shall not" is both SHALL NOT and SHALL. Null text gives null.
    """

    def of(operator: str, strength: str) -> Column:
        negated = F.lit("NOT" in operator or strength == "prohibited")
        return F.transform(
            F.regexp_extract_all(text, F.lit(_operator_pattern(operator)), 0),
            lambda span: F.struct(F.lit(operator).alias("operator"), F.lit(strength).alias("strength"), negated.alias("negated"), span.alias("span")),
        )

    return F.concat(*[of(*o) for o in operators])


def deontic_summary(text: Column) -> Column:
    """'SHALL x2 (mandatory), MAY x1 (permitted)', '' without operators."""
    parts = []
    for operator, strength in OPERATORS:
        times = F.regexp_count(text, F.lit(_operator_pattern(operator)))
        parts.append(F.when(times > 0, F.concat(F.lit(f"{operator} x"), times.cast("string"), F.lit(f" ({strength})"))))
    return F.concat_ws(", ", *parts)


def sentences(text: Column) -> Column:
    """ARRAY<STRING>: text cut after a full stop before white space and a capital letter; blank parts are dropped."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=\.)\s+(?=[A-Z])"), strip), lambda s: s != "")


def _without_stops(text: Column) -> Column:
    return F.regexp_replace(text, r"\.+$", "")


def _marker(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), r"^,+", ""))


def _condition(kind: str, marker: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), marker.alias("marker"), text.alias("text"))


def _split_at(markers: list[str]) -> str:
    return rf"(?iUs)^(.*?)(,?\s*{_any(markers)})(.*)$"


def _only(condition: Column, value: Column) -> Column:
    return F.when(condition, F.array(value)).otherwise(F.array())


def parse_sentence(sentence: Column) -> Column:
    """STRUCT<conditions, requirements, exceptions> of one sentence.

    An overriding opener is skipped up to its comma. A scope opener counts if
    a comma follows and after it a verb of requirement. The rest is split at
    its first exception marker, else at its first qualification marker, else it
    is a requirement as a whole.
    """
    override = rf"(?iUs)^{_any(OVERRIDE_OPENERS)}\s+[^,]*,(.*)$"
    scope = rf"(?iUs)^({_any(SCOPE_OPENERS)})([^,]*),(.*)$"
    verb = FLAGS + rf"\b{_any(REQUIREMENT_VERBS)}\b"
    nothing = F.array().cast(f"ARRAY<{CONDITION}>")

    def rest_of(s: Column) -> Column:
        scoped = s.rlike(scope) & found(s, scope, 3).rlike(verb)
        opened = F.struct(
            F.when(scoped, F.array(_condition("applicability", strip(found(s, scope, 1)), strip(found(s, scope, 2))))).otherwise(nothing).alias("conditions"),
            F.when(scoped, strip(found(s, scope, 3))).otherwise(s).alias("rest"),
        )
        return let(opened, split)

    def split(o: Column) -> Column:
        rest = o["rest"]
        at_exception, at_qualification = _split_at(EXCEPTION_MARKERS), _split_at(QUALIFICATION_MARKERS)
        head, tail, marker = (lambda p: strip(found(rest, p, 1))), (lambda p: _without_stops(strip(found(rest, p, 3)))), (lambda p: _marker(found(rest, p, 2)))
        is_exception = rest.rlike(at_exception)
        is_qualified = ~is_exception & rest.rlike(at_qualification)
        requirement = F.when(is_exception, or_null(head(at_exception))).when(is_qualified, or_null(head(at_qualification))).when(rest != "", _without_stops(rest))
        qualified = F.when(is_qualified & (tail(at_qualification) != ""), F.array(_condition("qualification", marker(at_qualification), tail(at_qualification)))).otherwise(nothing)
        excepted = F.when(is_exception & (tail(at_exception) != ""), F.array(_condition("exception", marker(at_exception), tail(at_exception)))).otherwise(nothing)
        return F.struct(F.concat(o["conditions"], qualified).alias("conditions"), present(F.array(requirement)).alias("requirements"), excepted.alias("exceptions"))

    skipped = F.when(sentence.rlike(override), strip(found(sentence, override, 1))).otherwise(sentence)
    return let(skipped, rest_of)


def parse_conditions(text: Column) -> Column:
    """STRUCT<conditions, requirements, exceptions> over all sentences of a text, in order."""
    parsed = F.transform(sentences(text), parse_sentence)
    return let(parsed, lambda p: F.struct(*[F.flatten(p[k]).alias(k) for k in ("conditions", "requirements", "exceptions")]))


def condition_summaries(parsed: Column) -> Column:
    """STRUCT<conditions, exceptions>: the clauses in quotes, cut at 100 characters."""

    def quoted(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda c: F.concat(F.lit('"'), F.substring(c["text"], 1, 100), F.lit('"'))), ", ")

    return F.struct(quoted(parsed["conditions"]).alias("conditions"), quoted(parsed["exceptions"]).alias("exceptions"))
