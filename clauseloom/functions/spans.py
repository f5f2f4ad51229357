"""References, dimensions and dependencies: extraction that needs the place of each match.

Spark's expressions give a match's text but not its offsets, so these are
vectorised functions over Arrow batches. Passes run in a fixed order; a match
that lies within an earlier one is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

REF = T.StructType([T.StructField(n, T.StringType()) for n in ("raw", "ref_type", "normalized", "context")])
DIMENSION = T.StructType(
    [T.StructField(n, T.StringType() if n in ("unit", "constraint", "span") else T.DoubleType()) for n in ("value", "unit", "constraint", "value_min", "value_max", "span")]
)
DEPENDENCY = T.StructType([*[T.StructField(n, T.StringType()) for n in ("dep_type", "marker", "text")], T.StructField("refs", T.ArrayType(REF)), T.StructField("text_refs", T.ArrayType(REF))])

# The numbering, labels, phrases and standards that references are made of.
NUMBER = r"[1-9]\d*\.\d+(?:\.\d+(?:\.\d+)?)?(?:\.\([0-9]+\))?[A-Z]?"
NOT_A_QUANTITY = r"(?!\s*(?:mm|cm|m\b|m2|m²|%|min|h\b|°|deg|storey))"
LABELS = r"Section|Article|Clause|Subsection|Sentence|Part|Appendix|Table|Figure|Div(?:ision)?|Paragraph|Sub-?clause"
PHRASES = (
    r"in\s+accordance\s+with|as\s+required\s+by|referred\s+to\s+in|as\s+provided\s+in|conforming\s+to|as\s+specified\s+in|pursuant\s+to|subject\s+to|"
    r"notwithstanding|in\s+conformance\s+with|as\s+described\s+in|as\s+permitted\s+by|as\s+allowed\s+by|under|per|see"
)
STANDARD_CLAUSE = r"((?:EN|BS|AS|NZS)\s+[\w.\-]+)\s+(?:clause|cl\.?|section)\s+(\d[\d.]*)"
STANDARDS = r"\b(?:CAN/\w+-\w+|ASTM\s+[A-Z]\d+[\w.-]*|CSA\s+[A-Z]\d+[\w.-]*|ISO\s+\d+[\w.-]*|NFPA\s+\d+|UL\s+\d+|ULC-[A-Z]\d+|ICC\s+\w+|ANSI\s+[\w/.-]+)\b"
STANDARDS_IN_CAPITALS = r"\b((?:EN|BS|AS|NZS|ASCE|ACI|DIN|GB|JIS)\s+\d[\w.\-:]*\b)"
SECTION_SIGN = r"§\s*([A-Z]?\d[\d.]*(?:\([a-z0-9]+\))?)"
SHORTHAND = r"\b(?:cl\.?|para\.?|Reg(?:ulation)?\.?)\s*(\d[\d.]*(?:\([a-z0-9]+\))?)"
NAMED_DOCUMENTS = r"\b(?:Approved\s+Document\s+[A-Z\d]+(?:\s+Part\s+[A-Z\d]+)?|BCA\s+Part\s+[\d.]+|NBC\s+(?:Section\s+)?[\d.]+|NBC\s+(?:Article\s+)?[\d.]+)"
PARTS = r"\bPart\s+([1-9]\d*)\b"
LABEL_TYPES = {
    "table": "table", "figure": "figure", "sentence": "sentence", "part": "article", "appendix": "article", "division": "article", "paragraph": "article",
}

# Units of limits, their common spelling, and the words that state a bound.
QUANTITY = r"\d+(?:[.,]\d+)?"
UNIT = (
    r"(?:mm|millimetres?|millimeters?|cm|m²|m³|m2|m3|sq\.?\s*m|metres?|meters?|m\b|min(?:utes?)?|h(?:rs?|ours?)?|%|per\s?cent|°|deg(?:rees?)?|store?y(?:s|ies)?|floors?)"
)
UNIT_NAMES = {
    "mm": "mm", "millimetre": "mm", "millimeter": "mm", "millimetres": "mm", "millimeters": "mm", "cm": "cm",
    "m²": "m2", "m2": "m2", "sq m": "m2", "sq. m": "m2", "m³": "m3", "m3": "m3", "m": "m", "metre": "m", "meter": "m", "metres": "m", "meters": "m",
    "min": "min", "minute": "min", "minutes": "min", "h": "h", "hr": "h", "hour": "h", "hours": "h", "%": "%", "percent": "%", "per cent": "%",
    "°": "deg", "deg": "deg", "degrees": "deg", "storey": "storeys", "storeys": "storeys", "story": "storeys", "stories": "storeys", "floor": "storeys", "floors": "storeys",
}
LEAST = r"(?:not\s+(?:be\s+)?less\s+than|not\s+(?:be\s+)?fewer\s+than|at\s+least|a\s+minimum\s+(?:of\s+)?|minimum\s+(?:of\s+)?)"
MOST = r"(?:not\s+(?:be\s+)?more\s+than|not\s+(?:be\s+)?greater\s+than|not\s+(?:be\s+)?exceed\s+|a\s+maximum\s+(?:of\s+)?|maximum\s+(?:of\s+)?)"

# Dependency wordings with their type and name, and where a clause ends.
CLAUSE_END = r"(?:,\s+(?=[A-Z(])|\.(?:\s+[A-Z]|\s*$)|$)"
SENTENCE_END = r"(?:\.(?:\s+[A-Z]|\s*$)|$)"
DEPENDENCIES: list[tuple[str, str, str, str]] = [
    (r"notwithstanding\s+(.+?)", CLAUSE_END, "override", "notwithstanding"),
    (r"subject\s+to\s+(.+?)", CLAUSE_END, "subject_to", "subject to"),
    (r"in\s+lieu\s+of\s+(.+?)", CLAUSE_END, "alternative", "in lieu of"),
    (r"in\s+addition\s+to\s+(.+?)", CLAUSE_END, "addition", "in addition to"),
    (r"except\s+(?:where|as\s+(?:permitted|required|provided|allowed)\s+(?:in|by)|that)\s+(.+?)", SENTENCE_END, "exception", "except"),
    (r"unless\s+(.+?)", CLAUSE_END, "exception", "unless"),
    (r"provided\s+that\s+(.+?)", CLAUSE_END, "conditional", "provided that"),
    (r"on\s+condition\s+that\s+(.+?)", CLAUSE_END, "conditional", "on condition that"),
    (r"(?:is|are)\s+deemed\s+to\s+(?:comply|satisfy)\s+(?:with\s+)?(.+?)", CLAUSE_END, "alternative", "deemed to comply"),
]


class Taken:
    """Spans of earlier matches; a later match inside one of them is skipped."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []

    def free(self, pattern: re.Pattern, text: str) -> Iterator[re.Match]:
        for match in pattern.finditer(text):
            if not any(a <= match.start() and match.end() <= b for a, b in self.spans):
                yield match

    def take(self, match: re.Match) -> None:
        self.spans.append(match.span())


def label_type(label: str) -> str:
    """What a label refers to; sections, clauses and unlisted labels are sections."""
    return LABEL_TYPES.get(label.lower(), "section")


def _shorthand_type(match: re.Match) -> str:
    return "article" if match[0].lower().startswith("reg") else "section"


def _needs(text: str) -> Callable[[tuple[str, ...]], bool]:
    """Whether a text holds one of some words that a pattern cannot do without: a cheap test that spares most passes over most texts."""
    low = text.casefold()
    if "ı" in text or "i̇" in low:  # letters that match an i without folding to one
        return lambda words: True
    return lambda words: not words or any(w in low for w in words)


_DOTTED = re.compile(r"[1-9]\d*\.\d")
#: Passes in order: pattern, words one of which it needs, then (raw, type, normalised, context) of a match.
_PASSES: list[tuple[re.Pattern, tuple[str, ...], Callable[[re.Match], tuple[str, str, str, str] | None]]] = [
    (re.compile(rf"({LABELS})\s+({NUMBER}){NOT_A_QUANTITY}", re.I), (".",), lambda m: (m[0], label_type(m[1]), m[2], "")),
    (re.compile(rf"((?:{PHRASES})\s+)({NUMBER}){NOT_A_QUANTITY}", re.I), (".",), lambda m: (m[2], "section", m[2], m[1].strip())),
    (re.compile(STANDARDS, re.I), ("can/", "astm", "csa", "iso", "nfpa", "ul ", "ul\n", "ul\t", "ul\xa0", "ulc-", "icc", "ansi"), lambda m: (m[0], "standard", m[0].upper(), "")),
    (re.compile(STANDARDS_IN_CAPITALS), (), lambda m: (m[0], "standard", m[1].upper(), "")),
    (re.compile(SECTION_SIGN, re.I), ("§",), lambda m: (m[0], "section", m[1], "")),
    (re.compile(SHORTHAND, re.I), (), lambda m: (m[0], _shorthand_type(m), m[1], "")),
    (re.compile(NAMED_DOCUMENTS, re.I), ("approved", "bca", "nbc"), lambda m: (m[0], "article", m[0], "")),
    (re.compile(PARTS, re.I), ("part",), lambda m: (m[0], "article", f"Part {m[1]}", "")),
    (re.compile(rf"\b({NUMBER}){NOT_A_QUANTITY}", re.I), (".",), lambda m: (m[1], "section", m[1], "") if m[1].count(".") > 1 else None),
]
_STANDARD_CLAUSE = re.compile(STANDARD_CLAUSE, re.I)


def find_refs(text: str) -> list[dict]:
    """References of a text, by pass, then by place; one per normalised form."""
    taken, refs, needs = Taken(), {}, _needs(text)
    dotted = bool(_DOTTED.search(text))

    def note(raw: str, kind: str, normal: str, context: str) -> None:
        refs.setdefault(normal, {"raw": raw, "ref_type": kind, "normalized": normal, "context": context})

    for m in _STANDARD_CLAUSE.finditer(text) if needs(("cl", "section")) else ():
        note(m[0], "standard", f"{m[1].upper()} cl.{m[2]}", "")
        taken.take(m)
    for pattern, words, reading in _PASSES:
        if (words == (".",) and not dotted) or not needs(words):
            continue
        for m in taken.free(pattern, text):
            ref = reading(m)
            if ref:
                note(*ref)
                taken.take(m)
    return list(refs.values())


def unit_name(raw: str | None) -> str:
    """The common spelling of a unit; unknown units in lower case, '' for none."""
    text = (raw or "").strip().lower()
    return UNIT_NAMES.get(text.replace(".", ""), text)


def number(raw: str) -> float:
    """A decimal number; a comma is a decimal point."""
    return float(raw.replace(",", "."))


_RANGES = [re.compile(rf"{a}\s+({QUANTITY})\s*({UNIT})?\s+{b}\s+({QUANTITY})\s*({UNIT})", re.I) for a, b in (("between", "and"), ("from", "to"))]
_BOUNDS = [
    (re.compile(rf"{words}({QUANTITY})\s*({UNIT})", re.I), kind, needed)
    for words, kind, needed in ((LEAST + r"\s*", "min", ("not", "least", "minimum")), (MOST + r"\s*", "max", ("not", "maximum")), ("", "exact", ()))
]


def find_dimensions(text: str) -> list[dict]:
    """Dimensions of a text: ranges, then least, most and plain values."""
    taken, dims, needs = Taken(), [], _needs(text)
    for pattern in _RANGES if needs(("between", "from")) else ():
        for m in taken.free(pattern, text):
            dims.append({"value": None, "unit": unit_name(m[2]) or unit_name(m[4]), "constraint": "range", "value_min": number(m[1]), "value_max": number(m[3]), "span": m[0]})
            taken.take(m)
    for pattern, kind, needed in _BOUNDS:
        if not needs(needed):
            continue
        for m in taken.free(pattern, text):
            value = number(m[1])
            low, high = value if kind == "min" else None, value if kind == "max" else None
            dims.append({"value": value, "unit": unit_name(m[2]), "constraint": kind, "value_min": low, "value_max": high, "span": m[0]})
            taken.take(m)
    return dims


#: Each with the first word it cannot do without.
_DEPENDENCIES = [(re.compile(body + end, re.I | re.S), (("deemed",) if "deemed" in name else (name.split()[0],)), kind, name) for body, end, kind, name in DEPENDENCIES]


def find_dependencies(text: str) -> list[dict]:
    """Dependencies of a text, one per span: ``refs`` are the references after the marker, ``text_refs`` those of the whole dependency."""
    spans, deps, needs = set(), [], _needs(text)
    for pattern, words, kind, name in _DEPENDENCIES:
        for m in pattern.finditer(text) if needs(words) else ():
            if m.span() not in spans:
                spans.add(m.span())
                deps.append({"dep_type": kind, "marker": name, "text": m[0].strip(), "refs": find_refs(m[1].strip()), "text_refs": find_refs(m[0].strip())})
    return deps


def _vectorised(kind: T.DataType, find: Callable[[str], object]):
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else find(t) for t in texts.to_pylist()], type=arrow)

    return apply


#: Columns of a text column; null text gives null.
cross_refs = _vectorised(T.ArrayType(REF), find_refs)
dimensions = _vectorised(T.ArrayType(DIMENSION), find_dimensions)
dependencies = _vectorised(T.ArrayType(DEPENDENCY), find_dependencies)
#: All three in one pass over the data.
spans = _vectorised(
    T.StructType([T.StructField("cross_refs", T.ArrayType(REF)), T.StructField("dimensions", T.ArrayType(DIMENSION)), T.StructField("dependencies", T.ArrayType(DEPENDENCY))]),
    lambda t: {"cross_refs": find_refs(t), "dimensions": find_dimensions(t), "dependencies": find_dependencies(t)},
)


def ref_summary(refs):
    """'Table 9.8.4.1, 9.8.2.1': references joined; tables and figures with their label."""
    name = lambda r: F.when(r["ref_type"].isin("table", "figure"), F.concat(F.initcap(r["ref_type"]), F.lit(" "), r["normalized"])).otherwise(r["normalized"])
    return F.array_join(F.transform(refs, name), ", ")


def dimension_summary(dims):
    """'900.0 mm (min), 125.0-200.0 mm (range), 0.35 m2'."""

    def one(d):
        text = lambda c: d[c].cast("string")
        ranged = F.concat(text("value_min"), F.lit("-"), text("value_max"), F.lit(" "), d["unit"], F.lit(" (range)"))
        bound = F.concat(text("value"), F.lit(" "), d["unit"], F.lit(" ("), d["constraint"], F.lit(")"))
        return F.when(d["constraint"] == "range", ranged).when(d["constraint"].isin("min", "max"), bound).otherwise(F.concat(text("value"), F.lit(" "), d["unit"]))

    return F.array_join(F.transform(dims, one), ", ")


def dependency_summary(deps):
    """'override: "..."; "..." | exception: "..."': by type in first-seen order, texts cut at 80 characters."""
    kinds = F.array_distinct(F.transform(deps, lambda d: d["dep_type"]))
    quoted = lambda d: F.concat(F.lit('"'), F.regexp_replace(F.substring(d["text"], 1, 80), r"(?U)\s+$", ""), F.lit('"'))
    one = lambda k: F.concat(k, F.lit(": "), F.array_join(F.transform(F.filter(deps, lambda d: d["dep_type"] == k), quoted), "; "))
    return F.array_join(F.transform(kinds, one), " | ")
