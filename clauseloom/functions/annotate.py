"""Annotation of paragraphs: element hints, subject, the whole record, and the chunk preambles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions import obligations, spans
from clauseloom.functions.columns import FLAGS, first_by, found, or_null, present, strip

# What elements are called in clause text, by class, in the order in which they are looked for.
SURFACES: list[tuple[str, tuple[str, ...]]] = [
    ("IfcStairFlight", ("stair", "step", "flight", "riser", "tread", "nosing", "winder")),
    ("IfcDoor", ("door", "exit", "egress", "doorway")),
    ("IfcWindow", ("window", "skylight")),
    ("IfcCurtainWall", ("curtain wall", "curtain-wall", "glazing system", "storefront", "glazing")),
    ("IfcRamp", ("ramp", "slope")),
    ("IfcRailing", ("guard", "handrail", "railing", "balustrade")),
    ("IfcWall", ("wall", "partition", "firewall", "separation")),
    ("IfcCovering", ("suspended ceiling", "drop ceiling", "ceiling", "soffit")),
    ("IfcRoof", ("roof", "roofing")),
    ("IfcSlab", ("slab", "landing", "floor", "platform")),
    ("IfcSpace", ("space", "room", "corridor")),
    ("IfcZone", ("zone",)),
    ("IfcSanitaryTerminal", ("water closet", "floor drain", "wash basin", "hand basin", "toilet", "lavatory", "urinal", "bathtub", "shower", "basin", "sink", "plumbing fixture", "sanitary")),
    ("IfcAlarm", ("smoke detector", "fire alarm", "smoke alarm", "heat detector", "carbon monoxide", "co detector", "alarm")),
    ("IfcSensor", ("detector", "sensor")),
    ("IfcColumn", ("column",)),
    ("IfcFooting", ("footing", "foundation")),
    ("IfcBeam", ("beam",)),
    ("IfcMember", ("truss", "joist", "rafter", "lintel", "member")),
    ("IfcFurnishingElement", ("furniture", "workstation", "casework", "cabinet")),
    ("IfcFlowTerminal", ("sprinkler", "diffuser")),
    ("IfcPipeSegment", ("pipe",)),
    ("IfcDuctSegment", ("duct",)),
]


def dictionary(surfaces: list[tuple[str, tuple[str, ...]]] = SURFACES) -> list[tuple[str, str]]:
    """(surface, class) pairs in order; any such list can be given to the functions below."""
    return [(surface, c) for c, names in surfaces for surface in names]


def element_hints(text: Column, pairs: list[tuple[str, str]] | None = None) -> Column:
    """ARRAY<STRUCT<surface, ifc_class>>: the first surface of each class found in a text, in dictionary order.

    A surface is found as a whole word, with or without a plural s. Patterns
    are literals, so each is compiled once.
    """
    lower = F.lower(text)
    hits = [
        F.when(lower.rlike(rf"(?U)\b{re.escape(s)}s?\b"), F.struct(F.lit(s).alias("surface"), F.lit(c).alias("ifc_class"))) for s, c in pairs or dictionary()
    ]
    return F.when(text.isNotNull(), first_by(present(F.array(*hits)), "ifc_class"))


def subject(text: Column, hints: Column) -> Column:
    """What stands before the verb at a text's start (3 to 60 characters without comma or stop), else the first hint's surface."""
    leading = strip(found(text, FLAGS + r"^([^,.]{3,60}?)\s+(?:shall|must|may|is\s+required)\b", 1))
    return F.coalesce(or_null(leading), F.get(hints, F.lit(0))["surface"])


def paragraph(text: Column, found_spans: Column, parsed: Column, hints: Column, keep_exceptions_apart: bool = False) -> Column:
    """The annotation of a paragraph as one struct.

    Exceptions are a list of their own, or follow the conditions; in the
    latter form the references of a dependency are those of its whole text.
    """
    conditions = parsed["conditions"] if keep_exceptions_apart else F.concat(parsed["conditions"], parsed["exceptions"])
    refs = "refs" if keep_exceptions_apart else "text_refs"
    dependencies = F.transform(found_spans["dependencies"], lambda d: F.struct(*[d[n].alias(n) for n in ("dep_type", "marker", "text")], d[refs].alias("refs")))
    fields = [
        obligations.deontics(text).alias("deontics"), conditions.alias("conditions"), parsed["requirements"].alias("requirements"),
        *([parsed["exceptions"].alias("exceptions")] if keep_exceptions_apart else []),
        found_spans["cross_refs"].alias("cross_refs"), found_spans["dimensions"].alias("dimensions"), dependencies.alias("dependencies"),
        hints.alias("ifc_hints"), subject(text, hints).alias("subject"),
    ]
    return F.struct(*fields)


def preamble(text: Column, found_spans: Column, parsed: Column, hints: Column, section: Column) -> Column:
    """The analysis block of a chunk's text, '' if nothing was found."""
    summaries = obligations.condition_summaries(parsed)
    lines = [
        ("Deontic", obligations.deontic_summary(text)), ("Cross-refs", spans.ref_summary(found_spans["cross_refs"])),
        ("Dimensions", spans.dimension_summary(found_spans["dimensions"])), ("Conditions", summaries["conditions"]), ("Exceptions", summaries["exceptions"]),
        ("Dependencies", spans.dependency_summary(found_spans["dependencies"])),
        ("IFC targets", F.array_join(F.array_distinct(F.transform(hints, lambda h: h["ifc_class"])), ", ")),
    ]
    body = F.concat_ws("\n", *[F.when(value != "", F.concat(F.lit(f"  {name}: "), value)) for name, value in lines])
    header = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("[NLP PRE-ANALYSIS - "), section, F.lit("]"))).otherwise(F.lit("[NLP PRE-ANALYSIS]"))
    return F.when(body == "", F.lit("")).otherwise(F.concat(header, F.lit("\n"), body, F.lit("\n[END PRE-ANALYSIS]")))


def collected_preamble(annotations: Column, section: Column) -> Column:
    """The block of a chunk from its paragraphs' annotations: distinct signals in first-seen order; '' unless it has more than two lines."""

    def line(title: str, of, separator: str = ", ") -> Column:
        values = F.array_distinct(F.flatten(F.transform(annotations, of)))
        return F.when(F.size(values) > 0, F.concat(F.lit(title + ": "), F.array_join(values, separator)))

    lines = [
        F.lit("[NLP PRE-ANALYSIS]"),
        F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Section context: "), section)),
        line("Deontic signals", lambda a: F.transform(a["deontics"], lambda d: F.concat(d["operator"], F.lit(" ("), d["strength"], F.lit(")")))),
        line("Numeric constraints", lambda a: F.transform(a["dimensions"], lambda d: d["span"])),
        line("Cross-references", lambda a: F.transform(a["cross_refs"], lambda r: r["normalized"])),
        line("Exceptions/Overrides", lambda a: F.transform(a["dependencies"], lambda d: F.concat(F.upper(d["marker"]), F.lit(": "), F.substring(d["text"], 1, 60))), " | "),
        line("IFC Entity hints", lambda a: F.transform(a["ifc_hints"], lambda h: F.concat(h["surface"], F.lit(" -> "), h["ifc_class"]))),
    ]
    kept = present(F.array(*lines))
    return F.when(F.size(kept) > 2, F.array_join(kept, "\n")).otherwise(F.lit(""))
