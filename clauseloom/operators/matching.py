"""Extracted rules against reference rules: matching, confusion, field differences, spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseloom.functions import rules as R
from clauseloom.functions.columns import strip
from clauseloom.functions.terms import tokenize
from clauseloom.tables import cut

RULE = (
    "ref STRING, target STRING, property_name STRING, operator STRING, value DOUBLE, value_min DOUBLE, value_max DOUBLE, value_min_property STRING, "
    "value_min_offset DOUBLE, value_max_property STRING, value_max_offset DOUBLE, unit STRING"
)
MODES = ("lenient", "normalized", "strict")
# Fields of a rule body in their order; numbers among them; words too common to tell clauses apart.
STRUCTURAL = [
    "target_ifc_class", "property_set", "property_name", "operator", "check_value", "value_min", "value_max", "value_min_offset", "value_max_offset", "value_min_property",
    "value_max_property", "compare_property", "name_pattern", "uniqueness_scope", "unit", "severity", "category", "rule_category", "mechanism", "applies_when",
]
NUMERIC = ("check_value", "value_min", "value_max", "value_min_offset", "value_max_offset")
COMMON_WORDS = ("the", "a", "an", "of", "and", "or", "to", "in", "for", "be", "shall", "not", "than", "with", "at", "on")


def prepared(rules: DataFrame, id_: str) -> DataFrame:
    """id, ord-able fields and comparable forms of rules: normalised ref and operator, values in base units."""
    r = F.struct(*[F.col(c.split(" ")[0]) for c in RULE.split(", ")])
    return rules.withColumn("_r", r).select(
        F.col(id_), R.normalize_ref(F.col("ref")).alias("nref"), R.normalize_op(F.col("operator")).alias("nop"), R.rule_values(F.col("_r")).alias("v"),
        F.lower(strip(F.coalesce("target", F.lit("")))).alias("tgt"), F.lower(strip(F.coalesce("property_name", F.lit("")))).alias("prop"), R.is_dimensional(F.col("_r")).alias("dimensional"),
    )


#: Questions a form may have; each pair of annotators is compared on all of them.
MOST_QUESTIONS = 1000


def alias_groups(aliases: list | None) -> list[tuple[str, ...]]:
    """Groups of names that mean the same; a caller may write a group as text with commas."""
    return [tuple(n.strip() for n in g.split(",")) if isinstance(g, str) else tuple(g) for g in aliases or []]


def candidate_pairs(gold: DataFrame, extracted: DataFrame, gold_id: str = "gold_id", rule_id: str = "rule_id", aliases: list | None = None) -> DataFrame:
    """gold_id, rule_id and per mode whether the two may be matched.

    The covering of references becomes an equi-join on a gold reference and
    its dotted prefixes; operator and values are compared on the joined rows.
    Null operators never match.
    """
    g = prepared(gold, gold_id).select(F.col(gold_id), *[F.col(c).alias(f"g_{c}") for c in ("nref", "nop", "v", "tgt", "prop")])
    g = g.withColumn("_ref", F.explode(R.covering_refs(F.col("g_nref"))))
    e = prepared(extracted, rule_id)
    pairs = g.join(e, (g["_ref"] == e["nref"]) & (g["g_nop"] == e["nop"])).where(R.values_agree(F.col("g_v"), F.col("v")))
    same_prop = R.same_name(F.col("g_prop"), F.col("prop"), alias_groups(aliases))
    strict = (F.col("g_tgt") == F.col("tgt")) & same_prop
    normal = R.same_name(F.col("g_tgt"), F.col("tgt"), R.SAME_TARGETS) & (same_prop | R.same_name(F.col("g_prop"), F.col("prop"), R.SAME_PROPERTIES))
    return pairs.select(gold_id, rule_id, F.col("nref").alias("ref"), F.lit(True).alias("lenient"), F.coalesce(normal, F.lit(False)).alias("normalized"), F.coalesce(strict, F.lit(False)).alias("strict"))


def with_area(pairs: DataFrame) -> DataFrame:
    """Pairs with ``area`` in place of ``ref``: the shortest of all extracted references that covers the pair's.

    A reference rule meets only extracted references that cover it, and of two
    of those the shorter covers the longer; so what shares a rule shares its
    area, and no chain of pairs leaves it. A code whose rules all begin with
    "9." has as many areas as it has articles, unless a rule names all of "9".
    """
    refs = pairs.select("ref").distinct()
    covers = refs.select("ref", F.explode(R.covering_refs(F.col("ref"))).alias("_by")).join(refs.select(F.col("ref").alias("_by")), "_by")
    areas = covers.groupBy("ref").agg(F.min_by("_by", F.length("_by")).alias("area"))
    return pairs.join(areas, "ref").drop("ref")


def greedy(pairs: DataFrame, left: str, right: str, part: list[str]) -> DataFrame:
    """One-to-one assignment in input order within parts that pairs cannot cross: each left, in order, takes its first free right.

    ``pairs`` has the part columns, left and right (all orderable, not null).
    Inherently sequential within a part, so parts are to be chosen fine. Rows
    of a part stream past in order; only the numbers taken in the part at hand
    are kept in memory.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    columns = [*part, left, right]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, taken_left, taken_right = None, set(), set()
        for rows in batches:
            keep = []
            for place, (*key, a, b) in enumerate(rows[columns].itertuples(index=False, name=None)):
                if key != current:
                    current, taken_left, taken_right = key, set(), set()
                if a not in taken_left and b not in taken_right:
                    taken_left.add(a)
                    taken_right.add(b)
                    keep.append(place)
            yield rows.iloc[keep]

    return pairs.select(*columns).repartition(*part).sortWithinPartitions(*columns).mapInPandas(assign, ", ".join(f"{c} {kinds[c]}" for c in columns))


def match_rules(gold: DataFrame, extracted: DataFrame, gold_id: str = "gold_id", rule_id: str = "rule_id", aliases: list | None = None) -> dict[str, DataFrame]:
    """Tables pairs, missed, false_positives and redundant, each with ``mode``; only dimensional extracted rules take part.

    An unmatched rule that restates a matched reference rule is redundant, not
    wrong. Candidate pairs and assignment are computed once for all modes and
    tables and kept in a checkpoint.
    """
    rules = extracted.join(prepared(extracted, rule_id).where("dimensional").select(rule_id), rule_id, "left_semi")
    candidates = cut(candidate_pairs(gold, rules, gold_id, rule_id, aliases))  # read for the pairs and for the redundant rules
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("ok")) for m in MODES])
    long = with_area(candidates).select(gold_id, rule_id, "area", F.explode(modes).alias("_m")).where("_m.ok").select(F.col("_m.mode").alias("mode"), "area", gold_id, rule_id)
    pairs = cut(greedy(long, gold_id, rule_id, ["mode", "area"]).drop("area"))  # all four tables are told from them
    all_modes = F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode")
    missed = gold.select(gold_id, all_modes).join(pairs, ["mode", gold_id], "left_anti")
    unused = rules.select(rule_id, all_modes).join(pairs, ["mode", rule_id], "left_anti")
    restating = candidates.select(gold_id, rule_id).join(pairs.select("mode", gold_id), gold_id).select("mode", rule_id).distinct()
    return {
        "pairs": pairs, "missed": missed, "redundant": unused.join(restating, ["mode", rule_id], "left_semi"), "false_positives": unused.join(restating, ["mode", rule_id], "left_anti"),
    }


def match_scores(tables: dict[str, DataFrame]) -> DataFrame:
    """mode, tp, fn, fp, redundant, precision, recall, f1."""
    from clauseloom.functions.stats import ratio

    counted = None
    for name, column in (("pairs", "tp"), ("missed", "fn"), ("false_positives", "fp"), ("redundant", "redundant")):
        part = tables[name].select("mode", F.lit(column).alias("_what"))
        counted = part if counted is None else counted.unionByName(part)
    rows = counted.groupBy("mode").pivot("_what", ["tp", "fn", "fp", "redundant"]).count().na.fill(0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.select("mode", "tp", "fn", "fp", "redundant", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def operator_confusion(gold: DataFrame, extracted: DataFrame, gold_id: str = "gold_id", rule_id: str = "rule_id") -> DataFrame:
    """gold_op and a count per extracted operator, over each gold rule and the first extracted rule that covers it with a close last value."""
    ops = [">=", "<=", "==", "between"]
    g = prepared(gold, gold_id).select(gold_id, F.coalesce("nop", F.lit("?")).alias("gold_op"), "nref", F.when(F.col("v.kind") != "rel", F.col("v.high")).alias("g_last"))
    g = g.withColumn("_ref", F.explode(R.covering_refs(F.col("nref")))).drop("nref")
    e = prepared(extracted, rule_id).select(rule_id, F.coalesce("nop", F.lit("?")).alias("op"), "nref", F.when(F.col("v.kind") != "rel", F.col("v.high")).alias("last"))
    hits = g.join(e, g["_ref"] == e["nref"]).where(R.close(F.col("g_last"), F.col("last")))
    first = hits.groupBy(gold_id, "gold_op").agg(F.min_by("op", rule_id).alias("op"))
    return first.groupBy("gold_op").pivot("op", [*ops, "?"]).count().na.fill(0)


def clause_confusion(clause_refs: DataFrame, gold: DataFrame, extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ref, truth, predicted of every clause; references of extracted rules that cover no clause)."""
    refs = clause_refs.select(R.normalize_ref(F.col("ref")).alias("ref")).distinct()
    truth = gold.select(R.normalize_ref(F.col("ref")).alias("ref")).distinct().withColumn("_t", F.lit(True))
    said = extracted.select(R.normalize_ref(F.col("ref")).alias("_e")).distinct()
    covered = refs.withColumn("_e", F.explode(R.covering_refs(F.col("ref")))).join(said, "_e")
    predicted = covered.select("ref").distinct().withColumn("_p", F.lit(True))
    rows = refs.join(truth, "ref", "left").join(predicted, "ref", "left")
    rows = rows.select("ref", F.col("_t").isNotNull().alias("truth"), F.col("_p").isNotNull().alias("predicted"))
    return rows, said.join(covered.select("_e").distinct(), "_e", "left_anti").withColumnRenamed("_e", "ref")


def _stated(rows: DataFrame, id_: str, kinds: list[tuple[str, Column, list[Column]]]) -> DataFrame:
    """id and ``_s`` (target, property, kind, numbers) of every way in which rows state something; nameless properties state nothing."""
    text = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))

    def made(kind: str, numbers: list[Column]) -> Column:
        two = [*numbers, F.lit(None), F.lit(None)][:2]
        pairs = [(c.isNull().alias(f"n{k}"), F.coalesce(c.try_cast("double"), F.lit(float("nan"))).alias(f"x{k}")) for k, c in enumerate(two)]
        return F.struct(text(F.col("target")).alias("t"), text(F.col("property_name")).alias("p"), F.lit(kind).alias("kind"), *[c for pair in pairs for c in pair])

    ways = F.filter(F.array(*[F.when(holds, made(kind, numbers)) for kind, holds, numbers in kinds]), lambda w: w.isNotNull())
    return rows.select(F.col(id_), F.explode(ways).alias("_s")).where("_s.p <> ''")


def _name_keys(name: Column, aliases: list[tuple[str, ...]]) -> Column:
    """The keys two names share if :func:`R.same_name` holds of them: the name, and the groups that list it."""
    groups = [F.when(name.isin(*g), F.lit(f"#{k}")) for k, g in enumerate(aliases)]
    return F.filter(F.array(F.concat(F.lit("="), name), *groups), lambda k: k.isNotNull())


def recall_match(gold: DataFrame, extracted: DataFrame, gold_id: str = "gold_id", rule_id: str = "rule_id", aliases: list | None = None, tolerance: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(gold_id, first rule_id that states it or null; rule_id of rules that state no gold rule). Many gold rules may share a rule.

    Rules that state the same are compared once, and only with those of their
    target and property whose numbers fall into the same or the next bucket of
    twice the tolerance; so the join does not grow with the square of a group.
    """
    aliases = alias_groups(aliases)
    always = F.lit(True)
    relative, between = F.col("value_min_property").isNotNull(), F.coalesce(F.col("operator") == "between", F.lit(False))
    g = _stated(gold, gold_id, [("relative", relative, []), ("range", ~relative & between, [F.col("value_min"), F.col("value_max")]), ("value", ~relative & ~between, [F.col("value")])])
    bound = relative | F.col("value_max_property").isNotNull()
    e = _stated(extracted, rule_id, [("relative", bound, []), ("range", always, [F.col("value_min"), F.col("value_max")]), ("value", always, [F.col("value")])])

    width, far = 2 * tolerance or 1.0, float(1 << 50)
    bucket = lambda s, k: F.when(s[f"n{k}"], F.lit(None).cast("bigint")).otherwise(F.floor(F.least(F.greatest(s[f"x{k}"] / width, F.lit(-far)), F.lit(far))))
    around = lambda b: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: b + d)
    at = lambda b: F.coalesce(b.cast("string"), F.lit(""))

    gs = g.select(F.col("_s").alias("_g")).distinct().withColumns({"_t": F.col("_g.t"), "_kind": F.col("_g.kind"), "_p": F.explode(_name_keys(F.col("_g.p"), aliases))})
    for k in (0, 1):
        b = bucket(F.col("_g"), k)
        gs = gs.withColumn(f"_b{k}", F.explode(F.when(b.isNull(), F.array(F.lit(""))).otherwise(F.transform(around(b), at))))
    es = e.groupBy(F.col("_s").alias("_e")).agg(F.min(rule_id).alias(rule_id))
    es = es.withColumns({"_t": F.col("_e.t"), "_kind": F.col("_e.kind"), "_p": F.explode(_name_keys(F.col("_e.p"), aliases)), **{f"_b{k}": at(bucket(F.col("_e"), k)) for k in (0, 1)}})
    # as R.number_close: two nulls, or numbers within the tolerance
    near = [(F.col(f"_g.n{k}") & F.col(f"_e.n{k}")) | (~F.col(f"_g.n{k}") & ~F.col(f"_e.n{k}") & (F.abs(F.col(f"_g.x{k}") - F.col(f"_e.x{k}")) <= tolerance)) for k in (0, 1)]
    hits = gs.join(es, ["_t", "_kind", "_p", "_b0", "_b1"]).where(near[0] & near[1])
    first = g.join(hits.groupBy(F.col("_g").alias("_s")).agg(F.min(rule_id).alias(rule_id)), "_s").groupBy(gold_id).agg(F.min(rule_id).alias(rule_id))
    stating = e.join(hits.select(F.col("_e").alias("_s")).distinct(), "_s", "left_semi").select(rule_id).distinct()
    return gold.select(gold_id).join(first, gold_id, "left"), extracted.select(rule_id).join(stating, rule_id, "left_anti")


def sheet_match(gold: DataFrame, drafts: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(one row per rule id with found/missed/invented and which fields agree; one row of totals).

    gold: rule_id, target, property, names (array), operator, value, unit,
    applicability; drafts: rule_id, target_ifc_class, property_name, operator,
    check_value, unit, applies_when and ``order``. Of drafts with one id the
    last counts, the others are duplicates.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    fields = ["target_ifc_class", "property_name", "operator", "check_value", "unit", "applies_when"]
    keyed = drafts.withColumn("rule_id", strip(F.coalesce(F.col("rule_id").cast("string"), F.lit(""))))
    last = keyed.groupBy("rule_id").agg(F.max_by(F.struct(*fields), order).alias("_d"), F.count(F.lit(1)).alias("_n"))
    g = gold.select(F.col("rule_id").alias("_id"), *[F.col(c).alias(f"g_{c}") for c in ("target", "property", "names", "operator", "value", "unit", "applicability")])
    joined = g.join(last, g["_id"] == last["rule_id"], "full_outer").withColumns({f"d_{f}": F.col(f"_d.{f}") for f in fields})
    names = F.transform(F.concat(F.array("g_property"), F.coalesce("g_names", F.array().cast("array<string>"))), F.lower)
    checks = {
        "target_right": low("d_target_ifc_class") == low("g_target"), "property_right": F.array_contains(names, low("d_property_name")),
        "operator_right": R.sheet_op(F.col("d_operator")) == R.sheet_op(F.col("g_operator")), "value_right": R.sheet_value(F.col("d_check_value")) == R.sheet_value(F.col("g_value")),
        "unit_right": R.sheet_unit(F.col("d_unit")) == R.sheet_unit(F.col("g_unit")),
    }
    status = F.when(F.col("_id").isNull(), "invented").when(F.col("rule_id").isNull(), "missed").otherwise("found")
    conditional = ~low("g_applicability").isin("", "all modeled windows", "all modeled doors")
    rows = joined.select(
        F.coalesce("_id", F.when(F.col("rule_id") == "", "(no rule id)").otherwise(F.col("rule_id"))).alias("rule_id"), status.alias("status"), F.coalesce(F.col("_n") - 1, F.lit(0)).alias("duplicates"),
        *[F.when(status == "found", c).alias(n) for n, c in checks.items()], F.when(status == "found", conditional).alias("conditional"),
        F.when(status == "found", conditional & (low("d_applies_when") != "")).alias("executable"),
    )
    all_right = F.col("target_right") & F.col("property_right") & F.col("operator_right") & F.col("value_right") & F.col("unit_right")
    totals = rows.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("found", "missed", "invented")], F.sum("duplicates").alias("duplicates"), F.count_if(all_right).alias("all_fields_right"),
        *[F.count_if(n).alias(n) for n in checks], F.count_if("conditional").alias("conditional"), F.count_if("executable").alias("executable"),
    )
    return rows, totals


def field_diffs(drafts: DataFrame, original: str = "original_proposed_rule", corrected: str = "proposed_rule") -> DataFrame:
    """draft_id, field, original, corrected, changed, grounded of each structural field; a null rule body has null fields."""
    a, b = F.col(original), F.col(corrected)
    one = [
        F.struct(
            F.lit(f).alias("field"), a[f].cast("string").alias("original"), b[f].cast("string").alias("corrected"), (~R.field_equal(F.lower(a[f].cast("string")), F.lower(b[f].cast("string")), f in NUMERIC)).alias("changed")
        )
        for f in STRUCTURAL
    ]
    grounded = strip(F.coalesce(a["kg_candidate_used"], F.lit(""))) != ""
    return drafts.select(F.col("id").alias("draft_id"), grounded.alias("grounded"), F.explode(F.array(*one)).alias("_f")).select("draft_id", "grounded", "_f.*")


def field_accuracy(diffs: DataFrame) -> DataFrame:
    """split (all, kg_grounded, blind), drafts, field_correct, field_total, field_accuracy, unchanged_drafts; grouping sets in one pass."""
    from clauseloom.functions.stats import ratio

    per = diffs.groupBy("draft_id", "grounded").agg(F.count_if(~F.col("changed")).alias("right"), F.count(F.lit(1)).alias("all"))
    rows = per.rollup("grounded").agg(F.count(F.lit(1)).alias("drafts"), F.sum("right").alias("field_correct"), F.sum("all").alias("field_total"), F.count_if(F.col("right") == F.col("all")).alias("unchanged_drafts"), F.grouping("grounded").alias("_g"))
    split = F.when(F.col("_g") == 1, "all").when(F.col("grounded"), "kg_grounded").otherwise("blind")
    return rows.select(split.alias("split"), "drafts", "field_correct", "field_total", F.round(ratio(F.col("field_correct"), F.col("field_total")), 4).alias("field_accuracy"), "unchanged_drafts")


def most_changed(diffs: DataFrame, n: int = 10) -> DataFrame:
    """field and number of drafts that changed it, the ``n`` most changed; ties by name."""
    return diffs.where("changed").groupBy("field").agg(F.count(F.lit(1)).alias("drafts")).orderBy(F.desc("drafts"), "field").limit(n)


def span_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Common share of two spans; 0 for empty ones."""
    common = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    union = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(union > 0, common / union).otherwise(0.0)


def span_agreement(spans: DataFrame, iou: float = 0.5, scope: str = "task") -> DataFrame:
    """a, b, label, tp, fp, fn, precision, recall, f1 of each pair of annotators (a < b) with a common task; label null is all.

    ``spans`` has task, annotator, start, end, label and ord, a number unique
    within an annotator. Spans match if labels agree and they overlap enough,
    one to one in order; with ``scope="global"`` also across tasks, otherwise
    within one. Overlap is an equi-join on task and label with the rest as a
    condition.
    """
    from clauseloom.functions.stats import ratio

    who = spans.select("task", "annotator").distinct()
    tasks = who.select("task", F.col("annotator").alias("a")).join(who.select("task", F.col("annotator").alias("b")), "task").where("a < b")
    side = lambda p: spans.select(F.col("annotator").alias(p), F.col("task").alias(f"{p}_task"), "label", F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.col("ord").alias(f"{p}_ord"))
    left, right = side("a"), side("b")
    pairs = left.join(right.withColumnRenamed("label", "_l"), (F.col("label") == F.col("_l")) & (F.col("a") < F.col("b")) & ((F.col("a_task") == F.col("b_task")) if scope == "task" else F.lit(True)))
    near = pairs.where(span_iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")) >= iou)
    part = ["a", "b", "label", "a_task"] if scope == "task" else ["a", "b", "label"]
    matched = greedy(near, "a_ord", "b_ord", part).groupBy("a", "b", "label").agg(F.count(F.lit(1)).alias("tp"))
    counted = tasks.join(spans.select("task", "annotator", "label"), "task").where((F.col("annotator") == F.col("a")) | (F.col("annotator") == F.col("b")))
    totals = counted.groupBy("a", "b", "label").agg(F.count_if(F.col("annotator") == F.col("a")).alias("n_a"), F.count_if(F.col("annotator") == F.col("b")).alias("n_b"))
    rows = totals.join(matched, ["a", "b", "label"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    rows = rows.withColumn("label", F.explode(F.array(F.col("label"), F.lit(None).cast("string")))).groupBy("a", "b", "label").agg(F.sum("tp").alias("tp"), F.sum("n_b").alias("_b"), F.sum("n_a").alias("_a"))
    p, r = ratio(F.col("tp"), F.col("_b")), ratio(F.col("tp"), F.col("_a"))
    return rows.select("a", "b", "label", "tp", (F.col("_b") - F.col("tp")).alias("fp"), (F.col("_a") - F.col("tp")).alias("fn"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def choice_agreement(choices: DataFrame) -> DataFrame:
    """a, b, from_name, n, observed, expected, kappa of each pair of annotators over their common tasks; ``choices`` has task, annotator, from_name, choice.

    A task both annotated where one gave no choice counts as NONE; pairs
    without any choice for a name are left out.
    """
    from clauseloom.functions.stats import cohen_kappa

    who = choices.select("task", "annotator").distinct()
    pairs = who.select("task", F.col("annotator").alias("a")).join(who.select("task", F.col("annotator").alias("b")), "task").where("a < b")
    asked = [r[0] for r in choices.where("choice IS NOT NULL").select("from_name").distinct().limit(MOST_QUESTIONS + 1).collect()]
    if len(asked) > MOST_QUESTIONS:
        raise ValueError(f"more than {MOST_QUESTIONS} questions")
    names = F.array(*[F.lit(n) for n in sorted(asked, key=str)]) if asked else F.array().cast("array<string>")
    given = choices.where("choice IS NOT NULL").groupBy("task", "annotator", "from_name").agg(F.min("choice").alias("choice"))
    side = lambda p: given.select("task", F.col("annotator").alias(p), "from_name", F.col("choice").alias(f"c{p}"))
    rows = pairs.withColumn("from_name", F.explode(names)).join(side("a"), ["task", "a", "from_name"], "left").join(side("b"), ["task", "b", "from_name"], "left")
    rows = rows.withColumns({"ca": F.coalesce("ca", F.lit("NONE")), "cb": F.coalesce("cb", F.lit("NONE"))})
    seen = rows.where("ca <> 'NONE' OR cb <> 'NONE'").select("a", "b", "from_name").distinct()
    return cohen_kappa(rows.join(seen, ["a", "b", "from_name"], "left_semi"), "ca", "cb", ["a", "b", "from_name"])


def _in_article(drafts: DataFrame, index: DataFrame) -> DataFrame:
    """draft_id, in_article (the best clause of the draft's article) and whether the sentence guessed ``_fits`` about as well.

    drafts: draft_id, guess, art, written, said. Articles meet the clauses whose
    reference starts with them by an equi-join on the references' prefixes. Of
    clauses with one reference the last text counts.
    """
    bare = F.regexp_replace("nref", r"^note:", "")
    starts = F.transform(F.sequence(F.lit(1), F.length(bare)), lambda n: F.substring(bare, F.lit(1), n))
    listed = F.when(F.col("nref").startswith("table:"), F.array(F.regexp_replace("nref", r"^table:", ""))).when(bare != "", F.filter(starts, lambda p: p.rlike(r"^\d+(\.\d+)+[A-Z]?$"))).otherwise(F.array().cast("array<string>"))
    one = index.groupBy("nref").agg(F.min("ord").alias("ord"), F.min_by("ref", "ord").alias("ref"), F.max_by("text", "ord").alias("text"))
    clauses = one.select("nref", "ord", "ref", "text", F.array_distinct(tokenize(F.col("text"))).alias("_words"), F.explode(listed).alias("art"))
    score = F.struct(R.quotes_value(F.col("text"), F.col("written")).alias("quotes"), F.size(F.array_intersect("said", "_words")).alias("shared"))
    scored = drafts.join(clauses, "art").withColumn("_score", score)
    top = F.max_by(F.struct("_score", "ref"), F.struct("_score", (-F.col("ord")).alias("first")))
    best = scored.groupBy("draft_id").agg(top.alias("_best"), F.max(F.when(F.col("nref") == F.col("guess"), F.col("_score"))).alias("_own"))
    own, most = F.col("_own"), F.col("_best._score")
    fits = own.isNotNull() & (own["quotes"] >= most["quotes"]) & (own["shared"] >= 0.6 * most["shared"])
    return best.select("draft_id", F.col("_best.ref").alias("in_article"), F.coalesce(fits, F.lit(False)).alias("_fits"))


def resolve_clause(drafts: DataFrame, index: DataFrame) -> DataFrame:
    """draft_id and ref: the clause a draft came from, and by which step.

    drafts: draft_id, clause_id, rule_id, snippet, description and, if there,
    values (array of the rule's numbers); index: ord, ref, text. In this order:
    the clause id; for a rule id of the form article-number, the best of the
    article's clauses, its table and notes, by whether they quote one of the
    values, then by words shared with the description, then the first; but the
    sentence the number names, if it quotes no less and shares 0.6 of the words,
    or if the index has nothing of the article; the first clause that holds a
    snippet of less than 1000 characters; the clause sharing most words (three
    or more, the rule's article first, then the first in the index) with the
    snippet, else with the description; the rule id.

    The index is the clause list of one document: words are joined, so the cost
    grows with the drafts times the clauses of that document that share a word
    with them. Containment is tested on clauses that have the snippet's rarest
    word only.
    """
    d = drafts.select("draft_id", "clause_id", F.coalesce("rule_id", F.lit("")).alias("rule_id"), strip(F.regexp_replace(F.coalesce("snippet", F.lit("")), r"(?U)\s+", " ")).alias("snippet"), F.coalesce("description", F.lit("")).alias("description"))
    number = r"^(\d+(?:\.\d+)+[A-Z]?)\.?(?:-(\d+)[a-z]?|\((\d+)[a-z]?\)(?:\([a-z]+\))*)(?:-[\w-]+)?$"
    guess = F.concat(F.regexp_extract("rule_id", number, 1), F.lit(".("), F.coalesce(F.nullif(F.regexp_extract("rule_id", number, 2), F.lit("")), F.regexp_extract("rule_id", number, 3)), F.lit(")"))
    d = d.withColumns({"guess": F.when(F.col("rule_id").rlike(number), guess), "article": F.regexp_extract("rule_id", r"^\d+(?:\.\d+)+", 0)})
    words = lambda c: F.array_except(F.array_distinct(tokenize(F.col(c))), F.array(*[F.lit(w) for w in COMMON_WORDS]))
    i = index.select("ord", "ref", "text", R.normalize_ref(F.col("ref")).alias("nref"))
    postings = i.select("ord", "ref", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("w"))
    values = F.col("values") if "values" in drafts.columns else F.array().cast("array<double>")
    numbered = drafts.select("draft_id", values.alias("values")).join(d.where("guess IS NOT NULL"), "draft_id")
    chosen = _in_article(numbered.select("draft_id", "guess", F.regexp_extract("rule_id", number, 1).alias("art"), R.written_values(F.col("values")).alias("written"), words("description").alias("said")), i)
    unsettled = d.where(F.col("guess").isNull() & (F.coalesce("clause_id", F.lit("")) == ""))  # only these need their words joined
    short = unsettled.where((F.col("snippet") != "") & (F.length("snippet") < 1000))

    def best(rows: DataFrame, source: str, out: str) -> DataFrame:
        shared = rows.select("draft_id", "article", F.explode(words(source)).alias("w")).join(postings, "w").groupBy("draft_id", "article", "ord", "ref").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
        own = (F.col("article") != "") & F.col("ref").contains(F.col("article"))
        return shared.groupBy("draft_id").agg(F.min_by("ref", F.struct((-F.col("n")).alias("n"), (~own).alias("other"), "ord")).alias(out))

    # a clause that holds the snippet has its rarest word; texts are fetched for those clauses only
    often = postings.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    said = short.select("draft_id", F.explode(F.array_distinct(tokenize(F.col("snippet")))).alias("w")).join(often, "w")
    rarest = said.groupBy("draft_id").agg(F.min_by("w", F.struct("n", (-F.length("w")).alias("l"), "w")).alias("w"))
    near = rarest.join(postings, "w").select("draft_id", "ord", "ref").join(i.select("ord", "text"), "ord").join(short.select("draft_id", "snippet"), "draft_id")
    holding = near.where(F.col("text").contains(F.col("snippet"))).groupBy("draft_id").agg(F.min_by("ref", "ord").alias("held"))
    rows = d.join(chosen, "draft_id", "left").join(holding, "draft_id", "left").join(best(short, "snippet", "by_snippet"), "draft_id", "left").join(best(unsettled, "description", "by_description"), "draft_id", "left")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    steps = [("clause_id", text("clause_id")), ("rule_id", F.when(F.coalesce("_fits", F.lit(True)), F.col("guess"))), ("article", F.col("in_article")), ("snippet", F.col("held")), ("snippet_words", F.col("by_snippet")), ("description_words", F.col("by_description")), ("rule_id_text", text("rule_id"))]
    by = None
    for name, value in steps:
        by = F.when(value.isNotNull(), name) if by is None else by.when(value.isNotNull(), name)
    return rows.select("draft_id", F.coalesce(*[v for _, v in steps]).alias("ref"), by.alias("step"))


def zip_rows(left: DataFrame, right: DataFrame, left_order: str, right_order: str, key: list[str]) -> DataFrame:
    """Rows joined by place within a key; the longer side is cut."""
    number = lambda df, o: df.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(o)))
    return number(left, left_order).join(number(right, right_order), [*key, "_rn"]).withColumnRenamed("_rn", "place")
