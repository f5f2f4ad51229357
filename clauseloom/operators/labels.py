"""Annotation tasks: what their labels say as annotations and as reference rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseloom.functions import rules as R
from clauseloom.functions.columns import FLAGS, found, or_null, strip

STRENGTHS = ("MANDATORY", "PROHIBITED", "RECOMMENDED", "PERMITTED")
CONDITIONS = ("APPLICABILITY", "EXCEPTION", "QUALIFICATION")
# Operator of each dimension label.
LABEL_OPERATORS = {"DIM_MIN": ">=", "DIM_MAX": "<=", "DIM_EXACT": "==", "DIM_RANGE": "between"}


def is_current(tasks: DataFrame) -> DataFrame:
    """Tasks that no other has taken over."""
    return tasks.where(F.coalesce(F.col("data.meta.superseded"), F.lit("")) == "")


def latest_results(tasks: DataFrame, predictions: bool = True) -> DataFrame:
    """task_id, section_ref, text and one row per result of a task's last annotation, or of its last prediction if it has no annotation."""
    last = F.try_element_at("annotations", F.lit(-1))["result"]
    if predictions and "predictions" in tasks.columns:
        last = F.when(F.size(F.coalesce("annotations", F.array())) > 0, last).otherwise(F.try_element_at("predictions", F.lit(-1))["result"])
    rows = tasks.select(F.col("id").alias("task_id"), F.col("data.section_ref").alias("section_ref"), F.coalesce("data.text", F.lit("")).alias("text"), F.posexplode(last).alias("pos", "r"))
    return rows.select(
        "task_id", "section_ref", "text", "pos", F.col("r.id").alias("region"), "r.from_name", "r.type", F.col("r.value.start").alias("start"), F.col("r.value.end").alias("end"),
        F.coalesce("r.value.text", F.lit("")).alias("span"), F.col("r.value.labels").alias("labels"), F.get("r.value.choices", F.lit(0)).alias("choice"),
    )


def region_properties(results: DataFrame) -> DataFrame:
    """Label results with ``dim_property``, the property chosen for their region: by region id, else by the same offsets; of several the last."""
    named = results.where((F.col("from_name") == "dim_property") & F.col("choice").isNotNull())
    by_id = named.where(F.col("region").isNotNull()).groupBy("task_id", F.col("region").alias("_region")).agg(F.max_by("choice", "pos").alias("_by_id"))
    by_place = named.where(F.col("start").isNotNull() & F.col("end").isNotNull()).groupBy("task_id", F.col("start").alias("_s"), F.col("end").alias("_e")).agg(F.max_by("choice", "pos").alias("_by_place"))
    labels = results.where(F.col("type") == "labels")
    a = labels.join(by_id.withColumnRenamed("task_id", "_t1"), (labels["task_id"] == F.col("_t1")) & (F.col("region") == F.col("_region")), "left")
    b = a.join(by_place.withColumnRenamed("task_id", "_t2"), (a["task_id"] == F.col("_t2")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")), "left")
    return b.withColumn("dim_property", F.coalesce("_by_id", "_by_place")).drop("_t1", "_t2", "_region", "_s", "_e", "_by_id", "_by_place")


def task_annotations(tasks: DataFrame) -> DataFrame:
    """One annotation per task from the labels of its latest answer, as the text annotation has it.

    task_id, deontics, conditions, cross_refs, dimensions, dependencies,
    ifc_hints, subject. A dimension without a number has value 0, without a
    unit mm. References whose text lies in an exception's text are nested in it.
    """
    results = latest_results(tasks)
    labels = region_properties(results).withColumn("label", F.explode("labels")).withColumn("label", F.upper("label"))
    number = R.numeric_value(F.col("span"))
    marker = F.coalesce(F.get(F.split(strip(F.col("span")), r"(?U)\s+"), F.lit(0)), F.lit(""))
    ref = R.cross_ref(F.col("span"))
    rows = labels.withColumns({"_n": number, "_ref": ref})
    at = F.col("pos")
    low = F.lower("label")
    deontic = F.when(F.col("label").isin(*STRENGTHS), F.struct(at, F.struct(F.upper(strip(F.col("span"))).alias("operator"), low.alias("strength"), (F.col("label") == "PROHIBITED").alias("negated"), F.col("span")).alias("x")))
    condition = F.when(F.col("label").isin(*CONDITIONS), F.struct(at, F.struct(low.alias("type"), marker.alias("marker"), F.col("span").alias("text")).alias("x")))
    dimension = F.when(
        F.col("label").startswith("DIM_"),
        F.struct(
            at,
            F.struct(
                F.coalesce("_n.value", F.lit(0.0)).alias("value"), F.coalesce("_n.unit", F.lit("mm")).alias("unit"), F.coalesce(R.lookup({k: k[4:].lower() for k in LABEL_OPERATORS}, F.col("label")), F.lit("exact")).alias("constraint"),
                F.col("_n.value_min").alias("value_min"), F.col("_n.value_max").alias("value_max"), F.col("span"), F.col("dim_property").alias("property_name"),
            ).alias("x"),
        ),
    )
    crossref = F.when(F.col("label").isin("CROSS_REF", "REFERENCE"), F.struct(at, F.struct(F.col("span").alias("raw"), F.col("_ref.ref_type").alias("ref_type"), F.col("_ref.normalized").alias("normalized"), F.col("span").alias("context")).alias("x")))
    gathered = rows.groupBy("task_id").agg(*[F.array_sort(F.collect_list(c), lambda p, q: p["pos"] - q["pos"]).alias(n) for n, c in (("deontics", deontic), ("conditions", condition), ("dimensions", dimension), ("cross_refs", crossref))])  # a task's results
    plain = gathered.select("task_id", *[F.transform(n, lambda e: e["x"]).alias(n) for n in ("deontics", "conditions", "dimensions", "cross_refs")])
    chosen = results.where((F.col("type") == "choices") & (F.col("from_name") == "ifc_entity") & F.col("choice").isNotNull())
    hint = F.struct(F.lower(F.replace("choice", F.lit("Ifc"), F.lit(""))).alias("surface"), F.col("choice").alias("ifc_class"))
    hints = chosen.groupBy(F.col("task_id").alias("_t")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", hint.alias("x"))), lambda p, q: p["pos"] - q["pos"]), lambda e: e["x"]).alias("ifc_hints"))
    joined = tasks.select(F.col("id").alias("task_id")).join(plain, "task_id", "left").join(hints, F.col("task_id") == F.col("_t"), "left").drop("_t")
    joined = joined.select("task_id", *[F.coalesce(n, F.array()).alias(n) for n in ("deontics", "conditions", "dimensions", "cross_refs", "ifc_hints")])
    exceptions = F.filter("conditions", lambda c: c["type"] == "exception")
    deps = F.transform(exceptions, lambda c: F.struct(F.lit("exception").alias("dep_type"), c["marker"].alias("marker"), c["text"].alias("text"), F.filter("cross_refs", lambda r: F.contains(c["text"], r["raw"])).alias("refs")))
    return joined.withColumns({"dependencies": deps, "subject": F.get("ifc_hints", F.lit(0))["ifc_class"]})


def bind_conditions(dims: DataFrame, conds: DataFrame, texts: DataFrame) -> DataFrame:
    """task_id, dim, cond: which dimension each condition qualifies; a condition of the whole clause comes with each dimension.

    dims: task_id, dim (number in order), start; conds: task_id, cond, start;
    texts: task_id, text, section_ref. In prose, list markers like (a) cut a
    clause into items; a condition before the first dimension, or in an item
    without one, holds for all; another belongs to the nearest dimension before
    it in its item, else to the next. In tables a condition belongs to the
    dimensions between it and the next condition, or to all if there are none.
    """
    # a marker's places from the lengths of the pieces between markers
    pieces = F.split("text", r"(?U)\((?:[a-z]|[ivx]+)\)\s")
    marks = F.regexp_extract_all("text", F.lit(r"(?U)\((?:[a-z]|[ivx]+)\)\s"), 0)
    starts = F.transform(
        F.sequence(F.lit(1), F.size(marks)),
        lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda a, p: a + F.length(p)) + F.aggregate(F.slice(marks, F.lit(1), k - 1), F.lit(0), lambda a, m: a + F.length(m)),
    )
    t = texts.select(F.col("task_id").alias("_t"), F.when(F.size(marks) > 0, starts).otherwise(F.array().cast("array<int>")).alias("_marks"), F.lower(F.coalesce("section_ref", F.lit(""))).startswith("table").alias("_table"))
    item = lambda c: F.size(F.filter("_marks", lambda m: m <= F.col(c)))
    nxt = F.lead("start").over(W.partitionBy("task_id").orderBy("start", "cond"))
    c = conds.withColumn("_next", nxt).join(t, conds["task_id"] == t["_t"]).select("task_id", "cond", F.col("start").alias("c_start"), "_next", "_table", item("start").alias("c_item"))
    d = dims.join(t, dims["task_id"] == t["_t"]).select(F.col("task_id").alias("_task"), "dim", F.col("start").alias("d_start"), item("start").alias("d_item"))
    both = c.join(d, F.col("task_id") == F.col("_task"))  # the few spans of one task
    per = W.partitionBy("task_id", "cond")
    between = (F.col("d_start") > F.col("c_start")) & (F.col("_next").isNull() | (F.col("d_start") < F.col("_next")))
    same = F.col("c_item") == F.col("d_item")
    before = same & (F.col("d_start") < F.col("c_start"))
    both = both.withColumns(
        {
            "_any_between": F.max(between.cast("int")).over(per), "_any_same": F.max(same.cast("int")).over(per), "_first": F.min("d_start").over(per),
            "_near": F.max_by("dim", F.when(before, F.struct("d_start", -F.col("dim")))).over(per), "_after": F.min_by("dim", F.when(same, F.struct("d_start", "dim"))).over(per),
        }
    )
    everywhere = F.when(F.col("_table"), F.col("_any_between") == 0).otherwise((F.col("_any_same") == 0) | ((F.col("c_item") == 0) & (F.col("c_start") < F.col("_first"))))
    own = F.when(F.col("_table"), between).otherwise(F.col("dim") == F.coalesce("_near", "_after"))
    return both.where(everywhere | own).select("task_id", "dim", "cond")


def gold_rules(tasks: DataFrame) -> DataFrame:
    """Reference rules of current tasks, one per dimension span in the order of start, label, text.

    task_id, dim, ref, target, property_name, operator, value, value_min,
    value_max, value_min_property, value_min_offset, value_max_property,
    value_max_offset, unit, desc, building_use, conditions, exceptions. Bounds
    relative to another property of the element or of another element carry
    the property and an offset; spans without a checkable value give no rule;
    exactly one relative lower and one upper bound of the same property become
    one ``between``.
    """
    current = is_current(tasks)
    results = latest_results(current, predictions=False)
    last = lambda name: F.max_by(F.when(F.col("from_name") == name, F.col("choice")), F.when((F.col("from_name") == name) & F.col("choice").isNotNull(), F.col("pos")))
    chosen = results.where(F.col("type") == "choices").groupBy(F.col("task_id").alias("_t")).agg(last("ifc_entity").alias("_entity"), last("property_name").alias("_property"), last("unit").alias("_unit"))
    labels = region_properties(results).withColumn("label", F.explode("labels")).withColumn("start", F.coalesce("start", F.instr("text", F.col("span")) - 1))
    dims = labels.where(F.col("label").startswith("DIM_")).withColumn("dim", F.row_number().over(W.partitionBy("task_id").orderBy("start", "label", "span", "dim_property")) - 1)
    conds = labels.where(F.col("label").isin(*CONDITIONS)).withColumn("cond", F.row_number().over(W.partitionBy("task_id").orderBy("start", "label", "span")) - 1)
    bound = bind_conditions(dims.select("task_id", "dim", "start"), conds.select("task_id", "cond", "start"), current.select(F.col("id").alias("task_id"), F.col("data.text").alias("text"), F.col("data.section_ref").alias("section_ref")))
    said = bound.join(conds.select("task_id", "cond", F.col("label").alias("_l"), F.col("span").alias("_s")), ["task_id", "cond"])
    use = F.when(F.col("_l") == "APPLICABILITY", R.building_use(F.col("_s")))
    scopes = said.groupBy(F.col("task_id").alias("_t"), F.col("dim").alias("_d")).agg(
        F.sort_array(F.collect_list(F.when(F.col("_l") != "EXCEPTION", F.struct("cond", "_s")))).alias("_c"), F.sort_array(F.collect_list(F.when(F.col("_l") == "EXCEPTION", F.struct("cond", "_s")))).alias("_x"),
        F.min_by(use, F.when(use.isNotNull(), F.col("cond"))).alias("building_use"),
    )
    rows = dims.join(chosen, dims["task_id"] == chosen["_t"], "left").drop("_t").join(scopes, (F.col("task_id") == F.col("_t")) & (F.col("dim") == F.col("_d")), "left")

    relative = FLAGS + rf"\bits\s+([a-z]+)(?:\s+plus)?(?:\s+({R.NUMBER})\s*(?:{R.UNIT})?)?"
    is_relative = F.col("span").rlike(relative)
    operator = R.lookup(LABEL_OPERATORS, F.col("label"))
    other = R.other_element_property(F.col("span"))
    is_other = ~is_relative & other.isNotNull() & operator.isin(">=", "<=")
    bound_name = F.when(is_relative, F.initcap(found(F.col("span"), relative, 1))).when(is_other, other)
    offset = F.when(is_relative, F.coalesce(R.spaced_number(or_null(found(F.col("span"), relative, 2))), F.lit(0.0))).when(is_other, F.lit(0.0))
    task_unit = F.when(F.col("_unit") != "none", F.col("_unit"))
    n = R.numeric_value(F.col("span"))
    plain = ~(is_relative | is_other)
    rows = rows.withColumns({"operator": operator, "_plain": plain, "_bound": bound_name, "_offset": offset, "_n": n})
    lower = F.col("operator") == ">="
    unit = (
        F.when(is_relative, F.coalesce(R.canonical_unit(or_null(found(F.col("span"), relative, 3))), task_unit))
        .when(is_other, task_unit)
        .otherwise(F.coalesce(F.col("_n.unit"), F.when(~R.has_count_word(F.col("span")), task_unit)))
    )
    ranged = F.col("_plain") & (F.col("operator") == "between")
    out = rows.select(
        "task_id", "dim", F.coalesce("section_ref", F.lit("unknown")).alias("ref"), F.coalesce("_entity", F.lit("IfcStairFlight")).alias("target"), F.coalesce("dim_property", "_property", F.lit("Width")).alias("property_name"),
        "operator", F.when(F.col("_plain") & ~ranged, F.col("_n.value")).alias("value"), F.when(ranged, F.col("_n.value_min")).alias("value_min"), F.when(ranged, F.col("_n.value_max")).alias("value_max"),
        F.when(lower, F.col("_bound")).alias("value_min_property"), F.when(lower, F.col("_offset")).alias("value_min_offset"), F.when(~lower, F.col("_bound")).alias("value_max_property"), F.when(~lower, F.col("_offset")).alias("value_max_offset"),
        unit.alias("unit"), F.concat(strip(F.substring("text", 1, 120)), F.when(F.length("text") > 120, "...").otherwise("")).alias("desc"), "building_use",
        F.transform(F.coalesce("_c", F.array()), lambda e: e["_s"]).alias("conditions"), F.transform(F.coalesce("_x", F.array()), lambda e: e["_s"]).alias("exceptions"), "_plain",
    )
    checkable = ~F.col("_plain") | F.when(F.col("operator") == "between", F.col("value_min").isNotNull()).otherwise(F.col("value").isNotNull())
    return merge_relative_bounds(out.where(checkable).drop("_plain"))


def merge_relative_bounds(rules: DataFrame) -> DataFrame:
    """A task's only relative lower and only relative upper bound, if of one target and property, as one ``between`` at the lower one's place."""
    per = W.partitionBy("task_id")
    low, high = F.col("value_min_property").isNotNull(), F.col("value_max_property").isNotNull()
    counted = rules.withColumns(
        {
            "_lows": F.count_if(low).over(per), "_highs": F.count_if(high).over(per), "_low": F.max(F.when(low, F.struct("target", "property_name"))).over(per),
            "_high": F.max(F.when(high, F.struct("target", "property_name"))).over(per), "_hi": F.max(F.when(high, F.struct("dim", "value_max_property", "value_max_offset", "unit"))).over(per),
        }
    )
    merged = (F.col("_lows") == 1) & (F.col("_highs") == 1) & (F.col("_low") == F.col("_high"))
    is_low = merged & low
    take = {"operator": F.lit("between"), "value_max_property": F.col("_hi.value_max_property"), "value_max_offset": F.col("_hi.value_max_offset"), "unit": F.coalesce("_hi.unit", "unit")}
    kept = counted.where(~(merged & high & ~low))
    return kept.withColumns({k: F.when(is_low, v).otherwise(F.col(k)) for k, v in take.items()}).drop("_lows", "_highs", "_low", "_high", "_hi")


def annotator_spans(tasks: DataFrame) -> DataFrame:
    """task, annotator, start, end, label, ord of every labelled span of every annotation; ord numbers an annotator's spans."""
    answers = tasks.select(F.col("id").alias("task"), F.explode("annotations").alias("a")).select("task", F.col("a.completed_by").alias("annotator"), F.col("a.id").alias("_a"), F.posexplode("a.result").alias("_p", "r"))
    rows = answers.where("r.type = 'labels'").select("task", "annotator", "_a", "_p", F.coalesce("r.value.start", F.lit(0)).alias("start"), F.coalesce("r.value.end", F.lit(0)).alias("end"), F.posexplode("r.value.labels").alias("_q", "label"))
    number = F.row_number().over(W.partitionBy("annotator", "task").orderBy("_a", "_p", "_q"))
    return rows.withColumn("ord", number).drop("_a", "_p", "_q")


def annotator_choices(tasks: DataFrame) -> DataFrame:
    """task, annotator, from_name, choice of task-level choices (those of a region are left out); of several the last."""
    answers = tasks.select(F.col("id").alias("task"), F.explode("annotations").alias("a")).select("task", F.col("a.completed_by").alias("annotator"), F.col("a.id").alias("_a"), F.posexplode("a.result").alias("_p", "r"))
    rows = answers.where((F.col("r.type") == "choices") & (F.col("r.from_name") != "dim_property") & F.col("r.value.start").isNull() & F.get("r.value.choices", F.lit(0)).isNotNull())
    return rows.groupBy("task", "annotator", F.col("r.from_name").alias("from_name")).agg(F.max_by(F.get("r.value.choices", F.lit(0)), F.struct("_a", "_p")).alias("choice"))


def preannotate(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tasks from annotated nodes: text, section and a prediction whose spans stand at their first place in the text.

    ``nodes`` has key, ord, text, section_number and ``annotation``.
    """
    a = F.col("annotation")
    strength = lambda d: F.upper(d["strength"])
    label = lambda kind, span, name: F.struct(F.lit(kind).alias("from_name"), span.alias("span"), name.alias("label"))
    parts = F.concat(
        F.transform(a["deontics"], lambda d: label("linguistic_labels", d["span"], strength(d))),
        F.transform(a["conditions"], lambda c: label("linguistic_labels", c["text"], F.upper(c["type"]))),
        F.transform(a["dimensions"], lambda d: label("linguistic_labels", d["span"], F.concat(F.lit("DIM_"), F.upper(d["constraint"])))),
        F.transform(a["cross_refs"], lambda r: label("linguistic_labels", r["raw"], F.lit("CROSS_REF"))),
    )
    # rows are exploded so that a span's place can be computed from two columns
    rows = nodes.select(key, "ord", "text", "section_number", F.posexplode_outer(parts).alias("_p", "x")).withColumn("start", F.instr("text", F.col("x.span")) - 1)
    item = F.when(F.col("start") >= 0, F.struct("_p", "x.from_name", F.lit("labels").alias("type"), F.struct("start", (F.col("start") + F.length("x.span")).alias("end"), F.col("x.span").alias("text"), F.array("x.label").alias("labels")).alias("value")))
    return rows.groupBy(key, "ord", "text", "section_number").agg(F.array_sort(F.collect_list(item), lambda p, q: p["_p"] - q["_p"]).alias("result"))


def rules_to_tasks(rules: DataFrame) -> DataFrame:
    """Reference rules as tasks with their operator as a label and their target, property and unit as choices."""
    name = F.lit(None).cast("string")
    for label, op in LABEL_OPERATORS.items():
        name = F.when(F.col("operator") == op, label).otherwise(name)
    choice = lambda n, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(n).alias("from_name"), F.lit("choices").alias("type"), F.col(c).alias("choice")))
    choices = F.filter(F.array(choice("ifc_entity", "target"), choice("property_name", "property_name"), choice("unit", "unit")), lambda x: x.isNotNull())
    return rules.select("ref", F.coalesce("desc", F.lit("")).alias("text"), name.alias("label"), choices.alias("choices"))


def tasks_to_nodes(nodes: DataFrame, tasks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nodes with the annotation of the task about them: by element id, else by equal text; of several tasks the last.

    tasks: element_id, text, order, annotation.
    """
    a = tasks.where(F.col("element_id").isNotNull()).groupBy(F.col("element_id").alias("_e")).agg(F.max_by("annotation", "order").alias("_by_id"))
    b = tasks.groupBy(F.col("text").alias("_x")).agg(F.max_by("annotation", "order").alias("_by_text"))
    joined = nodes.join(a, nodes["element_id"] == a["_e"], "left").join(b, nodes["text"] == b["_x"], "left")
    return joined.withColumn("annotation", F.coalesce("_by_id", "_by_text")).drop("_e", "_x", "_by_id", "_by_text")
