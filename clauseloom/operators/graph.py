"""The clause graph: assembly, merging, verdicts, grounding and review.

A graph is two tables: nodes (id, kind, attributes) and edges (src, dst, key,
kind, attributes). Keys are unique over the whole graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseloom.functions.columns import strip
from clauseloom.operators.documents import numeric_suffix
from clauseloom.operators.ordered import ordered_index

CANDIDATES = ("candidate_class_match", "candidate_property_match")
# Fields whose correction says something about a term, with the term's kind.
FIELD_KINDS = {"target_ifc_class": "class", "property_name": "property", "property_set": "property"}


def clause_edges(clauses: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, source_ref, target_ref, edge_type, label and the order columns seq, rank, pos of references between a document's clauses.

    A normalised reference points to the first clause with that number; own
    references are dropped. References come first, then those of dependencies
    as ``depends_on:<type>``.
    """
    first = clauses.groupBy(F.col(key).alias("_k"), numeric_suffix(F.col("ref")).alias("_suffix")).agg(F.min_by("ref", "clause_seq").alias("target_ref"))
    refs = clauses.select(key, "ref", "clause_seq", F.posexplode("cross_refs").alias("pos", "_r"))
    refs = refs.select(key, "ref", "clause_seq", F.lit(0).alias("rank"), "pos", F.col("_r.normalized").alias("_to"), F.lit("cross_ref").alias("edge_type"), F.col("_r.raw").alias("label"))
    deps = clauses.select(key, "ref", "clause_seq", F.posexplode("dependencies").alias("_p", "_d")).select(key, "ref", "clause_seq", "_p", "_d", F.posexplode("_d.refs").alias("_q", "_r"))
    deps = deps.select(
        key, "ref", "clause_seq", F.lit(1).alias("rank"), (F.shiftleft(F.col("_p").cast("bigint"), 31) + F.col("_q")).alias("pos"), F.col("_r.normalized").alias("_to"),
        F.concat(F.lit("depends_on:"), F.col("_d.dep_type")).alias("edge_type"), F.col("_d.marker").alias("label"),
    )
    found = refs.unionByName(deps)
    joined = found.join(first, (found[key] == first["_k"]) & (found["_to"] == first["_suffix"])).where(F.col("ref") != F.col("target_ref"))
    return joined.select(key, F.col("ref").alias("source_ref"), "target_ref", "edge_type", "label", F.col("clause_seq").alias("seq"), "rank", "pos")


def prune_ontology(classes: DataFrame, properties: DataFrame, links: DataFrame, dictionaries: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, properties, links) of the dictionaries whose uri holds one of the given parts; links follow classes, properties follow links."""
    if dictionaries:
        wanted = F.lit(False)
        for part in dictionaries:
            wanted = wanted | F.contains("dictionary_uri", F.lit(part))
        classes = classes.where(wanted)
    links = links.join(classes.select(F.col("uri").alias("class_uri")).distinct(), "class_uri", "left_semi")
    properties = properties.join(links.select(F.col("property_uri").alias("uri")).distinct(), "uri", "left_semi")
    return classes, properties, links


def clause_node_id(ref: Column) -> Column:
    return F.concat(F.lit("clause::"), ref)


def term_node_id(uri: Column) -> Column:
    return F.concat(F.lit("term::"), uri)


def clause_nodes(clauses: DataFrame) -> DataFrame:
    """Nodes of clauses: excerpt of 500 characters, distinct sorted operators and classes, counts."""
    sorted_distinct = lambda array, field: F.array_sort(F.array_distinct(F.filter(F.transform(array, lambda x: x[field]), lambda v: v != "")))
    return clauses.select(
        clause_node_id(F.col("ref")).alias("id"), F.lit("clause").alias("kind"), "ref", "heading", "level", "section_path", F.substring("text", 1, 500).alias("text_excerpt"),
        F.length("text").alias("char_count"), "element_ids", sorted_distinct("deontics", "operator").alias("deontic_operators"), (F.size("conditions") > 0).alias("has_conditions"),
        F.size("dimensions").alias("dimension_count"), sorted_distinct("ifc_hints", "ifc_class").alias("ifc_hints"),
    )


def _term_nodes(terms: DataFrame, used: DataFrame, kind: str, extra: list[str]) -> DataFrame:
    rows = terms.join(used, "uri", "left_semi")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(
        term_node_id(F.col("uri")).alias("id"), F.lit(kind).alias("kind"), "uri", text("code"), text("name"), *[text(c) for c in extra],
        F.substring(F.coalesce("definition", F.lit("")), 1, 500).alias("definition"),
    )


def assemble(
    nodes: DataFrame, references: DataFrame, classes: DataFrame, properties: DataFrame, links: DataFrame, class_matches: DataFrame, property_matches: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a document: its clauses, the terms they match, the links between those, all with global edge keys.

    Only classes that a clause matches are kept, and the properties matched or
    linked to a kept class. Candidate edges need both ends. Scores have four
    decimals.
    """
    used_classes = class_matches.select(F.col("term_id").alias("uri")).distinct()
    kept_links = links.join(used_classes.withColumnRenamed("uri", "class_uri"), "class_uri", "left_semi")
    used_properties = property_matches.select(F.col("term_id").alias("uri")).unionByName(kept_links.select(F.col("property_uri").alias("uri"))).distinct()
    all_nodes = nodes.unionByName(_term_nodes(classes, used_classes, "class", ["dictionary_uri", "class_type"]), allowMissingColumns=True)
    all_nodes = all_nodes.unionByName(_term_nodes(properties, used_properties, "property", ["data_type"]), allowMissingColumns=True)

    def edge(df: DataFrame, rank: int, src: Column, dst: Column, kind: Column, order: list[Column], **attrs: Column) -> DataFrame:
        at = F.array(*[o.cast("string") for o in order])
        columns = {"label": F.lit(None).cast("string"), "property_set": F.lit(None).cast("string"), "composite_score": F.lit(None).cast("double")}
        columns |= {f"signal_{s}": F.lit(None).cast("double") for s in ("tfidf_cosine", "jaccard_tokens", "fuzz_ratio", "exact_substring")} | attrs
        return df.select(src.alias("src"), dst.alias("dst"), kind.alias("kind"), F.lit(rank).alias("_rank"), at.alias("_at"), *[c.alias(n) for n, c in columns.items()])

    padded = lambda c: F.lpad(F.col(c).cast("string"), 19, "0")
    parts = [
        edge(references, 0, clause_node_id(F.col("source_ref")), clause_node_id(F.col("target_ref")), F.col("edge_type"), [padded("seq"), padded("rank"), padded("pos")], label=F.col("label")),
        edge(kept_links, 1, term_node_id(F.col("class_uri")), term_node_id(F.col("property_uri")), F.lit("class_has_property"), [F.col("class_uri"), F.col("property_uri")], property_set=F.coalesce("property_set", F.lit(""))),
    ]
    for rank, matches, kind in ((2, class_matches, CANDIDATES[0]), (3, property_matches, CANDIDATES[1])):
        signals = {f"signal_{s}": F.round(s, 4) for s in ("tfidf_cosine", "jaccard_tokens", "fuzz_ratio", "exact_substring")}
        parts.append(edge(matches, rank, clause_node_id(F.col("clause_id")), term_node_id(F.col("term_id")), F.lit(kind), [F.col("clause_id"), F.col("term_id")], composite_score=F.round("composite", 4), **signals))
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    ids = all_nodes.select("id").distinct()
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return all_nodes, ordered_index(edges, ["_rank", "_at", "src", "dst"], "key").drop("_rank", "_at")


def borderline(edges: DataFrame, top_k: int = 5, low: float = 0.15, high: float = 0.45) -> DataFrame:
    """Candidate edges to be judged: score within the band (both ends included), the best ``top_k`` per clause and kind.

    The band is applied before the rank. Adds ``rank``.
    """
    inside = edges.where(F.col("kind").isin(*CANDIDATES) & F.col("composite_score").between(low, high))
    rank = F.row_number().over(W.partitionBy("src", "kind").orderBy(F.col("composite_score").desc(), "key"))
    return inside.withColumn("rank", rank).where(F.col("rank") <= top_k)


def clause_tasks(picked: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, candidates and prompt: one judging task per clause with its candidates, classes before properties, in rank order."""
    term = nodes.select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("code").alias("_code"), F.col("definition").alias("_definition"))
    rows = picked.join(term, picked["dst"] == term["_id"])
    item = F.struct("kind", "rank", "dst", "key", "composite_score", "_name", "_code", "_definition")
    tasks = rows.groupBy("src").agg(F.sort_array(F.collect_list(item)).alias("candidates"))  # 2 * top_k at most
    clause = nodes.where("kind = 'clause'").select(F.col("id").alias("src"), "ref", "heading", "text_excerpt")

    def line(c: Column, i: Column) -> Column:
        kind = F.when(c["kind"] == CANDIDATES[0], "class").otherwise("property")
        text = lambda f: F.coalesce(c[f], F.lit(""))
        return F.format_string('[%d] (%s, score %.3f) %s | %s | %s', i, kind, c["composite_score"], text("_name"), text("_code"), F.substring(text("_definition"), 1, 300))

    prompt = F.concat(
        F.lit("Clause "), F.coalesce("ref", F.lit("")), F.lit(": "), F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("text_excerpt", F.lit("")),
        F.lit("\n\nWhich of these terms does the clause speak of? Answer as JSON {\"results\": [{\"index\", \"verdict\", \"confidence\", \"reason\"}]}.\n"),
        F.array_join(F.transform("candidates", line), "\n"),
    )
    return tasks.join(clause, "src").withColumn("prompt", prompt).select("src", "candidates", "prompt")


def read_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """One row per judged candidate of a model's replies: index, verdict (uncertain if missing), confidence (0), reason.

    Fences are stripped and the outermost object is read; entries without an
    index and replies without an object give nothing.
    """
    from clauseloom.functions.rules import json_reply

    shape = "STRUCT<results: ARRAY<STRUCT<index: INT, verdict: STRING, confidence: DOUBLE, reason: STRING>>>"
    rows = replies.withColumn("_r", F.explode(F.from_json(json_reply(F.col(reply)), shape)["results"])).where(F.col("_r.index").isNotNull())
    return rows.drop(reply).select(
        *[c for c in replies.columns if c != reply], F.col("_r.index").alias("index"), F.coalesce("_r.verdict", F.lit("uncertain")).alias("verdict"),
        F.coalesce("_r.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("_r.reason", F.lit("")).alias("reason"),
    )


def apply_verdicts(edges: DataFrame, verdicts: DataFrame, model: str) -> DataFrame:
    """Edges with llm_verdict, llm_confidence (four decimals), llm_reason and llm_model from verdicts by (src, dst, key); others keep theirs."""
    have = edges.columns
    for c, kind in (("llm_verdict", "string"), ("llm_confidence", "double"), ("llm_reason", "string"), ("llm_model", "string")):
        if c not in have:
            edges = edges.withColumn(c, F.lit(None).cast(kind))
    new = verdicts.select("src", "dst", "key", F.col("verdict").alias("_v"), F.round("confidence", 4).alias("_c"), F.col("reason").alias("_r"))
    joined = edges.join(new, ["src", "dst", "key"], "left")
    hit = F.col("_v").isNotNull()
    changed = {"llm_verdict": "_v", "llm_confidence": "_c", "llm_reason": "_r"}
    joined = joined.withColumns({c: F.when(hit, F.col(n)).otherwise(F.col(c)) for c, n in changed.items()} | {"llm_model": F.when(hit, F.lit(model)).otherwise(F.col("llm_model"))})
    return joined.select(*edges.columns)


def drop_rejected(edges: DataFrame, verdicts: tuple[str, ...] = ("incorrect",)) -> DataFrame:
    """Edges without those judged so; edges not judged stay."""
    return edges.where(F.col("llm_verdict").isNull() | ~F.col("llm_verdict").isin(*verdicts))


def checked_decisions(rows: DataFrame) -> DataFrame:
    """Reviewers' rows with their verdict in lower case; a verdict that is neither correct, incorrect nor blank fails and names its row."""
    verdict = F.lower(strip(F.coalesce("human_verdict", F.lit(""))))
    message = F.concat(F.lit("human_verdict of "), F.coalesce("clause_id", F.lit("?")), F.lit(" / "), F.coalesce("term_id", F.lit("?")), F.lit(" is neither correct, incorrect nor blank"))
    return rows.withColumn("human_verdict", F.when(verdict.isin("correct", "incorrect", ""), verdict).otherwise(F.raise_error(message)))


def apply_decisions(edges: DataFrame, decisions: DataFrame, reviewer: str = "", order: str = "row") -> tuple[DataFrame, DataFrame]:
    """(edges with the decisions, one row n_applied and n_missing).

    Decisions name clause_id, term_id, edge_key; blank ones do nothing, the last
    one for an edge holds, those for edges that do not exist are counted.
    """
    rows = checked_decisions(decisions).where(F.col("human_verdict") != "")
    rows = rows.select(F.col("clause_id").alias("src"), F.col("term_id").alias("dst"), F.col("edge_key").cast("bigint").alias("key"), "human_verdict", "human_reviewer", "human_reason", order)
    last = rows.groupBy("src", "dst", "key").agg(F.max_by(F.struct("human_verdict", "human_reviewer", "human_reason"), order).alias("_d"))
    known = edges.select("src", "dst", "key").withColumn("_known", F.lit(True))
    tally = rows.join(known, ["src", "dst", "key"], "left").agg(F.count_if(F.col("_known").isNotNull()).alias("n_applied"), F.count_if(F.col("_known").isNull()).alias("n_missing"))
    joined = edges.join(last, ["src", "dst", "key"], "left")
    hit = F.col("_d").isNotNull()
    text = lambda c: F.nullif(c, F.lit(""))
    kept = [c for c in edges.columns if c not in ("llm_verdict", "human_reviewed", "human_reviewer", "human_reason")]
    old = lambda c, kind: F.col(c) if c in edges.columns else F.lit(None).cast(kind)
    out = joined.select(
        *kept, F.when(hit, F.col("_d.human_verdict")).otherwise(old("llm_verdict", "string")).alias("llm_verdict"),
        F.coalesce(F.when(hit, True), old("human_reviewed", "boolean")).alias("human_reviewed"),
        F.when(hit, F.coalesce(text(F.col("_d.human_reviewer")), text(F.lit(reviewer)))).otherwise(old("human_reviewer", "string")).alias("human_reviewer"),
        F.when(hit, text(F.col("_d.human_reason"))).otherwise(old("human_reason", "string")).alias("human_reason"),
    )
    return out, tally


def trusted(edges: DataFrame, score_high: float = 0.45) -> DataFrame:
    """Candidate edges that can be relied on, with ``source``: judged correct, or not judged and scored ``score_high`` or more; people's calls are named so."""
    judged = F.when(F.col("llm_verdict") == "correct", "llm_verified").when(F.col("llm_verdict").isNull() & (F.col("composite_score") >= score_high), "lexical_high_confidence")
    source = F.when(judged.isNotNull() & F.coalesce("human_reviewed", F.lit(False)), "human_verified").otherwise(judged)
    return edges.where(F.col("kind").isin(*CANDIDATES)).withColumn("source", source).where(F.col("source").isNotNull())


def modality(operators: Column) -> Column:
    """The one plain operator of a clause in lower case, null if it has none, several, or a negated one."""
    one = F.array_distinct(operators)
    return F.when((F.size(one) == 1) & F.get(one, F.lit(0)).isin("SHALL", "MUST", "SHOULD", "MAY"), F.lower(F.get(one, F.lit(0))))


def grounding(nodes: DataFrame, edges: DataFrame, score_high: float = 0.45) -> DataFrame:
    """id, ref, classes, properties, deontic, dependencies of every clause: trusted terms by score, and what it refers to with the text there."""
    clause = nodes.where("kind = 'clause'")
    term = nodes.select(F.col("id").alias("dst"), "uri", "name", "code")
    entries = trusted(edges, score_high).join(term, "dst")
    entry = F.struct((-F.round("composite_score", 4)).alias("_o"), "key", "uri", "name", "code", F.round("composite_score", 4).alias("score"), "source", "llm_confidence")
    kinds = entries.groupBy(F.col("src").alias("_s")).agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, entry))).alias(a) for k, a in zip(CANDIDATES, ("classes", "properties"))])
    plain = lambda a: F.transform(F.coalesce(a, F.array()), lambda e: F.struct(*[e[f].alias(f) for f in ("uri", "name", "code", "score", "source", "llm_confidence")]))
    target = nodes.select(F.col("id").alias("dst"), F.coalesce("ref", "id").alias("target_ref"), F.coalesce("text_excerpt", F.lit("")).alias("target_text_excerpt"))
    refs = edges.where((F.col("kind") == "cross_ref") | F.col("kind").startswith("depends_on:")).join(target, "dst")
    dep = F.struct("key", F.col("kind").alias("edge_type"), F.coalesce("label", F.lit("")).alias("label"), "target_ref", "target_text_excerpt")
    deps = refs.groupBy(F.col("src").alias("_t")).agg(F.sort_array(F.collect_list(dep)).alias("_deps"))
    joined = clause.join(kinds, clause["id"] == kinds["_s"], "left").join(deps, clause["id"] == deps["_t"], "left")
    said = modality(F.col("deontic_operators"))
    return joined.select(
        "id", "ref", plain(F.col("classes")).alias("classes"), plain(F.col("properties")).alias("properties"),
        F.when(said.isNotNull(), F.struct(said.alias("modality"), F.coalesce("text_excerpt", F.lit("")).alias("text"))).alias("deontic"),
        F.transform(F.coalesce("_deps", F.array()), lambda d: F.struct(*[d[f].alias(f) for f in ("edge_type", "label", "target_ref", "target_text_excerpt")])).alias("dependencies"),
    )


def review_queue(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges judged uncertain as flat rows with blanks for the reviewer; order by confidence (null as 0), then edge_key."""
    a = nodes.select(F.col("id").alias("src"), F.coalesce("ref", "id").alias("clause_ref"), F.coalesce("heading", F.lit("")).alias("clause_heading"), F.coalesce("text_excerpt", F.lit("")).alias("clause_text_excerpt"))
    b = nodes.select(F.col("id").alias("dst"), F.coalesce("name", F.lit("")).alias("term_name"), F.coalesce("uri", F.lit("")).alias("term_uri"), F.coalesce("definition", F.lit("")).alias("term_definition"))
    for c in ("llm_reason", "llm_model"):
        if c not in edges.columns:
            edges = edges.withColumn(c, F.lit(None).cast("string"))
    rows = edges.where("llm_verdict = 'uncertain'").join(a, "src").join(b, "dst")
    blank = [F.lit("").alias(c) for c in ("human_verdict", "human_reviewer", "human_reason")]
    return rows.select(
        F.col("src").alias("clause_id"), F.col("dst").alias("term_id"), F.col("key").alias("edge_key"), "clause_ref", "clause_heading", "clause_text_excerpt",
        F.when(F.col("kind") == CANDIDATES[0], "class").otherwise("property").alias("term_kind"), "term_name", "term_uri", "term_definition",
        F.round(F.coalesce("composite_score", F.lit(0.0)), 4).alias("lexical_score"), "llm_confidence", F.coalesce("llm_reason", F.lit("")).alias("llm_reason"),
        F.coalesce("llm_model", F.lit("")).alias("llm_model"), *blank,
    ).orderBy(F.coalesce("llm_confidence", F.lit(0.0)), "edge_key")


def correction_signal(diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term_kind, term of originals that were corrected; term_kind, n corrections) from rows with field and original."""
    from clauseloom.functions.rules import lookup

    rows = diffs.select(lookup(FIELD_KINDS, F.col("field")).alias("term_kind"), F.lower(strip(F.coalesce("original", F.lit("")))).alias("term")).where(F.col("term_kind").isNotNull())
    return rows.where(F.col("term") != "").distinct(), rows.groupBy("term_kind").agg(F.count(F.lit(1)).alias("n"))


def prioritise(queue: DataFrame, bad_terms: DataFrame, kind_counts: DataFrame) -> DataFrame:
    """The queue with priority_score, priority_reason: terms that were corrected first, then by their kind's share of corrections, then by confidence."""
    total = kind_counts.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).alias("_total"))  # one row
    shares = kind_counts.crossJoin(total).select("term_kind", F.col("n").alias("_n"), "_total")  # two rows at most
    bad = bad_terms.select("term_kind", F.col("term").alias("_term")).withColumn("_bad", F.lit(True))
    rows = queue.withColumn("_term", F.lower(strip(F.coalesce("term_name", F.lit("")))))
    rows = rows.join(bad, ["term_kind", "_term"], "left").join(shares, "term_kind", "left")
    share = F.coalesce(F.col("_n") / F.col("_total"), F.lit(0.0))
    exact = F.col("_bad").isNotNull()
    reason = (
        F.when(exact, F.concat(F.lit("this "), F.col("term_kind"), F.lit(" was corrected before: "), F.col("term_name")))
        .when(share > 0, F.format_string("%d of %d corrections were of this kind", F.col("_n"), F.col("_total")))
        .otherwise(F.lit("no correction of this term or kind"))
    )
    scored = rows.withColumns({"priority_score": F.round(F.when(exact, 1000).otherwise(0) + share * 10, 4), "priority_reason": reason}).drop("_term", "_bad", "_n", "_total")
    return scored.select(*queue.columns, "priority_score", "priority_reason").orderBy(F.desc("priority_score"), F.coalesce(F.col("llm_confidence"), F.lit(0.0)), "edge_key")


def namespaced(nodes: DataFrame, edges: DataFrame, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Clause ids without a document get it as a prefix, in nodes and edges; terms keep theirs."""
    own = F.col("doc_id") if "doc_id" in nodes.columns else F.lit(None).cast("string")
    local = F.col("id").startswith("clause::") & own.isNull()
    renamed = nodes.withColumns({"_new": F.when(local, F.concat(F.lit(f"{doc_id}::"), F.col("id"))).otherwise(F.col("id")), "doc_id": F.when(local, F.lit(doc_id)).otherwise(own)})
    out = renamed.withColumn("id", F.col("_new")).drop("_new")
    move = lambda c: F.when(F.col(c).startswith("clause::"), F.concat(F.lit(f"{doc_id}::"), F.col(c))).otherwise(F.col(c))
    return out, edges.withColumns({"src": move("src"), "dst": move("dst")})


def merge(base: tuple[DataFrame, DataFrame] | None, additions: list[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graphs put together: clauses by document, terms by id, new edge keys after those of the base.

    Of a node in several graphs, each attribute comes from the last graph that
    has it. A document that is there already, or twice, is an error.
    """
    names = [d for d, _, _ in additions]
    if len(set(names)) < len(names):
        raise ValueError("a document is added twice")
    nodes, edges, start = None, None, 0
    if base is not None:
        nodes, edges = base
        there = nodes.where(F.col("doc_id").isin(*names)).select("doc_id").limit(1).collect() if "doc_id" in nodes.columns and names else []
        if there:
            raise ValueError(f"{there[0][0]} is in the base already")
        largest = edges.agg(F.max("key")).first()[0]
        start = 0 if largest is None else largest + 1
        nodes = nodes.withColumn("_src", F.lit(0))
    for k, (doc_id, more_nodes, more_edges) in enumerate(additions, 1):
        n, e = namespaced(more_nodes, more_edges, doc_id)
        e = e.withColumn("_add", F.lit(k))
        n = n.withColumn("_src", F.lit(k))
        nodes = n if nodes is None else nodes.unionByName(n, allowMissingColumns=True)
        edges = e if edges is None else edges.unionByName(e, allowMissingColumns=True)
    rest = [c for c in nodes.columns if c not in ("id", "_src")]
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_src"))).alias(c) for c in rest]
    merged = nodes.groupBy("id").agg(*latest)
    if "_add" not in edges.columns:
        return merged, edges
    old = edges.where(F.col("_add").isNull()).drop("_add")
    new = ordered_index(edges.where(F.col("_add").isNotNull()).withColumnRenamed("key", "_old"), ["_add", "_old", "src", "dst"], "key", start).drop("_add", "_old")
    return merged, old.unionByName(new, allowMissingColumns=True)


def correction_report(edges: DataFrame) -> DataFrame:
    """One row: candidate edges, judged, correct, incorrect, uncertain, kept after dropping the incorrect."""
    c = edges.where(F.col("kind").isin(*CANDIDATES))
    said = lambda v: F.count_if(F.col("llm_verdict") == v).alias(v)
    return c.agg(
        F.count(F.lit(1)).alias("candidates"), F.count("llm_verdict").alias("judged"), said("correct"), said("incorrect"), said("uncertain"),
        F.count_if(F.coalesce(F.col("llm_verdict") != "incorrect", F.lit(True))).alias("kept"),
    )
