"""The clause graph and candidate scoring, over parts, suppliers and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.terms import term_text
from clauseloom.operators import graph as G
from clauseloom.operators import similarity as S
from clauseloom.tables import table

# The same SQL makes the graph in Spark and in DuckDB: parts are clauses, suppliers terms, sold pairs candidate edges.
_EDGES = """SELECT concat('clause::', l_partkey) AS src, concat('term::', l_suppkey) AS dst, l_partkey * 1000000 + l_suppkey AS key,
 CASE WHEN l_suppkey % 2 = 0 THEN 'candidate_class_match' ELSE 'candidate_property_match' END AS kind, round(max(l_discount) * 6, 4) AS composite_score,
 CASE (l_partkey + l_suppkey) % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'uncertain' END AS llm_verdict,
 CASE WHEN (l_partkey + l_suppkey) % 5 < 3 THEN (l_partkey % 7) / 10.0E0 END AS llm_confidence, (l_partkey + l_suppkey) % 10 = 0 AS human_reviewed, l_partkey AS p, l_suppkey AS s
 FROM lineitem GROUP BY l_partkey, l_suppkey"""
_REFS = "SELECT concat('clause::', p_partkey) AS src, concat('clause::', p_partkey + 1) AS dst, p_partkey AS key, 'cross_ref' AS kind, concat('see ', p_partkey) AS label FROM part WHERE p_partkey % 10 < 3"


def _edges(spark: SparkSession, sf_dir: str, refs: bool = False) -> DataFrame:
    rows = spark.sql(_EDGES.replace("FROM lineitem", "FROM {t}"), t=table(spark, sf_dir, "lineitem"))
    if refs:
        rows = rows.unionByName(spark.sql(_REFS.replace("FROM part", "FROM {t}"), t=table(spark, sf_dir, "part")), allowMissingColumns=True)
    return rows


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    ops = F.when(k == 0, F.array(F.lit("SHALL"))).when(k == 1, F.array(F.lit("MAY"), F.lit("SHALL"))).when(k == 2, F.array(F.lit("SHALL NOT"))).otherwise(F.array().cast("array<string>"))
    clause = table(spark, sf_dir, "part").select(
        F.concat(F.lit("clause::"), "p_partkey").alias("id"), F.lit("clause").alias("kind"), F.col("p_partkey").cast("string").alias("ref"), F.col("p_name").alias("heading"), F.col("p_type").alias("text_excerpt"), ops.alias("deontic_operators")
    )
    term = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("term::"), "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "class").otherwise("property").alias("kind"), F.col("s_suppkey").cast("string").alias("uri"), F.col("s_name").alias("name"),
        F.concat(F.lit("S"), "s_suppkey").alias("code"), F.concat(F.lit("Supplier of nation "), "s_nationkey").alias("definition"),
    )
    return clause.unionByName(term, allowMissingColumns=True)


def graph_borderline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.borderline(_edges(spark, sf_dir), top_k=2).select("src", "dst", "key", "kind", "composite_score", "rank")


def graph_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judging tasks with their prompts."""
    return G.clause_tasks(G.borderline(_edges(spark, sf_dir)), _nodes(spark, sf_dir)).select("src", F.size("candidates").alias("n"), "prompt")


def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of several shapes, read leniently."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    one = F.concat(F.lit('{"results": [{"index": 0, "verdict": "correct", "confidence": 0.'), (F.col("p_partkey") % 9).cast("string"), F.lit(', "reason": "fits"}, {"index": 1}, {"verdict": "correct"}]}'))
    reply = F.when(k == 0, one).when(k == 1, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), one, F.lit(" Done."))).otherwise(F.lit("I cannot say."))
    return G.read_replies(p.select("p_partkey", reply.alias("reply")))


def graph_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for every third edge put on the edges; the others keep theirs."""
    edges = _edges(spark, sf_dir)
    given = edges.where("key % 3 = 0").select("src", "dst", "key", F.lit("correct").alias("verdict"), F.lit(0.87654).alias("confidence"), F.lit("ok").alias("reason"))
    return G.apply_verdicts(edges, given, "judge-1").select("key", "llm_verdict", "llm_confidence", "llm_reason", "llm_model")


def graph_drop_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.drop_rejected(_edges(spark, sf_dir)).select("src", "dst", "key", "llm_verdict")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _edges(spark, sf_dir).where("llm_verdict = 'uncertain'").select(F.col("src").alias("clause_id"), F.col("dst").alias("term_id"), F.col("key").alias("edge_key"), "p", "s")
    verdict = F.when(F.col("p") % 3 == 0, "Correct ").when(F.col("p") % 3 == 1, "incorrect").otherwise("")
    return rows.withColumns({"human_verdict": verdict, "human_reviewer": F.when(F.col("s") % 2 == 0, "rev").otherwise(""), "human_reason": F.lit(""), "row": F.col("edge_key"), "edge_key": F.when(F.col("p") % 11 == 0, -1).otherwise(F.col("edge_key"))})


def graph_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = G.apply_decisions(_edges(spark, sf_dir), _decisions(spark, sf_dir), reviewer="team")
    return edges.select("key", "llm_verdict", "human_reviewed", "human_reviewer", "human_reason")


def graph_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.apply_decisions(_edges(spark, sf_dir), _decisions(spark, sf_dir))[1]


def graph_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.grounding(_nodes(spark, sf_dir), _edges(spark, sf_dir, refs=True))
    shown = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["uri"], F.lit(":"), F.round(e["score"], 2), F.lit(":"), e["source"])), ",").alias(c)
    deps = F.array_join(F.transform("dependencies", lambda d: F.concat(d["edge_type"], F.lit(">"), d["target_ref"], F.lit(">"), d["target_text_excerpt"])), ",")
    return rows.select("id", "ref", shown("classes"), shown("properties"), F.col("deontic.modality").alias("modality"), deps.alias("dependencies"))


def graph_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.review_queue(_nodes(spark, sf_dir), _edges(spark, sf_dir)).select("clause_id", "term_id", "edge_key", "clause_heading", "term_kind", "term_name", "lexical_score", "llm_confidence")


def correction_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that reviewers corrected, from the drafts' field differences, with their kind's number of corrections; a class or a property of every draft is corrected here."""
    from clauseloom.operators.matching import field_diffs
    from clauseloom.tables import distinct_by

    drafts = distinct_by(table(spark, sf_dir, "sample_rule_drafts").select("id", "original_proposed_rule", "proposed_rule"), "id").where("proposed_rule IS NOT NULL")
    given = lambda f: F.col(f"proposed_rule.{f}")
    fixed = F.col("proposed_rule").withField("target_ifc_class", F.when(F.col("id") % 3 == 0, F.lit("IfcSlab")).otherwise(given("target_ifc_class")))
    drafts = drafts.withColumn("proposed_rule", fixed.withField("property_name", F.when(F.col("id") % 3 == 1, F.lit("Rise")).otherwise(given("property_name"))))
    terms, counts = G.correction_signal(field_diffs(drafts).where("changed"))
    return terms.join(counts, "term_kind")


def graph_prioritised(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = G.review_queue(_nodes(spark, sf_dir), _edges(spark, sf_dir))
    fixed = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.when(F.col("s_suppkey") % 2 == 0, "target_ifc_class").otherwise("property_name").alias("field"), F.upper("s_name").alias("original"))
    return G.prioritise(queue, *G.correction_signal(fixed)).select("edge_key", "priority_score", "priority_reason")


def graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.correction_report(_edges(spark, sf_dir))


def ontology_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of some nations, the pairs they sold, and the parts in those."""
    classes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uri"), F.concat(F.lit("dict/"), "s_nationkey").alias("dictionary_uri"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("class_uri"), F.col("l_partkey").alias("property_uri")).distinct()
    props = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uri"))
    c, p, l = G.prune_ontology(classes, props, links, ["dict/1"])
    tag = lambda df, what, cols: df.select(F.lit(what).alias("what"), *[F.col(x).cast("bigint").alias(y) for x, y in cols])
    return tag(c, "class", [("uri", "a")]).withColumn("b", F.lit(None).cast("bigint")).unionByName(tag(p, "property", [("uri", "a")]).withColumn("b", F.lit(None).cast("bigint"))).unionByName(tag(l, "link", [("class_uri", "a"), ("property_uri", "b")]))


def _assembled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph assembled from clauses (parts), their references, and matched terms (suppliers) of both kinds, with every candidate edge."""
    nodes = _nodes(spark, sf_dir).where("kind = 'clause'").select("id", "kind", "ref", "heading", "text_excerpt", "deontic_operators")
    refs = table(spark, sf_dir, "part").where("p_partkey % 10 < 3").select(
        F.col("p_partkey").cast("string").alias("source_ref"), (F.col("p_partkey") + 1).cast("string").alias("target_ref"), F.lit("cross_ref").alias("edge_type"), F.concat(F.lit("see "), "p_partkey").alias("label"),
        F.col("p_partkey").alias("seq"), F.lit(0).alias("rank"), F.lit(0).alias("pos"),
    )
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("uri"), F.col("s_name").alias("name"), F.lit("c").alias("code"), F.lit("d").alias("dictionary_uri"), F.lit("Class").alias("class_type"), F.lit("Real").alias("data_type"), F.lit("def").alias("definition"), F.col("s_suppkey").alias("n"))
    links = sup.where("n % 2 = 0").select(F.col("uri").alias("class_uri"), (F.col("n") + 1).cast("string").alias("property_uri"), F.lit("Pset").alias("property_set"))
    candidates = _edges(spark, sf_dir)
    matches = candidates.select(F.col("p").cast("string").alias("clause_id"), F.col("s").cast("string").alias("term_id"), "s", F.col("composite_score").alias("composite"), *[F.col("composite_score").alias(x) for x in ("tfidf_cosine", "jaccard_tokens", "fuzz_ratio", "exact_substring")])
    return G.assemble(nodes, refs, sup.where("n % 2 = 0").drop("n", "data_type"), sup.where("n % 2 = 1").drop("n", "dictionary_uri", "class_type"), links, matches.where("s % 2 = 0").drop("s"), matches.where("s % 2 = 1").drop("s"))


def graph_assemble_all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir)[0].select("id", "kind", "name")


def graph_assemble_all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate edge assembled and numbered."""
    return _assembled(spark, sf_dir)[1].select("src", "dst", F.col("key").cast("bigint").alias("key"), "kind", "label", "property_set", "composite_score")


def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part graph appended to another: terms unite by id, clauses by document, keys go on after the base's."""
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir).select("src", "dst", "key", "kind")
    base = G.namespaced(nodes, edges.where("key % 2 = 0"), "a")
    merged_nodes, merged_edges = G.merge(base, [("b", nodes.withColumn("heading", F.upper("heading")), edges.where("key % 2 = 1"))])
    n = merged_nodes.select(F.lit("node").alias("what"), "id", F.coalesce("doc_id", F.lit("")).alias("doc"), F.coalesce("heading", "name").alias("text"), F.lit(0).cast("bigint").alias("key"))
    e = merged_edges.select(F.lit("edge").alias("what"), F.col("src").alias("id"), F.lit("").alias("doc"), F.col("dst").alias("text"), F.col("key").cast("bigint"))
    return n.unionByName(e)


def graph_merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph whose largest edge key is 0, and one of all nations, appended: keys go on after 0."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    node = lambda df, key, name: df.select(F.concat(F.lit("clause::"), key).alias("id"), F.lit("clause").alias("kind"), F.col(name).alias("heading"))
    one = region.agg(F.min("r_regionkey").alias("k")).select(F.concat(F.lit("clause::"), "k").alias("src"), F.lit("term::x").alias("dst"), F.lit(0).cast("bigint").alias("key"), F.lit("self").alias("kind"))
    many = nation.select(F.concat(F.lit("clause::"), "n_nationkey").alias("src"), F.concat(F.lit("term::"), "n_regionkey").alias("dst"), F.col("n_nationkey").cast("bigint").alias("key"), F.lit("in").alias("kind"))
    base = G.merge(None, [("a", node(region, "r_regionkey", "r_name"), one)])
    edges = G.merge(base, [("b", node(nation, "n_nationkey", "n_name"), many)])[1]
    return edges.select("src", "dst", F.col("key").cast("bigint").alias("key"), "kind")


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clause_id"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("heading"), F.coalesce("text", F.lit("")).alias("text"))
    t = table(spark, sf_dir, "canonical_terms")
    blob = term_text(F.col("name"), F.col("definition"), F.array_join("aliases", " "))
    return docs, t.select(F.format_string("%05d", "term_id").alias("term_id"), "name", blob.alias("text"))


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three terms nearest to each document by cosine; documents without common words get the first terms."""
    short = S.cosine_shortlist(*_corpus(spark, sf_dir), top_k=3)
    return short.select("clause_id", "term_id", F.round("tfidf_cosine", 6).alias("cosine"))


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite scores without the fuzzy signal, which SQL cannot compute."""
    weights = {"tfidf_cosine": 0.5, "jaccard_tokens": 0.3, "exact_substring": 0.2}
    rows = S.score_candidates(*_corpus(spark, sf_dir), "term", top_k=5, weights=weights)
    return rows.select("clause_id", "term_id", *[F.round(c, 5).alias(c) for c in ("composite", "tfidf_cosine", "jaccard_tokens", "exact_substring")])


def candidate_scores_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite scores with all four signals: parts as clauses, the kinds of parts as terms."""
    p = table(spark, sf_dir, "part")
    words = F.concat(F.lower("p_type"), F.lit(" "), "p_name")
    docs = p.select(F.col("p_partkey").alias("clause_id"), F.col("p_name").alias("heading"), F.concat("p_brand", F.lit(" "), words).alias("text"))
    terms = p.groupBy(words.alias("name")).agg(F.format_string("%09d", F.min("p_partkey")).alias("term_id")).select("term_id", "name", F.col("name").alias("text"))
    rows = S.score_candidates(docs, terms, "part", top_k=5)
    return rows.select("clause_id", "term_id", *[F.round(c, 5).alias(c) for c in ("composite", "tfidf_cosine", "jaccard_tokens", "fuzz_ratio", "exact_substring")])


def candidate_scores_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite scores with all four signals, separately for classes and properties."""
    docs, _ = _corpus(spark, sf_dir)
    t = table(spark, sf_dir, "canonical_terms")
    out = None
    for field, kind in (("target_ifc_class", "class"), ("property_name", "property")):
        terms = t.where(F.col("field") == field).select(F.format_string("%05d", "term_id").alias("term_id"), "name", term_text(F.col("name"), F.col("definition"), F.array_join("aliases", " ")).alias("text"))
        part = S.score_candidates(docs, terms, kind)
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        graph_borderline, graph_tasks, reply_parse, graph_verdicts, graph_drop_rejected, graph_decisions, graph_decision_counts, graph_grounding, graph_review_queue, correction_signal, graph_prioritised,
        graph_report, ontology_prune, graph_assemble_all_nodes, graph_assemble_all_edges, graph_merge, graph_merge_small, tfidf_topk, candidate_scores, candidate_scores_parts, candidate_scores_full,
    )
}

_W = f"WITH e AS ({_EDGES}), x AS ({_REFS}) "
_TRUST = """, t AS (SELECT *, CASE WHEN (llm_verdict = 'correct' OR (llm_verdict IS NULL AND composite_score >= 0.45)) AND human_reviewed THEN 'human_verified' WHEN llm_verdict = 'correct' THEN 'llm_verified'
 WHEN llm_verdict IS NULL AND composite_score >= 0.45 THEN 'lexical_high_confidence' END AS source FROM e),
 g AS (SELECT src, kind, string_agg(concat(s, ':', round(composite_score, 2), ':', source), ',' ORDER BY composite_score DESC, key) AS l FROM t WHERE source IS NOT NULL GROUP BY 1, 2) """
_TFIDF = """WITH d AS (SELECT concat('d', doc_id) AS id, 0 AS side, coalesce(text, '') AS text FROM documents UNION ALL
  SELECT concat('t', lpad(CAST(term_id AS VARCHAR), 5, '0')), 1, concat(coalesce(name, ''), '. ', coalesce(definition, ''), ' ', coalesce(array_to_string(aliases, ' '), '')) FROM canonical_terms),
 tok AS (SELECT id, side, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM d), tf AS (SELECT id, side, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 w AS (SELECT id, side, tf.term, tf * (ln((1 + (SELECT count(*) FROM d)) / (1.0 + df)) + 1) AS w FROM tf JOIN df ON tf.term = df.term), n AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1),
 u AS (SELECT w.id, side, term, w / n AS w FROM w JOIN n ON w.id = n.id), c AS (SELECT a.id AS c, b.id AS t, sum(a.w * b.w) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.side = 0 AND b.side = 1 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(cosine, 9) DESC, t) AS r FROM c), k AS (SELECT c, t, cosine FROM r WHERE r <= {k}), h AS (SELECT c, count(*) AS have FROM k GROUP BY 1),
 gap AS (SELECT d.id AS c, {k} - coalesce(have, 0) AS miss FROM d LEFT JOIN h ON d.id = h.c WHERE side = 0 AND coalesce(have, 0) < {k}),
 f AS (SELECT gap.c, d.id AS t, miss, row_number() OVER (PARTITION BY gap.c ORDER BY d.id) AS r FROM gap, d WHERE d.side = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.c = gap.c AND k.t = d.id)),
 s AS (SELECT * FROM k UNION ALL SELECT c, t, 0.0 FROM f WHERE r <= miss) """
# cosines of parts and their kinds, then the finer signals of the pairs chosen; common lengths row by row
_PARTS = ("""WITH RECURSIVE q AS (SELECT lower(p_type) || ' ' || p_name AS name, lpad(CAST(min(p_partkey) AS VARCHAR), 9, '0') AS term_id FROM part GROUP BY 1),
 d AS (SELECT concat('d', p_partkey) AS id, 0 AS side, concat(p_brand, ' ', lower(p_type), ' ', p_name) AS text FROM part UNION ALL SELECT concat('t', term_id), 1, name FROM q),
 tok AS""" + _TFIDF.split(" tok AS", 1)[1]).replace("{k}", "5") + """, z AS (SELECT CAST(substr(c, 2) AS BIGINT) AS clause_id, substr(t, 2) AS term_id, cosine, p_name AS h, name AS n FROM s JOIN part ON p_partkey = CAST(substr(c, 2) AS BIGINT) JOIN q ON q.term_id = substr(t, 2)),
 w2 AS (SELECT DISTINCT h, n, array_to_string(list_sort(string_split(h, ' ')), ' ') AS x, array_to_string(list_sort(string_split(n, ' ')), ' ') AS y FROM z),
 l AS (SELECT h, n, x, y, 0 AS i, list_transform(range(length(y) + 1), lambda k: CAST(0 AS BIGINT)) AS best FROM w2
  UNION ALL SELECT h, n, x, y, i + 1, list_transform(range(length(y) + 1), lambda k: list_max(o[1:k + 1])) FROM (
   SELECT *, list_transform(range(length(y) + 1), lambda k: greatest(best[k + 1], CASE WHEN k > 0 AND substr(x, i + 1, 1) = substr(y, k, 1) THEN best[k] + 1 ELSE 0 END)) AS o FROM l WHERE i < length(x))),
 v AS (SELECT z.*, 2.0 * best[length(y) + 1] / (length(x) + length(y)) AS fuzz, CASE WHEN contains(lower(z.h), lower(z.n)) OR contains(lower(z.n), lower(z.h)) THEN 1.0 ELSE 0 END AS sub,
  len(list_intersect(list_distinct(string_split(lower(z.h), ' ')), list_distinct(string_split(lower(z.n), ' ')))) * 1.0 / len(list_distinct(list_concat(string_split(lower(z.h), ' '), string_split(lower(z.n), ' ')))) AS jac
  FROM z JOIN l ON z.h = l.h AND z.n = l.n WHERE i = length(x)), e4 AS (SELECT *, 0.4 * cosine + 0.25 * jac + 0.2 * fuzz + 0.15 * sub AS m FROM v)
 SELECT clause_id, term_id, round(m, 5) AS composite, round(cosine, 5) AS tfidf_cosine, round(jac, 5) AS jaccard_tokens, round(fuzz, 5) AS fuzz_ratio, CAST(round(sub, 5) AS DOUBLE) AS exact_substring FROM e4 WHERE m >= 0.05"""
ORACLE_SQL = {
    "candidate_scores_parts": _PARTS,
    "graph_borderline": _W + "SELECT src, dst, key, kind, composite_score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src, kind ORDER BY composite_score DESC, key) AS r FROM e WHERE composite_score BETWEEN 0.15 AND 0.45) WHERE r <= 2",
    "graph_tasks": _W + r""", b AS (SELECT *, row_number() OVER (PARTITION BY src, kind ORDER BY composite_score DESC, key) AS r FROM e WHERE composite_score BETWEEN 0.15 AND 0.45),
 o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY kind, r) - 1 AS i FROM b WHERE r <= 5),
 l AS (SELECT src, p, count(*) AS n, string_agg(concat('[', i, '] (', CASE WHEN kind = 'candidate_class_match' THEN 'class' ELSE 'property' END, ', score ', printf('%.3f', composite_score), ') ', s_name, ' | S', s, ' | Supplier of nation ', s_nationkey), chr(10) ORDER BY i) AS lines
  FROM o JOIN supplier ON s_suppkey = s GROUP BY 1, 2)
 SELECT src, CAST(n AS INTEGER) AS n, concat('Clause ', p, ': ', p_name, chr(10), p_type, chr(10), chr(10), 'Which of these terms does the clause speak of? Answer as JSON {"results": [{"index", "verdict", "confidence", "reason"}]}.', chr(10), lines) AS prompt FROM l JOIN part ON p_partkey = p""",
    "reply_parse": """SELECT p_partkey, i AS index, CASE i WHEN 0 THEN 'correct' ELSE 'uncertain' END AS verdict, CASE i WHEN 0 THEN (p_partkey % 9) / 10.0 ELSE 0 END AS confidence, CASE i WHEN 0 THEN 'fits' ELSE '' END AS reason FROM part, (VALUES (0), (1)) AS v(i) WHERE p_partkey % 4 < 3""",
    "graph_verdicts": _W + "SELECT key, CASE WHEN key % 3 = 0 THEN 'correct' ELSE llm_verdict END AS llm_verdict, CASE WHEN key % 3 = 0 THEN 0.8765 ELSE llm_confidence END AS llm_confidence, CASE WHEN key % 3 = 0 THEN 'ok' END AS llm_reason, CASE WHEN key % 3 = 0 THEN 'judge-1' END AS llm_model FROM e",
    "graph_drop_rejected": _W + "SELECT src, dst, key, llm_verdict FROM e WHERE llm_verdict IS NULL OR llm_verdict <> 'incorrect'",
    "graph_decisions": _W + """, d AS (SELECT key, CASE p % 3 WHEN 0 THEN 'correct' ELSE 'incorrect' END AS v, CASE WHEN s % 2 = 0 THEN 'rev' ELSE 'team' END AS r FROM e WHERE llm_verdict = 'uncertain' AND p % 3 < 2 AND p % 11 <> 0)
 SELECT e.key, coalesce(v, llm_verdict) AS llm_verdict, CASE WHEN v IS NOT NULL THEN true ELSE human_reviewed END AS human_reviewed, r AS human_reviewer, CAST(NULL AS VARCHAR) AS human_reason FROM e LEFT JOIN d ON e.key = d.key""",
    "graph_decision_counts": _W + "SELECT CAST(count(*) FILTER (WHERE p % 11 <> 0) AS BIGINT) AS n_applied, CAST(count(*) FILTER (WHERE p % 11 = 0) AS BIGINT) AS n_missing FROM e WHERE llm_verdict = 'uncertain' AND p % 3 < 2",
    "graph_grounding": _W + _TRUST + """SELECT concat('clause::', p_partkey) AS id, CAST(p_partkey AS VARCHAR) AS ref, coalesce(a.l, '') AS classes, coalesce(b.l, '') AS properties, CASE WHEN p_partkey % 4 = 0 THEN 'shall' END AS modality,
 CASE WHEN p_partkey % 10 < 3 AND n.t IS NOT NULL THEN concat('cross_ref>', p_partkey + 1, '>', n.t) ELSE '' END AS dependencies FROM part LEFT JOIN g a ON a.src = concat('clause::', p_partkey) AND a.kind = 'candidate_class_match'
 LEFT JOIN g b ON b.src = concat('clause::', p_partkey) AND b.kind = 'candidate_property_match' LEFT JOIN (SELECT p_partkey - 1 AS q, p_type AS t FROM part) n ON n.q = p_partkey""",
    "graph_review_queue": _W + "SELECT src AS clause_id, dst AS term_id, key AS edge_key, p_name AS clause_heading, CASE WHEN s % 2 = 0 THEN 'class' ELSE 'property' END AS term_kind, s_name AS term_name, composite_score AS lexical_score, llm_confidence FROM e JOIN part ON p_partkey = p JOIN supplier ON s_suppkey = s WHERE llm_verdict = 'uncertain'",
    "correction_signal": """WITH d AS (SELECT DISTINCT id, original_proposed_rule AS o, proposed_rule AS n FROM sample_rule_drafts WHERE proposed_rule IS NOT NULL),
 f AS (SELECT 'class' AS k, o.target_ifc_class AS a, CASE WHEN id % 3 = 0 THEN 'IfcSlab' ELSE n.target_ifc_class END AS b FROM d
 UNION ALL SELECT 'property', o.property_name, CASE WHEN id % 3 = 1 THEN 'Rise' ELSE n.property_name END FROM d UNION ALL SELECT 'property', o.property_set, n.property_set FROM d),
 g AS (SELECT k, regexp_replace(lower(coalesce(a, '')), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS a, regexp_replace(lower(coalesce(b, '')), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS b FROM f), c AS (SELECT * FROM g WHERE a <> b)
 SELECT DISTINCT k AS term_kind, a AS term, CAST(n AS BIGINT) AS n FROM c JOIN (SELECT k AS kk, count(*) AS n FROM c GROUP BY 1) ON k = kk WHERE a <> ''""",
    "graph_prioritised": _W + """, f AS (SELECT lower(s_name) AS t, CASE WHEN s_suppkey % 2 = 0 THEN 'class' ELSE 'property' END AS k FROM supplier WHERE s_suppkey % 5 = 0), c AS (SELECT k, count(*) AS n FROM f GROUP BY 1), a AS (SELECT count(*) AS total FROM f),
 q AS (SELECT key, s_name, CASE WHEN s % 2 = 0 THEN 'class' ELSE 'property' END AS k FROM e JOIN supplier ON s_suppkey = s WHERE llm_verdict = 'uncertain'), b AS (SELECT q.*, EXISTS (SELECT 1 FROM f WHERE f.k = q.k AND f.t = lower(q.s_name)) AS x FROM q)
 SELECT key AS edge_key, round(CASE WHEN x THEN 1000 ELSE 0 END + n * 10.0 / total, 4) AS priority_score, CASE WHEN x THEN concat('this ', b.k, ' was corrected before: ', s_name) ELSE concat(n, ' of ', total, ' corrections were of this kind') END AS priority_reason FROM b JOIN c ON b.k = c.k, a""",
    "graph_report": _W + "SELECT CAST(count(*) AS BIGINT) AS candidates, CAST(count(llm_verdict) AS BIGINT) AS judged, CAST(count(*) FILTER (WHERE llm_verdict = 'correct') AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE llm_verdict = 'incorrect') AS BIGINT) AS incorrect, CAST(count(*) FILTER (WHERE llm_verdict = 'uncertain') AS BIGINT) AS uncertain, CAST(count(*) FILTER (WHERE llm_verdict IS NULL OR llm_verdict <> 'incorrect') AS BIGINT) AS kept FROM e",
    "ontology_prune": """WITH c AS (SELECT s_suppkey FROM supplier WHERE contains(concat('dict/', s_nationkey), 'dict/1')), l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM c))
 SELECT 'class' AS what, CAST(s_suppkey AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM c UNION ALL SELECT DISTINCT 'property', l_partkey, NULL FROM l UNION ALL SELECT 'link', l_suppkey, l_partkey FROM l""",
    "graph_assemble_all_nodes": _W + """, m AS (SELECT DISTINCT s FROM e), u AS (SELECT s FROM m UNION SELECT s + 1 FROM m WHERE s % 2 = 0)
 SELECT concat('clause::', p_partkey) AS id, 'clause' AS kind, CAST(NULL AS VARCHAR) AS name FROM part UNION ALL SELECT concat('term::', s_suppkey), CASE WHEN s_suppkey % 2 = 0 THEN 'class' ELSE 'property' END, s_name FROM supplier WHERE s_suppkey IN (SELECT s FROM u)""",
    "graph_assemble_all_edges": _W + """, m AS (SELECT * FROM e), a AS (
 SELECT 0 AS rk, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS o1, '' AS o2, src, dst, kind, label, CAST(NULL AS VARCHAR) AS property_set, CAST(NULL AS DOUBLE) AS composite_score FROM x JOIN part ON key = p_partkey WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)
 UNION ALL SELECT 1, CAST(s_suppkey AS VARCHAR), CAST(s_suppkey + 1 AS VARCHAR), concat('term::', s_suppkey), concat('term::', s_suppkey + 1), 'class_has_property', NULL, 'Pset', NULL FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey IN (SELECT s FROM m) AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)
 UNION ALL SELECT CASE WHEN s % 2 = 0 THEN 2 ELSE 3 END, CAST(p AS VARCHAR), CAST(s AS VARCHAR), src, dst, kind, NULL, NULL, composite_score FROM m)
 SELECT src, dst, CAST(row_number() OVER (ORDER BY rk, o1, o2, src, dst) - 1 AS BIGINT) AS key, kind, label, property_set, composite_score FROM a""",
    "graph_merge": _W + """, b AS (SELECT max(key) AS m FROM e WHERE key % 2 = 0)
 SELECT 'node' AS what, concat(d, '::clause::', p_partkey) AS id, d AS doc, CASE d WHEN 'b' THEN upper(p_name) ELSE p_name END AS text, CAST(0 AS BIGINT) AS key FROM part, (VALUES ('a'), ('b')) AS v(d)
 UNION ALL SELECT 'node', concat('term::', s_suppkey), '', s_name, 0 FROM supplier UNION ALL SELECT 'edge', concat('a::', src), '', dst, key FROM e WHERE key % 2 = 0
 UNION ALL SELECT 'edge', concat('b::', src), '', dst, m + row_number() OVER (ORDER BY key) FROM e, b WHERE key % 2 = 1""",
    "graph_merge_small": """SELECT concat('a::clause::', min(r_regionkey)) AS src, 'term::x' AS dst, CAST(0 AS BIGINT) AS key, 'self' AS kind FROM region
 UNION ALL SELECT concat('b::clause::', n_nationkey), concat('term::', n_regionkey), row_number() OVER (ORDER BY n_nationkey), 'in' FROM nation""",
    "tfidf_topk": _TFIDF.replace("{k}", "3") + "SELECT CAST(substr(c, 2) AS BIGINT) AS clause_id, substr(t, 2) AS term_id, round(cosine, 6) AS cosine FROM s",
    "candidate_scores": _TFIDF.replace("{k}", "5") + """, x AS (SELECT s.*, lower(trim(split_part(coalesce(text, ''), chr(10), 1))) AS h, list_distinct(regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '[a-z0-9]+')) AS ht, lower(trim(name)) AS n, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS nt
  FROM s JOIN documents ON CAST(substr(c, 2) AS BIGINT) = doc_id JOIN canonical_terms ON CAST(substr(t, 2) AS BIGINT) = term_id),
 y AS (SELECT c, t, cosine, CASE WHEN len(ht) > 0 AND len(nt) > 0 THEN len(list_intersect(ht, nt)) * 1.0 / len(list_distinct(list_concat(ht, nt))) ELSE 0 END AS j, CASE WHEN h <> '' AND n <> '' AND (contains(h, n) OR contains(n, h)) THEN 1.0 ELSE 0 END AS u FROM x)
 SELECT CAST(substr(c, 2) AS BIGINT) AS clause_id, substr(t, 2) AS term_id, round(0.5 * cosine + 0.3 * j + 0.2 * u, 5) AS composite, round(cosine, 5) AS tfidf_cosine, round(j, 5) AS jaccard_tokens, round(u, 5) AS exact_substring FROM y WHERE 0.5 * cosine + 0.3 * j + 0.2 * u >= 0.05""",
}
