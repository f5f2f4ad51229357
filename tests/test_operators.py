"""Statistics, documents, graph, matching, labels, runs and files on small inputs."""

import itertools
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import stats
from clauseloom.operators import compliance, documents, graph, labels, matching, runs, similarity
from clauseloom.plans import stat_queries
from clauseloom.sources import files, sinks
from conftest import DATA, rows, same_rows


def test_confusion_and_wilson(spark):
    df = spark.createDataFrame([(20, 2, 5, 23), (0, 0, 0, 0)], "tp INT, fp INT, fn INT, tn INT")
    m = df.select(*[c.alias(k) for k, c in stats.confusion_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]).items()]).collect()
    assert m[0]["recall"] == 0.8 and m[0]["precision"] == pytest.approx(0.9091) and all(v == 0 for v in m[1])
    for lo, p, hi in ((m[0][f"{k}_lower"], m[0][k], m[0][f"{k}_upper"]) for k in ("accuracy", "recall", "precision", "specificity")):
        assert 0 <= lo <= p <= hi <= 1


def test_kappa_edges(spark):
    k = lambda pairs, rule: rows(stats.cohen_kappa(spark.createDataFrame(pairs, "g INT, a STRING, b STRING"), "a", "b", ["g"], rule).select("kappa"))
    assert k([(1, "x", "x"), (1, "x", "x")], "categories") == [(1.0,)] and k([(1, "x", "x"), (1, "x", "x")], "observed") == [(1.0,)]
    assert k([(1, "x", "y"), (1, "y", "x")], "categories") == [(-1.0,)]
    assert k([(1, None, "x")], "categories") == []


def test_fleiss_and_correlations(spark):
    long = spark.createDataFrame([(i, c) for i, cs in enumerate(("aaa", "bbb", "aab")) for c in cs], "i INT, c STRING")
    r = stats.fleiss_kappa(long, ["i"], "c", [], 3).first()
    assert r["n_items"] == 3 and r["kappa"] == pytest.approx((7 / 9 - 41 / 81) / (1 - 41 / 81))
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 3.0, 6.0), (2, 1.0, 1.0)], "g INT, x DOUBLE, y DOUBLE")
    got = {r["g"]: r for r in stats.correlations(df, "x", "y", ["g"]).collect()}
    assert got[1]["pearson"] == pytest.approx(1) and got[1]["spearman"] == pytest.approx(1) and got[2]["pearson"] == 0 and got[1]["mae"] == 2


def test_bootstrap(spark):
    df = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("v"))
    b = stats.bootstrap(df, [], lambda w: F.sum(F.col("v") * w) / F.sum(w), ["id"], resamples=200).first()
    assert b["estimate"] == 4.5 and 3.9 < b["lower"] < 4.5 < b["upper"] < 5.1
    small = spark.createDataFrame([(1, k, float(k)) for k in range(5)], "g INT, pos INT, v DOUBLE")
    draws = stats.draw_table(spark, [5], 100)
    rng = random.Random(42)
    means = sorted(sum(rng.randint(0, 4) for _ in range(5)) / 5 for _ in range(100))
    assert rows(stats.bootstrap_indexed(small, ["g"], "pos", "v", draws)) == [(1, 2.0, round(means[2], 4), round(means[97], 4))]


def _broadcast_bytes(plan):
    """Bytes of all broadcasts of a plan that has run."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _broadcast_bytes(plan.executedPlan())
    own = plan.metrics().apply("dataSize").value() if plan.nodeName() == "BroadcastExchange" else 0
    below = [plan.plan()] if plan.nodeName().endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    return own + sum(map(_broadcast_bytes, below))


def test_bootstrap_sends_no_draws(spark, tmp_path):
    sent = tmp_path / "supplier.parquet"
    spark.range(1000).selectExpr("id AS s_suppkey", "CAST(id >= 940 AS INT) AS s_nationkey", "id * 7919 % 100003 / 100D AS s_acctbal").write.parquet(str(sent))
    df = stat_queries.QUERIES["bootstrap_indexed"](spark, str(tmp_path))
    sql = stat_queries.ORACLE_SQL["bootstrap_indexed"].replace("FROM supplier", f"FROM read_parquet('{sent}/*.parquet')")
    same_rows(df, sql, DATA)
    df.collect()
    assert _broadcast_bytes(df._jdf.queryExecution().executedPlan()) < 10 << 20  # a million draws take more


@pytest.mark.parametrize(("array_rows", "few_draws"), [(1000, 10**6), (6, 10**6), (6, 0), (0, 0)])
def test_bootstrap_by_rule_and_by_table(spark, monkeypatch, array_rows, few_draws):
    groups = {"a": [1.0], "b": [float(k) for k in range(5)], "c": [None, *range(6)], "d": [k * 0.01 for k in range(40)], "e": [None, None]}
    df = spark.createDataFrame([(g, k, v if v is None else float(v)) for g, vs in groups.items() for k, v in enumerate(vs)], "g STRING, pos INT, v DOUBLE")
    rule = lambda n, b, pos: (b * 31 + pos * 17 + b * pos * 7) % 1009 % n
    draws = spark.createDataFrame([(n, b, p, rule(n, b, p)) for n in {len(v) for v in groups.values()} for b in range(50) for p in range(n)], "n INT, b INT, pos INT, idx INT")
    want = []
    for g, vs in groups.items():
        drawn = [[vs[rule(len(vs), b, p)] for p in range(len(vs))] for b in range(50)]
        means = sorted(sum(x) / len(x) for d in drawn if (x := [v for v in d if v is not None]))
        have = [v for v in vs if v is not None]
        want.append((g, *([round(x + 1e-9, 4) for x in (sum(have) / len(have), means[int(len(means) * 0.025)], means[min(int(len(means) * 0.975), len(means) - 1)])] if have else [None] * 3)))
    monkeypatch.setattr(stats, "ARRAY_ROWS", array_rows)
    monkeypatch.setattr(stats, "FEW_DRAWS", few_draws)
    assert sorted(rows(stats.bootstrap_indexed(df, ["g"], "pos", "v", rule, resamples=50))) == want
    assert sorted(rows(stats.bootstrap_indexed(df, ["g"], "pos", "v", draws))) == want


MARKUP = '<d><heading level="1">9.8 Stairs</heading><text>one shall</text><text>two</text><heading level="2">9.8.4. Treads</heading><table><fcel/>Run<fcel/>Rise<nl/><fcel/>255<nl/></table><heading>Last</heading></d>'


def test_documents(spark):
    df = spark.createDataFrame([(1, MARKUP), (2, "<bad"), (3, None), (4, '<!DOCTYPE x [<!ENTITY e "x">]><d><text>a</text></d>'), (5, "<d><p>before</p><heading>H</heading></d>"), (6, "")], "doc_id INT, xml STRING")
    n = documents.nodes(df)
    got = rows(n.where("doc_id = 1").orderBy("ord").select("tag", "section_number", "section_name", F.array_join("section_path", "/")))
    assert got == [("heading", "9.8", "Stairs", "9.8"), ("text", "9.8", "Stairs", "9.8"), ("text", "9.8", "Stairs", "9.8"), ("heading", "9.8.4", "Treads", "9.8/9.8.4"), ("table", "9.8.4", "Treads", "9.8/9.8.4"), ("heading", None, "Last", "Last")]
    assert {r[0] for r in rows(n.select("doc_id").distinct())} == {1, 5}
    table = n.where("tag = 'table'").first()["text"]
    assert table == "| Run | Rise |\n| --- | --- |\n| 255 |  |"
    assert rows(documents.chunks(n).orderBy("doc_id", "section_seq").select("doc_id", "section_seq", "text")) == [(1, 1, "one shall\n\ntwo"), (1, 2, table), (5, 0, "before")]
    assert rows(documents.clauses(n).orderBy("doc_id", "clause_seq").select("doc_id", "ref", "text")) == [(1, "9.8", "one shall\n\ntwo"), (1, "9.8.4", table), (1, "H3", ""), (5, "PREAMBLE-1", "before"), (5, "H1", "")]
    marked = {r[0]: r[1] for r in rows(documents.inject(df, n))}
    assert marked[2] == "<bad" and marked[3] is None and 'operator="SHALL"' in marked[1]
    again = documents.nodes(spark.createDataFrame([(1, marked[1])], "doc_id INT, xml STRING")).orderBy("ord")
    assert rows(again.select("text")) == rows(n.where("doc_id = 1").orderBy("ord").select("text"))


def test_header_cells_merge_unless_strict():
    root = documents.parse("<d><table><ched/>Method<ched/>Accuracy<nl/><fcel/>a<fcel/>b<nl/></table></d>")
    assert documents.table_rows(root[0])[0] == ["MethodAccuracy"] and documents.table_rows(root[0], strict=True)[0] == ["Method", "Accuracy"]


def test_stitch_needs_single_roots(spark):
    df = spark.createDataFrame([(1, 1, "<a x='1'><p>1</p></a>"), (1, 2, "<a><p>2</p></a>")], "k INT, o INT, xml STRING")
    assert rows(documents.stitch(df, "k", "o")) == [(1, "<a x='1'><p>1</p><p>2</p></a>")]
    with pytest.raises(Exception, match="single root"):
        documents.stitch(spark.createDataFrame([(1, 1, "<a/><b/>")], "k INT, o INT, xml STRING"), "k", "o").collect()


def test_shortlist_fills_gaps_and_scores(spark):
    c = spark.createDataFrame([(1, "door", "clear width of a door"), (2, "none", "zzz"), (3, None, None)], "clause_id INT, heading STRING, text STRING")
    t = spark.createDataFrame([("a", "Door", "door leaf"), ("b", "Wall", "wall width"), ("c", "Roof", "roof")], "term_id STRING, name STRING, text STRING")
    c = c.withColumn("text", F.coalesce("text", F.lit("")))
    short = similarity.cosine_shortlist(c, t, 2)
    assert sorted((r["clause_id"], r["term_id"]) for r in short.collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b")]
    best = similarity.score_candidates(c, t, "class").where("clause_id = 1").orderBy(F.desc("composite")).first()
    assert best["term_id"] == "a" and best["exact_substring"] == 1 and best["composite"] > 0.45
    assert similarity.score_candidates(c.where("false"), t, "class").count() == 0 and similarity.score_candidates(c, t.where("false"), "class").count() == 0


def test_top_k_limits_groups_early(spark):
    e = spark.createDataFrame([("a", "t", 1, "candidate_class_match", 0.3)], "src STRING, dst STRING, key BIGINT, kind STRING, composite_score DOUBLE")
    assert "WindowGroupLimit" in graph.borderline(e)._jdf.queryExecution().executedPlan().toString()


def test_decisions_fail_fast(spark):
    bad = spark.createDataFrame([("c", "t", "maybe")], "clause_id STRING, term_id STRING, human_verdict STRING")
    with pytest.raises(Exception, match="neither correct"):
        graph.checked_decisions(bad).collect()


def test_merge_rejects_known_documents(spark):
    n = spark.createDataFrame([("clause::1", "clause", None)], "id STRING, kind STRING, doc_id STRING")
    e = spark.createDataFrame([("clause::1", "clause::1", 0)], "src STRING, dst STRING, key BIGINT")
    nodes, edges = graph.merge(None, [("a", n, e), ("b", n, e)])
    assert sorted(r[0] for r in rows(nodes.select("id"))) == ["a::clause::1", "b::clause::1"] and sorted(r[0] for r in rows(edges.select("key"))) == [0, 1]
    with pytest.raises(ValueError):
        graph.merge((nodes, edges), [("a", n, e)])
    again, _ = graph.merge((nodes, edges), [("c", n, e)])
    assert again.count() == 3


def test_ordered_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = rows(graph.ordered_index(df, ["v"], "n", 5).orderBy("n").select("n", "v"))
    assert got == [(k + 5, k) for k in range(1000)]


def brute_greedy(pairs):
    a_used, b_used, out = set(), set(), []
    for part, a, b in sorted(pairs):
        if (part, a) not in a_used and (part, b) not in b_used:
            a_used.add((part, a))
            b_used.add((part, b))
            out.append((part, a, b))
    return out


def test_greedy_assignment(spark):
    rng = random.Random(3)
    pairs = sorted({(rng.randint(0, 9), rng.randint(0, 15), rng.randint(0, 15)) for _ in range(700)})
    df = spark.createDataFrame(pairs, "p INT, a INT, b INT").repartition(5)
    assert sorted(rows(matching.greedy(df, "a", "b", ["p"]))) == brute_greedy(pairs)
    assert matching.greedy(df.where("false"), "a", "b", ["p"]).count() == 0


def iou(a, b):
    common, union = max(0, min(a[1], b[1]) - max(a[0], b[0])), max(a[1], b[1]) - min(a[0], b[0])
    return common / union if union > 0 else 0


def test_span_agreement_against_brute_force(spark):
    rng = random.Random(4)
    spans = []
    for task, who in itertools.product("tuv", (1, 2, 3)):
        if (task, who) != ("v", 3):
            for o in range(6):
                s = rng.randint(0, 20)
                spans.append((task, who, s, s + rng.randint(0, 6), rng.choice("AB"), o))
    df = spark.createDataFrame(spans, "task STRING, annotator INT, start INT, end INT, label STRING, ord INT")
    got = {(r["a"], r["b"], r["label"]): r["tp"] for r in matching.span_agreement(df).collect()}
    for a, b in itertools.combinations((1, 2, 3), 2):
        tp = {"A": 0, "B": 0}
        for task in "tuv":
            mine, theirs = ([s for s in spans if s[0] == task and s[1] == w] for w in (a, b))
            used = set()
            for x in mine:
                for y in theirs:
                    if y[5] not in used and x[4] == y[4] and iou(x[2:4], y[2:4]) >= 0.5:
                        used.add(y[5])
                        tp[x[4]] += 1
                        break
        assert got[a, b, None] == tp["A"] + tp["B"] and got[a, b, "A"] == tp["A"]


def test_rule_match_plan_has_no_nested_loop(spark, sf_dir):
    from clauseloom.plans.match_queries import _rules

    from clauseloom.tables import cut

    gold, extracted = map(cut, _rules(spark, sf_dir))  # cut off from how the rules are made
    plan = matching.candidate_pairs(gold, extracted)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


TASK = (
    "id STRING, data STRUCT<section_ref: STRING, text: STRING, code: STRING, clause_id: STRING, meta: STRUCT<superseded: STRING>>, annotations ARRAY<STRUCT<id: BIGINT, completed_by: INT, annotator_role: STRING, "
    "result: ARRAY<STRUCT<id: STRING, from_name: STRING, to_name: STRING, type: STRING, value: STRUCT<start: INT, end: INT, text: STRING, labels: ARRAY<STRING>, choices: ARRAY<STRING>>>>>>, "
    "predictions ARRAY<STRUCT<model_version: STRING, result: ARRAY<STRUCT<id: STRING, from_name: STRING, to_name: STRING, type: STRING, value: STRUCT<start: INT, end: INT, text: STRING, labels: ARRAY<STRING>, choices: ARRAY<STRING>>>>>>"
)


def span(text, part, label, region=None):
    s = text.index(part)
    return (region, "linguistic_labels", "text", "labels", (s, s + len(part), part, [label], None))


def choice(name, value, region=None):
    return (region, name, "text", "choices", (None, None, None, None, [value]))


def task(key, text, results, ref="9.8.2.1.(1)", superseded=None):
    return (key, (ref, text, "C", None, (superseded,)), [(1, 7, None, results)], None)


def test_gold_rules(spark):
    t1 = "The width shall be not less than 900 mm for ramps serving a house, and the rise shall be at most 1 in 12 except in shops."
    t2 = "The run shall be not less than its rise and not more than its rise plus 25 mm."
    t3 = "(a) at least 3 m, or (b) 5 m for ramps not serving a house."
    data = [
        task("a", t1, [span(t1, "not less than 900 mm", "DIM_MIN", "r1"), choice("dim_property", "ClearWidth", "r1"), span(t1, "at most 1 in 12", "DIM_MAX"), span(t1, "for ramps serving a house", "APPLICABILITY"), span(t1, "except in shops", "EXCEPTION"), choice("ifc_entity", "IfcRamp")]),
        task("b", t2, [span(t2, "not less than its rise", "DIM_MIN"), span(t2, "not more than its rise plus 25 mm", "DIM_MAX"), choice("property_name", "Run")]),
        task("c", t3, [span(t3, "at least 3 m", "DIM_MIN"), span(t3, "5 m", "DIM_EXACT"), span(t3, "for ramps not serving a house", "APPLICABILITY")]),
        task("d", t1, [span(t1, "not less than 900 mm", "DIM_MIN")], superseded="a"), task("e", "", []), ("f", None, None, None),
    ]
    got = {(r["task_id"], r["dim"]): r for r in labels.gold_rules(spark.createDataFrame(data, TASK)).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1)}
    assert (got["a", 0]["property_name"], got["a", 0]["value"], got["a", 0]["unit"], got["a", 0]["building_use"], got["a", 0]["conditions"]) == ("ClearWidth", 900.0, "mm", "dwelling_unit", ["for ramps serving a house"])
    assert got["a", 1]["value"] == pytest.approx(0.083333) and got["a", 1]["exceptions"] == ["except in shops"] and got["a", 1]["target"] == "IfcRamp"
    b = got["b", 0]
    assert (b["operator"], b["value_min_property"], b["value_min_offset"], b["value_max_property"], b["value_max_offset"], b["unit"]) == ("between", "Rise", 0.0, "Rise", 25.0, "mm")
    assert got["c", 0]["building_use"] is None and got["c", 1]["building_use"] == "non_dwelling_unit"
    a = {r["task_id"]: r for r in labels.task_annotations(spark.createDataFrame(data, TASK)).collect()}
    assert a["a"]["subject"] == "IfcRamp" and a["e"]["dimensions"] == [] and a["f"]["subject"] is None


def test_findings_fixture_counts(spark):
    data = [("FAIL", "FAIL")] * 18 + [("FAIL", "PASS")] + [("PASS", "PASS")] * 19 + [("PASS", ""), (None, None)]
    r = compliance.score_findings(spark.createDataFrame([("g", *d) for d in data], "g STRING, tool_verdict STRING, human_verdict STRING"), ["g"]).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["reviewed"]) == (18, 1, 0, 19, 38)


def test_run_times_and_regressions(spark):
    df = spark.createDataFrame([("20310106T004724Z",), ("2031-01-06T00:47:24Z",), ("2031-01-06T02:47:24+02:00",), ("2031-01-06T00:47:24",), ("x",), (None,)], "t STRING")
    assert len({r[0] for r in rows(df.select(runs.run_time(F.col("t"))))}) == 2
    kind = "eval_id STRING, score DOUBLE, duration_s DOUBLE, failing ARRAY<STRING>"
    now = spark.createDataFrame([("a", 0.8, 1.0, ["x"]), ("b", 1.0, 9.0, []), ("c", 1.0, None, None), ("d", 1.0, 1.0, [])], kind)
    base = spark.createDataFrame([("a", 0.9, 1.0, ["x"]), ("b", 1.0, 1.0, []), ("d", 1.0, 1.0, ["y"])], kind)
    got = {r["eval_id"]: (r["regressed"], r["improved_checks"]) for r in runs.compare(now, base).collect()}
    assert got == {"a": (True, []), "b": (True, []), "c": (False, None), "d": (False, ["y"])}


def test_markup_and_archives_from_files(spark, tmp_path):
    (tmp_path / "one.dclg").write_text("<d><text>one</text></d>")
    with zipfile.ZipFile(tmp_path / "two.dclx", "w") as z:
        z.writestr("_rels/.rels", '<r><Relationship Target="/parts/the_document.xml"/></r>')
        z.writestr("parts/the_document.xml", "<d><text>two</text></d>")
    got = {r["doc_id"]: (r["xml"], len(r["digest"])) for r in files.read_markup(spark, str(tmp_path)).collect()}
    assert got == {"one": ("<d><text>one</text></d>", 64), "two": ("<d><text>two</text></d>", 64)}
    with zipfile.ZipFile(tmp_path / "bad.dclx", "w") as z:
        z.writestr("a.txt", "x")
    with pytest.raises(Exception, match="without a document part"):
        files.read_markup(spark, str(tmp_path)).collect()


def test_graph_json_and_results(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "clause::1", "kind": "clause"}], "links": [{"source": "clause::1", "target": "clause::1", "key": 3}]}')
    nodes, edges = files.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 1 and edges.first()["key"] == 3
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "nlp_20310106T004724Z.json").write_text('{"eval_id": "nlp", "score": 0.5, "details": [{"label": "b", "passed": false}, {"label": "a"}, {"label": "c", "passed": true}]}')
    r = files.read_results(spark, str(tmp_path / "r")).first()
    assert r["run_id"] == "20310106T004724Z" and r["failing"] == ["a", "b"]
    assert "| a |" in sinks.markdown(spark.createDataFrame([("a", 0.123456)], "k STRING, v DOUBLE"), "T")


def test_stream_of_documents(spark, tmp_path):
    from clauseloom.streaming import incremental

    docs = spark.createDataFrame([(1, "Doors shall open."), (1, "Doors shall open."), (2, None)], "doc_id INT, text STRING").withColumn("fetched_at", F.lit("2031-01-01").cast("timestamp"))
    docs.write.parquet(str(tmp_path / "in" / "docs.parquet"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in" / "docs.parquet"))
    out = incremental.new_clauses(stream).select("doc_id", F.size("annotation.deontics").alias("n"))
    incremental.run_once(out, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out"))), key=str) == [(1, 1), (2, None)] or sorted(rows(spark.read.parquet(str(tmp_path / "out"))), key=str) == [(1, 1), (2, -1)]


def test_rules_of_wrong_shapes_are_errors(spark):
    from clauseloom.sources import files

    texts = spark.createDataFrame([('{"none": 1}',), ("not json",), (None,), ("[]",)], "text STRING")
    assert files.flatten_rules(texts, strict=False).count() == 0
    with pytest.raises(Exception, match="expected a list of rules"):
        files.flatten_rules(texts).collect()
    present = spark.createDataFrame([('[{"value": null, "rule": {"value": 5}}, {"rule": {"check_value": 900}}, {"target": "", "ifc_class": "IfcDoor"}]',)], "text STRING")
    assert [(r["value"], r["target"]) for r in files.flatten_rules(present).orderBy("ord").collect()] == [(None, None), (900.0, None), (None, "")]


def test_a_missing_shared_folder_is_an_error_off_one_machine():
    from types import SimpleNamespace

    from clauseloom.tables import shared_dir

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"), conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def _cosines(clauses, terms, k):
    import math
    import re
    from collections import Counter

    docs = {("c", i): Counter(re.findall("[a-z0-9]+", t.lower())) for i, t in clauses} | {("t", i): Counter(re.findall("[a-z0-9]+", t.lower())) for i, t in terms}
    df = Counter(w for d in docs.values() for w in d)
    vec = {key: {w: n * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in d.items()} for key, d in docs.items()}
    vec = {key: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for key, v in vec.items()}
    dot = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items())
    return {i: sorted(((round(dot(vec["c", i], vec["t", j]), 9), j) for j, _ in terms), key=lambda x: (-x[0], x[1]))[:k] for i, _ in clauses}


def test_shortlist_is_exact_with_a_token_in_every_document(spark):
    rng = random.Random(4)
    word = lambda: "w" + str(int(rng.paretovariate(0.6)) % 60)
    clauses = [(i, " ".join(["the", *[word() for _ in range(rng.randint(0, 12))]])) for i in range(40)] + [(99, "")]
    terms = [(f"t{j:02d}", " ".join(["the", *[word() for _ in range(rng.randint(0, 4))]])) for j in range(30)]
    c, t = spark.createDataFrame(clauses, "clause_id INT, text STRING"), spark.createDataFrame(terms, "term_id STRING, text STRING")
    expected = _cosines(clauses, terms, 4)
    for block in (similarity.BLOCK, 9):
        got = {}
        for r in similarity.cosine_shortlist(c, t, 4, block=block).collect():
            got.setdefault(r["clause_id"], []).append((round(r["tfidf_cosine"], 9), r["term_id"]))
        assert {k: sorted(v, key=lambda x: (-x[0], x[1])) for k, v in got.items()} == expected
    assert similarity.cosine_shortlist(c, t, 0).count() == 41 * 30


def test_shortlist_shuffles_no_pairs(spark):
    left, right = spark.createDataFrame([("c1", "the", 1.0)], "c STRING, term STRING, _a DOUBLE"), spark.createDataFrame([("t1", "the", 1.0)], "t STRING, term STRING, _b DOUBLE")
    plan = similarity._nearest(left, right, 3, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(c#" in plan and "WindowGroupLimit" in plan


def test_areas_split_a_code_and_no_pair_leaves_its_area(spark):
    pairs = spark.createDataFrame([(1, 1, "9.8.2"), (1, 2, "9.8.2.1"), (2, 3, "9.8.2.1.(2)"), (3, 4, "9.9.1"), (4, 5, "9.9.10"), (5, 6, "table:9.8.2"), (6, 7, "9.9.1.(3)")], "gold_id INT, rule_id INT, ref STRING")
    got = {r["rule_id"]: r["area"] for r in matching.with_area(pairs).collect()}
    assert got == {1: "9.8.2", 2: "9.8.2", 3: "9.8.2", 4: "9.9.1", 5: "9.9.10", 6: "table:9.8.2", 7: "9.9.1"}


def test_rules_all_under_one_number_are_matched_as_in_order(spark):
    rng = random.Random(11)
    gold = [(k, f"9.{k % 7}.{k % 3}.({k % 4})", "IfcDoor", "Width", ">=", float(rng.randint(1, 3))) for k in range(200)]
    found = [(k, rng.choice([f"9.{k % 7}.{k % 3}", f"9.{k % 7}.{k % 3}.({k % 4})", f"9.{k % 7}"]), "IfcDoor", "Width", ">=", float(rng.randint(1, 3))) for k in range(150)]
    rule = lambda name, rows_: spark.createDataFrame(rows_, f"{name} INT, ref STRING, target STRING, property_name STRING, operator STRING, value DOUBLE").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in matching.RULE.split(", ")) if c not in ("ref", "target", "property_name", "operator", "value")])
    pairs = {tuple(r) for r in matching.match_rules(rule("gold_id", gold), rule("rule_id", found))["pairs"].where("mode = 'lenient'").select("gold_id", "rule_id").collect()}
    free, expected = set(range(150)), set()
    for g in gold:
        for e in found:
            if e[0] in free and (g[1] == e[1] or (g[1].startswith(e[1] + ".") and "(" not in e[1])) and g[5] == e[5]:
                expected.add((g[0], e[0]))
                free.discard(e[0])
                break
    assert pairs == expected


def test_json_files_of_lists_and_single_objects(spark, tmp_path):
    import json

    task = lambda k: {"id": k, "data": {"section_ref": "9.8.1", "meta": {"superseded": None}}, "annotations": [{"id": 7, "completed_by": 1, "result": [{"id": "r", "type": "choices", "value": {"choices": ["A"]}}]}]}
    (tmp_path / "tasks").mkdir()
    (tmp_path / "tasks" / "list.json").write_text(json.dumps([task(1), task("b")], indent=1))
    (tmp_path / "tasks" / "one.json").write_text(json.dumps(task(3), indent=1))
    tasks = files.read_tasks(spark, str(tmp_path / "tasks"))
    assert sorted(r[0] for r in tasks.select("id").collect()) == ["1", "3", "b"]
    assert tasks.select(F.col("annotations")[0]["result"][0]["value"]["choices"][0]).distinct().first()[0] == "A"
    (tmp_path / "drafts").mkdir()
    draft = lambda k, s: {"id": k, "status": s, "original_proposed_rule": {"check_value": "900", "value_min": 1.5}}
    (tmp_path / "drafts" / "a.json").write_text(json.dumps([draft(1, "edited"), draft(2, "new")]))
    (tmp_path / "drafts" / "b.json").write_text(json.dumps({"drafts": [draft(3, "edited")]}, indent=1))
    (tmp_path / "drafts" / "c.json").write_text(json.dumps(draft(4, "edited")))
    assert sorted(r[0] for r in files.read_drafts(spark, str(tmp_path / "drafts"), status="edited").select("id").collect()) == [1, 3, 4]
    (tmp_path / "findings.json").write_text(json.dumps([{"element_id": "e", "tool_verdict": "PASS", "human_verdict": "PASS", "count": 2}]))
    assert files.read_findings(spark, str(tmp_path / "findings.json")).first()["count"] == 2


def test_report_and_snapshot(spark):
    table = spark.createDataFrame([("a", 0.5), (None, 1.0)], "k STRING, v DOUBLE")
    text = sinks.report("Scores", {"First": table, "Empty": table.where("false")}, {"First": "What it says."})
    assert text.startswith("# Scores\n\n## First\n\nWhat it says.\n\n| k | v |") and "## Empty" in text and "| a | 0.5 |" in text
    row = runs.snapshot(spark, "/nowhere").first()
    assert row["processors"] >= 1 and row["commit"] is None and row["changed"] is None


def test_running_counts_and_percentiles_of_hot_groups(spark):
    from clauseloom.operators import ordered

    rng = random.Random(2)
    data = [("hot", float(rng.randint(0, 40))) for _ in range(900)] + [("b", 1.0), ("b", 2.0), (None, 5.0), ("c", None), ("c", float("nan"))]
    df = spark.createDataFrame(data, "g STRING, v DOUBLE")
    got = {r["g"]: r for r in ordered.interpolated_percentiles(df, ["g"], "v", {"m": 0.5, "q": 0.9, "low": 0.0, "high": 1.0}).collect()}
    values = sorted(v for g, v in data if g == "hot")
    at = lambda p: values[int(p * 899)] * (1 - p * 899 % 1) + values[min(899, int(p * 899) + 1)] * (p * 899 % 1)
    assert got["hot"]["m"] == pytest.approx(at(0.5)) and got["hot"]["q"] == pytest.approx(at(0.9)) and (got["hot"]["low"], got["hot"]["high"]) == (values[0], values[-1])
    assert got["b"]["m"] == 1.5 and got[None]["m"] == 5.0 and "c" not in got and got["hot"]["n"] == 900
    ranks = {r["v"]: r["r"] for r in ordered.average_ranks(df.where("g = 'hot'").select("v"), [], "v", "r").collect()}
    assert all(ranks[v] == pytest.approx(values.index(v) + 1 + (values.count(v) - 1) / 2) for v in set(values))
