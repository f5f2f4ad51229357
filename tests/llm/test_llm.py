"""Operators for training data: against brute force, exact round trips, and hard cases."""

import random

import pytest
from pyspark.sql import functions as F

from clauseloom.llm import canonical, consensus, mixing, quantiles, stuffing, tokens
from conftest import rows, same_rows


@pytest.fixture(scope="module")
def queries():
    from clauseloom.llm import queries

    return queries


def test_queries_agree_with_sql(spark, sf_dir, queries):
    for name, sql in queries.ORACLE_SQL.items():
        same_rows(queries.QUERIES[name](spark, sf_dir), sql, sf_dir)


@pytest.mark.parametrize("name", ["p3_found", "p3_annotators", "p3_agreement", "p5_found", "p6_ids", "p6_round_trip", "p7_mix", "p7_shares", "p8_found"])
def test_queries_run(spark, sf_dir, queries, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


# percentiles


def test_percentiles_within_error(spark):
    rng = random.Random(1)
    data = [(g, rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9)) for g in "ab" for _ in range(999)] + [("a", 0.0)] * 50 + [("a", None), ("a", float("nan")), ("a", float("inf")), (None, 5.0), ("b", 1e308), ("b", 1e-308)]
    df = spark.createDataFrame(data, "g STRING, v DOUBLE").withColumn("metric", F.lit("clash"))
    at = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    whole = quantiles.sketch(df, ["g"], ["v"])
    got = {(r["g"], r["p"]): (r["estimate"], r["n"]) for r in quantiles.percentiles(whole, ["g"], at).collect()}
    for g in ("a", "b", None):
        exact = sorted(v for k, v in data if k == g and v is not None and v == v and abs(v) != float("inf"))
        for p in at:
            true = exact[max(1, -(-int(p * len(exact) * 1000) // 1000)) - 1]
            estimate, n = got[g, p]
            assert n == len(exact) and abs(estimate - true) <= 0.0100001 * abs(true), (g, p, estimate, true)
    # parts summarised apart and combined give the same
    parts = quantiles.sketch(df.withColumn("day", (F.rand(3) * 5).cast("int")), ["g", "day"], ["v"])
    assert sorted(rows(quantiles.merge(parts, ["g"])), key=str) == sorted(rows(whole), key=str)
    assert quantiles.percentiles(quantiles.sketch(df.where("false"), ["g"], ["v"]), ["g"], at).count() == 0
    with pytest.raises(ValueError):
        quantiles.sketch(df, ["g"], ["v"], error=0)


# consensus


def brute_consensus(votes, rounds=20, prior=(8.0, 2.0)):
    import math
    from collections import Counter, defaultdict

    items = defaultdict(dict)
    for item, who, label in votes:
        items[item][who] = label
    kinds = len({v for i in items.values() for v in i.values()})
    weight = defaultdict(lambda: 1.0)
    accuracy = {}

    def tally(ballot):
        score = Counter()
        for who, label in ballot.items():
            score[label] += weight[who]
        return score

    for _ in range(rounds):
        hits = defaultdict(lambda: [0.0, 0])
        for ballot in items.values():
            if len(ballot) > 1:
                for who, label in ballot.items():
                    rest = tally({k: v for k, v in ballot.items() if k != who})
                    mine, other = rest.pop(label, None), max(rest.values(), default=None)
                    hits[who][1] += 1
                    if mine is not None:
                        hits[who][0] += 1 if other is None or mine > other + 1e-12 else 0.5 if abs(mine - other) <= 1e-12 else 0
        before, accuracy = accuracy, {k: (h + prior[0]) / (n + sum(prior)) for k, (h, n) in hits.items()}
        weight = defaultdict(lambda: 1.0, {k: math.log(a * max(1, kinds - 1) / (1 - a)) for k, a in accuracy.items()})
        if before and max(abs(accuracy[k] - before[k]) for k in accuracy) < 1e-3:
            break
    return {i: min(tally(b).items(), key=lambda x: (-x[1], x[0]))[0] for i, b in items.items()}, accuracy


def votes_of(seed):
    rng = random.Random(seed)
    skill = {"w1": 0.95, "w2": 0.9, "w3": 0.85, "w4": 0.4, "w5": 0.02}
    truth, votes = {}, []
    for k in range(300):
        truth[k] = rng.choice("ABCD")
        for who in rng.sample(sorted(skill), rng.randint(2, 5)):
            votes.append((k, who, truth[k] if rng.random() < skill[who] else rng.choice([x for x in "ABCD" if x != truth[k]])))
    return truth, votes


def test_consensus_against_brute_force_and_truth(spark):
    truth, votes = votes_of(5)
    df = spark.createDataFrame([("q", *v) for v in votes] * 2, "question STRING, item INT, annotator STRING, label STRING")
    labels, annotators, agreement = consensus.consensus(df, ["question", "item"], "question")
    got = {r["item"]: r["label"] for r in labels.collect()}
    expected, accuracy = brute_consensus(votes)
    assert got == expected
    assert {r["annotator"]: pytest.approx(r["accuracy"]) for r in annotators.collect()} == accuracy
    assert sum(got[k] == truth[k] for k in truth) / len(truth) >= 0.95
    a = agreement.first()
    assert a["n_ratings"] == len(votes) and 0 < a["alpha"] < 1


def test_krippendorff_by_hand(spark):
    votes = [("q", i, w, x) for i, row in enumerate([("a", "a", None), ("a", "b", "b"), ("c", None, None), ("b", "b", "b")]) for w, x in enumerate(row)]
    a = consensus.consensus(spark.createDataFrame(votes, "g STRING, i INT, annotator INT, label STRING"), ["g", "i"], "g")[2].first()
    values = {"a": 3, "b": 5}
    observed = (2 + (2 + 0) / 2 + 3) / 8
    expected = sum(v * (v - 1) for v in values.values()) / (8 * 7)
    assert a["n_items"] == 3 and a["observed"] == pytest.approx(observed) and a["alpha"] == pytest.approx((observed - expected) / (1 - expected))


def test_consensus_edges(spark):
    kind = "g STRING, i INT, annotator INT, label STRING, at INT"
    empty = consensus.consensus(spark.createDataFrame([], kind), ["g", "i"], "g")
    assert [t.count() for t in empty] == [0, 0, 0]
    data = [("q", 1, 1, "a", 1), ("q", 1, 1, "b", 2), ("q", 1, None, "a", 1), ("q", 2, 1, None, 1), ("q", 3, 1, "x", 1), ("q", 3, 2, "y", 1), (None, 4, 1, "a", 1)]
    labels = consensus.consensus(spark.createDataFrame(data, kind), ["g", "i"], "g", order="at")[0]
    assert sorted(rows(labels.select("i", "label", "n_annotators"))) == [(1, "b", 1), (3, "x", 2)]


# canonical values


def damerau(a, b):
    """Unrestricted distance by search, for short words."""
    from functools import lru_cache

    @lru_cache(None)
    def d(i, j):
        best = max(i, j) if min(i, j) == 0 else min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        for p in range(1, i):
            for q in range(1, j):
                if a[p - 1] == b[j - 1] and b[q - 1] == a[i - 1]:
                    best = min(best, d(p - 1, q - 1) + (i - p - 1) + 1 + (j - q - 1))
        return best

    return d(len(a), len(b))


def test_distance_is_the_metric():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(60)]
    for _ in range(400):
        a, b, c = rng.choice(words), rng.choice(words), rng.choice(words)
        assert canonical.distance(a, b) == damerau(a, b) == canonical.distance(b, a)
        assert canonical.distance(a, c) <= canonical.distance(a, b) + canonical.distance(b, c)


def test_tree_returns_every_form_within_radius():
    rng = random.Random(3)
    forms = [("".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))), f"t{k}") for k in range(300)]
    tree = canonical.BKTree(forms)
    for _ in range(40):
        key, radius = "".join(rng.choice("abcd") for _ in range(5)), rng.randint(0, 3)
        assert {(f, t) for _, f, t in tree.search(key, radius)} == {(f, t) for f, t in set(forms) if canonical.distance(key, f) <= radius}


TERMS = [("p", "ClearWidth", ["net opening"]), ("p", "StepRise", None), ("c", "IfcDoor", ["door leaf"]), ("c", "IfcWall", []), ("operator", ">=", ["gte"]), ("operator", "<=", ["lte"])]
TYPED = [
    ("p", "clear_width", "ClearWidth"), ("p", "Width, Clear", "ClearWidth"), ("p", "Pset_X.CleerWidth", "ClearWidth"), ("p", "StерRisе​", "StepRise"), ("p", "Clr Wdth", "ClearWidth"), ("p", "the step-rsie *", "StepRise"),
    ("p", "net  openign", "ClearWidth"), ("p", "Mood", "unmatched"), ("p", "   ", "unmatched"), ("p", None, "unmatched"), ("p", "x" * 30000, "unmatched"), ("c", "ifc4x3.IfcDoor (W-590)", "IfcDoor"), ("c", "DOORS", "IfcDoor"),
    ("c", "IfcWal", "IfcWall"), ("c", "IfcTeapot", "unmatched"), ("operator", "≥", ">="), ("operator", "&gt;=", ">="), ("operator", "no less than", ">="), ("operator", "not more than", "<="), ("operator", "similar", "unmatched"), ("none", "IfcDoor", "unmatched"),
]


def test_typed_values(spark):
    terms = spark.createDataFrame(TERMS, "field STRING, name STRING, aliases ARRAY<STRING>")
    df = spark.createDataFrame([(*t, "clash") for t in TYPED], "field STRING, value STRING, expected STRING, term STRING")
    for shard in (canonical.SHARD, 2):
        for r in canonical.match_values(df, "field", "value", terms, shard=shard).collect():
            assert r["term"] == r["expected"], (r, shard)
    assert {r["term"] for r in canonical.match_values(df, "field", "value", terms.where("false")).collect()} == {"unmatched"}
    assert canonical.match_values(df.where("false"), "field", "value", terms).count() == 0


def test_equally_near_names_stay_unmatched(spark):
    terms = spark.createDataFrame([("p", "alphabeta", None), ("p", "alphabetb", None)], "field STRING, name STRING, aliases ARRAY<STRING>")
    for shard in (10, 1):
        assert canonical.match_values(spark.createDataFrame([("p", "alphabetc")], "field STRING, value STRING"), "field", "value", terms, shard=shard).first()["term"] == "unmatched"


# tokens

HARD = [None, "", " ", "\n\n\r\n", "a", "don't 're 'll", "a\x1cb .\x1f c", "é漢字 🚧‍🚪", "<|endoftext|>", "x" * 50000, " " * 50000, "ab " * 30000, "漢" * 20000, "　全角　空白", "1234567 89.10"]


def test_round_trip_and_reference_encoding(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id INT, text STRING")
    got = tokens.encode_corpus(df).withColumn("back", tokens.token_texts(F.col("ids"))).collect()
    assert len(got) == len(HARD)
    for r in got:
        text = HARD[r["doc_id"]] or ""
        assert r["back"] == text and r["ids"] == reference.encode(text, add_special_tokens=False).ids
    counted = df.select(tokens.token_count(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in counted] == [len(r["ids"]) for r in got]
    assert tokens.encode_corpus(df.where("false")).count() == 0


def test_tree_joins_are_exact():
    enc, rng = tokens.encoder(), random.Random(6)
    alphabet = list("ab' \n\t\x1c\x1f​\x85　's re.,1é漢🚪\r") + ["'re", "  ", "don't "]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert tokens.encode(enc, text, leaf=3, window=1) == enc.encode_ordinary(text), repr(text)


# mixing


def test_water_fill_and_tree():
    assert mixing.water_fill(10, [(1, 100), (1, 2), (2, 100)]) == pytest.approx([8 / 3, 2, 16 / 3])
    assert mixing.water_fill(10, [(0, 5), (1, 3)]) == pytest.approx([5, 3])
    # the shortage of errata goes to its domain first: code_text, not forum
    targets = [("m", "code_text", 0.5, 1), ("m", "errata", 0.25, 1), ("m", "forum", 0.25, 1)]
    got = {r[1]: r[3] for r in mixing.budgets(targets, [("code_text", "en", 1000), ("errata", "en", 10), ("forum", "en", 1000)], 400)}
    assert got == pytest.approx({"code_text": 290, "errata": 10, "forum": 100})


def test_mix_reaches_targets(spark):
    rng = random.Random(7)
    docs = [(k, " ".join(["word"] * rng.randint(1, 60)), rng.choice(["en", "fr", None]), rng.choices(["big", "mid", "tiny", None], [30, 20, 3, 1])[0], "clash") for k in range(3000)] + [(9001, None, "en", "big", ""), (9002, "", "en", "big", "")]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING, mix STRING")
    kind = "mix STRING, source STRING, target_share DOUBLE, max_repeats INT"
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "tiny", 0.2, 5), ("n", "big", 0.9, 1), ("n", "absent", 0.1, 3)], kind)
    chosen = mixing.mix(df, targets)
    out = {(r["mix"], r["source"]): r for r in mixing.shares(chosen, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert out["m", s]["actual_share"] == pytest.approx(share, abs=0.01) and out["m", s]["most_repeats"] <= out["m", s]["max_repeats"]
    assert out["m", "tiny"]["most_repeats"] > 1 and out["n", "absent"]["actual_share"] == 0 and out["n", "big"]["actual_share"] == 1
    assert chosen.groupBy("mix", "doc_id").count().where("count > 1").count() == 0 and chosen.where("doc_id > 9000").count() == 0
    assert sorted(rows(chosen)) == sorted(rows(mixing.mix(df.repartition(3), targets)))
    assert sorted(rows(chosen.select("doc_id"))) != sorted(rows(mixing.mix(df, targets, seed=1).select("doc_id")))
    assert mixing.mix(df.where("false"), targets).count() == 0 and mixing.mix(df, targets.where("false")).count() == 0


# stuffed pages

STUFFED = [
    "corridor for sale, corridor for sale, Corridor For Sale, corridor for sales, CORRIDOR FOR SALE, corridor for sale", "SKU 5846, size S, in stock, add to cart, brick, size M, lockable, rubber, deals, size L",
    "\n".join(f'<a href="http://x.example/p/{k}">buy roof hatch</a>' for k in range(6)), " ".join(f"[brick ramp](http://a.test/{k})" for k in range(5)), "Home > Next > Cart > Click here > Fast Delivery Ramp > Top > Login > Next > Cart",
    "#window_price #door_cheap #ramp_sale #stair_custom #guard_best #lobby_online #sill_kit", "Our guard is the guard guard buyers call cheap guard. Need guard? Guard here, guard there, price guard deals guard! " * 3,
    "The drawing shows a door. " + "price sill in Fenwick. quote sill in Marstead. cheap sill in Ulburn. " * 6, "kit vestibule\nprecast concrete service room\ninstaller shaft wall\nhardwood platform\nbuy ceiling void\nwholesale kerb",
]
PLAIN = [
    "Customers tell us that the lobby feels solid and closes quietly. Ask for a sample before you decide.", "No objections were raised to item 25. " * 20, "Contents\n" + "\n".join(f"5.1.{k}.2 Ramp ....... {k}" for k in range(9)),
    "Data sheet 606\n" + "\n".join(f"Step Rise: at most {k}.5 mm" for k in range(9)), "| Element | Requirement |\n|---|---|\n" + "\n".join(f"| ramp width | at least {k} mm |" for k in range(9)),
    "Ramp: see the entry for duct.\nParapet: the timber member that carries a ramp in a workshop.\nSill: see the entry for suite.", "\n".join(f"{k}. Check the sill against Article 5.4.{k}.2." for k in range(1, 9)),
    "Toda rampa tendrá una anchura libre no inferior a 90 mm. ¿Quién revisó la ventana antes de la entrega?", "Tags: balcony", "", "   \n", None,
]


def test_stuffed_pages(spark):
    data = [(k, t, 9.9) for k, t in enumerate(STUFFED + PLAIN)]
    df = spark.createDataFrame(data, "doc_id INT, text STRING, share DOUBLE")
    got = stuffing.stuffed_pages(df)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(len(STUFFED))) and got.columns.count("share") == 1
    assert stuffing.stuffed_pages(df.where("false")).count() == 0


def test_half_of_the_text_decides():
    junk = "buy ramp, cheap ramp, ramp price, ramp online, custom ramp, ramp deals, ramp kit, best ramp"
    prose = "It was agreed to keep the width of the door at the value that the report gives until the next meeting. "
    assert stuffing.page(junk + ". " + prose)[0] < 0.5 < stuffing.page(junk + ", " + junk + ". " + prose)[0]
    assert stuffing.page("word " * 100000)[0] in (0.0, 1.0)
