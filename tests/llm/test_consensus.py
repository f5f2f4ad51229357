"""Consensus by tables equals consensus by arrays, reports whether it settled, and survives hot items and annotators."""

import random

from pyspark.sql import functions as F

from clauseloom.llm import consensus
from conftest import rows
from test_llm import votes_of

KIND = "question STRING, item INT, annotator STRING, label STRING"


def rounded(df):
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()], key=str)


def test_tables_give_what_arrays_give(spark):
    votes = [("q", *v) for v in votes_of(5)[1]] + [("r", i, w, x) for i, w, x in votes_of(15)[1] if i < 60]
    df = spark.createDataFrame(votes * 2, KIND)
    arrays = consensus.consensus(df, ["question", "item"], "question", rounds=2)
    tables = consensus.consensus(df, ["question", "item"], "question", rounds=2, sent_annotators=0)
    for a, b in zip(arrays, tables):
        assert a.columns == b.columns and rounded(a) == rounded(b)


def test_tables_take_empty_and_missing_votes(spark):
    assert [t.count() for t in consensus.consensus(spark.createDataFrame([], KIND), ["question", "item"], "question", sent_annotators=0)] == [0, 0, 0]
    data = [("q", 1, "a", "x"), ("q", 1, None, "y"), ("q", 2, "a", None), (None, 3, "a", "x")]
    labels, annotators, agreement = consensus.consensus(spark.createDataFrame(data, KIND), ["question", "item"], "question", sent_annotators=0)
    assert rows(labels.select("item", "label", "n_annotators")) == [(1, "x", 1)] and annotators.first()["n_votes"] == 0 and agreement.count() == 0


def test_settling_is_reported(spark):
    df = spark.createDataFrame([("q", *v) for v in votes_of(5)[1]], KIND)
    r = consensus.consensus(df, ["question", "item"], "question")[1].first()
    assert r["converged"] and 1 < r["rounds"] < 100
    short = consensus.consensus(df, ["question", "item"], "question", rounds=1, sent_annotators=0)[1].first()
    assert short["rounds"] == 1 and not short["converged"]


def test_misspelt_labels_shift_no_weight(spark):
    rng = random.Random(3)
    votes = [("q", i, f"w{k}", "yes" if rng.random() < 0.8 else "no") for i in range(800) for k in range(3)]
    clean = consensus.consensus(spark.createDataFrame(votes, KIND), ["question", "item"], "question", rounds=3)[1]
    odd = consensus.consensus(spark.createDataFrame([*votes, ("q", 9001, "w1", "yess"), ("q", 9002, "w1", "noo")], KIND), ["question", "item"], "question", rounds=3)[1]
    assert rounded(clean.select("annotator", "weight")) == rounded(odd.select("annotator", "weight"))


def test_an_item_with_very_many_votes(spark):
    many = spark.range(5000).select(F.lit("q").alias("question"), F.lit(1).alias("item"), F.concat(F.lit("w"), "id").alias("annotator"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("label"))
    for sent in (consensus.SENT_ANNOTATORS, 100):
        labels = consensus.consensus(many, ["question", "item"], "question", rounds=2, sent_annotators=sent)[0]
        assert [(r["label"], r["n_annotators"]) for r in labels.collect()] == [("a", 5000)]
