"""One agreed label per item from annotators who disagree and differ in care.

Iteratively reweighted voting: a weighted vote gives each item's consensus; each
annotator's accuracy is measured against the consensus of the others (their own
vote left out), smoothed, and becomes the weight of the next round; this repeats
until the accuracies stand still.

A round is computed in one of two ways with the same result. With up to
``SENT_ANNOTATORS`` annotators an item's votes stand in one array and the
weights are read from an array in the JVM, so that a round is one pass without
a shuffle. With more, votes and weights are tables and a round is joins and sums
that are combined before each shuffle, so that neither the annotators nor one
item's votes are ever in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.operators.skew import skewed_join
from clauseloom.tables import cut

#: Annotators (over all groups) whose weights are sent to every task: 1.6 MB of doubles, and as many votes at most in an item's array.
SENT_ANNOTATORS = 200_000
#: Share of a group's votes from which a label counts as one of its labels, so that misspelt ones shift no weight.
RARE = 0.001


def single_votes(votes: DataFrame, item: list[str], group: str, annotator: str, label: str, order: str | None) -> DataFrame:
    """The item columns, annotator and label: one vote per item and annotator.

    An annotator who voted on an item more than once counts with the vote of
    the greatest ``order`` (the greatest label where there is none). Votes with
    a null group, annotator or label are no votes. Copies are combined before
    the shuffle.
    """
    votes = votes.where(F.col(annotator).isNotNull() & F.col(label).isNotNull() & F.col(group).isNotNull())
    rank = F.struct(F.col(order) if order else F.lit(0), F.col(label))
    one = votes.groupBy(*item, F.col(annotator).alias("_who")).agg(F.max_by(F.col(label), rank).alias("_label"))
    return one.select(*item, F.col("_who").alias("annotator"), F.col("_label").alias("label"))


def _best_first(entries: Column) -> Column:
    """ARRAY<STRUCT<score, label, n>>, the best first; equal scores rank by label."""
    by_loss = F.array_sort(F.transform(entries, lambda x: F.struct(F.round(-x["score"], 9).alias("loss"), x["label"].alias("label"), x["n"].alias("n"))))
    return F.transform(by_loss, lambda x: F.struct((-x["loss"]).alias("score"), x["label"].alias("label"), x["n"].alias("n")))


def _left_out(ranked: Column, label: Column, weight: Column) -> Column:
    """1, 0.5 or 0: whether the consensus without a vote of this weight is the vote's label (0.5 at equal scores)."""
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    own = F.get(F.filter(ranked, lambda x: x["label"] == label), F.lit(0))
    rest = F.round(own["score"] - weight, 9)  # whatever order the weights were added in
    other = F.when(top["label"] == label, second["score"]).otherwise(top["score"])
    return F.when(own["n"] == 1, 0.0).when(other.isNull() | (rest > other), 1.0).when(rest == other, 0.5).otherwise(0.0)


def _step(done: int) -> float:
    """How far the accuracies move to what the next round measures: whole steps at first, then shorter ones, so that votes that tip to and fro settle."""
    return 1.0 if done < 6 else 1.0 / (done - 4)


class _Arrays:
    """Rounds over items whose votes stand in an array, with weights by the annotator's place in the list of all."""

    def __init__(self, votes: DataFrame, item: list[str], group: str, known: list, kinds: str):
        self.spark, self.item = votes.sparkSession, item
        ids = self.spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(known)], "_id INT, " + kinds.format("_group", "_who"))
        placed = votes.join(F.broadcast(ids), (votes["annotator"] == ids["_who"]) & (votes[group] == ids["_group"]))
        vote = F.struct(F.col("_id").alias("annotator"), F.col("label"))
        self.items = cut(placed.groupBy(*item).agg(F.sort_array(F.collect_list(vote)).alias("votes")))
        self.known, self.kinds = known, kinds

    def _weighing(self, weights: list[float]) -> tuple[DataFrame, Column]:
        """The items with the weights beside them, and the ranking of their labels."""
        table = self.spark.createDataFrame([(weights,)], "w ARRAY<DOUBLE>").scalar()  # one value, read in the JVM
        items = self.items.withColumn("_w", table)
        labels = F.array_sort(F.array_distinct(F.transform("votes", lambda v: v["label"])))

        def entry(label: Column) -> Column:
            mine = F.filter("votes", lambda v: v["label"] == label)
            score = F.aggregate(mine, F.lit(0.0), lambda acc, v: acc + F.get("_w", v["annotator"]))
            return F.struct(score.alias("score"), label.alias("label"), F.size(mine).cast("long").alias("n"))

        return items, _best_first(F.transform(labels, entry))

    def ranked(self, weights: list[float]) -> DataFrame:
        items, ranking = self._weighing(weights)
        return items.select(*self.item, ranking.alias("_ranked"))

    def tried(self, weights: list[float]) -> dict[int, tuple[float, int]]:
        """Hits and tries of each annotator on items with another vote."""
        items, ranking = self._weighing(weights)
        items = items.where(F.size("votes") > 1).withColumn("_ranked", ranking)
        each = items.select(F.explode(F.transform("votes", lambda v: F.struct(v["annotator"].alias("a"), _left_out(F.col("_ranked"), v["label"], F.get("_w", v["annotator"])).alias("h")))).alias("x"))
        rows = each.groupBy("x.a").agg(F.sum("x.h").alias("hits"), F.count(F.lit(1)).alias("tries")).collect()
        return {r["a"]: (r["hits"], r["tries"]) for r in rows}

    def settle(self, n_labels: dict, prior: tuple[float, float], tolerance: float, rounds: int) -> tuple[DataFrame, DataFrame]:
        good, bad = prior
        others = [max(1, n_labels.get(r[0], 2) - 1) for r in self.known]
        accuracy, weights, tries = [0.0] * len(self.known), [1.0] * len(self.known), [0] * len(self.known)
        done, change = 0, math.inf
        while self.known and done < rounds and change >= tolerance:
            stats = self.tried(weights)
            tries = [stats.get(k, (0.0, 0))[1] for k in range(len(self.known))]
            new = [(stats.get(k, (0.0, 0))[0] + good) / (tries[k] + good + bad) for k in range(len(self.known))]
            new = [a + (b - a) * _step(done) for a, b in zip(accuracy, new)]
            change = max(abs(a - b) for a, b in zip(accuracy, new)) if done else math.inf
            accuracy, done = new, done + 1
            weights = [math.log(p * n / (1 - p)) for p, n in zip((min(max(a, 0.001), 0.999) for a in accuracy), others)]
        rows = [(r[0], r[1], accuracy[k], weights[k], int(tries[k]), done, change < tolerance) for k, r in enumerate(self.known)]
        schema = self.kinds.format("_group", "annotator") + ", accuracy DOUBLE, weight DOUBLE, n_votes BIGINT, rounds INT, converged BOOLEAN"
        return self.ranked(weights), self.spark.createDataFrame(rows, schema)


class _Tables:
    """Rounds over votes and weights as tables, for any number of annotators and of votes on an item."""

    def __init__(self, votes: DataFrame, item: list[str], group: str):
        self.item, self.group = item, group
        self.votes = votes.select(*item, "label", F.struct(*item).alias("_item"), F.struct(F.col(group).alias("g"), F.col("annotator").alias("a")).alias("_who"))

    def _weighed(self, weights: DataFrame) -> DataFrame:
        return skewed_join(self.votes, weights.select("_who", "weight"), "_who")

    def _ranked(self, weighed: DataFrame) -> DataFrame:
        sums = weighed.groupBy("_item", "label").agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("n"))
        # an item has as many entries as labels were given to it
        return sums.groupBy("_item").agg(_best_first(F.collect_list(F.struct("score", "label", "n"))).alias("_ranked"))

    def settle(self, n_labels: DataFrame, prior: tuple[float, float], tolerance: float, rounds: int) -> tuple[DataFrame, DataFrame]:
        good, bad = prior
        known = self.votes.groupBy("_who").agg(F.lit(1.0).alias("weight"))
        known = cut(known.join(n_labels.select(F.col(self.group).alias("_g"), "_labels"), F.col("_who.g") == F.col("_g"), "left").select("_who", "weight", F.greatest(F.lit(1), F.coalesce("_labels", F.lit(2)) - 1).alias("_others")))
        current = known.withColumns({"accuracy": F.lit(0.0), "n_votes": F.lit(0).cast("long")})
        done, change = 0, math.inf
        while done < rounds and change >= tolerance:
            weighed = self._weighed(current)
            ranked = self._ranked(weighed).where(F.aggregate("_ranked", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]) > 1)
            tried = skewed_join(weighed.drop(*self.item), ranked, "_item").groupBy("_who").agg(F.sum(_left_out(F.col("_ranked"), F.col("label"), F.col("weight"))).alias("hits"), F.count(F.lit(1)).alias("tries"))
            new = current.select("_who", "_others", F.col("accuracy").alias("_before")).join(tried, "_who", "left")
            measured = (F.coalesce("hits", F.lit(0.0)) + good) / (F.coalesce("tries", F.lit(0)) + (good + bad))
            new = new.withColumn("accuracy", F.col("_before") + (measured - F.col("_before")) * _step(done))
            odds = F.least(F.greatest(F.col("accuracy"), F.lit(0.001)), F.lit(0.999))
            current = cut(new.select("_who", "_others", "accuracy", "_before", F.log(odds * F.col("_others") / (1 - odds)).alias("weight"), F.coalesce("tries", F.lit(0)).alias("n_votes")))
            moved = current.agg(F.max(F.abs(F.col("accuracy") - F.col("_before")))).first()[0]
            change = 0.0 if moved is None else moved if done else math.inf
            done += 1
        ranked = self._ranked(self._weighed(current)).select("_item.*", "_ranked")
        annotators = current.select(F.col("_who.g").alias("_group"), F.col("_who.a").alias("annotator"), "accuracy", "weight", "n_votes", F.lit(done).alias("rounds"), F.lit(change < tolerance).alias("converged"))
        return ranked, annotators


def consensus(
    votes: DataFrame,
    item: list[str],
    group: str,
    annotator: str = "annotator",
    label: str = "label",
    order: str | None = None,
    prior: tuple[float, float] = (8.0, 2.0),
    tolerance: float = 1e-3,
    rounds: int = 100,
    sent_annotators: int = SENT_ANNOTATORS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, annotators, agreement) of votes on items; ``group`` is the item column that names the question asked.

    labels: the item columns, label, support (its score less the next one's), n_annotators and unanimous.
    annotators: group, annotator, accuracy (left-one-out, smoothed by ``prior``
    hits and misses), weight, n_votes (on items with another vote), rounds and
    converged (whether no accuracy moved by ``tolerance`` in the last round,
    which :func:`_step` shortens; it ends after ``rounds`` in any case and says
    so here).
    agreement, one row a group: see :func:`krippendorff`.

    Weights are log-odds of the accuracy against an even choice of the other
    labels: who is right less often than by chance counts against the label
    given. Labels with less than ``RARE`` of a group's votes are not counted
    among them. Ties go to the label first in order. Null groups, annotators
    and labels are no votes; empty votes give empty tables. The votes are cut
    through a checkpoint once. ``sent_annotators`` chooses how a round is
    computed and changes no result.
    """
    kinds = f"{{}} {votes.schema[group].dataType.simpleString()}, {{}} {votes.schema[annotator].dataType.simpleString()}"
    one = cut(single_votes(votes, item, group, annotator, label, order))
    counts = one.groupBy(group, "label").count()
    parts = counts.groupBy(group).agg(F.sum("count").alias("_all"), F.collect_list("count").alias("_counts"))  # as many as labels
    n_labels = parts.select(group, F.size(F.filter("_counts", lambda n: n >= F.col("_all") * RARE)).alias("_labels"))
    known = one.groupBy(F.col(group).alias("g"), F.col("annotator").alias("a")).agg(F.lit(1)).limit(sent_annotators + 1).collect()
    if len(known) <= sent_annotators:
        known.sort(key=lambda r: (r[0], r[1]))
        ranked, annotators = _Arrays(one, item, group, known, kinds).settle({r[0]: r[1] for r in n_labels.collect()}, prior, tolerance, rounds)
    else:
        ranked, annotators = _Tables(one, item, group).settle(n_labels, prior, tolerance, rounds)
    top, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    labels = ranked.select(
        *item, top["label"].alias("label"), (top["score"] - F.coalesce(second["score"], F.lit(0.0))).alias("support"),
        F.aggregate("_ranked", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).cast("int").alias("n_annotators"), (F.size("_ranked") == 1).alias("unanimous"),
    )
    return labels, annotators.withColumnsRenamed({"_group": group, "annotator": annotator}), krippendorff(ranked, group)


def krippendorff(ranked: DataFrame, group: str) -> DataFrame:
    """group, n_items, n_ratings, observed and alpha, over items with two votes or more; ``_ranked`` has each label's ``n``.

    alpha is Krippendorff's for nominal labels, which corrects for chance and
    allows for missing ratings; 1 where all ratings are one label.
    """
    m = F.aggregate("_ranked", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    same = F.aggregate("_ranked", F.lit(0.0), lambda acc, x: acc + x["n"] * (x["n"] - 1))
    items = ranked.select(group, "_ranked", m.alias("m"), same.alias("same")).where(F.col("m") > 1)
    within = items.groupBy(group).agg(F.count(F.lit(1)).alias("n_items"), F.sum("m").alias("n_ratings"), F.sum(F.col("same") / (F.col("m") - 1)).alias("_agree"))
    counts = items.select(group, F.explode("_ranked").alias("x")).groupBy(group, "x.label").agg(F.sum("x.n").alias("n"))
    chance = counts.groupBy(F.col(group).alias("_g")).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("_chance"))
    n = F.col("n_ratings").cast("double")
    observed, expected = F.col("_agree") / n, F.try_divide(F.col("_chance"), n * (n - 1))
    return within.join(chance, within[group] == chance["_g"]).select(
        group, "n_items", "n_ratings", observed.alias("observed"),
        F.when(expected == 1, F.lit(1.0)).otherwise(F.try_divide(observed - expected, 1 - expected)).alias("alpha"),
    )


def task_votes(tasks: DataFrame, choices: tuple[str, ...], terms: DataFrame) -> DataFrame:
    """task_id, superseded, from_name, annotator, label, annotation_id of each task-level choice.

    Spelling is evened: white space and case of a choice do not matter; entity
    classes get their spelling in ``terms``. The first choice of an answer counts.
    Re-delivered tasks are exact copies: their votes are those of the same
    annotators again, which :func:`single_votes` combines.
    """
    answers = tasks.select(F.col("id").alias("task_id"), F.col("data.meta.superseded").alias("superseded"), F.explode("annotations").alias("a")).select(
        "task_id", "superseded", F.col("a.completed_by").alias("annotator"), F.col("a.id").alias("annotation_id"), F.explode("a.result").alias("r")
    )
    typed = F.trim(F.regexp_replace(F.get(F.filter(F.col("r.value.choices"), lambda x: F.trim(x) != ""), F.lit(0)), r"[\s ​]+", " "))
    answers = answers.where((F.col("r.type") == "choices") & F.col("r.from_name").isin(*choices)).select(
        "task_id", "superseded", "annotator", "annotation_id", F.col("r.from_name").alias("from_name"), typed.alias("_typed")
    )
    classes = terms.where(F.col("field") == "target_ifc_class").select(F.lower("name").alias("_key"), F.col("name").alias("_class")).dropDuplicates(["_key"])
    answers = answers.join(classes, F.lower("_typed") == classes["_key"], "left")
    label = F.when(F.col("from_name") == "ifc_entity", F.coalesce("_class", "_typed")).otherwise(F.upper("_typed"))
    return answers.select("task_id", "superseded", "from_name", "annotator", label.alias("label"), "annotation_id").where(F.col("label").isNotNull())
