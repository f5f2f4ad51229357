"""Copies count once whichever way groups are brought together, and exact percentiles agree with sorted values."""

import random

import pytest

from clauseloom.llm import quantiles
from conftest import rows

KIND = "run BIGINT, g STRING, day INT, a DOUBLE, b DOUBLE"


def data():
    rng = random.Random(12)
    made = [(k, rng.choice(["x", "x", "x", "y", None]), rng.randint(1, 3), rng.choice([rng.lognormvariate(0, 3), -1.0, 0.0, None]), float("nan") if k % 9 == 0 else rng.random()) for k in range(600)]
    return made + made[::7] + made[:3] * 50


@pytest.mark.parametrize("by", [["g"], ["g", "day"], []])
def test_sketch_of_copies_does_not_depend_on_the_way(spark, by):
    df = spark.createDataFrame(data(), KIND)
    once = spark.createDataFrame(sorted(set(data()), key=str), KIND).dropDuplicates(["run"])
    expected = sorted(rows(quantiles.sketch(once, by, ["a", "b"], keep=lambda v: v >= 0)), key=str)
    for limit in (0, 10**9):
        assert sorted(rows(quantiles.sketch(df, by, ["a", "b"], keep=lambda v: v >= 0, once="run", group_rows=limit)), key=str) == expected


def test_groups_of_bounded_size_are_shuffled_once(spark):
    counts = quantiles.sketch(spark.createDataFrame(data(), KIND), ["g", "day"], ["a", "b"], once="run")
    plan = quantiles.percentiles(counts, ["g", "day"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_exact_percentiles(spark):
    df = spark.createDataFrame(data(), KIND)
    at = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r["g"], r["metric"], r["p"]): (r["n"], r["exact"], r["estimate"]) for r in quantiles.exact_percentiles(df, ["g"], ["a", "b"], at, once="run").collect()}
    for g in ("x", "y", None):
        for place, metric in ((3, "a"), (4, "b")):
            values = sorted(v for v in (r[place] for r in {r[0]: r for r in data() if r[1] == g}.values()) if v is not None and v == v)
            for p in at:
                n, exact, estimate = got[g, metric, p]
                true = values[max(1, -(-round(p * len(values) * 1000) // 1000)) - 1]
                assert n == len(values) and exact == true and abs(estimate - exact) <= 0.0100001 * abs(exact)
    assert quantiles.exact_percentiles(df.where("false"), ["g"], ["a"], at).count() == 0
