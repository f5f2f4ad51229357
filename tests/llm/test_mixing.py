"""Budgets are exact at any size of the sources, and trees are the caller's."""

import pytest

from clauseloom.llm import mixing
from conftest import rows


def got(*args, **kw):
    out = {}
    for mix, source, lang, budget, *_ in mixing.budgets(*args, **kw):
        out[source] = out.get(source, 0) + budget
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}, total


@pytest.mark.parametrize("tokens", [300, 30_000])
@pytest.mark.parametrize("languages", [1, 3])
def test_an_absent_source_leaves_its_share_to_its_domain(tokens, languages):
    targets = [("m", "code_text", 0.3, 1), ("m", "errata", 0.2, 1), ("m", "forum", 0.5, 1)]
    sizes = [("code_text", f"l{k}", tokens // languages) for k in range(languages)] + [("forum", "en", 5000)]
    shares, total = got(targets, sizes)
    assert shares == pytest.approx({"code_text": 0.5, "forum": 0.5}) and total == pytest.approx(2 * min(tokens, 5000))


def test_an_absent_domain_leaves_its_share_to_the_others():
    targets = [("m", "errata", 0.5, 1), ("m", "forum", 0.2, 1), ("m", "product_pages", 0.3, 2)]
    assert got(targets, [("forum", "en", 700), ("product_pages", "en", 10**6)])[0] == pytest.approx({"forum": 0.4, "product_pages": 0.6})
    assert mixing.budgets(targets, []) == []


def test_shortage_goes_to_the_same_language_of_the_domain_first():
    targets = [("m", "code_text", 0.4, 1), ("m", "errata", 0.2, 1), ("m", "forum", 0.4, 1)]
    sizes = [("code_text", "en", 1000), ("code_text", "fr", 1000), ("errata", "en", 20), ("forum", "en", 5000)]
    out = {r[1:3]: r[3] for r in mixing.budgets(targets, sizes, 1000)}
    assert out == pytest.approx({("code_text", "en"): 380, ("code_text", "fr"): 200, ("errata", "en"): 20, ("forum", "en"): 400})


def test_the_tree_is_an_argument():
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.5, 1)]
    tree = [("m", "x", "en", "a", 3.0), ("m", "x", "fr", "a", 1.0), ("m", "y", "en", "b", 4.0), ("m", "y", "en", "c", 1.0)]
    sizes = [("a", "en", 900), ("a", "fr", 900), ("b", "en", 900), ("c", "en", 900)]
    out = {r[1:3]: r[3] for r in mixing.budgets(targets, sizes, 1000, tree=tree)}
    # c has no target, so it may not be repeated even once; its weight stays in its language
    assert out == pytest.approx({("a", "en"): 1000 * 4 / 9 * 0.75, ("a", "fr"): 1000 * 4 / 9 * 0.25, ("b", "en"): 1000 * 5 / 9, ("c", "en"): 0})
    apart = got([("m", "code_text", 0.3, 1), ("m", "errata", 0.2, 1), ("m", "forum", 0.5, 1)], [("code_text", "en", 100), ("forum", "en", 100)], domains={})
    assert apart[0] == pytest.approx({"code_text": 0.375, "forum": 0.625})


def test_a_mix_beyond_what_a_source_can_fill(spark):
    docs = spark.createDataFrame([(k, "word " * 50, "en", s) for s, n, at in (("code_text", 60, 0), ("errata", 5, 100), ("forum", 200, 200)) for k in range(at, at + n)], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    targets = spark.createDataFrame([("m", "code_text", 0.3, 1), ("m", "errata", 0.2, 2), ("m", "forum", 0.5, 1)], "mix STRING, source STRING, target_share DOUBLE, max_repeats INT")
    tree = spark.createDataFrame([("m", "rules", "en", "code_text", 0.3), ("m", "rules", "en", "errata", 0.2), ("m", "talk", "en", "forum", 0.5)], "mix STRING, domain STRING, language STRING, source STRING, weight DOUBLE")
    out = {r["source"]: r for r in mixing.shares(mixing.mix(docs, targets, stretch=2.0, tree=tree), targets).collect()}
    assert out["errata"]["most_repeats"] == 2 and out["errata"]["actual_share"] == pytest.approx(0.1, abs=0.02)
    assert out["code_text"]["actual_share"] == pytest.approx(0.4, abs=0.02) and out["forum"]["actual_share"] == pytest.approx(0.5, abs=0.02)
    assert rows(mixing.mix(docs.where("false"), targets, tree=tree)) == []
