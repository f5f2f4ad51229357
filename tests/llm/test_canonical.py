"""Reference lists in parts give what the whole list gives, and lists of another kind are matched as well."""

import random

import pytest
from pyspark.sql import functions as F

from clauseloom.llm import canonical
from clauseloom.tables import table
from conftest import rows

SCHEMA = "field STRING, name STRING, aliases ARRAY<STRING>"


@pytest.mark.parametrize("shards", [2, 3, 7])
def test_parts_decide_as_the_whole(spark, sf_dir, shards):
    terms = table(spark, sf_dir, "canonical_terms")
    typed = canonical.typed_fields(table(spark, sf_dir, "sample_rule_drafts")).select("field", "value").distinct()
    size = -(-terms.count() // shards)
    whole = canonical.match_values(typed, "field", "value", terms)
    parts = canonical.match_values(typed, "field", "value", terms, shard=size, block=100)
    assert sorted(rows(parts)) == sorted(rows(whole))


RIVALS = [("p", "WidthA", None), ("p", "OpeningB", ["WidthA (clear)"]), ("p", "Twin1", ["twin form"]), ("p", "Twin2", ["twin form"]), ("p", "alphabeta", None), ("p", "alphabetb", None), ("p", "ClearWidth", None), ("p", "ClearHeight", None)]
ASKED = ["WidthA (clear)", "twin form", "Twin 1", "alphabetc", "alphabeta", "ClrWdth", "ClrHght", "clear wdth", "nothing of it", "x" * 30_000, " ", "widtha", "twin forn"]


def test_rival_terms_in_different_parts(spark):
    terms = spark.createDataFrame(RIVALS, SCHEMA)
    df = spark.createDataFrame([("p", v) for v in ASKED], "field STRING, value STRING")
    whole = {r["value"]: (r["term"], r["edits"]) for r in canonical.match_values(df, "field", "value", terms).collect()}
    assert whole["WidthA (clear)"] == ("OpeningB", 0) and whole["twin form"] == ("unmatched", None) and whole["widtha"] == ("WidthA", 0)
    for shard in (1, 2, 3):
        for sent in (canonical.SENT_BYTES, 0):
            got = canonical.match_values(df, "field", "value", terms, shard=shard, block=2, sent_bytes=sent)
            assert {r["value"]: (r["term"], r["edits"]) for r in got.collect()} == whole, (shard, sent)


def test_decision_does_not_depend_on_the_cut():
    rng = random.Random(8)
    syllables = ["ka", "lo", "mi", "ter", "san", "ob", "ru", "vel"]
    name = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))).title()
    terms = [("p", n, rng.choice([None, [name()], [name(), name()]])) for n in {name() for _ in range(120)}]
    whole = canonical.Matcher(terms)
    for _ in range(3):
        k = rng.randint(2, 6)
        parts = [canonical.Matcher(p) for p in ([t for t in terms if hash((t[1], k)) % k == j] for j in range(k))]
        for _ in range(150):
            value = list(name())
            for _ in range(rng.randint(0, 2)):
                value[rng.randrange(len(value))] = rng.choice("aeiklmnorst ")
            value = "".join(value)
            expected = canonical.decide(whole.candidates("p", value))
            assert canonical.decide([c for p in parts for c in p.candidates("p", value, alone=False)]) == expected, value


CITIES = (
    "Amsterdam Athens Barcelona Belgrade Berlin Bern Bologna Bratislava Bremen Brussels Bucharest Budapest Cologne Copenhagen Cork Dresden Dublin Edinburgh Florence Frankfurt Geneva Genoa Ghent Glasgow Gothenburg Graz "
    "Hamburg Hanover Helsinki Krakow Leipzig Liege Lille Lisbon Liverpool Ljubljana Lodz London Lyon Madrid Malaga Manchester Marseille Milan Munich Nantes Naples Nice Nuremberg Oslo Palermo Paris Porto Poznan Prague "
    "Reykjavik Riga Rome Rotterdam Seville Sofia Stockholm Strasbourg Stuttgart Tallinn Toulouse Turin Utrecht Valencia Venice Vienna Vilnius Warsaw Zagreb Zurich"
).split()
NO_CITY = "Atlantis Gotham Springfield Wakanda Narnia Mordor Rivendell Hogsmeade Metropolis Smallville Arkham Winterfell Lilliput Brigadoon Xanadu Camelot Avalon Utopia Oz Eldorado".split()


def test_precision_on_a_list_of_cities(spark):
    """Typing errors find their city, other names find none: a list that has nothing to do with the test tables."""
    rng = random.Random(9)
    asked = []
    for city in CITIES:
        for _ in range(4):
            at = rng.randrange(1, len(city) - 1)
            typo = rng.choice([city[:at] + city[at + 1 :], city[:at] + city[at] + city[at:], city[:at] + city[at + 1] + city[at] + city[at + 2 :], city[:at] + rng.choice("aeinrst") + city[at + 1 :], city.upper(), f" {city.lower()} "])
            asked.append((typo, city))
    asked += [(n, "unmatched") for n in NO_CITY]
    terms = spark.createDataFrame([("city", c, None) for c in CITIES], SCHEMA)
    df = spark.createDataFrame([("city", *a) for a in asked], "field STRING, value STRING, expected STRING")
    got = canonical.match_values(df, "field", "value", terms).select("term", "expected").collect()
    matched = [r for r in got if r["term"] != "unmatched"]
    assert sum(r["term"] == r["expected"] for r in matched) / len(matched) >= 0.98
    assert sum(r["term"] == r["expected"] for r in got) / len(got) >= 0.93


def test_hot_values_and_clashing_columns(spark):
    terms = spark.createDataFrame(RIVALS, SCHEMA)
    df = spark.range(3000).select(F.lit("p").alias("field"), F.when(F.col("id") % 3 == 0, "widtha").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("value"), F.lit(7).alias("edits"), "id")
    got = canonical.match_values(df, "field", "value", terms, sent_bytes=0)
    assert got.columns.count("edits") == 1 and got.where("term = 'WidthA' AND edits = 0").count() == 1000 and got.count() == 3000
