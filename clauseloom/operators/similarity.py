"""Candidate terms of clauses: a cosine shortlist first, finer signals on the shortlist only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseloom.functions.terms import exact_substring, fuzz_ratio, jaccard, tokenize
from clauseloom.tables import cut, spread

# Weights of the signals in the composite score.
WEIGHTS = {"tfidf_cosine": 0.40, "jaccard_tokens": 0.25, "fuzz_ratio": 0.20, "exact_substring": 0.15}


#: Postings of terms sent to the clauses at once: some 40 MB.
BLOCK = 500_000
#: Terms that may be asked for each clause.
MOST_TERMS = 100_000


def term_frequencies(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, term, tf of every token of every document."""
    return docs.select(*keys, F.explode(tokenize(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, term, weight: tf times smoothed idf ``ln((1 + N) / (1 + df)) + 1``, of length 1 per document.

    N counts all documents, also those without tokens.
    """
    tf = cut(term_frequencies(docs, keys, text))  # used three times: frequencies, weights, norms
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    total = docs.agg(F.count(F.lit(1)).alias("_total"))  # one row
    idf = df.crossJoin(F.broadcast(total)).select("term", (F.log((1 + F.col("_total")) / (1 + F.col("_df"))) + 1).alias("_idf"))
    weighted = tf.join(idf, "term").withColumn("_w", F.col("tf") * F.col("_idf"))
    norms = weighted.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    same = [weighted[k].eqNullSafe(norms[f"_{k}"]) for k in keys]
    joined = weighted.join(norms, same)
    return joined.select(*keys, "term", (F.col("_w") / F.col("_norm")).alias("weight"))


def _best(scored: DataFrame, wanted: int) -> DataFrame:
    """The ``wanted`` greatest cosines of each clause, equal ones by term."""
    place = F.row_number().over(W.partitionBy("c").orderBy(F.round("cosine", 9).desc(), "t"))
    return scored.withColumn("_r", place).where(F.col("_r") <= wanted).drop("_r")


def _nearest(left: DataFrame, right: DataFrame, wanted: int, block: int) -> DataFrame:
    """c, t, cosine: the best terms of each clause that share a token with it.

    The terms' postings are sent to the clauses in blocks of ``block`` at most.
    A clause's postings lie together, so its products are summed and its best
    are chosen where they are: neither the products nor the pairs of clauses
    and terms are shuffled, and a token that every document has is no hot key.
    Blocks after the first add their best to those before.
    """
    placed = left.repartition("c")
    blocks = max(1, -(-right.count() // block))
    best = None
    for k in range(blocks):
        part = right if blocks == 1 else right.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k)
        scored = placed.join(F.broadcast(part), "term").groupBy("c", "t").agg(F.sum(F.col("_a") * F.col("_b")).alias("cosine"))
        found = _best(scored, wanted)
        best = found if best is None else _best(best.unionByName(found), wanted)
        if k % 8 == 7:
            best = cut(best)
    return best


def cosine_shortlist(clauses: DataFrame, terms: DataFrame, top_k: int = 15, block: int = BLOCK) -> DataFrame:
    """clause_id, term_id, tfidf_cosine of each clause's ``top_k`` terms (all terms for 0), by cosine, then term_id.

    ``clauses`` has clause_id and text, ``terms`` term_id and text; both form
    one corpus. Exact: see :func:`_nearest` for what meets what; ``block``
    changes no result. Places that no positive cosine fills are filled with
    zero-cosine terms in the order of term_id. All terms of more than
    ``MOST_TERMS`` are not given: so many for each clause is no shortlist.
    """
    both = clauses.select(F.lit(0).alias("side"), F.col("clause_id").cast("string").alias("id"), "text").unionByName(
        terms.select(F.lit(1).alias("side"), F.col("term_id").cast("string").alias("id"), "text")
    )
    weights = cut(tfidf(spread(both), ["side", "id"], "text"))  # read from both sides
    left = weights.where("side = 0").select(F.col("id").alias("c"), "term", F.col("weight").alias("_a"))
    right = weights.where("side = 1").select(F.col("id").alias("t"), "term", F.col("weight").alias("_b"))
    n_terms = terms.count()
    wanted = min(top_k or n_terms, n_terms)
    if wanted > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms for each clause")
    ranked = _nearest(left, right, wanted, block)
    # the first terms by id, enough to fill any gap: 2 * wanted at most
    spare = terms.select(F.col("term_id").cast("string").alias("t")).orderBy("t").limit(2 * wanted).agg(F.sort_array(F.collect_list("t")).alias("_spare"))
    have = ranked.groupBy("c").agg(F.collect_list("t").alias("_have"))
    gaps = clauses.select(F.col("clause_id").cast("string").alias("c")).join(have, "c", "left").withColumn("_have", F.coalesce("_have", F.array().cast("array<string>")))
    gaps = gaps.where(F.size("_have") < wanted).crossJoin(F.broadcast(spare))
    fill = gaps.select("c", F.explode(F.slice(F.array_except("_spare", "_have"), F.lit(1), F.lit(wanted) - F.size("_have"))).alias("t"))
    out = ranked.unionByName(fill.withColumn("cosine", F.lit(0.0)))
    ids_c = clauses.select("clause_id").withColumn("c", F.col("clause_id").cast("string"))
    ids_t = terms.select("term_id").withColumn("t", F.col("term_id").cast("string"))
    return out.join(ids_c, "c").join(ids_t, "t").select("clause_id", "term_id", F.col("cosine").alias("tfidf_cosine"))


def score_candidates(
    clauses: DataFrame, terms: DataFrame, kind: str, top_k: int = 15, min_composite: float = 0.05, weights: dict[str, float] | None = None
) -> DataFrame:
    """clause_id, term_id, term_kind, composite and the four signals of the shortlist, from ``min_composite`` on.

    ``clauses`` has clause_id, heading, text; ``terms`` term_id, name, text.
    The finer signals compare heading and name; a signal of weight 0 is not
    computed (null). Empty inputs give no candidates.
    """
    weights = WEIGHTS if weights is None else weights
    short = cosine_shortlist(clauses, terms, top_k)
    rows = short.join(clauses.select("clause_id", F.coalesce("heading", F.lit("")).alias("_h")), "clause_id")
    rows = rows.join(terms.select("term_id", F.coalesce("name", F.lit("")).alias("_n")), "term_id")
    signals = {
        "jaccard_tokens": jaccard(F.array_distinct(tokenize(F.col("_h"))), F.array_distinct(tokenize(F.col("_n")))),
        "fuzz_ratio": fuzz_ratio(F.col("_h"), F.col("_n")),
        "exact_substring": exact_substring(F.col("_h"), F.col("_n")),
    }
    for name, value in signals.items():
        rows = rows.withColumn(name, value if weights.get(name) else F.lit(None).cast("double"))
    composite = sum((F.lit(w) * F.col(n) for n, w in weights.items() if w), F.lit(0.0))
    rows = rows.withColumn("composite", composite).where(F.col("composite") >= min_composite)
    return rows.select("clause_id", "term_id", F.lit(kind).alias("term_kind"), "composite", "tfidf_cosine", "jaccard_tokens", "fuzz_ratio", "exact_substring")
