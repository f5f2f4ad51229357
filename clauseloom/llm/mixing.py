"""Mixes of sources with target shares of the total size in tokens.

Hierarchical budgeting: each mix is a tree of domain, language and source; a
node's budget is split over its children by weight. What a child cannot fill
(its documents, repeated as often as allowed) goes to its siblings first and to
the ancestors' other children only after that; so does the weight of sources
that have no documents at all. Each leaf then takes its budget as whole epochs
in seeded order and a token-prefix of one more.

A source stands under each of its languages, with its target split in
proportion to its tokens, so that its leaves together have the target share.

The trees are small (one leaf per mix, source and language) and are budgeted on
the driver; documents are never collected, and a leaf's prefix is found from a
histogram, so a leaf that holds a third of all rows is no task of its own.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseloom.llm.tokens import TOKENIZERS, VOCABULARY, token_count
from clauseloom.tables import cut

#: Leaves over all mixes that the driver will budget.
MAX_LEAVES = 200_000
#: Ranges of the seeded order per leaf in the histogram.
RANGES = 4096
SEED = 20_260_901

# The domain of each source where no tree or other domains are given; others form a domain of their own.
DOMAINS = {
    "code_text": "rules", "errata": "rules", "glossary": "rules",
    "guidance": "commentary", "review_notes": "commentary", "minutes": "commentary", "forum": "commentary",
    "product_pages": "products", "spec_sheets": "products", "drawings_ocr": "products",
}


class Node:
    """A node of a mix's tree: its weight among its siblings and how much it can hold."""

    def __init__(self, weight: float = 0.0, room: float = 0.0):
        self.weight, self.own_room, self.children, self.budget, self.share = weight, room, {}, 0.0, 0.0

    @property
    def room(self) -> float:
        return sum(c.room for c in self.children.values()) if self.children else self.own_room

    def fill(self, budget: float) -> float:
        """Split ``budget`` over the children; returns what found no room."""
        self.budget = min(budget, self.room)
        if self.children:
            for child, share in zip(self.children.values(), water_fill(self.budget, [(c.weight, c.room) for c in self.children.values()])):
                child.fill(share)
        return budget - self.budget


def water_fill(budget: float, parts: list[tuple[float, float]]) -> list[float]:
    """Shares of ``budget`` by weight, none above its room; the rest of a full part goes to the others by weight.

    Parts of weight 0 get something only when all others are full.
    """
    given = [0.0] * len(parts)
    for eligible in (lambda w: w > 0, lambda w: True):
        open_ = [k for k, (w, room) in enumerate(parts) if eligible(w) and given[k] < room]
        while open_ and budget - sum(given) > 1e-9:
            left = budget - sum(given)
            total = sum(parts[k][0] or 1e-12 for k in open_)
            full = []
            for k in open_:
                given[k] += left * (parts[k][0] or 1e-12) / total
                if given[k] >= parts[k][1] - 1e-9:
                    given[k] = parts[k][1]
                    full.append(k)
            if not full:
                break
            open_ = [k for k in open_ if k not in full]
    return given


def pass_on(node: Node, share: float = 1.0) -> None:
    """Set each node's ``share``: its part of the whole by weight, where what has no room passes its part on to its siblings.

    A node without room gets nothing, so its weight stays in its parent; a
    parent of such nodes only has no room itself.
    """
    node.share = share
    present = {k: c for k, c in node.children.items() if c.room > 0}
    weighted = sum(c.weight for c in present.values())
    for k, child in node.children.items():
        pass_on(child, share * child.weight / weighted if k in present and weighted > 0 else 0.0)


def leaves_of(node: Node) -> list[Node]:
    return [leaf for c in node.children.values() for leaf in leaves_of(c)] if node.children else [node]


def largest_exact_total(root: Node) -> float:
    """The largest total at which every leaf gets its share (see :func:`pass_on`) of it."""
    pass_on(root)
    return min((leaf.room / leaf.share for leaf in leaves_of(root) if leaf.share > 0), default=0.0)


Branch = tuple[str, str, str | None, str, float]


def default_tree(targets: list[tuple[str, str, float, int]], sizes: list[tuple[str, str | None, int]], domains: dict[str, str] | None = None) -> list[Branch]:
    """(mix, domain, language, source, weight) of each leaf: a source's target, split over its languages in proportion to its tokens.

    Sources without a domain (see :data:`DOMAINS`) form one of their own. A source without documents
    stands under a language of its own in its domain, so that what it leaves is
    shared by the whole domain.
    """
    by_source: dict[str, list[tuple[str | None, int]]] = defaultdict(list)
    for source, lang, tokens in sizes:
        if tokens:
            by_source[source].append((lang, int(tokens)))
    out: list[Branch] = []
    for mix, source, share, _ in targets:
        domain, here = (DOMAINS if domains is None else domains).get(source, source), by_source.get(source, [])
        total = sum(n for _, n in here)
        out += [(mix, domain, lang, source, max(share or 0.0, 0.0) * n / total) for lang, n in here]
        if not here:
            out.append((mix, domain, f"(no {source})", source, max(share or 0.0, 0.0)))
    return out


def budgets(
    targets: list[tuple[str, str, float, int]], sizes: list[tuple[str, str | None, int]], totals: dict[str, float] | float | None = None,
    tree: list[Branch] | None = None, domains: dict[str, str] | None = None, stretch: float = 1.0,
) -> list[tuple]:
    """(mix, source, lang, budget, epochs, rest, size) for each leaf.

    ``targets`` are (mix, source, share, most repeats), ``sizes`` are (source,
    language, tokens); ``tree`` has the leaves of each mix as rows of
    :func:`default_tree`, which makes them from the targets where it is not
    given. Without ``totals`` a mix is ``stretch`` times as large as it can be
    with every share exact; with a total that some source cannot fill, the
    shortage is redistributed up the tree. Negative or null shares and repeats
    count as 0.
    """
    tokens_of: dict[tuple[str, str | None], int] = defaultdict(int)
    for source, lang, tokens in sizes:
        tokens_of[source, lang] += int(tokens)
    repeats: dict[tuple[str, str], int] = {}
    for mix, source, _, most in targets:
        repeats[mix, source] = max(repeats.get((mix, source), 0), max(int(most or 0), 0))
    mixes: dict[str, Node] = {}
    placed: dict[str, list[tuple[str, str | None, Node]]] = defaultdict(list)
    for mix, domain, lang, source, weight in default_tree(targets, sizes, domains) if tree is None else tree:
        weight = max(weight or 0.0, 0.0)
        node = mixes.setdefault(mix, Node(1.0))
        for name in (("domain", domain), ("language", lang)):
            node = node.children.setdefault(name, Node())
            node.weight += weight
        if source not in node.children:
            node.children[source] = Node(0.0, tokens_of.get((source, lang), 0) * repeats.get((mix, source), 0))
            placed[mix].append((source, lang, node.children[source]))
        node.children[source].weight += weight
    out = []
    for mix, root in sorted(mixes.items()):
        wanted = totals.get(mix) if isinstance(totals, dict) else totals
        root.fill(largest_exact_total(root) * stretch if wanted is None else wanted)
        for source, lang, leaf in placed[mix]:
            tokens = tokens_of.get((source, lang), 0)
            if tokens:
                epochs = int((leaf.budget + 1e-6) // tokens)
                out.append((mix, source, lang, float(leaf.budget), epochs, float(max(leaf.budget - epochs * tokens, 0.0)), tokens))
    return out


def sized(documents: DataFrame, targets: DataFrame, name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, lang, n_tokens of the documents of targeted sources that have tokens, written to the shared folder once."""
    wanted = targets.where(F.col("target_share") > 0).select("source").distinct()
    docs = documents.select("doc_id", "source", "lang", "text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    docs = docs.join(wanted, "source", "left_semi")
    return cut(docs.select("doc_id", "source", "lang", token_count(F.col("text"), name, folder).alias("n_tokens")).where(F.col("n_tokens") > 0))


def plan(
    documents: DataFrame, targets: DataFrame, totals: dict[str, float] | float | None = None, tree: DataFrame | None = None,
    domains: dict[str, str] | None = None, stretch: float = 1.0, **tokenizer,
) -> tuple[DataFrame, DataFrame]:
    """(sized documents, leaf budgets) of all mixes."""
    docs = sized(documents, targets, **tokenizer)
    per_leaf = docs.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")).limit(MAX_LEAVES + 1).collect()
    wanted = targets.select("mix", "source", "target_share", "max_repeats").where(F.col("mix").isNotNull() & F.col("source").isNotNull()).distinct()
    wanted = wanted.orderBy("mix", "source", "target_share", "max_repeats").limit(MAX_LEAVES + 1).collect()
    branches = None if tree is None else sorted(tree.select("mix", "domain", "language", "source", "weight").limit(MAX_LEAVES + 1).collect(), key=str)
    if max(len(per_leaf), len(wanted), len(branches or [])) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    rows = budgets([tuple(r) for r in wanted], sorted(((r[0], r[1], r[2]) for r in per_leaf), key=str), totals, branches and [tuple(r) for r in branches], domains, stretch)
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    return docs, docs.sparkSession.createDataFrame(rows, "mix STRING, source STRING, lang STRING, budget DOUBLE, epochs INT, rest DOUBLE, tokens BIGINT")


def mix(
    documents: DataFrame, targets: DataFrame, totals: dict[str, float] | float | None = None, seed: int = SEED, tree: DataFrame | None = None,
    domains: dict[str, str] | None = None, stretch: float = 1.0, **tokenizer,
) -> DataFrame:
    """mix, doc_id, source, lang, n_tokens, repeats of every selected document.

    ``repeats`` is the number of whole epochs, plus one if the document stands
    in the token-prefix of the last epoch, never more than the target's
    ``max_repeats``. The order of an epoch is a hash of document, mix, epoch and
    seed. Documents are whole, so a leaf misses its budget by half a document
    at most. Sources without a target and texts without tokens (null, empty) are
    never selected. Targets without documents leave their share to their
    siblings, whatever the sizes of the others. ``tree`` (mix, domain, language,
    source, weight) and ``domains`` say what is whose sibling; ``totals`` and
    ``stretch`` how large a mix is (see :func:`budgets`).
    """
    docs, leaves = plan(documents, targets, totals, tree, domains, stretch, **tokenizer)
    leaves = leaves.where(F.col("budget") > 0).select("mix", F.col("source").alias("_s"), F.col("lang").alias("_l"), "epochs", "rest")
    # MAX_LEAVES rows at most, hence small enough for every task
    rows = docs.join(F.broadcast(leaves), (F.col("source") == F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l"))).drop("_s", "_l")
    place = F.xxhash64("doc_id", "mix", "epochs", F.lit(seed))
    rows = rows.withColumns({"_place": place, "_range": F.shiftrightunsigned(place, 52).cast("int")})
    open_ = rows.where(F.col("rest") > 0)
    by_leaf = ["mix", "source", "lang"]
    histogram = open_.groupBy(*by_leaf, "_range").agg(F.sum("n_tokens").alias("_n"), F.first("rest").alias("rest"))
    upto = F.sum("_n").over(W.partitionBy(*by_leaf).orderBy("_range"))  # RANGES rows a leaf at most
    before = histogram.select(*by_leaf, "_range", "rest", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"))
    # the range in which the prefix ends, one a leaf
    edge = before.where((F.col("_before") <= F.col("rest")) & (F.col("_upto") > F.col("rest")))
    edge = edge.select(*[F.col(c).alias(f"_{c}") for c in by_leaf], F.col("_range").alias("_edge"), "_before")
    rows = rows.join(F.broadcast(edge), (F.col("mix") == F.col("_mix")) & (F.col("source") == F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang")), "left")
    inside = F.col("_range") == F.col("_edge")
    last = rows.where(inside).withColumn("_sum", F.col("_before") + F.sum("n_tokens").over(W.partitionBy(*by_leaf).orderBy("_place", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)))
    # the document on the edge belongs to the prefix if that comes nearer to the budget
    extra_last = last.withColumn("_extra", (F.col("_sum") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    whole = (F.col("rest") > 0) & (F.col("_edge").isNull() | (F.col("_range") < F.col("_edge")))
    extra_rest = rows.where(~F.coalesce(inside, F.lit(False))).withColumn("_extra", whole.cast("int"))
    out = ["mix", "doc_id", "source", "lang", "n_tokens", (F.col("epochs") + F.col("_extra")).alias("repeats")]
    return extra_last.select(*out).unionByName(extra_rest.select(*out)).where(F.col("repeats") > 0)


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """mix, source, target_share, actual_share, tokens, documents, most_repeats, max_repeats of each target; sources that gave nothing have 0."""
    used = selection.groupBy("mix", "source").agg(
        F.sum(F.col("n_tokens").cast("long") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats")
    )
    total = used.groupBy("mix").agg(F.sum("tokens").alias("_total"))
    wanted = targets.groupBy("mix", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = wanted.join(used, ["mix", "source"], "left").join(total, "mix", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("tokens", "documents", "most_repeats")}
    return rows.select(
        "mix", "source", "target_share", F.coalesce(F.try_divide(F.col("tokens"), F.col("_total")), F.lit(0.0)).alias("actual_share"),
        zero["tokens"], zero["documents"], zero["most_repeats"], "max_repeats",
    )
