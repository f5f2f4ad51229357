"""Freely typed values mapped to the entry of a reference list that was meant.

The reference forms stand in BK-trees under the unrestricted Damerau-Levenshtein
distance, which is a metric, so the triangle inequality prunes and a search
returns every form within its threshold. Each distinct value is searched once.

A list of at most ``SHARD`` entries is one tree, sent to every task. A longer
one is cut into shards that are never together in one place: blocks of values
meet one shard at a time, each shard hands on the candidates it has, and the
same decision as for one tree is taken once, over the candidates of all shards.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.operators.skew import skewed_join
from clauseloom.tables import cut

#: Entries of a shard: with up to some hundred bytes an entry, a bound of about 50 MB in a task.
SHARD = 100_000
#: Values that meet a shard in one task.
BLOCK = 100_000
#: Bytes of matched values up to which they are sent to every task; more are joined by shuffle.
SENT_BYTES = 32 << 20
UNMATCHED = "unmatched"

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеіјорсухһԁѕԛԝьАВЕНІЈКМОРСТУХЅαβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıȷɡ",
    "aeijopcyxhdsqwbABEHIJKMOPCTYXSabeiknoptuxABEZHIKMNOPTYXijg",
)
# Words before or after a name that do not belong to it.
FILLERS = frozenset("the a an of required req min max minimum maximum value actual net".split())
# Comparison signs and their one spelling.
SIGNS = {
    "≥": ">=", "⩾": ">=", "≧": ">=", "=>": ">=", ">=": ">=", "≤": "<=", "⩽": "<=", "≦": "<=", "=<": "<=", "<=": "<=",
    "=": "==", "==": "==", "===": "==", ">": ">", "<": "<", "≠": "!=", "<>": "!=", "!=": "!=", "=/=": "!=", "/=": "!=",
}
# Wordings of comparisons beside those of the reference list.
WORDINGS = {
    ">=": "not below; not less than; no less than; no smaller than; not smaller than; not fewer than; no fewer than; or more; or greater; "
    "greater or equal; greater than or equal; greater than or equal to; greater equal; equal or greater; at minimum; minimum of; min; ge; gte; geq",
    "<=": "not above; not more than; no more than; not greater than; no greater than; not exceeding; shall not exceed; must not exceed; does not exceed; "
    "or less; or fewer; less or equal; less than or equal; less than or equal to; less equal; equal or less; up to; at maximum; maximum of; max; le; lte; leq",
    "==": "equal; equal to; is equal to; equals; exact; exactly; is; eq; same as; identical to",
    "between": "between; in range; within range; within; range; from to; in between",
    ">": "greater than; greater; more than; above; exceeds; exceeding; over; strictly greater; strictly more; strictly greater than; strictly more than; gt; larger than; higher than",
    "<": "less than; less; fewer than; below; under; strictly less; strictly fewer; strictly less than; strictly below; smaller than; lower than; lt",
    "!=": "not equal; not equal to; unequal; different from; differs from; other than; is not; ne; neq",
}


def plain(value: str) -> str:
    """One script, no markup, no invisible characters, single spaces."""
    text = unicodedata.normalize("NFKC", html.unescape(html.unescape(value))).translate(LOOKALIKES)
    text = "".join(ch for ch in text if unicodedata.category(ch) not in ("Cf", "Cc") or ch in "\t\n")
    return " ".join(text.split())


def words(text: str) -> list[str]:
    """Lower-case words; camel case, underscores and signs separate."""
    text = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", text)
    folded = "".join(ch for ch in unicodedata.normalize("NFD", text) if not unicodedata.combining(ch)).lower()
    return re.findall(r"[a-z0-9]+", folded)


def skeleton(parts: list[str]) -> str:
    """First letters and consonants: what is left of words written without vowels."""
    return "".join(w[0] + re.sub("[aeiou]", "", w[1:]) for w in parts)


def variants(value: str, field: str) -> list[str]:
    """Keys to look up, the likeliest first: as typed, then without decorations."""
    text = plain(value)
    sign = SIGNS.get(re.sub(r"\s", "", text))
    if sign:
        return [sign]
    bare = re.sub(r"\s*[\(\[].*?[\)\]]\s*", " ", text)
    tail = re.sub(r"^.*[.:/](?=\s*\w{2})", "", bare) if re.match(r"^\S*[.:/]\S", bare) else bare
    keys: list[str] = []
    skeletons: list[str] = []
    for form in (text, bare, tail):
        parts = words(form)
        pieces = [x for x in form.split(",") if x.strip()]
        orders = [parts, words(" ".join(reversed(pieces)))] if len(pieces) > 1 else [parts]
        for p in orders:
            while p and re.fullmatch(r"ifc\d\w*", p[0]):
                p = p[1:]
            inner = [w for w in p if w not in FILLERS]
            keys += ["".join(p), "".join(inner)]
            short = skeleton(inner)
            if len(short) >= 4:
                skeletons.append("~" + short)
    return list(dict.fromkeys(k for k in [*keys, *skeletons] if k))


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insert, delete, replace, or swap neighbours. A metric."""
    if a == b:
        return 0
    big = len(a) + len(b)
    seen: dict[str, int] = {}
    rows = [[big] * (len(b) + 2), [big, *range(len(b) + 1)]]
    for i, ca in enumerate(a, 1):
        row, above, match = [big, i], rows[i], 0
        for j, cb in enumerate(b, 1):
            swap_i, swap_j = seen.get(cb, 0), match
            cost = 1
            if ca == cb:
                cost, match = 0, j
            row.append(min(above[j] + cost, row[j] + 1, above[j + 1] + 1, rows[swap_i][swap_j] + i - swap_i - 1 + 1 + j - swap_j - 1))
        rows.append(row)
        seen[ca] = i
    return rows[-1][-1]


def threshold(key: str) -> int:
    """Edits allowed for a key of this length."""
    return 0 if len(key) <= 2 else 1 if len(key) <= 5 else 2 if len(key) <= 11 else 3


def tolerance(form: str) -> int:
    """Edits a reference form may be away; forms of three letters differ too little among themselves for any."""
    return 0 if len(form) <= 3 else threshold(form)


class BKTree:
    """Forms by distance from their parent form; each node has the terms its form stands for."""

    def __init__(self, forms: Iterable[tuple[str, str]]):
        self.root: list | None = None
        self.longest = 0
        terms: dict[str, set[str]] = {}
        for form, term in sorted(set(forms)):
            terms.setdefault(form, set()).add(term)
        for form, meant in terms.items():
            self._add(form, meant)

    def _add(self, form: str, terms: set[str]) -> None:
        self.longest = max(self.longest, len(form))
        if self.root is None:
            self.root = [form, terms, {}]
            return
        node = self.root
        while True:
            d = distance(form, node[0])
            if d not in node[2]:
                node[2][d] = [form, terms, {}]
                return
            node = node[2][d]

    def search(self, key: str, radius: int) -> list[tuple[int, str, str]]:
        """(distance, form, term) of every form within ``radius``."""
        if len(key) - radius > self.longest:  # further than the radius from every form
            return []
        found, stack = [], [self.root] if self.root else []
        while stack:
            form, terms, children = stack.pop()
            d = distance(key, form)
            if d <= radius:
                found += [(d, form, t) for t in terms]
            stack += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
        return sorted(found)


def reference_forms(terms: Iterable[tuple[str, str, list[str] | None]]) -> tuple[dict[str, list[tuple[str, str]]], dict[str, list[tuple[str, str]]]]:
    """(forms searched with edits, forms that must be met exactly), by field, of (field, name, aliases) rows. Skeletons start with ``~``."""
    near: dict[str, list[tuple[str, str]]] = {}
    only: dict[str, list[tuple[str, str]]] = {}
    for field, name, aliases in terms:
        if not field or not name:
            continue
        loose, strict = near.setdefault(field, []), only.setdefault(field, [])
        if name in SIGNS.values():
            strict.append((name, name))
        for listed in [name, *(aliases or [])]:
            parts = words(plain(listed))
            if not parts:
                continue
            loose.append(("".join(parts), name))
            strict.append(("~" + skeleton(parts), name))
            if parts[0] == "ifc" and len(parts) > 1:
                parts = parts[1:]
                strict += [("".join(parts), name), ("~" + skeleton(parts), name)]
            strict.append(("".join(parts) + "s", name))
        if field == "operator":
            loose += [("".join(words(w)), name) for w in WORDINGS.get(name, "").split(";") if words(w)]
    return near, only


#: A candidate: how it was found (0 a form met exactly, 1 a form within its threshold, 2 the same consonants), the rank of the key, the distance, the term.
Candidate = tuple[int, int, int, str]
_ANSWER = T.StructType([T.StructField("term", T.StringType()), T.StructField("edits", T.IntegerType())])
_CANDIDATES = "array<struct<step:int,rank:int,edits:int,term:string>>"


class Matcher:
    """The trees of a part of the reference list, which has all forms of each of its terms."""

    def __init__(self, terms: Iterable[tuple[str, str, list[str] | None]]):
        near, only = reference_forms(terms)
        self.near = {field: BKTree(forms) for field, forms in near.items()}
        self.only = {field: BKTree(forms) for field, forms in only.items()}
        self.spelt: dict[tuple[str, str], set[str]] = {}
        for forms in (near, only):
            for field, listed in forms.items():
                for form, term in listed:
                    if form[0] != "~":
                        self.spelt.setdefault((field, term), set()).add(form)

    def candidates(self, field: str, value: str, alone: bool = True) -> list[Candidate]:
        """What :func:`decide` needs to know of this part; ``alone`` if there is no other part, so that a later step is not looked at in vain."""
        if field not in self.near:
            return []
        keys = variants(value, field)
        typed = [k for k in keys if k[0] != "~"]
        found: list[Candidate] = []
        for place, key in enumerate(typed):
            for kind, tree in enumerate((self.near[field], self.only[field])):
                found += [(0, 2 * place + kind, 0, term) for _, _, term in tree.search(key, 0)]
            if alone and decide(found):
                return found
        best: dict[str, int] = {}
        for key in typed:
            for d, form, term in self.near[field].search(key, threshold(key)):
                if d <= tolerance(form):
                    best[term] = min(d, best.get(term, d))
        if best:
            least = min(best.values())
            found += [(1, 0, d, term) for term, d in best.items() if d == least]
        if not best or not alone:
            for place, key in enumerate(k for k in keys if k[0] == "~"):
                for term in {t for _, _, t in self.only[field].search(key, 0)}:
                    found.append((2, place, min(distance(k, form) for k in typed for form in self.spelt[field, term]), term))
        return found

    def match(self, field: str, value: str) -> tuple[str, int, bool] | None:
        """(term, distance, whether other terms are as near) of a value against this part alone, or None."""
        found = self.candidates(field, value)
        meant = decide(found)
        near = sorted(c for c in found if c[0] == 1)
        return (*meant, False) if meant else (near[0][3], near[0][2], True) if near else None


def decide(candidates: Iterable[Candidate]) -> tuple[str, int] | None:
    """(term, edits) of the candidates of all parts, or None.

    The first key that is exactly a form of one term decides; else the term
    with the nearest form, if it is the only one as near; else, where no form
    is near, the first key whose consonants are those of one term.
    """
    steps: dict[int, dict[int, dict[str, int]]] = {0: {}, 1: {}, 2: {}}
    for step, rank, edits, term in candidates:
        terms = steps[step].setdefault(edits if step == 1 else rank, {})
        terms[term] = min(edits, terms.get(term, edits))
    for step in (0, 1, 2):
        for rank in sorted(steps[step]):
            if len(steps[step][rank]) == 1:
                return next(iter(steps[step][rank].items()))
            if step == 1:
                return None
    return None


def match_values(df: DataFrame, field: str, value: str, terms: DataFrame, shard: int = SHARD, block: int = BLOCK, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Add ``term`` (the name meant or 'unmatched') and ``edits`` (null if unmatched).

    ``terms`` has field, name and aliases; a term listed in several rows has the
    aliases of all. A value equally near to several names is unmatched, as are
    null, blank and unknown values. The distinct values are taken out (combined
    before the shuffle), searched once and joined back: sent to every task up to
    ``sent_bytes``, else by a join that splits hot values. ``shard`` and
    ``block`` bound the memory of a task and never change a result. Clashing
    columns ``term`` and ``edits`` are replaced.
    """
    terms = terms.select("field", "name", "aliases").where(F.col("field").isNotNull() & F.col("name").isNotNull())
    typed = df.select(F.col(field).alias("_f"), F.col(value).alias("_v")).where(F.col("_f").isNotNull() & (F.trim("_v") != "")).distinct()
    tasks = df.sparkSession.sparkContext.defaultParallelism
    head = terms.limit(shard + 1).collect()
    if len(head) <= shard:
        found = typed.repartition(tasks).select("_f", "_v", _search(df, head)("_f", "_v").alias("_m"))
    else:
        typed = cut(typed)
        shards, blocks = -(-terms.count() // shard), max(1, -(-typed.count() // block))
        listed = terms.withColumns({"_shard": F.pmod(F.xxhash64("field", "name"), F.lit(shards)), "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        asked = typed.withColumns({"_block": F.pmod(F.xxhash64("_v"), F.lit(blocks)), "_shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
        by = [F.col("_shard").cast("int"), F.col("_block").cast("int")]
        met = asked.groupBy(*by).cogroup(listed.groupBy(*by)).applyInPandas(_block_candidates, f"_f STRING, _v STRING, _c {_CANDIDATES}")
        # a value has few candidates in each shard
        found = met.groupBy("_f", "_v").agg(F.flatten(F.collect_list("_c")).alias("_c")).select("_f", "_v", _decided("_c").alias("_m"))
    # the values without a term go after the cut: a filter on the search before it would be pushed to the rows below distinct
    found = cut(found.select("_f", "_v", "_m.term", "_m.edits")).where(F.col("term").isNotNull())
    kept = df.drop("term", "edits")
    size = found.agg(F.sum(F.octet_length("_f") + F.octet_length("_v") + F.octet_length("term") + 64)).first()[0] or 0
    if size <= sent_bytes:
        out = kept.join(F.broadcast(found), (F.col(field) == F.col("_f")) & (F.col(value) == F.col("_v")), "left").drop("_f", "_v")
    else:
        keyed = found.select(F.struct("_f", "_v").alias("_key"), "term", "edits")
        out = skewed_join(kept.withColumn("_key", F.struct(F.col(field).alias("_f"), F.col(value).alias("_v"))), keyed, "_key", "left").drop("_key")
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], F.coalesce("term", F.lit(UNMATCHED)).alias("term"), "edits")


def _search(df: DataFrame, listed: list):
    """A vectorised function over the whole reference list; its trees are kept by the worker process for all its tasks."""
    rows = sorted((r["field"], r["name"], sorted(r["aliases"] or [], key=str)) for r in listed)
    sent = df.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf(_ANSWER)
    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        matcher = _kept_matcher(sent.value)
        for fields, values in batches:
            yield _answers([decide(matcher.candidates(f, v)) for f, v in zip(fields, values)])

    return search


def _kept_matcher(rows: list) -> Matcher:
    kept = sys.__dict__.setdefault("_clauseloom_matchers", {})
    key = hash(repr(rows))
    if key not in kept:
        kept.clear()
        kept[key] = Matcher(rows)
    return kept[key]


def _answers(found: list) -> pd.DataFrame:
    return pd.DataFrame([r or (None, None) for r in found], columns=["term", "edits"]).astype({"edits": "Int32"})


@F.pandas_udf(_ANSWER)
def _decided(candidates: pd.Series) -> pd.DataFrame:
    return _answers([decide((c["step"], c["rank"], c["edits"], c["term"]) for c in cs) for cs in candidates])


def _block_candidates(asked: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one block of values in one shard of the list."""
    if asked.empty or listed.empty:
        return pd.DataFrame(columns=["_f", "_v", "_c"])
    matcher = Matcher((f, n, None if a is None else list(a)) for f, n, a in zip(listed["field"], listed["name"], listed["aliases"]))
    found = [(f, v, matcher.candidates(f, v, alone=False)) for f, v in zip(asked["_f"], asked["_v"])]
    return pd.DataFrame([(f, v, [dict(zip(("step", "rank", "edits", "term"), c)) for c in cs]) for f, v, cs in found if cs], columns=["_f", "_v", "_c"])


def typed_fields(drafts: DataFrame, fields: tuple[str, ...] = ("property_name", "target_ifc_class", "operator")) -> DataFrame:
    """draft_id, field, value of each non-empty field of ``original_proposed_rule``."""
    rule = F.col("original_proposed_rule")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), rule[f].alias("value")) for f in fields])
    rows = drafts.select(F.col("id").alias("draft_id"), F.explode(pairs).alias("_p")).select("draft_id", "_p.field", "_p.value")
    return rows.where(F.col("value").isNotNull() & (F.col("value") != ""))


def map_typed_fields(drafts: DataFrame, terms: DataFrame) -> DataFrame:
    """draft_id, field, term for each typed value that is not itself a name of the list; re-delivered drafts count once."""
    names = terms.select("field", F.col("name").alias("value")).distinct()
    rows = typed_fields(drafts).join(names, ["field", "value"], "left_anti")
    return match_values(rows, "field", "value", terms).select("draft_id", "field", "term").distinct()
