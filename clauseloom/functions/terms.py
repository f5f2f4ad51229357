"""Tokens and pairwise similarities of short texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions.columns import strip


def tokenize(text: Column) -> Column:
    """ARRAY<STRING>: runs of Latin letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two token sets; 0 if either is empty."""
    common, total = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / total).otherwise(F.lit(0.0))


def exact_substring(a: Column, b: Column) -> Column:
    """1 if one text holds the other, trimmed and in lower case; 0 if either is empty."""
    x, y = F.lower(strip(a)), F.lower(strip(b))
    return F.when((x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.lit(1.0)).otherwise(F.lit(0.0))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one machine-word operation per character of ``b`` and 64 of ``a``."""
    places: dict[str, int] = {}
    for k, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    rest = full
    for ch in b:
        hit = rest & places.get(ch, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


def token_sort_similarity(a: str | None, b: str | None) -> float | None:
    """Share of characters in common order, after sorting the words; case counts. Two texts without words: 0."""
    if a is None or b is None:
        return None
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not x or not y:
        return 0.0
    return 2 * common_length(x, y) / (len(x) + len(y))


@F.arrow_udf(T.DoubleType())
def fuzz_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """:func:`token_sort_similarity` of two columns."""
    return pa.array([token_sort_similarity(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], type=pa.float64())


def term_text(name: Column, definition: Column, description: Column | None = None) -> Column:
    """'{name}. {definition} {description}' without the missing parts."""
    parts = [F.coalesce(c, F.lit("")) for c in (name, definition, description if description is not None else F.lit(""))]
    return strip(F.concat(parts[0], F.lit(". "), parts[1], F.lit(" "), parts[2]))
