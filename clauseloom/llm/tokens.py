"""Token ids of whole texts by a public byte-level BPE.

Encoding is a monoid: a long text is halved, the halves are encoded recursively,
and two neighbours are joined by encoding a window around their border again.
The window grows until it starts and ends at places where a token must end in
any text, so the tokens outside it stand; decoding concatenates up the tree.

Such a place is the start of white space after a character that is none: no
piece of the splitting pattern holds white space after another character, and no
piece's end depends on what follows that place.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# Fixed value: the pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters up to which a text is encoded at once, and of the first window at a border.
LEAF = 16_384
WINDOW = 64

# Fixed value: what the pattern counts as white space (Python's own class has four control characters more).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BREAK = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")


def encoder(name: str = VOCABULARY, folder: str = TOKENIZERS, sent=None):
    """The tokenizer of a rank file, from ``sent`` (its broadcast bytes) or the folder; kept by the process for all its tasks."""
    import tiktoken

    kept = sys.__dict__.setdefault("_clauseloom_encoders", {})
    if (name, folder) not in kept:
        data = _rank_file(name, folder) if sent is None else sent.value
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
        kept[name, folder] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[name, folder]


def _rank_file(name: str, folder: str) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        return file.read()


def _sent_ranks(name: str, folder: str):
    """The rank file, read by the driver and sent to the executors once a session; some megabytes, whatever the corpus. Executors need no folder of their own."""
    context = SparkSession.active().sparkContext
    kept = sys.__dict__.setdefault("_clauseloom_rank_files", {})
    key = (context.applicationId, name, folder)
    if key not in kept:
        kept[key] = context.broadcast(_rank_file(name, folder))
    return kept[key]


def _cut_ids(enc, ids: list[int], size: int, from_end: bool) -> int:
    """Number of tokens at one end of ``ids`` that spell exactly ``size`` bytes."""
    count = length = 0
    for token in reversed(ids) if from_end else ids:
        if length >= size:
            break
        length += len(enc.decode_single_token_bytes(token))
        count += 1
    if length != size:
        raise AssertionError("a token crosses a place where tokens end")
    return count


def join(enc, left: tuple[str, list[int]], right: tuple[str, list[int]], window: int = WINDOW) -> tuple[str, list[int]]:
    """The encoding of two neighbouring texts together, from their own encodings."""
    (a, a_ids), (b, b_ids) = left, right
    if not a or not b:
        return (a + b, a_ids + b_ids)
    start = end = None
    size = window
    while start is None:
        tail = max(0, len(a) - size)
        found = [m.start() for m in _BREAK.finditer(a, max(0, tail - 1))]
        start = found[0] if found else 0 if tail == 0 else None
        size *= 2
    size = window
    while end is None:
        found = next(_BREAK.finditer(b, 0, min(len(b), size)), None)
        end = found.start() if found else len(b) if size >= len(b) else None
        size *= 2
    keep_left = len(a_ids) - _cut_ids(enc, a_ids, len(a[start:].encode()), True)
    keep_right = _cut_ids(enc, b_ids, len(b[:end].encode()), False)
    return a + b, a_ids[:keep_left] + enc.encode_ordinary(a[start:] + b[:end]) + b_ids[keep_right:]


def encode(enc, text: str, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
    """Token ids of a text by tree reduction."""

    def tree(piece: str) -> tuple[str, list[int]]:
        if len(piece) <= leaf:
            return piece, enc.encode_ordinary(piece)
        half = len(piece) // 2
        return join(enc, tree(piece[:half]), tree(piece[half:]), window)

    return tree(text)[1]


def decode(enc, ids: list[int]) -> str:
    """The text of token ids; halves' bytes are concatenated up the tree."""

    def tree(part: list[int]) -> bytes:
        if len(part) <= LEAF:
            return b"".join(map(enc.decode_single_token_bytes, part))
        half = len(part) // 2
        return tree(part[:half]) + tree(part[half:])

    return tree(ids).decode("utf-8")


def token_ids(text: Column, name: str = VOCABULARY, folder: str = TOKENIZERS) -> Column:
    """ARRAY<INT> of the ids of whole texts, without special tokens; null and empty texts give an empty array."""

    sent = _sent_ranks(name, folder)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(name, folder, sent)
        for texts in batches:
            found = [encode(enc, t.as_py() or "") for t in texts]
            ends = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in found], out=ends[1:])
            flat = np.fromiter((k for x in found for k in x), dtype=np.int32, count=int(ends[-1]))
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return ids(text)


def token_count(text: Column, name: str = VOCABULARY, folder: str = TOKENIZERS) -> Column:
    """Number of tokens of whole texts; 0 for null and empty ones."""

    sent = _sent_ranks(name, folder)

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(name, folder, sent)
        for texts in batches:
            yield pa.array([len(encode(enc, t.as_py() or "")) for t in texts], type=pa.int32())

    return count(text)


def token_texts(ids: Column, name: str = VOCABULARY, folder: str = TOKENIZERS) -> Column:
    """The texts of arrays of ids; null for null."""

    sent = _sent_ranks(name, folder)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(name, folder, sent)
        for batch in batches:
            yield pa.array([None if x is None else decode(enc, x) for x in batch.to_pylist()], type=pa.string())

    return texts(ids)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """key and ids of every row. Narrow: each row is encoded where it is read."""
    return documents.select(key, token_ids(F.col(text), name, folder).alias("ids"))
