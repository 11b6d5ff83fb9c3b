"""Token counts of whole texts under a byte-level BPE vocabulary, without encoding most words.

Before any row is read, every vocabulary string is merged on its own: the strings that come out
as one token are proven to count as 1 wherever they stand as a pre-token, because merges never
cross pre-tokens. Counting is then a table lookup; only pre-tokens outside the table are merged.

Null and empty texts have 0 tokens. Texts of any length are counted whole; a pre-token of any
length is merged in n log n. Extra columns pass through; equal rows give equal rows.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import in_small_batches

#: Merged pre-tokens remembered by a task before it starts over; bounds memory only.
REMEMBERED = 500_000
NEVER = 1 << 40


def category_class(initial: str) -> str:
    """The body of a character class of all code points whose general category starts so."""
    ranges, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] == initial
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(ranges)


@lru_cache(maxsize=1)
def pre_token_pattern() -> re.Pattern:
    """The published split pattern of this vocabulary, with its Unicode classes written out."""
    letter, number = category_class("L"), category_class("N")
    space = r"\t-\r \x85\xa0  -     　"
    return re.compile(
        f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """Byte to vocabulary character: printable bytes stand for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def merged_length(parts: list[str], ranks: dict) -> int:
    """Number of parts left when the best-ranked neighbours are merged until none can be."""
    if len(parts) > 100:
        return _merged_length_heap(parts, ranks)
    while len(parts) > 1:
        found = [ranks.get(pair, NEVER) for pair in zip(parts, parts[1:], strict=False)]
        best = min(found)
        if best == NEVER:
            break
        i = found.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return len(parts)


def _merged_length_heap(parts: list[str], ranks: dict) -> int:
    """The same for long runs: a heap of (rank, position) over a linked list."""
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
            if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    left = len(parts)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, ""
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        left -= 1
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < len(parts):
                r = ranks.get((parts[x], parts[y]))
                if r is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return left


class PreTokenCounts(dict):
    """Pre-token to number of tokens; starts as the proven table and merges what is missing."""

    def __init__(self, whole: list[str], ranks: dict):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.ranks, self.chars = whole, ranks, byte_chars()

    def __reduce__(self):
        return PreTokenCounts, (self.whole, self.ranks)

    def __missing__(self, pre_token: str) -> int:
        n = merged_length([self.chars[b] for b in pre_token.encode()], self.ranks)
        if len(pre_token) <= 100:
            if len(self) > len(self.whole) + REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[pre_token] = n
        return n


def load_vocabulary(path: str) -> tuple[list[str], dict, list[str]]:
    """(strings proven to be one token, merge ranks, special strings) of a vocabulary file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i
             for i, m in enumerate(spec["model"]["merges"])}
    specials = [t["content"] for t in spec["added_tokens"]]
    byte_of = {c: b for b, c in enumerate(byte_chars())}
    pattern, whole = pre_token_pattern(), []
    for token in spec["model"]["vocab"]:
        if token in specials or merged_length(list(token), ranks) != 1:
            continue
        try:
            text = bytes(byte_of[c] for c in token).decode()
        except UnicodeDecodeError:
            continue
        if pattern.fullmatch(text):
            whole.append(text)
    return whole, ranks, specials


def count_tokens(texts: Iterator[str | None], counts: PreTokenCounts, specials: list[str]) -> list[int]:
    find, get, totals = pre_token_pattern().findall, counts.__getitem__, []
    # the longest special string wins where several start
    split = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))) or r"(?!)")
    for text in texts:
        parts = split.split(text) if text else []
        totals.append(sum(sum(map(get, find(p))) for p in parts) + max(0, len(parts) - 1))
    return totals


def with_token_counts(df: DataFrame, vocabulary: str, text: str = "text",
                      name: str = "n_tokens") -> DataFrame:
    """``df`` with the token count of ``text`` as ``name``; a column of that name is replaced.

    ``vocabulary`` is a tokenizer file of the byte-level BPE kind. Its tables have a fixed size
    (the vocabulary's) and are sent to the executors; rows are counted where they lie.
    """
    whole, ranks, specials = load_vocabulary(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast((PreTokenCounts(whole, ranks), specials))
    kept = in_small_batches(df.drop(name) if name != text else df)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, specials = shared.value  # lives as long as the Python worker
        for batch in batches:
            texts = (v.as_py() for v in batch.column(batch.schema.get_field_index(text)))
            totals = pa.array(count_tokens(texts, counts, specials), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, totals],
                                             names=[*batch.schema.names, name])

    schema = T.StructType([*kept.schema, T.StructField(name, T.LongType())])
    return kept.mapInArrow(count, schema)


def token_report(documents: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every text."""
    sized = documents.select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    return with_token_counts(sized, vocabulary).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
