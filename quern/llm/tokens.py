"""Token counts of texts under a public byte-level BPE vocabulary, and token budgets by slice.

Each piece (a match of the vocabulary's split pattern) is kept as a linked list of symbols with a
priority queue of merges; the symbols that survive are its tokens.  A piece is merged once per worker
and weighted by its frequency, so the work in Python is one pattern scan of the text.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import canonical, canonical_language, process_cache

TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that the rank files are defined with.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by a worker before it starts anew; bounds its memory, not the result.
MEMO_PIECES = 400_000
#: Longer pieces are counted without being remembered.
MEMO_LENGTH = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged_symbols(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Number of symbols left when all merges of ``piece`` are done, lowest rank first, leftmost first."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return min(n, 1)
    end = list(range(1, n + 1))  # symbol i is piece[i:end[i]]; its right neighbour starts at end[i]
    before = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    left = n
    while queue:
        _, i, stop = heapq.heappop(queue)
        mid = end[i]
        if mid == 0 or mid >= n or end[mid] != stop:
            continue  # one of the two symbols has been merged since
        end[i], end[mid] = stop, 0
        left -= 1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(queue, (r, j, stop))
    return left


class PieceCounts(dict):
    """piece -> tokens, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        n = merged_symbols(piece.encode("utf-8", "replace"), self.ranks)
        if len(piece) <= MEMO_LENGTH:
            self[piece] = n
        return n


def counter(path: str):
    """text -> tokens, with the vocabulary loaded once per process."""
    cache = process_cache()
    if ("tokens", path) not in cache:
        import regex

        cache["tokens", path] = regex.compile(SPLIT_PATTERN), PieceCounts(load_ranks(path))
    pattern, pieces = cache["tokens", path]
    find, get = pattern.findall, pieces.__getitem__

    def count(text: str | None) -> int:
        if not text:
            return 0
        if len(pieces) > MEMO_PIECES:
            pieces.clear()
        return sum(map(get, find(text)))

    return count


def with_token_counts(df: DataFrame, text_col: str, out_col: str = "n_tokens", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the tokens of ``text_col`` as bigint ``out_col``.

    Null and empty texts have 0 tokens; texts of any length are counted whole; equal rows have equal counts;
    an existing column ``out_col`` is replaced; an empty table stays empty.
    """
    path = os.path.join(tokenizers, vocabulary)

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for texts in batches:
            yield pd.Series([count(x) for x in texts], dtype="int64")

    return df.withColumn(out_col, tokens(F.col(text_col)))


def token_budget(examples: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Documents and tokens of ``examples`` by dataset, language and domain, and for each of the three alone.

    Spelling variants are brought together; nulls form a slice of their own (the value is null);
    ``slice`` says what a row sums over (``dataset+language+domain``, ``dataset``, ``language``, ``domain``, ``all``).
    Counting is map-side; the only shuffle carries partial sums.  An empty table gives no rows.
    """
    counted = with_token_counts(
        examples.select(
            F.col("text").alias("text"),
            canonical(F.col("dataset")).alias("dataset"),
            canonical_language(F.try_element_at(F.col("meta"), F.lit("language"))).alias("language"),
            canonical(F.col("domain")).alias("domain"),
        ),
        "text",
        tokenizers=tokenizers,
    )
    finest = counted.groupBy("dataset", "language", "domain").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.when(F.col("n_tokens") > 0, 1).otherwise(0)).alias("with_text"),
        F.sum("n_tokens").alias("tokens"),
    )
    sets = finest.groupingSets([["dataset", "language", "domain"], ["dataset"], ["language"], ["domain"], []], "dataset", "language", "domain").agg(
        F.grouping_id().alias("gid"),
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum("with_text"), F.lit(0)).alias("with_text"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )
    names = {0: "dataset+language+domain", 3: "dataset", 5: "language", 6: "domain", 7: "all"}
    kind = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return sets.select(
        kind[F.col("gid").cast("int")].alias("slice"), "dataset", "language", "domain", "documents", "with_text", "tokens"
    )
