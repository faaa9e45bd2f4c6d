"""Texts into containers of a fixed number of tokens, by minimum bin slack on the multiset of lengths.

Only the number of texts of each length matters for the plan, and there are at most ``capacity`` lengths.
So the driver plans with a histogram whose size doesn't grow with the corpus: it finds the multiset that
fills a window closest to capacity (subset sums in a bitset, counts read back), uses it as often as the
histogram allows, and goes on with what is left.  Texts then find their place by their rank within
their length, computed from per-partition offsets; no window holds all texts of a length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import checkpoint
from quern.llm.tokens import TOKENIZERS, with_token_counts

CAPACITY = 4096


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of ``counts`` (length -> how many) that holds a longest length and is closest to ``capacity``."""
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    room = capacity - first
    full, mask = 1 << room, (1 << (room + 1)) - 1
    sums, steps = 1, []  # bit s: s can be reached; steps: (length, copies, sums before)
    for length in lengths:
        free = counts[length] - (length == first)
        if length > room or free <= 0:
            continue
        copies = 1
        free = min(free, room // length)
        while free > 0:  # powers of two and a rest stand for 0..free copies
            take = min(copies, free)
            steps.append((length, take, sums))
            sums |= (sums << (take * length)) & mask
            free -= take
            copies *= 2
        if sums & full:
            break
    at = sums.bit_length() - 1
    chosen = {first: 1}
    for length, take, sums_before in reversed(steps):
        if not (sums_before >> at) & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Pairs of how often a multiset of lengths is used and the multiset; together they use up ``histogram``."""
    left = {n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0}
    plan = []
    while left:
        chosen = fullest(left, capacity)
        times = min(left[n] // c for n, c in chosen.items())
        plan.append((times, chosen))
        for n, c in chosen.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
    return plan


def _slots(plan: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[list, list]]:
    """By length: first ranks, and for each the first container, copies per container and offset of the first copy."""
    slots: dict[int, tuple[list, list]] = {}
    used: dict[int, int] = {}
    base = 0
    for times, chosen in plan:
        offset = 0
        for n in sorted(chosen, reverse=True):
            starts, places = slots.setdefault(n, ([], []))
            starts.append(used.get(n, 0))
            places.append((base, chosen[n], offset))
            used[n] = used.get(n, 0) + times * chosen[n]
            offset += n * chosen[n]
        base += times
    return slots


def pack_documents(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, tokenizers: str = TOKENIZERS) -> DataFrame:
    """One row per piece of a text: ``doc_id, part, parts, n_tokens, container, start, end``.

    A text of at most ``capacity`` tokens is one piece; a larger one fills containers of its own and its rest
    is packed like a small text.  ``start`` and ``end`` are token positions in the container.  Null and empty texts
    take no room: their row has 0 tokens and a null container.  Rows that repeat an id are packed as texts of their own.
    Containers are numbered from 0 without gaps, those of the plan before those of the parts of large texts.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = checkpoint(with_token_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", tokenizers=tokenizers).drop("text"))
    full = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / capacity).cast("bigint")  # whole containers of a large text
    rests = sized.select("doc_id", F.col("n_tokens").alias("total"), full.alias("full"), (F.col("n_tokens") - full * capacity).alias("rest"), F.spark_partition_id().alias("pid"))

    per_partition = rests.groupBy("rest", "pid").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("fulls"))
    per_partition = checkpoint(per_partition)
    histogram = {r["rest"]: r["n"] for r in per_partition.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    plan = plan_containers(histogram, capacity)
    slots = spark.sparkContext.broadcast(_slots(plan))
    planned = sum(times for times, _ in plan)

    before = F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_partition.select("rest", "pid", before.alias("before"))
    by_pid = per_partition.groupBy("pid").agg(F.sum("fulls").alias("fulls"))
    full_before = F.coalesce(F.sum("fulls").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full_offsets = by_pid.select("pid", full_before.alias("full_before"))  # one row per partition

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        fulls = 0
        for b in batches:
            local = b.groupby("rest").cumcount() + b["rest"].map(seen).fillna(0).astype("int64")
            for n, c in b["rest"].value_counts().items():
                seen[n] = seen.get(n, 0) + int(c)
            run = b["full"].cumsum() - b["full"] + fulls
            fulls += int(b["full"].sum())
            yield b.assign(local=local.astype("int64"), full_local=run.astype("int64"))

    id_type = sized.schema["doc_id"].dataType.simpleString()
    numbered = rests.mapInPandas(number, f"doc_id {id_type}, total bigint, full bigint, rest bigint, pid int, local bigint, full_local bigint")
    ranked = (
        numbered.join(offsets, ["rest", "pid"])
        .join(F.broadcast(full_offsets), "pid")
        .select("doc_id", "total", "full", "rest", (F.col("local") + F.col("before")).alias("rank"), (F.col("full_local") + F.col("full_before")).alias("full_rank"))
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = slots.value
        for b in batches:
            container, start = np.full(len(b), -1, dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for i, (n, rank) in enumerate(zip(b["rest"].to_numpy(), b["rank"].to_numpy(), strict=True)):
                if n > 0:
                    firsts, places = table[n]
                    k = bisect_right(firsts, rank) - 1
                    base, copies, offset = places[k]
                    q, r = divmod(int(rank) - firsts[k], copies)
                    container[i], start[i] = base + q, offset + r * n
            yield b.assign(container=container, start=start).drop(columns=["rank"])

    placed = ranked.mapInPandas(place, f"doc_id {id_type}, total bigint, full bigint, rest bigint, full_rank bigint, container bigint, start bigint")
    in_plan = placed.select(
        "doc_id",
        F.col("full").alias("part"),
        (F.col("full") + 1).alias("parts"),
        F.col("rest").alias("n_tokens"),
        F.when(F.col("rest") > 0, F.col("container")).alias("container"),
        F.when(F.col("rest") > 0, F.col("start")).alias("start"),
    )
    cut = placed.where("full > 0").select("doc_id", F.col("full"), "full_rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("part"))
    cut = cut.select("doc_id", "part", (F.col("full") + 1).alias("parts"), F.lit(capacity).cast("bigint").alias("n_tokens"), (F.lit(planned) + F.col("full_rank") + F.col("part")).alias("container"), F.lit(0).cast("bigint").alias("start"))
    return in_plan.unionByName(cut).withColumn("end", F.col("start") + F.col("n_tokens"))


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers of ``packed`` by tokens left over: ``slack, containers, pieces, tokens``; no container, no row."""
    each = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return each.groupBy((F.lit(capacity) - F.col("used")).alias("slack")).agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("pieces"), F.sum("used").alias("tokens"))
