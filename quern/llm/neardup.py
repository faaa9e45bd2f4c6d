"""Near-duplicate texts across a pool: tiles of bit fingerprints compared with exclusive-or and bit counts.

1. A text becomes its set of hashed three-word sequences, a fingerprint of 256 bits (two bits of each of 128
   minima of the set under different hash functions) and ``BANDS`` block keys (two minima each).
   Copies with equal sets are one class; each task ships a class's fingerprint once.
2. Classes that share a block key are compared in tiles: rows sorted by set size, tile pairs whose sizes or bit
   counts differ by more than the similarity allows are skipped, the rest get exclusive-or and bit counts.
   A block far larger than a tile is split over many tasks, which hold one pair of its parts each.
3. Pairs within the radius are checked exactly on their sets.

A pair of similarity s is missed in step 2 with probability (1 - s*s) ** BANDS at most plus the tail beyond RADIUS:
0.3 % at 0.5, 0.013 % at 0.6, none at 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Bitmap, checkpoint
from quern.llm.shingles import _mix, set_id, shingles

THRESHOLD = 0.5
PERMUTATIONS, BANDS, ROWS = 128, 20, 2
TILE = 256
#: Blocks this large (estimated from one text in SAMPLE) are split into parts.
PART_ROWS, SAMPLE = 16_384, 64
#: Pairs of a block that a task holds before it passes them on.
PAIRS = 1 << 19


def radius(threshold: float) -> int:
    """Bits in which fingerprints of sets of similarity ``threshold`` differ, plus 4 standard deviations."""
    miss = 1 - threshold
    return int(np.ceil(PERMUTATIONS * miss + 4 * np.sqrt(PERMUTATIONS * (1.5 * miss - miss * miss))))


_MULTIPLIERS = _mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Fingerprint and block keys of a set of hashes."""
    lows = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):  # keeps the products of very long texts small
        lows = np.minimum(lows, (hashes[at : at + 2048, None] * _MULTIPLIERS[None, :]).min(axis=0))
    mixed = _mix(lows)
    bits = np.stack([mixed & np.uint64(1), (mixed >> np.uint64(1)) & np.uint64(1)], axis=1).astype(np.uint8).ravel()
    picked = mixed[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mix(keys * np.uint64(31) + picked[:, r])
    return np.packbits(bits).tobytes(), keys.view(np.int64)


def signed(pool: DataFrame) -> DataFrame:
    """``id, cls, n, fp, keys`` of the texts with enough words; fp and keys are null where the task has shipped the class before."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"], strict=True):
                h = shingles(text)
                if h is None or i is None:
                    continue
                c = set_id(h)
                fp, keys = (None, None) if c in seen else signature(h)
                seen.add(c)
                rows.append((i, c, len(h), fp, keys))
            yield pd.DataFrame(rows, columns=["id", "cls", "n", "fp", "keys"])

    return pool.mapInPandas(sign, "id string, cls bigint, n int, fp binary, keys array<bigint>")


def _close(fps: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    d = np.zeros(len(i), dtype=np.uint16)
    for k in range(fps.shape[1]):
        d += np.bitwise_count(fps[i, k] ^ fps[j, k])
    return d <= most


def compare_block(cls: np.ndarray, n: np.ndarray, fps: np.ndarray, part: np.ndarray | None, threshold: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of one block, sorted by ``n``, within the radius, tile pair by tile pair; ``part``: only pairs of different parts."""
    m = len(cls)
    counts = np.bitwise_count(fps).sum(axis=1).astype(np.int32)
    for x in range(0, m, TILE):
        xs = slice(x, min(x + TILE, m))
        for y in range(x, m, TILE):
            ys = slice(y, min(y + TILE, m))
            if n[xs][-1] < threshold * n[ys][0]:
                break  # all later tiles hold larger sets
            if max(counts[ys].min() - counts[xs].max(), counts[xs].min() - counts[ys].max()) > most:
                continue
            d = np.zeros((xs.stop - xs.start, ys.stop - ys.start), dtype=np.uint16)
            for k in range(fps.shape[1]):
                d += np.bitwise_count(fps[xs, k][:, None] ^ fps[ys, k][None, :])
            i, j = np.nonzero(d <= most)
            i, j = i + x, j + y
            keep = (i < j) & (n[i] >= threshold * n[j]) & (cls[i] != cls[j])
            if part is not None:
                keep &= part[i] != part[j]
            yield i[keep], j[keep]


def _candidates(rows: pd.DataFrame, threshold: float, most: int) -> Iterator[pd.DataFrame]:
    """Pairs within the blocks of ``rows``, which are sorted by block and set size and hold whole blocks."""
    if rows.empty:  # no block has ended yet
        return
    rows = rows[~rows.duplicated(["key", "cls"])]
    key, cls, n = rows["key"].to_numpy(), rows["cls"].to_numpy(), rows["n"].to_numpy()
    fps = np.frombuffer(b"".join(rows["fp"]), dtype=np.uint64).reshape(len(rows), -1)
    split, part = rows["split"].to_numpy(), rows["part"].to_numpy()
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.repeat(sizes <= 64, sizes)
    last = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(small & (np.arange(len(key)) + 1 < last))
    step = 1

    def classes() -> pd.DataFrame:
        i, j = np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])
        held.clear()
        return pd.DataFrame({"a": np.minimum(cls[i], cls[j]), "b": np.maximum(cls[i], cls[j])}).drop_duplicates()

    waiting = 0
    while len(at):  # all small blocks in lockstep: each row with the one `step` places on
        other = at + step
        near = n[at] >= threshold * n[other]
        at, other = at[near], other[near]
        ok = _close(fps, at, other, most) & ((split[at] == 0) | (part[at] != part[other]))
        held.append((at[ok], other[ok]))
        waiting += int(ok.sum())
        if waiting > PAIRS:
            yield classes()
            waiting = 0
        step += 1
        at = at[at + step < last[at]]
    for s, m in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        w = slice(s, s + m)
        for i, j in compare_block(cls[w], n[w], fps[w], part[w] if split[s] else None, threshold, most):
            held.append((i + s, j + s))
            waiting += len(i)
            if waiting > PAIRS:
                yield classes()
                waiting = 0
    if held:
        yield classes()


def candidate_pairs(sigs: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs ``a < b`` of classes that share a block and whose fingerprints lie within the radius."""
    most = radius(threshold)
    postings = sigs.where("keys is not null").select("cls", "n", "fp", F.explode("keys").alias("key"))
    sampled = sigs.where(F.col("keys").isNotNull() & (F.pmod(F.xxhash64("cls"), F.lit(SAMPLE)) == 0)).select(F.explode("keys").alias("key"))
    hot = sampled.groupBy("key").count().where(F.col("count") * SAMPLE > PART_ROWS).select("key", F.ceil(F.col("count") * SAMPLE / PART_ROWS).cast("int").alias("parts"))
    hot = checkpoint(hot)
    plain = postings.withColumns({"split": F.lit(0), "part": F.lit(0)})
    if hot.limit(1).count():
        marked = postings.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("cls"), F.coalesce("parts", F.lit(1))).cast("int"))
        plain = marked.where("parts is null").select("cls", "n", "fp", "key", F.lit(0).alias("split"), F.lit(0).alias("part"))
        # A part meets each part (also itself) under a key of its own; pairs inside a part are found where it meets itself.
        meets = marked.where("parts is not null").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        own = F.col("part") == F.col("with")
        key = F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with"))
        plain = plain.unionByName(meets.select("cls", "n", "fp", key.alias("key"), F.when(own, 0).otherwise(1).alias("split"), "part"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []  # rows since the last block that ended
        for b in batches:
            if not len(b):
                continue
            if kept and kept[-1]["key"].iloc[0] == b["key"].iloc[-1]:
                kept.append(b)
                continue
            cut = int(np.flatnonzero(b["key"].to_numpy() == b["key"].iloc[-1])[0])
            yield from _candidates(pd.concat([*kept, b.iloc[:cut]]), threshold, most)
            kept = [b.iloc[cut:]]
        if kept:
            yield from _candidates(pd.concat(kept), threshold, most)

    blocks = plain.repartition("key").sortWithinPartitions("key", "n")
    return blocks.mapInPandas(compare, "a bigint, b bigint").distinct()


def verified_pairs(pool: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes ``a, b, similarity`` whose sets have a Jaccard similarity of at least ``threshold``; exact, from the whole texts."""
    pairs = checkpoint(candidate_pairs(sigs, threshold))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    owner = sigs.where("keys is not null").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id"))
    owners = Bitmap(owner.select(F.xxhash64("id").alias("h")), "h", 2 * pairs.count())

    @F.pandas_udf("boolean")
    def may_own(h: pd.Series) -> pd.Series:
        return pd.Series(owners.may_hold(h.to_numpy(dtype=np.int64)))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [shingles(t) for t in b["text"]]
            yield pd.DataFrame([(set_id(h), h.tobytes()) for h in got if h is not None], columns=["cls", "h"])

    # The bitmap passes few texts beyond the owners; the join by class drops what they bring.
    held = pool.where("id is not null").where(may_own(F.xxhash64("id"))).mapInPandas(sets, "cls bigint, h binary")

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / (len(p) + len(q) - both))
        return pd.Series(out, dtype="float64")

    held = held.groupBy("cls").agg(F.first("h").alias("h"))
    full = pairs.join(held.withColumnsRenamed({"cls": "a", "h": "ha"}), "a").join(held.withColumnsRenamed({"cls": "b", "h": "hb"}), "b")
    return full.select("a", "b", jaccard("ha", "hb").alias("similarity")).where(F.col("similarity") >= threshold)


def text_pool(examples: DataFrame, pair_docs: DataFrame) -> DataFrame:
    return examples.select(F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).unionByName(pair_docs.select(F.col("source_id").cast("string").alias("id"), F.col("source_text").cast("string").alias("text")))


def near_duplicates(pool: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal texts (``a, b, similarity``) and membership (``id, cls``).

    ``pool`` has ``id`` and ``text``.  Null texts, null ids and texts of under 20 words belong to no class.  Texts with equal sets of
    sequences are one class and have no link; other texts of at least ``threshold`` are linked.  Texts are taken whole;
    a repeated id belongs to each of its texts' classes.  An empty pool gives two empty results.
    """
    sigs = checkpoint(signed(pool.select("id", "text")))
    links = checkpoint(verified_pairs(pool.select("id", "text"), sigs, threshold))
    return links, sigs.select("id", "cls")


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs ``id_a < id_b`` of ids whose classes are linked or the same."""
    grouped = members.distinct()
    linked = links.select("a", "b").join(grouped.withColumnsRenamed({"cls": "a", "id": "x"}), "a").join(grouped.withColumnsRenamed({"cls": "b", "id": "y"}), "b").where("x != y")
    same = grouped.withColumnRenamed("id", "x").join(grouped.withColumnRenamed("id", "y"), "cls").where("x < y")
    pairs = linked.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(same.select(F.col("x").alias("id_a"), F.col("y").alias("id_b")))
    return pairs.distinct()


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """``id, cls, group_id, links``: group_id is the smallest class id that can be reached, links the number of linked classes.

    Every text of the pool with a class has a row; a text without partners is a group of its own.  Smallest labels spread along links
    and jump to the label of their label, with a checkpoint each round, until no label changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpoint(both)
    label = checkpoint(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("c"), F.count(F.lit(1)).alias("links")))
    while True:  # a round at least halves the longest way to the smallest label
        offers = both.join(label.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        near = label.join(offers, "v").select("v", F.least("c", "m").alias("c"), "links", F.col("c").alias("old"))
        far = near.join(label.select(F.col("v").alias("c"), F.col("c").alias("root")), "c", "left")
        new = checkpoint(far.select("v", F.least("c", F.coalesce("root", "c")).alias("c"), "links", "old"))
        changed = new.where("c != old").limit(1).count()
        label = new.drop("old")
        if not changed:
            break
    return members.join(label.select(F.col("v").alias("cls"), "c", "links"), "cls", "left").select("id", "cls", F.coalesce("c", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
