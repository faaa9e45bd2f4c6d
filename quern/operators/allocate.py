"""Deterministic samples, allocations and splits in the order of SHA-256 keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import key_of
from quern.operators.ranks import global_position, positions


def with_sort_key(rows: DataFrame, seed: int | str, *parts: str) -> DataFrame:
    return rows.withColumn("sort_key", F.sha2(key_of(F.lit(str(seed)), *parts), 256))


def top_per_group(rows: DataFrame, groups: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group.  Spark keeps k rows per group and task before it shuffles (WindowGroupLimit)."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_place") <= k).drop("_place")


def largest_remainder(strata: DataFrame, size: str, quota: int, tie: list[str]) -> DataFrame:
    """``quota`` shared out in proportion to ``size``, whole parts first, then by largest fraction (then size, then hash); never more than a stratum has.

    ``strata`` has one row per stratum; there are few.
    """
    total = F.sum(size).over(Window.partitionBy())
    raw = F.lit(quota) * F.col(size) / total
    base = strata.withColumn("_raw", raw).withColumn("_whole", F.least(F.floor("_raw"), F.col(size)))
    base = base.withColumn("_left", F.lit(quota) - F.sum("_whole").over(Window.partitionBy()))
    order = Window.orderBy(F.desc(F.round(F.col("_raw") - F.floor("_raw"), 9)), F.desc(size), F.desc(F.sha2(key_of(*tie), 256)))
    base = base.withColumn("_turn", F.row_number().over(order))
    extra = F.when((F.col("_turn") <= F.col("_left")) & (F.col("_whole") < F.col(size)), 1).otherwise(0)
    return base.withColumn("allocated", (F.col("_whole") + extra).cast("bigint")).drop("_raw", "_whole", "_left", "_turn")


def stratified_sample(rows: DataFrame, strata: list[str], quota: int, seed: int, id_col: str) -> DataFrame:
    """``quota`` rows whose strata have their share of all rows, each stratum taken in SHA order."""
    placed = positions(with_sort_key(rows, seed, id_col), ["sort_key", id_col], strata).withColumn("_s", F.struct(*strata))
    counts = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    shares = largest_remainder(counts, "n", quota, strata).where("allocated > 0").select(F.struct(*strata).alias("_s"), "allocated")
    return placed.join(shares, "_s").where("position < allocated").drop("_s", "position", "group_rows", "allocated")


def balanced_allocation(strata: list[dict], target: int, min_side: int, min_per_side: int, max_per_side: int, seed: int | str, equal: bool = False) -> dict[str, int]:
    """Rows per side (label 0 and label 1 alike) for each stratum so that both sides have ``target / 2``.

    ``strata``: ``key, n0, n1``.  Strata with fewer than ``min_side`` rows on a side get none.  Everyone starts with ``min_per_side``
    (with nothing, if that is too much); the rest goes in proportion to sqrt(min(n0, n1)), or evenly if ``equal``, then one by one by largest fraction and hash.  Raises if the target can't be reached.
    """
    import hashlib

    able = {s["key"]: min(s["n0"], s["n1"], max_per_side) for s in strata if min(s["n0"], s["n1"]) >= min_side}
    half = target // 2
    if not able:
        raise ValueError("no stratum has enough rows on both sides")
    got = {k: min(min_per_side, room) for k, room in able.items()}
    if sum(got.values()) > half:
        got = dict.fromkeys(able, 0)
    rest = half - sum(got.values())
    weight = {k: 1.0 if equal else math.sqrt(room) for k, room in able.items()}
    share = {k: rest * weight[k] / sum(weight.values()) for k in able}
    for k in able:
        got[k] += min(int(share[k]), able[k] - got[k])
    order = sorted(able, key=lambda k: (share[k] - int(share[k]), hashlib.sha256(f"{seed}{k}".encode()).hexdigest()), reverse=True)
    rest = half - sum(got.values())
    while rest:
        before = rest
        for k in order:
            if rest and got[k] < able[k]:
                got[k] += 1
                rest -= 1
        if rest == before:
            raise ValueError(f"{rest} rows per side can't be placed")
    return got


def balanced_sample(rows: DataFrame, stratum: Column, label: str, id_col: str, target: int, seed: int | str, min_side: int = 5, min_per_side: int = 1, max_per_side: int = 10**9, equal: bool = False) -> DataFrame:
    """Equal numbers of both labels from each stratum, ``target`` rows in all, in SHA order.  Strata are planned on the driver; there are few."""
    keyed = with_sort_key(rows.where(F.col(label).isNotNull()).withColumn("stratum", stratum), seed, id_col).where("stratum is not null")
    sides = keyed.groupBy("stratum").agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).collect()
    plan = balanced_allocation([{"key": r["stratum"], "n0": r["n0"], "n1": r["n1"]} for r in sides], target, min_side, min_per_side, max_per_side, seed, equal)
    quota = rows.sparkSession.createDataFrame([(k, n) for k, n in sorted(plan.items()) if n], "stratum string, quota int")
    placed = positions(keyed, ["sort_key", id_col], ["stratum", label])
    return placed.join(quota, "stratum").where("position < quota").drop("position", "group_rows", "quota")


def sha_split(rows: DataFrame, id_col: str, seed: int, sizes: list[tuple[str, float]], groups: list[str] = []) -> DataFrame:  # noqa: B006
    """Column ``assigned``: rows (of each group) in SHA order, cut into shares; a share of n rows has round-half-even(n * share), the last takes the rest."""
    keyed = positions(with_sort_key(rows, seed, id_col), ["sort_key", id_col], groups)
    end, assigned = F.lit(0), None
    for name, share in sizes[:-1]:
        end = end + F.bround(F.col("group_rows") * share)
        cond = F.col("position") < end
        assigned = F.when(cond, name) if assigned is None else assigned.when(cond, name)
    return keyed.withColumn("assigned", assigned.otherwise(sizes[-1][0])).drop("group_rows", "position", "sort_key")


def round_robin_shards(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Column ``shard``: position in ``order`` modulo ``shards``.  Positions come from partition offsets, not from one window over all rows."""
    return global_position(rows, order).withColumn("shard", F.pmod(F.col("position"), F.lit(shards)).cast("int")).drop("position")


def weighted_without_replacement(rows: DataFrame, groups: list[str], weight: Column, k: int, seed: int, id_col: str) -> DataFrame:
    """``k`` rows of each group drawn with probability by weight, without replacement: smallest -ln(u) / w with hashed u."""
    u = (F.conv(F.substring(F.sha2(key_of(F.lit(str(seed)), id_col), 256), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    keyed = rows.withColumn("_key", F.round(-F.ln(u) / weight, 9))
    return top_per_group(keyed, groups, ["_key", id_col], k).drop("_key")


def oversample(rows: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, with ``copy`` from 0."""
    return rows.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))


def filter_set(raw) -> set[str] | None:
    """A filter given as null, text or list: its trimmed entries that aren't empty; None if it lets everything pass (nothing given, or ``*``)."""
    given = [raw] if isinstance(raw, str) else list(raw or [])
    kept = {str(x).strip() for x in given if x is not None and str(x).strip()}
    return None if not kept or "*" in kept else kept


def allowed(rows: DataFrame, value: Column, raw) -> DataFrame:
    """Rows whose ``value`` is in the filter ``raw``."""
    kept = filter_set(raw)
    return rows if kept is None else rows.where(value.isin(sorted(kept)))


def taking_turns(rows: DataFrame, groups: list[str], stratum: str, seed: int, id_col: str, k: int) -> DataFrame:
    """``k`` rows of each group, its strata taking turns (in the order of a hash of their name), each stratum in the order of ``sort_key``."""
    turned = positions(rows, ["sort_key", id_col], [stratum]).drop("group_rows").withColumnRenamed("position", "_turn")
    turned = turned.where(F.col("_turn") < k)  # a stratum never gives more than k rows
    order = F.row_number().over(Window.partitionBy(*groups).orderBy("_turn", F.sha2(key_of(F.lit(str(seed)), stratum), 256), stratum))
    return turned.withColumn("_k", order).where(F.col("_k") <= k).drop("_k", "_turn", "sort_key")


def balanced_evaluation(rows: DataFrame, label: str, id_col: str, size: int, seed: int) -> DataFrame:
    """Equal numbers of both labels, as many as the smaller one has up to half of ``size``, then filled up to ``size`` from what is left, all in SHA order."""
    placed = positions(with_sort_key(rows, seed, id_col), ["sort_key", id_col], [label])
    n = {r[label]: r["n"] for r in placed.groupBy(label).agg(F.max("group_rows").alias("n")).collect()}  # two rows
    m = min(size // 2, n.get(0, 0), n.get(1, 0))
    rest = placed.where((F.col("position") >= m) & (F.col("position") < m + size)).orderBy("sort_key", id_col).limit(size - 2 * m)
    return placed.where(F.col("position") < m).unionByName(rest).select(*rows.columns)


def apportion(rows: DataFrame, groups: list[str], raw: Column, total: Column, tie: list[str]) -> DataFrame:
    """Column ``slots``: ``total`` of each group shared out in proportion to ``raw``, whole parts first, the rest by largest fraction."""
    by = Window.partitionBy(*groups)
    w = rows.withColumn("_raw", raw).withColumn("_whole", F.floor(F.col("_raw") + 1e-9))
    turn = F.row_number().over(by.orderBy(F.desc(F.round(F.col("_raw") - F.col("_whole"), 9)), *tie))
    w = w.withColumns({"_left": total - F.sum("_whole").over(by), "_turn": turn})
    return w.withColumn("slots", (F.col("_whole") + (F.col("_turn") <= F.col("_left")).cast("int")).cast("bigint")).drop("_raw", "_whole", "_left", "_turn")


def weighted_share(rows: DataFrame, groups: list[str], weight: Column, one_of: int, seed: int, id_col: str) -> DataFrame:
    """One of ``one_of`` rows of each group (at least one), drawn by weight without replacement: those with the smallest -ln(u) / w."""
    u = (F.conv(F.substring(F.sha2(key_of(F.lit(str(seed)), id_col), 256), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    placed = positions(rows.withColumn("_x", F.round(-F.ln(u) / weight, 9)), ["_x", id_col], groups)
    return placed.where(F.col("position") < F.greatest(F.lit(1), F.floor(F.col("group_rows") / one_of))).drop("_x", "position", "group_rows")


def assign_in_turn(rows: DataFrame, stratum: str, label: str, id_col: str, parts: list[tuple[str, str, int, str]], seed: int) -> DataFrame:
    """``id, split``: balanced samples one after the other, each from the rows of its pool that none before has taken.

    ``rows`` has ``pool``; ``parts``: name, pool, size and weights ('equal' or 'sqrt' of the smaller side).  Sizes that strata can't fill raise.
    """
    taken = None
    for name, pool, size, weights in parts:
        left = rows.where(F.col("pool") == pool)
        if taken is not None:
            left = left.join(taken, id_col, "left_anti")
        got = balanced_sample(left.drop("stratum") if stratum != "stratum" else left, F.col(stratum), label, id_col, size, f"{seed}|{name}", min_side=1, equal=weights == "equal")
        got = got.select(id_col, F.lit(name).alias("split"))
        taken = got if taken is None else taken.unionByName(got)
    return taken
