"""Positions over a whole table without a single-task window, and ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows that a range of the first column may hold before it is cut further, and the most ranges of a number.
LARGEST, RANGES = 1_000_000, 1024


def positions(rows: DataFrame, order: list[str], groups: list[str] = [], largest: int = LARGEST) -> DataFrame:  # noqa: B006
    """Columns ``position`` (from 0, in ascending ``order`` within ``groups``, nulls first) and ``group_rows``; ``order`` must be unique for a fixed result.

    A row's position is its rank in its range of the first column plus the rows of its group in the ranges before, so no task holds a group.
    Strings are cut by a prefix, which is lengthened until no range holds more than ``largest`` rows; numbers and times by their quantiles.  Ties of the first
    column stay in one range, as the range depends on the value alone.
    """
    first, kind = order[0], rows.schema[order[0]].dataType.simpleString()
    counted = lambda m: m.groupBy("_key").agg(F.first("_group").alias("_group"), F.first("_head").alias("_head"), F.count(F.lit(1)).alias("_n"))
    group = F.struct(*groups) if groups else F.lit(0)
    keyed = lambda head: rows.withColumns({"_group": group, "_head": head}).withColumn("_key", F.struct("_group", "_head"))
    if kind == "string":
        for length in (3, 6, 12, 24, 48, 96, 192):
            marked = keyed(F.substring(first, 1, length))
            most = counted(marked).agg(F.max("_n")).first()[0]
            if most is None or most <= largest:
                break
    else:
        value = F.unix_micros(F.col(first).cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else F.col(first).cast("double")
        x = F.when(~F.isnan(value), value)
        n, found = rows.agg(F.count(F.lit(1)), F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)], 4 * RANGES)).first()  # one pass
        step = RANGES // min(RANGES, max(16, 1 << (n // largest).bit_length()))
        cuts = sorted(set((found or [])[step - 1 :: step]))
        marked = keyed(F.when(value.isNotNull(), F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value))).otherwise(-1) if cuts else F.lit(0))
    heads = counted(marked)
    of_group = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("_key", before.alias("_before"), F.sum("_n").over(of_group).alias("group_rows"))  # a row per group and range
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(*order)) - 1
    return marked.join(heads, "_key").withColumn("position", F.col("_before") + rank).drop("_key", "_group", "_head", "_before")


def global_position(rows: DataFrame, order: list[str]) -> DataFrame:
    """Column ``position`` from 0 over the whole table."""
    return positions(rows, order).drop("group_rows")


def ordered_ema(rows: DataFrame, key: str, order: list[str], value: str, alpha: float, start: float) -> DataFrame:
    """``key, ema, visits``: exponential moving average of a key's values in arrival order.

    As the average is a weighted sum with weights alpha * (1 - alpha)^(rows after), it needs positions and a sum, not a fold over a collected list.
    """
    placed = positions(rows.select(key, *order, F.col(value).alias("_v")), order, [key])
    weight = F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("group_rows") - 1 - F.col("position"))
    visits = F.count(F.lit(1))
    return placed.groupBy(key).agg((F.sum(weight * F.col("_v")) + F.lit(start) * F.pow(F.lit(1 - alpha), visits)).alias("ema"), visits.alias("visits"))


def streaks(rows: DataFrame, key: str, order: list[str], condition: Column) -> DataFrame:
    """``rows`` with ``streak``: how many rows in a row, up to this one, fulfil ``condition`` (0 where it doesn't hold)."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_ok", F.coalesce(condition, F.lit(False)))
    island = marked.withColumn("_island", F.count_if(~F.col("_ok")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    count = F.count_if("_ok").over(Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return island.withColumn("streak", count).drop("_ok", "_island")


def midrank(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Column ``midrank``: tie-aware percentile of ``value`` within its group, (rows below + half of the ties) / rows."""
    counts = rows.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_ties"))
    w = Window.partitionBy(*groups).orderBy(value)
    below = F.sum("_ties").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_ties")
    total = F.sum("_ties").over(Window.partitionBy(*groups))
    ranked = counts.select(*groups, value, ((below + F.col("_ties") / 2) / total).alias("midrank"))
    return rows.join(ranked, [*groups, value])


def early_stop(rows: DataFrame, key: str, order: list[str], measures: list[str]) -> DataFrame:
    """``rows`` with ``better`` (some measure beats its best before) and ``streak`` (steps in a row, up to this one, without any that does)."""
    w = Window.partitionBy(key).orderBy(*order)
    better = F.lit(False)
    for m in measures:
        best = F.max(m).over(w.rowsBetween(Window.unboundedPreceding, -1))
        better = better | F.coalesce(F.col(m) > F.coalesce(best, F.lit(float("-inf"))), F.lit(False))
    marked = rows.withColumn("better", better)
    return streaks(marked, key, order, ~F.col("better"))


def _group_statistics(rows: DataFrame, groups: list[str], value: Column) -> DataFrame:
    return rows.groupBy(F.struct(*groups).alias("_k")).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.min(value).alias("_lo"), F.stddev_pop(value).alias("_sd"))


def group_advantages(rows: DataFrame, groups: list[str], value: str, floor: float = 0.0, baseline: str = "mean", missing: float | None = None, least: int = 1, out: str = "advantage") -> DataFrame:
    """Column ``out``: (value - mean or least of its group) / max(population spread, floor, 0.0001), within -5..5.

    Statistics are aggregated and joined back, so no task holds a group.  A null value gets ``missing``, a group with fewer than ``least`` values null.
    """
    stats = _group_statistics(rows, groups, F.col(value))
    base = F.col("_lo") if baseline == "min" else F.col("_m")
    z = (F.col(value) - base) / F.greatest(F.col("_sd"), F.lit(floor), F.lit(1e-4))
    clipped = F.when(F.col(value).isNotNull(), F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z))).otherwise(F.lit(missing).cast("double"))
    return rows.withColumn("_k", F.struct(*groups)).join(stats, "_k").withColumn(out, F.when(F.col("_n") >= least, clipped)).drop("_k", "_n", "_m", "_lo", "_sd")


def correct_only_advantages(rows: DataFrame, groups: list[str], value: str, correct: str, floor: float, low: float, high: float) -> DataFrame:
    """Column ``advantage``: correct rows are scored against the correct rows of their group (a single one keeps its value), wrong ones never get more than 0."""
    stats = _group_statistics(rows, groups, F.when(F.col(correct), F.col(value)))
    z = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col(value) - F.col("_m")) / F.greatest(F.col("_sd"), F.lit(floor), F.lit(1e-4))))
    clip = lambda c, top: F.greatest(F.lit(low), F.least(F.lit(top), c))
    advantage = F.when(~F.col(correct), clip(F.col(value), 0.0)).when(F.col("_n") >= 2, clip(z, high)).otherwise(clip(F.col(value), high))
    return rows.withColumn("_k", F.struct(*groups)).join(stats, "_k").withColumn("advantage", advantage).drop("_k", "_n", "_m", "_lo", "_sd")
