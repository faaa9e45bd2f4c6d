"""Weights of online samplers as expressions on their state, and weighted draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ucb_raw(variance: Column, visits: Column, ema: Column, c: float, hardness: float) -> Column:
    """Spread of rewards, a bonus for few visits, and one for rewards under a half."""
    return variance + F.lit(c) / F.sqrt(visits + 1) + F.lit(hardness) * F.greatest(F.lit(0.0), 0.5 - ema)


def softmax_with_floor(state: DataFrame, raw: str, beta: float, floor: float) -> DataFrame:
    """Column ``weight``: softmax of beta * raw over all rows, mixed with ``floor`` shared evenly.  One row per stratum; there are few."""
    everyone = Window.partitionBy()
    x = F.exp(F.lit(beta) * (F.col(raw) - F.max(raw).over(everyone)))
    s = state.withColumn("_x", x)
    return s.withColumn("weight", (1 - floor) * F.col("_x") / F.sum("_x").over(everyone) + floor / F.count(F.lit(1)).over(everyone)).drop("_x")


def curriculum(state: DataFrame, weight: str, difficulty: str, tau: float, gamma: float) -> DataFrame:
    """``weight`` times exp(-gamma * (difficulty - tau)^2), renormalized; unchanged if everything vanishes."""
    everyone = Window.partitionBy()
    w = F.col(weight) * F.exp(-F.lit(gamma) * (F.col(difficulty) - tau) ** 2)
    s = state.withColumn("_w", w).withColumn("_t", F.sum("_w").over(everyone))
    return s.withColumn(weight, F.when(F.col("_t") > 1e-12, F.col("_w") / F.col("_t")).otherwise(F.col(weight))).drop("_w", "_t")


def linear_ramp(step: Column, first: float, last: float, steps: int) -> Column:
    return F.lit(first) + (F.lit(last) - F.lit(first)) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), step / float(steps)))


def replay_priority(variance: Column, mean: Column) -> Column:
    """Mostly the spread of an item's rewards, partly how hard it is; never 0."""
    return F.greatest(F.lit(0.000001), 0.8 * variance + 0.2 * F.greatest(F.lit(0.0), 1 - mean))


def weighted_draws(state: DataFrame, key: str, weight: str, draws: int, seed: int) -> DataFrame:
    """``draw, key``: draws with replacement by weight, each by a hashed uniform against the running weights of the few keys."""
    up = Window.orderBy(key)
    total = F.sum(weight).over(Window.partitionBy())
    high = F.sum(weight).over(up.rowsBetween(Window.unboundedPreceding, 0)) / total
    cum = state.select(key, high.alias("_high")).withColumn("_low", F.coalesce(F.lag("_high").over(up), F.lit(0.0)))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("draw")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    return state.sparkSession.range(draws).select(F.col("id").alias("draw")).withColumn("_u", u).join(F.broadcast(cum), (F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high"))).select("draw", key)


def fifo_pool(observations: DataFrame, key: str, order: list[str], value: str, alpha: float, pool: int) -> DataFrame:
    """State of a replay pool after all observations: ``key, ema, visits, first_seen`` of the ``pool`` keys seen last for the first time."""
    from quern.operators.ranks import ordered_ema

    state = ordered_ema(observations, key, order, value, alpha, 0.0).join(observations.groupBy(key).agg(F.min(F.struct(*order)).alias("first_seen")), key)
    return state.orderBy(F.desc("first_seen"), key).limit(pool)  # the pool's size is a parameter of the sampler


def stratum_state(rewards: DataFrame, key: str, step: str, value: str, alpha: float, reward_alpha: float) -> DataFrame:
    """``key, visits, ema, variance`` of the strata after all steps: averages of the step means (from 0.5) and of the variance within a step (from 0.25)."""
    from quern.operators.ranks import ordered_ema

    v = F.when(F.count(F.lit(1)) > 1, F.var_pop(value)).otherwise(0.0)
    steps = rewards.groupBy(key, step).agg(F.avg(value).alias("_m"), v.alias("_v"))
    mean = ordered_ema(steps, key, [step], "_m", alpha, 0.5)
    spread = ordered_ema(steps, key, [step], "_v", reward_alpha, 0.25).select(key, F.col("ema").alias("variance"))
    return mean.join(spread, key)


def reward_ema(rows: DataFrame, key: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """``key, reward``: moving average in arrival order that starts at the key's first value."""
    from quern.operators.ranks import ordered_ema

    first = rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("_x0"))
    e = ordered_ema(rows, key, order, value, alpha, 0.0).join(first, key)
    return e.select(key, (F.col("ema") + F.pow(F.lit(1 - alpha), F.col("visits")) * F.col("_x0")).alias("reward"))


def continued_ema(state: DataFrame, rows: DataFrame, key: str, order: list[str], value: str, alpha: float, start: float) -> DataFrame:
    """``key, ema, visits``: a restored state carried on with further rows; keys only one of the two knows keep what they have."""
    from quern.operators.ranks import ordered_ema

    more = ordered_ema(rows, key, order, value, alpha, 0.0).withColumnsRenamed({"ema": "_e", "visits": "_v"})
    both = state.join(more, key, "full")
    n = F.coalesce("_v", F.lit(0))
    return both.select(key, (F.coalesce("_e", F.lit(0.0)) + F.pow(F.lit(1 - alpha), n) * F.coalesce("ema", F.lit(start))).alias("ema"), (F.coalesce("visits", F.lit(0)) + n).alias("visits"))


def capped(state: DataFrame, weight: str, most: float) -> DataFrame:
    """``weight`` cut at ``most`` and renormalized once.  One row per stratum; there are few."""
    s = state.withColumn("_w", F.least(F.lit(most), F.col(weight)))
    return s.withColumn(weight, F.col("_w") / F.sum("_w").over(Window.partitionBy())).drop("_w")


def hashed_draws(state: DataFrame, key: str, weight: str, draws: int, seed: int) -> DataFrame:
    """``draw, key``: draws with replacement by weight; draw i takes the key whose share of the running weights holds the i-th hashed number.  ``state`` has few keys."""
    up = Window.orderBy(key)
    total = F.sum(weight).over(Window.partitionBy())
    high = F.sum(weight).over(up.rowsBetween(Window.unboundedPreceding, 0))
    cum = state.select(key, (high / total).alias("_high"), ((high - F.col(weight)) / total).alias("_low"))
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    numbers = state.sparkSession.range(draws).select(F.col("id").alias("draw"), u.alias("_u"))
    return numbers.join(F.broadcast(cum), (F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high"))).select("draw", key)  # a row per stratum
