"""Quantiles and weighted means as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranks import positions


def lower_quantile(rows: DataFrame, groups: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Discrete lower quantiles ``sorted[floor(q * (n - 1))]`` per group, as columns; from positions, so no task holds a group."""
    placed = positions(rows.where(F.col(value).isNotNull()).select(*groups, value), [value], groups)
    at = {k: F.floor(F.lit(q) * (F.col("group_rows") - 1)) for k, q in quantiles.items()}
    return placed.groupBy(*groups).agg(*[F.max(F.when(F.col("position") == a, F.col(value))).alias(k) for k, a in at.items()])


def linear_quantile(rows: DataFrame, groups: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per group, as columns (q <= 0: the least, q >= 1: the greatest); from positions, so no task holds a group."""
    placed = positions(rows.where(F.col(value).isNotNull()).select(*groups, value), [value], groups)
    out = []
    for k, q in quantiles.items():
        at = F.lit(min(1.0, max(0.0, q))) * (F.col("group_rows") - 1)
        share = at - F.floor(at)
        low = F.max(F.when(F.col("position") == F.floor(at), F.col(value)))
        high = F.max(F.when(F.col("position") == F.ceil(at), F.col(value)))
        out.append((low + (high - low) * F.max(share)).alias(k))
    return placed.groupBy(*groups).agg(*out)


def softmax_mean(score: Column, beta: float = 3.0) -> Column:
    """Mean of signed scores weighted by exp(beta * |score|); 0 without scores, the plain mean for beta <= 0."""
    if beta <= 0:
        return F.coalesce(F.avg(score), F.lit(0.0))
    w = F.exp(F.lit(beta) * F.abs(score))
    return F.coalesce(F.sum(w * score) / F.sum(w), F.lit(0.0))
