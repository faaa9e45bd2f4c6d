"""Rankings of judges: validity, head-to-head wins of one kind against another, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BY = ["doc_id", "judge_id"]


def valid_rankings(judgments: DataFrame) -> DataFrame:
    """``doc_id, judge_id`` of rankings that hold every item once, with ranks 1..n."""
    rows = judgments.select(*BY, "item_id", "rank").distinct()
    g = rows.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("items"), F.count_distinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    return g.where("items = n and ranks = n and low = 1 and high = n").select(*BY, "n")


def win_rates(judgments: DataFrame, ours: str = "model", theirs: str = "human") -> DataFrame:
    """``doc_id, judge_id, wins, duels, win_rate``: how often items of one kind are ranked before those of the other, ties half.

    A ranking's duels are counted from running sums over its ranks instead of pairs: an item of ours beats those of theirs ranked after it.
    """
    rows = judgments.where(F.col("true_kind").isin(ours, theirs) & F.col("rank").isNotNull()).groupBy(*BY, "rank").agg(F.count_if(F.col("true_kind") == ours).alias("a"), F.count_if(F.col("true_kind") == theirs).alias("b"))
    from pyspark.sql.window import Window

    w = Window.partitionBy(*BY)
    after = F.sum("b").over(w) - F.sum("b").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    scored = rows.withColumn("won", F.col("a") * (after + 0.5 * F.col("b")))
    g = scored.groupBy(*BY).agg(F.sum("won").alias("wins"), (F.sum("a") * F.sum("b")).alias("duels")).where("duels > 0")
    return g.withColumn("win_rate", F.col("wins") / F.col("duels"))


def panel(rates: DataFrame) -> DataFrame:
    """``doc_id, judges, panel_rate, consensus``: mean over judges; 1 if all are above a half, 0 if all are below, else a half."""
    consensus = F.when(F.min("win_rate") > 0.5, 1.0).when(F.max("win_rate") < 0.5, 0.0).otherwise(0.5)
    return rates.groupBy("doc_id").agg(F.count(F.lit(1)).alias("judges"), F.avg("win_rate").alias("panel_rate"), consensus.alias("consensus"))
