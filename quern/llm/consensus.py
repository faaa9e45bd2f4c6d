"""Consensus of annotators who disagree: iteratively reweighted voting with leave-one-out reliabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import canonical_class, checkpoint

#: Rounds after which accuracies that still change are an error.
ROUNDS = 200
#: Strength (in votes) and accuracy of the prior that smooths an annotator's accuracy.
PRIOR_VOTES, PRIOR_ACCURACY = 4.0, 0.7
SLOTS = 5


def long_votes(articles: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``id, annotator, vote`` (+1 AI, -1 human) with ``gold``; one row per person and article.

    Blank and unknown guesses and people without an id give no row.  Someone who fills two slots of an article
    has one vote there, or none if the two contradict each other.
    """
    cells = F.array(*[F.struct(F.trim(F.col(f"annotator_{i}.annotator_id")).alias("annotator"), canonical_class(F.col(f"annotator_{i}.guess")).alias("guess")) for i in range(1, slots + 1)])
    rows = articles.select("id", canonical_class(F.col("ground_truth")).alias("gold"), F.explode(cells).alias("c"))
    rows = rows.where("id is not null and c.annotator is not null and c.annotator != '' and c.guess is not null")
    votes = rows.groupBy("id", F.col("c.annotator").alias("annotator")).agg(F.avg(F.col("c.guess") * 2 - 1).alias("mean"), F.max("gold").alias("gold"))
    return votes.where("mean != 0").select("id", "annotator", F.signum("mean").alias("vote"), (F.col("gold") * 2 - 1).cast("double").alias("gold"))


def reweighted_votes(votes: DataFrame, rounds: int = ROUNDS, tolerance: float = 1e-3, use_gold: bool = False) -> DataFrame:
    """Reliability ``annotator, votes, accuracy, weight`` once weights and consensus no longer change.

    A round scores each article by its weighted votes, takes an annotator's own vote out of the score, and
    sets the annotator's accuracy to the smoothed mean probability that the others (or, with ``use_gold``, the known truth) agree with the vote.
    """
    by_article = Window.partitionBy("id")
    n = votes.sparkSession.conf.get("spark.sql.shuffle.partitions")
    votes = checkpoint(votes.repartition(int(n), "id"))
    start = F.log(F.lit(PRIOR_ACCURACY / (1 - PRIOR_ACCURACY)))
    people = votes.groupBy("annotator").agg(F.count(F.lit(1)).alias("votes")).withColumn("accuracy", F.lit(PRIOR_ACCURACY)).withColumn("weight", start)
    people = checkpoint(people)
    for _ in range(rounds):
        weighted = votes.join(people.select("annotator", "weight"), "annotator")
        own = F.col("weight") * F.col("vote")
        others = F.sum(own).over(by_article) - own
        agree = F.lit(1.0) / (1 + F.exp(-others * F.col("vote")))
        if use_gold:
            agree = F.when(F.col("gold").isNotNull(), F.when(F.col("gold") == F.col("vote"), 1.0).otherwise(0.0)).otherwise(agree)
        accuracy = (F.sum("agree") + PRIOR_VOTES * PRIOR_ACCURACY) / (F.count(F.lit(1)) + PRIOR_VOTES)
        new = weighted.withColumn("agree", agree).groupBy("annotator").agg(F.count(F.lit(1)).alias("votes"), F.round(accuracy, 9).alias("accuracy"))
        new = new.withColumn("weight", F.log(F.col("accuracy") / (1 - F.col("accuracy"))))
        new = checkpoint(new.join(people.select("annotator", F.col("accuracy").alias("old")), "annotator"))
        moved = new.agg(F.max(F.abs(F.col("accuracy") - F.col("old")))).first()[0]
        people = new.drop("old")
        if moved is None or moved < tolerance:
            return people
    raise RuntimeError(f"accuracies still change by {moved:.3g} after {rounds} rounds")


def consensus_labels(articles: DataFrame, use_gold: bool = False) -> tuple[DataFrame, DataFrame]:
    """Consensus per article and reliability per annotator.

    ``articles`` has ``id``, ``annotator_1..5`` (structs with ``annotator_id`` and ``guess``), ``majority_vote`` and ``ground_truth``; other columns don't matter.
    First result: ``id, n_votes, agreement, score, consensus, probability, majority, gold`` - classes are 1 (AI), 0 (human)
    or null (no usable vote, or a score of exactly 0); ``agreement`` is the share of agreeing pairs of votes (null under two votes);
    the votes alone decide; only with ``use_gold`` does a known truth weigh in and is the consensus where it exists.  Second: ``annotator, votes, accuracy, weight``.
    Articles without votes keep a row; rows that repeat an id are one article (their votes are taken together).
    """
    votes = checkpoint(long_votes(articles))
    people = reweighted_votes(votes, use_gold=use_gold)
    scored = votes.join(people.select("annotator", "weight"), "annotator").groupBy("id").agg(
        F.count(F.lit(1)).alias("n_votes"), F.sum(F.when(F.col("vote") > 0, 1).otherwise(0)).alias("ai"), F.round(F.sum(F.col("weight") * F.col("vote")), 9).alias("score")
    )
    base = articles.where("id is not null").groupBy("id").agg(F.max(canonical_class(F.col("majority_vote"))).alias("majority"), F.max(canonical_class(F.col("ground_truth"))).alias("gold"))
    n, a = F.col("n_votes"), F.col("ai")
    agreement = F.when(n > 1, (a * (a - 1) + (n - a) * (n - a - 1)) / (n * (n - 1)))
    voted = F.when(F.col("score") > 0, 1).when(F.col("score") < 0, 0)
    probability = 1 / (1 + F.exp(-F.col("score")))
    if use_gold:
        voted, probability = F.coalesce(F.col("gold"), voted), F.coalesce(F.col("gold").cast("double"), probability)
    out = base.join(scored, "id", "left").select(
        "id", F.coalesce(n, F.lit(0)).alias("n_votes"), agreement.alias("agreement"), "score", voted.cast("int").alias("consensus"), probability.alias("probability"), "majority", "gold"
    )
    return out, people


def krippendorff_alpha(votes: DataFrame) -> DataFrame:
    """Chance-corrected agreement over units with at least two votes, whatever is missing: one row ``alpha, pairable_votes, units``.

    Nominal coincidences: a unit of m votes counts each ordered pair 1/(m-1).  Null where fewer than two classes occur or nothing can be paired.
    """
    unit = votes.groupBy("id").agg(F.sum(F.when(F.col("vote") > 0, 1.0).otherwise(0.0)).alias("a"), F.count(F.lit(1)).cast("double").alias("m")).where("m >= 2")
    s = unit.agg(F.sum(2 * F.col("a") * (F.col("m") - F.col("a")) / (F.col("m") - 1)).alias("observed"), F.sum("a").alias("a"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("units"))
    expected = 2 * F.col("a") * (F.col("m") - F.col("a")) / (F.col("m") - 1)
    return s.select(F.when(F.col("a") * (F.col("m") - F.col("a")) > 0, F.round(1 - F.col("observed") / expected, 9)).alias("alpha"), F.coalesce(F.col("m"), F.lit(0.0)).cast("bigint").alias("pairable_votes"), "units")
