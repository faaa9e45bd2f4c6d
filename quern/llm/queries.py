"""Queries of the training-data problems over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import consensus, mixing, neardup, overlap, packing, quality, ranking, sampling, subjects, tokens
from quern.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    labels, _ = consensus.consensus_labels(table(spark, d, "expert_articles"))
    return labels.where("majority is not null and consensus is not null and majority != consensus").select("id")


def p1_annotators(spark: SparkSession, d: str) -> DataFrame:
    _, people = consensus.consensus_labels(table(spark, d, "expert_articles"))
    return people.select("annotator", "votes", F.round("accuracy", 4).alias("accuracy"))


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.krippendorff_alpha(consensus.long_votes(table(spark, d, "expert_articles")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "examples")).where("kind != 'prose'").select("id", "kind")


def p2_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "examples"))


def p3_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(table(spark, d, "examples"))


def p3_per_document(spark: SparkSession, d: str) -> DataFrame:
    return tokens.with_token_counts(table(spark, d, "examples").select("id", "text"), "text").select("id", "n_tokens")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.id_pairs(*overlap.contaminated_pairs(table(spark, d, "examples")))
    return pairs.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "examples"))


#: The contestant that the others are held against.
REFERENCE_CONTESTANT = "model_rollout_0"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    strengths, _ = ranking.rank_contestants(table(spark, d, "judgments"))
    bar = strengths.where(F.col("source_id") == REFERENCE_CONTESTANT).select(F.col("strength").alias("bar"))
    return strengths.crossJoin(F.broadcast(bar)).where("strength > bar").select("source_id")  # bar: one row at most


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_contestants(table(spark, d, "judgments"))[0]


def p5_inconsistency(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_contestants(table(spark, d, "judgments"))[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = sampling.proportional_sample(table(spark, d, "examples"), table(spark, d, "sample_targets"))
    return report.where("not feasible").select("target_id")


def p6_targets(spark: SparkSession, d: str) -> DataFrame:
    return sampling.target_report(table(spark, d, "examples"), table(spark, d, "sample_targets"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.proportional_sample(table(spark, d, "examples"), table(spark, d, "sample_targets"))[1]


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.proportional_sample(table(spark, d, "examples"), table(spark, d, "sample_targets"))[0]


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return neardup.text_pool(table(spark, d, "examples"), table(spark, d, "pair_docs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand_pairs(*neardup.near_duplicates(_pool(spark, d)))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*neardup.near_duplicates(_pool(spark, d)))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, d, "documents"), "doc_id", "text")
    return packed.where("parts > 1").select("doc_id").distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), "doc_id", "text")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(packing.pack_documents(table(spark, d, "documents"), "doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.where("not feasible").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0].where("uses > 0")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    assigned, _ = subjects.assign_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))
    return assigned.select("doc_id", "subject").distinct()


def p10_makeup(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))[1]


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_annotators, p1_agreement, p2_found, p2_statistics, p3_budget, p3_per_document, p4_found, p4_report, p5_found, p5_ranking, p5_inconsistency,
        p6_found, p6_targets, p6_sample, p6_report, p7_found, p7_groups, p8_found, p8_containers, p8_fill, p9_found, p9_shares, p9_mixture, p10_found, p10_makeup,
    )
}
