"""Records of different sources brought into one schema, with counts of what was seen, kept and left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import key_of, normalize_language

UNIFIED = (
    "unified_id", "dataset_id", "source_split", "row_index", "text", "label", "label_text", "domain", "domain_detail", "source", "source_detail", "lang", "language",
    "generator_model", "title", "decoding", "repetition_penalty", "attack", "is_adversarial", "is_default_training_candidate", "original_json",
)
NOT_FOR_TRAINING = ("code", "non_english", "unknown")
TRAINING_LANGUAGES = ("en",)


def canonical_name(c: Column) -> Column:
    """Trimmed, lower-cased, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def mapped(c: Column, table: dict[str, str], default: str = "unknown") -> Column:
    """The value that ``table`` has for the lower-cased ``c``."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, F.lower(c)), F.lit(default))


def infer_language(lang: Column, domain: Column, detail: Column | None = None, by_detail: dict[str, str] | None = None) -> Column:
    """The normalized language, else that of the detail, else 'unknown' for a domain of other languages, else 'en'."""
    known = normalize_language(lang)
    if by_detail and detail is not None:
        known = F.coalesce(known, F.try_element_at(F.create_map(*[F.lit(x) for kv in by_detail.items() for x in kv]), F.lower(F.trim(detail))))
    return F.coalesce(known, F.when(domain == "non_english", "unknown").otherwise("en"))


def unified_record(
    rows: DataFrame, dataset: Column, split: Column, row_index: Column, text: Column, label: Column, domain: Column, lang: Column, generator: Column, attack: Column,
    source: Column | None = None, detail: Column | None = None, title: Column | None = None, domain_detail: Column | None = None, decoding: Column | None = None, penalty: Column | None = None,
) -> DataFrame:
    """Project any source into the unified schema.

    A record is adversarial if it has an attack other than 'none'; it is a training candidate if it isn't adversarial, is of a language in
    TRAINING_LANGUAGES and of no domain in NOT_FOR_TRAINING.  A null text is an empty one.
    """
    none = F.lit(None).cast("string")
    or_none = lambda c: none if c is None else c.cast("string")
    adversarial = F.coalesce(attack != "none", F.lit(False))
    language = infer_language(lang, domain)
    columns = {
        "unified_id": key_of(dataset, split, row_index, sep="::"), "dataset_id": dataset, "source_split": split, "row_index": row_index.cast("bigint"), "text": F.coalesce(text, F.lit("")), "label": label.cast("int"),
        "label_text": F.when(label == 1, "AI").otherwise("human"), "domain": domain, "domain_detail": or_none(domain_detail), "source": or_none(source), "source_detail": or_none(detail),
        "lang": F.coalesce(lang, language), "language": language, "generator_model": generator, "title": or_none(title), "decoding": or_none(decoding), "repetition_penalty": or_none(penalty),
        "attack": attack, "is_adversarial": adversarial, "is_default_training_candidate": ~domain.isin(*NOT_FOR_TRAINING) & ~adversarial & language.isin(*TRAINING_LANGUAGES),
        "original_json": F.to_json(F.struct(*sorted(rows.columns))),
    }
    return rows.select(*[columns[c].alias(c) for c in UNIFIED])


def concatenate(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def route_rows(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows kept (null reason) and rows left out with their ``reason``; together they are all rows."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def build_counts(rows: DataFrame, dataset: str, split: str, reason: Column) -> DataFrame:
    """Counts of rows seen and left out by dataset, dataset and split, dataset and reason, and all three: one pass, four grouping sets.

    ``level`` names the set; ``reason`` is null in the rows that count all that was seen.
    """
    marked = rows.select(F.col(dataset).alias("dataset"), F.col(split).alias("split"), reason.alias("reason"))
    finest = marked.groupBy("dataset", "split", "reason").agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("out"))
    sets = finest.groupingSets([["dataset"], ["dataset", "split"], ["dataset", "reason"], ["dataset", "split", "reason"]], "dataset", "split", "reason").agg(F.grouping_id().alias("gid"), F.sum("n").alias("seen"), F.sum("out").alias("excluded"))
    names = F.create_map(*[F.lit(x) for kv in {3: "dataset", 1: "dataset+split", 2: "dataset+reason", 0: "dataset+split+reason"}.items() for x in kv])
    level = names[F.col("gid").cast("int")]
    return sets.select(level.alias("level"), "dataset", "split", "reason", "seen", "excluded").where("level in ('dataset', 'dataset+split') or reason is not null")


def conservation(rows: DataFrame, dataset: str, reason: Column) -> DataFrame:
    """Per dataset: ``seen, excluded, included`` and whether they add up."""
    out = rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("seen"), F.count(reason).alias("excluded"), F.count_if(reason.isNull()).alias("included"))
    return out.withColumn("adds_up", F.col("seen") - F.col("excluded") == F.col("included"))
