"""Writers: JSON lines with sorted keys, TSV for reports, split and sharded folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_line(rows: DataFrame) -> Column:
    """A row as JSON with its keys in alphabetical order."""
    return F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})


def write_jsonl(rows: DataFrame, path: str, gzip: bool = False, mode: str = "errorifexists") -> None:
    rows.select(json_line(rows).alias("value")).write.mode(mode).option("compression", "gzip" if gzip else "none").text(path)


def tsv_cell(c: Column, kind: str) -> Column:
    """Null and NaN to empty, tabs and line breaks to blanks."""
    text = F.when(~F.isnan(c), c.cast("string")) if kind in ("double", "float") else c.cast("string")
    return F.coalesce(F.regexp_replace(text, r"[\t\r\n]", " "), F.lit(""))


def write_tsv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.select(*[tsv_cell(F.col(c), k).alias(c) for c, k in rows.dtypes]).write.mode(mode).option("header", True).option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def write_splits(rows: DataFrame, assignments: DataFrame, path: str, key: str, shards: int = 1, mode: str = "errorifexists") -> None:
    """One folder per split (rows without an assignment in 'remaining') and shard of it by a hash of the key, as zstd Parquet; nothing passes through one task."""
    joined = rows.drop("split").join(assignments.select(key, "split"), key, "left").withColumn("split", F.coalesce("split", F.lit("remaining")))
    joined.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")).write.mode(mode).option("compression", "zstd").partitionBy("split", "shard").parquet(path)


def write_unified(rows: DataFrame, folder: str, mode: str = "errorifexists") -> DataFrame:
    """Parquet (zstd) and gzipped JSON lines of unified records; returns the counts by dataset, split, domain and label, read back from what was written."""
    rows.write.mode(mode).option("compression", "zstd").parquet(f"{folder}/parquet")
    back = rows.sparkSession.read.parquet(f"{folder}/parquet")
    write_jsonl(back, f"{folder}/jsonl", gzip=True, mode=mode)
    return back.groupingSets([["dataset_id"], ["dataset_id", "source_split"], ["domain"], ["domain", "label"]], "dataset_id", "source_split", "domain", "label").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("rows"))


def last_value_per_step(metrics: DataFrame) -> DataFrame:
    """A log of ``step, seq, key, value`` as one map per step, the last value of a key winning."""
    last = metrics.groupBy("step", "key").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("step").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metrics"))  # the keys of one step


def write_json_list(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document that lists the rows; for configurations and small tables, as it is one line."""
    line = F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns))))
    rows.agg(line.alias("value")).write.mode(mode).text(path)


def write_keyed_json(rows: DataFrame, key: str, path: str, mode: str = "errorifexists") -> None:
    """One JSON document with an entry per row under its number; for configurations and small tables."""
    fields = F.struct(*[c for c in rows.columns if c != key])
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), fields)))).alias("value")).write.mode(mode).text(path)


def write_json_document(one: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A single row as an indented JSON document with sorted keys."""
    one.select(F.to_json(F.struct(*sorted(one.columns)), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_by_detector(rows: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """JSON lines of predictions, a folder per detector."""
    rows.write.mode(mode).partitionBy("detector").json(folder)


def without_nan(rows: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null."""
    return rows.select(*[F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in rows.dtypes])


def shard_manifest(rows: DataFrame, shard: str, id_col: str) -> DataFrame:
    """``shard, rows, content``: rows of each shard and a hash of its sorted ids (hash sums would do for shards too large to list; these are work units of a scorer)."""
    return rows.groupBy(shard).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(id_col)), "\n"), 256).alias("content"))


def detector_rows(unified: DataFrame, split: Column, policy: str) -> DataFrame:
    """Unified records as a scorer's input: generator and language filled in, attack never null, with split and policy."""
    generator = F.when(F.trim("generator_model") != "", F.trim("generator_model")).when(F.col("label") == 0, "human").otherwise("")
    return unified.select(
        F.col("unified_id").alias("id"), "text", "label", split.alias("split"), "dataset_id", "domain", generator.alias("generator_model"), F.coalesce("attack", F.lit("none")).alias("attack"),
        F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("en")).alias("language"), "source_split", "source", "source_detail", "is_default_training_candidate", "is_adversarial", F.lit(policy).alias("split_policy"),
    )


def training_rows(unified: DataFrame, adversarial: bool = False) -> DataFrame:
    """Eleven columns of a training row; adversarial rows are a domain of their own, with the attack as detail."""
    domain = F.lit("adversarial") if adversarial else F.col("domain")
    detail = F.coalesce(F.nullif("attack", F.lit("")), F.lit("unknown")) if adversarial else F.col("source_detail")
    return unified.select(F.col("unified_id").alias("id"), "text", "label", domain.alias("domain"), "dataset_id", "source", detail.alias("source_detail"), "generator_model", "attack", "language", F.lit(None).cast("double").alias("external_score"))


def harness_rows(unified: DataFrame, split: Column, policy: str) -> DataFrame:
    """Rows for the benchmark, clean and adversarial ones in one form."""
    adv = F.col("is_adversarial")
    return unified.select(
        F.col("unified_id").alias("id"), "text", "label", split.alias("split"), F.col("dataset_id").alias("dataset"), F.when(adv, "adversarial").otherwise(F.col("domain")).alias("domain"), F.col("generator_model").alias("generator"),
        "attack", "language", "source_split", "source", F.when(adv, F.col("attack")).otherwise(F.col("source_detail")).alias("source_detail"), (~adv).alias("is_default_training_candidate"), "is_adversarial", F.lit(policy).alias("split_policy"),
    )
