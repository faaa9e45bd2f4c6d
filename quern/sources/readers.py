"""Readers of the file forms that corpora and scorer outputs come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXAMPLE = "id string, text string, label int, split string, dataset string, domain string, generator string, attack string, meta map<string,string>"
PREDICTION = "id string, detector string, score_ai double, raw_score double, raw_label string, pred_builtin int, features map<string,string>, runtime_s double, error string, label int, split string, dataset string, domain string, generator string, attack string"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Lines of JSON; blank lines are skipped.  A malformed line raises, or with ``strict=False`` is kept in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header, quoted line breaks and all columns as strings; a byte-order mark and columns without a name are dropped."""
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    for c in df.columns:
        if c.startswith("﻿"):
            df = df.withColumnRenamed(c, c.lstrip("﻿"))
    return df.drop(*[c for c in df.columns if not c.strip() or c.startswith("_c")])


def read_keyed_json(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A JSON object whose keys are the row numbers: ``row_index`` and ``fields``, one row per key."""
    raw = spark.read.option("wholetext", True).text(path)
    value = F.from_json("value", f"map<string,struct<{fields}>>")
    rows = raw.select(F.explode(value).alias("k", "r"))
    return rows.select(F.col("k").cast("int").alias("row_index"), "r.*").orderBy("row_index")


def read_predictions_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All ``<detector>.predictions.jsonl`` of a folder; the file's name gives the detector.

    A row without a score counts as ``failed`` and gets score 0; a row with an error keeps its score.
    """
    rows = spark.read.schema(PREDICTION).json(f"{folder}/*.predictions.jsonl").drop("detector")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.predictions\.jsonl$", 1)
    failed = F.col("score_ai").isNull() | (F.coalesce("error", F.lit("")) != "")
    return rows.withColumn("detector", name).withColumns({"failed": failed, "score_ai": F.coalesce("score_ai", F.lit(0.0))})


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Reader by the path's ending: parquet, json lines (also gzipped), csv, tsv; a folder is read as parquet."""
    low = path.lower().removesuffix(".gz")
    if low.endswith((".jsonl", ".json")):
        return read_jsonl(spark, path, schema) if schema else spark.read.json(path)
    if low.endswith(".csv"):
        return read_delimited(spark, path)
    if low.endswith(".tsv"):
        return read_delimited(spark, path, "\t")
    return spark.read.parquet(path)


def with_positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``row_index`` from 0 in the order of ``order``, for sources that are aligned by position."""
    from quern.operators.ranks import global_position

    return global_position(rows, order).withColumnRenamed("position", "row_index")


def align_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on ``row_index``: null where the right side has no such row."""
    return left.join(right, "row_index", "left")


def latest_log_entry(spark: SparkSession, path: str, schema: str, step: int | None = None) -> DataFrame:
    """Last entry of an append-only JSON-lines log by ``step`` (the last of those with the given step)."""
    rows = read_jsonl(spark, path, schema).withColumn("_at", F.monotonically_increasing_id())
    if step is not None:
        rows = rows.where(F.col("step") == step)
    return rows.orderBy(F.desc("_at")).limit(1).drop("_at")


def read_splits(spark: SparkSession, path: str, split: str, order: list[str]) -> DataFrame:
    """A folder per split, with ``row_index`` from 0 within each."""
    from quern.operators.ranks import positions

    return positions(spark.read.parquet(path), order, [split]).drop("group_rows").withColumnRenamed("position", "row_index")


def dataset_path(path: Column) -> tuple[Column, Column]:
    """Repository and split of ``scheme://owner/repo/split..``; a path with fewer parts is an error."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"^[a-z]+://", ""), r"^/+|/+$", ""), "/")
    bad = F.raise_error(F.concat(F.lit("not owner/repo/split: "), path)).cast("string")
    repo = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(bad)
    return repo, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "/")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples with their schema; an id or label (other than 0, 1 or null) that isn't valid is an error."""
    rows = read_jsonl(spark, path, EXAMPLE)
    bad = F.col("id").isNull() | (F.col("label").isNotNull() & ~F.col("label").isin(0, 1))
    return rows.withColumn("id", F.when(bad, F.raise_error(F.concat(F.lit("not a valid example: "), F.coalesce("id", F.lit("without id")))).cast("string")).otherwise(F.col("id")))


def read_json_document(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A JSON document that lists rows; a document is read in one task, so this is for configurations and small tables."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", f"array<struct<{fields}>>")).alias("r")).select("r.*")


def read_detector_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions in a folder per detector, as ``read_predictions_folder`` gives them."""
    schema = ", ".join(f for f in PREDICTION.split(", ") if not f.startswith("detector "))
    rows = spark.read.schema(schema + ", detector string").json(folder)
    failed = F.col("score_ai").isNull() | (F.coalesce("error", F.lit("")) != "")
    return rows.withColumns({"failed": failed, "score_ai": F.coalesce("score_ai", F.lit(0.0))})


class ListSource(DataSource):
    """Rows that Python code yields (a pickled list, a paged service), as a source with partitions."""

    @classmethod
    def name(cls) -> str:
        return "quern_list"

    def schema(self) -> str:
        return "k bigint, v bigint"

    def reader(self, schema):
        return ListReader(int(self.options.get("rows", 0)), int(self.options.get("parts", 1)))


class ListReader(DataSourceReader):
    def __init__(self, rows: int, parts: int):
        self.rows, self.parts = rows, parts

    def partitions(self):
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition):
        for k in range(partition.value, self.rows, self.parts):
            yield (k, k * k)
