"""Queries that write the forms corpora and scorer outputs come in, and read them back: sources and sinks in one round trip.

Files go to the shared folder that the session names for checkpoints; a local session has one of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import metrics as M
from quern.operators import normalize as N
from quern.operators.allocate import with_sort_key
from quern.operators.ranks import global_position
from quern.plans.metrics_q import VALID
from quern.plans.records_q import _NAME, _U, _unified
from quern.plans.registry import query, table
from quern.session import shared_folder
from quern.sources import readers as A
from quern.sources import writers as B


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex}"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "title", "label")


@query("A01_rows_by_split", "SELECT id, lower(trim(split)) AS split, row_number() OVER (PARTITION BY lower(trim(split)) ORDER BY id) - 1 AS row_index FROM examples WHERE split IS NOT NULL")
def a01(spark, d):
    """A source of several splits, read split by split: positions within the split, all rows counted as seen."""
    rows = table(spark, d, "examples").where("split is not null").select("id", F.lower(F.trim("split")).alias("split"))
    path = _place(spark, "splits")
    rows.write.partitionBy("split").parquet(path)
    return A.read_splits(spark, path, "split", ["id"]).select("id", "split", "row_index")


@query("A02_one_kind_source", "SELECT id, 1 AS label, 'student_essay' AS domain, row_number() OVER (ORDER BY id) - 1 AS row_index FROM examples WHERE lower(trim(dataset)) = 'quillmark/essay_bank' AND generator <> 'human'")
def a02(spark, d):
    rows = table(spark, d, "examples").where("lower(trim(dataset)) = 'quillmark/essay_bank' and generator != 'human'").select("id")
    return global_position(rows, ["id"]).select("id", F.lit(1).alias("label"), F.lit("student_essay").alias("domain"), F.col("position").alias("row_index"))


@query("A03_web_source", "SELECT id, CASE WHEN lower(trim(raw)) = 'ai' THEN 1 ELSE 0 END AS label, 'web_text' AS domain FROM (SELECT id, CASE WHEN label = 1 THEN ' AI' ELSE 'human' END AS raw FROM examples WHERE label IN (0, 1))")
def a03(spark, d):
    """Labels as words; any other word is an error."""
    raw = table(spark, d, "examples").where("label in (0, 1)").select("id", F.when(F.col("label") == 1, " AI").otherwise("human").alias("raw"))
    low = F.lower(F.trim("raw"))
    return raw.select("id", F.when(low == "ai", 1).when(low == "human", 0).otherwise(F.raise_error(F.concat(F.lit("unexpected label: "), "raw")).cast("int")).alias("label"), F.lit("web_text").alias("domain"))


@query("A04_flagged_source", "SELECT doc_id, coalesce(label, 0) = 1 AS generated, CASE WHEN label = 1 THEN generator_model ELSE 'human' END AS generator FROM documents")
def a04(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.coalesce("label", F.lit(0)) == 1).alias("generated"), "generator_model")
    path = _place(spark, "flags")
    rows.write.json(path)
    back = A.read_jsonl(spark, path, "doc_id bigint, generated boolean, generator_model string")
    return back.select("doc_id", "generated", F.when(F.col("generated"), F.col("generator_model")).otherwise("human").alias("generator"))


@query("A05_excluded_after_counting", "SELECT source_id, k AS row_index, CASE WHEN text_type IN ('human_written', 'ai_generated') THEN NULL ELSE 'text_type=' || coalesce(text_type, '') END AS reason FROM (SELECT source_id, text_type, row_number() OVER (ORDER BY source_id) - 1 AS k FROM pair_docs)")
def a05(spark, d):
    """Rows of other kinds are left out with their reason after they got their position, so positions keep gaps."""
    placed = global_position(table(spark, d, "pair_docs").select("source_id", "text_type"), ["source_id"])
    reason = F.when(F.coalesce(~F.col("text_type").isin("human_written", "ai_generated"), F.lit(True)), F.concat(F.lit("text_type="), F.coalesce("text_type", F.lit(""))))
    kept, out = N.route_rows(placed, reason)
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(out).select("source_id", F.col("position").alias("row_index"), "reason")


@query("A06_csv", "SELECT doc_id::VARCHAR AS doc_id, lang, source, title FROM documents")
def a06(spark, d):
    path = _place(spark, "csv")
    _docs(spark, d).select("doc_id", "lang", "source", "title").write.option("header", True).option("escape", '"').option("nullValue", "\\N").csv(path)
    back = A.read_delimited(spark, path)
    return back.select(*[F.when(F.col(c) != "\\N", F.col(c)).alias(c) for c in ("doc_id", "lang", "source", "title")])


@query("A07_tsv", "SELECT doc_id::VARCHAR AS doc_id, coalesce(regexp_replace(title, '[\\t\\r\\n]', ' ', 'g'), '') AS title FROM documents")
def a07(spark, d):
    path = _place(spark, "tsv")
    B.write_tsv(_docs(spark, d).select("doc_id", "title", F.lit("x").alias(" ")), path)
    back = A.read_delimited(spark, path, "\t")
    return back.select("doc_id", F.coalesce("title", F.lit("")).alias("title"))


@query("A08_python_source", "SELECT k, k * k AS v FROM range(0, 50) AS r(k)")
def a08(spark, d):
    """A list that a Python reader yields, as a data source with partitions."""
    spark.dataSource.register(A.ListSource)
    return spark.read.format("quern_list").option("rows", "50").option("parts", "4").load()


@query("A09_positional_columns", "WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents WHERE label = 0), a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents WHERE label = 1) SELECT h.doc_id AS human, a.doc_id AS ai, k FROM h LEFT JOIN a USING (k)")
def a09(spark, d):
    side = lambda y: A.with_positions(table(spark, d, "documents").where(F.col("label") == y).select("doc_id"), ["doc_id"])
    h, a = side(0).withColumnRenamed("doc_id", "human"), side(1).withColumnRenamed("doc_id", "ai")
    return A.align_by_position(h, a).select("human", "ai", F.col("row_index").alias("k"))


@query("A10_files_by_language", "SELECT doc_id::VARCHAR AS doc_id, lang, CASE WHEN label = 1 THEN 'train' ELSE 'test' END || '_' || lang AS source_split FROM documents WHERE lang IN ('en', 'es') AND label IN (0, 1)")
def a10(spark, d):
    """One file per language and split; which is which comes from the loop, not from the rows."""
    parts = []
    for lang in ("en", "es"):
        for split, y in (("train", 1), ("test", 0)):
            path = _place(spark, f"{split}-{lang}")
            B.write_tsv(_docs(spark, d).where((F.col("lang") == lang) & (F.col("label") == y)).select("doc_id", "lang"), path)
            parts.append(A.read_delimited(spark, path, "\t").withColumn("source_split", F.lit(f"{split}_{lang}")))
    return N.concatenate(parts)


@query("A11_prefixed_rows", "SELECT count(*) AS seen, count(*) FILTER (lower(source) LIKE 'c%') AS included, count(*) FILTER (NOT coalesce(lower(source), '') LIKE 'c%') AS excluded FROM documents")
def a11(spark, d):
    reason = F.when(~F.coalesce(F.lower("source"), F.lit("")).startswith("c"), "prefix")
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("seen"), F.count_if(reason.isNull()).alias("included"), F.count(reason).alias("excluded"))


@query("A13_all_sources", "SELECT dataset_id, count(*) AS rows FROM (SELECT 'documents' AS dataset_id FROM documents UNION ALL SELECT 'examples' FROM examples UNION ALL SELECT 'pairs' FROM pair_docs) GROUP BY dataset_id")
def a13(spark, d):
    one = lambda name, t, i: table(spark, d, t).select(F.lit(name).alias("dataset_id"), F.col(i).cast("string").alias("id"))
    return N.concatenate([one("documents", "documents", "doc_id"), one("examples", "examples", "id"), one("pairs", "pair_docs", "source_id")]).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows"))


@query("A14_path_forms", "SELECT form, count(*) AS rows FROM (SELECT unnest(['csv', 'jsonl', 'parquet', 'tsv']) AS form FROM documents) GROUP BY form")
def a14(spark, d):
    rows, parts = table(spark, d, "documents").select("doc_id", "lang"), []
    for form in ("parquet", "jsonl", "csv", "tsv"):
        path = _place(spark, "form") + f".{form}"
        if form == "parquet":
            rows.write.parquet(path)
        elif form == "jsonl":
            B.write_jsonl(rows, path)
        elif form == "csv":
            rows.write.option("header", True).csv(path)
        else:
            B.write_tsv(rows, path)
        parts.append(A.read_any(spark, path).select(F.lit(form).alias("form")))
    return N.concatenate(parts).groupBy("form").agg(F.count(F.lit(1)).alias("rows"))


@query("A15_dataset_paths", "SELECT * FROM (VALUES ('hub://owner/repo/train', 'owner/repo', 'train'), ('hub://owner/repo/a/b', 'owner/repo', 'a/b')) AS v(path, repo, split)")
def a15(spark, d):
    rows = spark.createDataFrame([("hub://owner/repo/train",), ("hub://owner/repo/a/b",)], "path string")
    repo, split = A.dataset_path(F.col("path"))
    return rows.select("path", repo.alias("repo"), split.alias("split"))


@query("A16_strict_json_lines", "SELECT id, label FROM examples")
def a16(spark, d):
    path = _place(spark, "lines")
    B.write_jsonl(table(spark, d, "examples").select("id", "text", "label"), path)
    return A.read_jsonl(spark, path, "id string, text string, label int").select("id", "label")


@query("A17_validated_examples", "SELECT id, label, domain, meta['language'] AS language FROM examples WHERE label IS NULL OR label IN (0, 1)")
def a17(spark, d):
    path = _place(spark, "examples")
    B.write_jsonl(table(spark, d, "examples"), path)
    return A.read_examples(spark, path).select("id", "label", "domain", F.try_element_at("meta", F.lit("language")).alias("language"))


@query("A18_typed_predictions", "SELECT id, detector, score_ai, error FROM predictions WHERE NOT isnan(score_ai) AND NOT isinf(score_ai) OR score_ai IS NULL")
def a18(spark, d):
    s = F.col("score_ai")
    rows = table(spark, d, "predictions").where(s.isNull() | (~F.isnan(s) & (F.abs(s) != float("inf")))).drop("generated_at")
    path = _place(spark, "predictions")
    B.write_jsonl(rows, path)
    return A.read_jsonl(spark, path, A.PREDICTION).select("id", "detector", "score_ai", "error")


@query("A19_json_forms", "SELECT id, title FROM expert_articles")
def a19(spark, d):
    """A list in one JSON document and JSON lines give the same rows."""
    rows = table(spark, d, "expert_articles").select("id", "title")
    path = _place(spark, "list")
    B.write_json_list(rows, path)
    return A.read_json_document(spark, path, "id:bigint,title:string").select("id", "title")


@query("A20_keyed_json", "SELECT id, title, row_number() OVER (ORDER BY id) - 1 AS row_index FROM expert_articles")
def a20(spark, d):
    placed = global_position(table(spark, d, "expert_articles").select("id", "title"), ["id"])
    path = _place(spark, "keyed")
    B.write_keyed_json(placed, "position", path)
    return A.read_keyed_json(spark, path, "id:bigint,title:string").select("id", "title", F.col("row_index").cast("bigint").alias("row_index"))


@query("A21_latest_log_entry", "SELECT max(event_id) AS event_id FROM events WHERE event_type = 'click'")
def a21(spark, d):
    rows = table(spark, d, "events").where("event_type = 'click'").select((F.col("event_id") % 5).alias("step"), "event_id").orderBy("event_id")
    path = _place(spark, "log")
    rows.coalesce(1).write.json(path)  # a log is one file in order
    return A.latest_log_entry(spark, path, "step bigint, event_id bigint").select("event_id")


@query("A22_prediction_folder", "SELECT detector, count(*) AS rows, count(*) FILTER (score_ai IS NULL OR coalesce(error, '') <> '') AS failed, round(avg(coalesce(score_ai, 0.0)), 6) AS mean FROM predictions WHERE (NOT isnan(score_ai) AND NOT isinf(score_ai)) OR score_ai IS NULL GROUP BY detector")
def a22(spark, d):
    s = F.col("score_ai")
    rows = table(spark, d, "predictions").where(s.isNull() | (~F.isnan(s) & (F.abs(s) != float("inf")))).drop("generated_at")
    folder = _place(spark, "detectors")
    B.write_by_detector(rows, folder)
    back = A.read_detector_folders(spark, folder)
    return back.groupBy("detector").agg(F.count(F.lit(1)).alias("rows"), F.count_if("failed").alias("failed"), F.round(F.avg("score_ai"), 6).alias("mean"))


@query("A23_wide_scores_unfolded", f"SELECT id, detector, round(max(score_ai), 9) AS score FROM predictions WHERE {VALID} GROUP BY id, detector")
def a23(spark, d):
    """Rows with a map of scores, as nested JSON, unfolded to one row per detector."""
    best = table(spark, d, "predictions").where(M.is_valid()).groupBy("id", "detector").agg(F.max("score_ai").alias("s"))
    wide = best.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("detector", F.struct(F.col("s").alias("score_ai"))))).alias("scores"))  # an entry per detector
    path = _place(spark, "wide")
    wide.write.json(path)
    back = A.read_jsonl(spark, path, "id string, scores map<string,struct<score_ai:double>>")
    return back.select("id", F.explode("scores").alias("detector", "v")).select("id", "detector", F.round("v.score_ai", 9).alias("score"))


@query("A24_rescaled_scores", "SELECT id, detector, generated_at, round(CASE WHEN raw_score IS NULL OR isnan(raw_score) OR isinf(raw_score) THEN 0.0 ELSE (raw_score + 1) / 2 END, 9) AS score, raw_score IS NULL OR isnan(raw_score) OR isinf(raw_score) AS failed FROM predictions")
def a24(spark, d):
    r = F.col("raw_score")
    bad = r.isNull() | F.isnan(r) | (F.abs(r) == float("inf"))
    return table(spark, d, "predictions").select("id", "detector", "generated_at", F.round(F.when(bad, 0.0).otherwise((r + 1) / 2), 9).alias("score"), bad.alias("failed"))


@query("A25_label_fallbacks", "SELECT doc_id, coalesce(label, CASE WHEN generator_model IS NOT NULL THEN (generator_model <> 'human')::INT END, 0) AS label FROM documents")
def a25(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.col("label").cast("int"), (F.col("generator_model") != "human").cast("int"), F.lit(0)).alias("label"))


@query("A27_explanation_lines", "SELECT id, slot, a.comment AS why FROM (SELECT id, unnest([1, 2, 3, 4, 5]) AS slot, unnest([annotator_1, annotator_2, annotator_3, annotator_4, annotator_5]) AS a FROM expert_articles) WHERE trim(a.comment) <> ''")
def a27(spark, d):
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"annotator_{i}.comment").alias("why")) for i in range(1, 6)])
    path = _place(spark, "whys")
    table(spark, d, "expert_articles").select("id", F.explode(slots).alias("s")).select("id", "s.slot", "s.why").write.json(path)
    return A.read_jsonl(spark, path, "id bigint, slot int, why string").where("trim(why) != ''")


@query("B01_unified_corpus", f"WITH {_U} SELECT dataset_id, source_split, domain, label, gid, count(*) AS rows FROM (SELECT dataset_id, NULL AS source_split, NULL AS domain, NULL::INT AS label, 7 AS gid FROM v UNION ALL SELECT dataset_id, source_split, NULL, NULL, 3 FROM v UNION ALL SELECT NULL, NULL, domain, NULL, 13 FROM v UNION ALL SELECT NULL, NULL, domain, label, 12 FROM v) GROUP BY ALL")
def b01(spark, d):
    counts = B.write_unified(_unified(spark, d), _place(spark, "unified"))
    return counts.withColumn("gid", F.col("gid").cast("int"))


@query("B02_fixed_columns", "SELECT count(*) AS rows, 21 AS columns FROM examples")
def b02(spark, d):
    path = _place(spark, "columns")
    _unified(spark, d).select(*N.UNIFIED).write.option("compression", "zstd").parquet(path)
    back = spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(back.columns)).alias("columns"))


@query("B03_json_lines", "SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":' || CASE WHEN lang IS NULL THEN 'null' ELSE '\"' || lang || '\"' END || '}') AS line FROM documents")
def b03(spark, d):
    path = _place(spark, "jsonl")
    B.write_jsonl(table(spark, d, "documents").select("lang", "doc_id"), path, gzip=True)
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.doc_id").cast("bigint").alias("doc_id"), F.sha2("value", 256).alias("line"))


@query("B04_json_document", "SELECT count(*) AS rows, count(DISTINCT dataset) AS datasets FROM examples")
def b04(spark, d):
    summary = table(spark, d, "examples").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("dataset").alias("datasets"))
    path = _place(spark, "summary")
    B.write_json_document(summary, path)
    return spark.read.option("multiLine", True).schema("rows bigint, datasets bigint").json(path)


@query("B05_replaced_lines", "SELECT doc_id FROM documents WHERE label = 1")
def b05(spark, d):
    """A file that is written twice holds what was written last; the committer swaps it in as a whole."""
    path, rows = _place(spark, "swap"), table(spark, d, "documents")
    B.write_jsonl(rows.select("doc_id"), path)
    B.write_jsonl(rows.where("label = 1").select("doc_id"), path, mode="overwrite")
    return A.read_jsonl(spark, path, "doc_id bigint")


@query("B06_split_folders", "SELECT CASE WHEN lower(trim(split)) = 'test' THEN 'main_eval' WHEN lower(trim(split)) = 'train' THEN 'train' ELSE 'remaining' END AS split, count(*) AS rows FROM examples GROUP BY 1")
def b06(spark, d):
    e = table(spark, d, "examples").select("id", "label", F.lower(F.trim("split")).alias("s"))
    assigned = e.where("s in ('test', 'train')").select("id", F.when(F.col("s") == "test", "main_eval").otherwise("train").alias("split"))
    path = _place(spark, "folders")
    B.write_splits(e, assigned, path, "id", shards=4)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("B08_shard_manifest", "SELECT shard, count(*) AS rows, sha256(string_agg(id, chr(10) ORDER BY id)) AS content FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) % 6 AS shard FROM expert_articles_ids) GROUP BY shard".replace("expert_articles_ids", "(SELECT id::VARCHAR AS id FROM expert_articles)"))
def b08(spark, d):
    from quern.operators.allocate import round_robin_shards

    rows = round_robin_shards(table(spark, d, "expert_articles").select(F.col("id").cast("string").alias("id")), ["id"], 6)
    path = _place(spark, "shards")
    rows.write.partitionBy("shard").parquet(path)
    return B.shard_manifest(spark.read.parquet(path), "shard", "id")


@query("B09_detector_rows", f"WITH {_U} SELECT unified_id AS id, label, source_split AS split, CASE WHEN trim(generator_model) <> '' THEN trim(generator_model) WHEN label = 0 THEN 'human' ELSE '' END AS generator_model, coalesce(attack, 'none') AS attack, coalesce(nullif(trim(lang0), ''), 'en') AS language, 'v1' AS split_policy FROM v")
def b09(spark, d):
    return B.detector_rows(_unified(spark, d), F.col("source_split"), "v1").select("id", "label", "split", "generator_model", "attack", "language", "split_policy")


@query("B10_training_rows", f"WITH {_U} SELECT unified_id AS id, label, domain, source_detail, attack, language, NULL::DOUBLE AS external_score FROM v WHERE NOT is_adversarial")
def b10(spark, d):
    return B.training_rows(_unified(spark, d).where("not is_adversarial")).select("id", "label", "domain", "source_detail", "attack", "language", "external_score")


@query("B11_adversarial_rows", f"WITH {_U} SELECT unified_id AS id, 'adversarial' AS domain, coalesce(nullif(attack, ''), 'unknown') AS source_detail FROM v WHERE is_adversarial")
def b11(spark, d):
    return B.training_rows(_unified(spark, d).where("is_adversarial"), adversarial=True).select("id", "domain", "source_detail")


@query("B12_harness_rows", f"WITH {_U} SELECT unified_id AS id, CASE WHEN is_adversarial THEN 'adversarial' ELSE domain END AS domain, CASE WHEN is_adversarial THEN attack ELSE source_detail END AS source_detail, NOT is_adversarial AS is_default_training_candidate, is_adversarial FROM v")
def b12(spark, d):
    return B.harness_rows(_unified(spark, d), F.col("source_split"), "v1").select("id", "domain", "source_detail", "is_default_training_candidate", "is_adversarial")


@query("B13_export_counts", "SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty_text' WHEN label IS NULL THEN 'bad_label' ELSE 'written' END AS outcome, count(*) AS rows FROM examples GROUP BY 1")
def b13(spark, d):
    reason = F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty_text").when(F.col("label").isNull(), "bad_label")
    kept, out = N.route_rows(table(spark, d, "examples").select("id", "text", "label"), reason)
    path = _place(spark, "export")
    B.write_jsonl(kept, path)
    written = A.read_jsonl(spark, path, "id string, text string, label int").agg(F.lit("written").alias("outcome"), F.count(F.lit(1)).alias("rows"))
    return out.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("rows")).unionByName(written.where("rows > 0"))


@query("B14_roc_points", f"WITH g AS (SELECT detector, score_ai AS s, count(*) FILTER (label = 1)::DOUBLE AS pos, count(*) FILTER (label <> 1)::DOUBLE AS neg FROM predictions WHERE {VALID} GROUP BY ALL), c AS (SELECT detector, s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY detector) AS p, sum(neg) OVER (PARTITION BY detector) AS n FROM g WINDOW w AS (PARTITION BY detector ORDER BY s DESC)), o AS (SELECT * FROM c WHERE p > 0 AND n > 0 UNION ALL SELECT DISTINCT detector, 'inf'::DOUBLE, 0.0, 0.0, p, n FROM c WHERE p > 0 AND n > 0), l AS (SELECT *, lag(tp) OVER w AS a, lag(fp) OVER w AS b, lead(tp) OVER w AS x, lead(fp) OVER w AS y FROM o WINDOW w AS (PARTITION BY detector ORDER BY s DESC)) SELECT detector, count(*) AS points, round(sum(fp / n), 6) AS fpr_sum FROM l WHERE a IS NULL OR x IS NULL OR (tp - a) * (y - fp) <> (x - tp) * (fp - b) GROUP BY detector")
def b14(spark, d):
    path = _place(spark, "roc")
    M.roc_points(table(spark, d, "predictions").where(M.is_valid()), ["detector"]).write.option("header", True).csv(path)
    back = spark.read.option("header", True).schema("detector string, fpr double, tpr double, threshold string").csv(path)
    return back.groupBy("detector").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("fpr"), 6).alias("fpr_sum"))


@query("B15_report_tsv", "SELECT detector, count(*)::VARCHAR AS rows FROM predictions GROUP BY detector")
def b15(spark, d):
    path = _place(spark, "report")
    B.write_tsv(table(spark, d, "predictions").groupBy("detector").agg(F.count(F.lit(1)).alias("rows")).orderBy("detector"), path)
    return A.read_delimited(spark, path, "\t")


@query("B16_flat_tsv", "SELECT detector, printf('%.6f', round(avg(runtime_s), 6)) AS mean_s FROM predictions WHERE runtime_s IS NOT NULL GROUP BY detector")
def b16(spark, d):
    path = _place(spark, "flat")
    B.write_tsv(table(spark, d, "predictions").where("runtime_s is not null").groupBy("detector").agg(F.format_string("%.6f", F.round(F.avg("runtime_s"), 6)).alias("mean_s")), path)
    return A.read_delimited(spark, path, "\t")


@query("B17_collected_metrics", "SELECT detector, count(*) AS n, NULL::VARCHAR AS note FROM predictions GROUP BY detector")
def b17(spark, d):
    """One metrics document per detector, collected into a table; fields a document lacks are null."""
    folder = _place(spark, "metrics")
    table(spark, d, "predictions").groupBy("detector").agg(F.count(F.lit(1)).alias("n")).repartition("detector").write.json(folder)
    return A.read_jsonl(spark, folder, "detector string, n bigint, note string")


@query("B18_csv_table", "SELECT prompt_id, count(*) AS rows FROM expert_articles GROUP BY prompt_id")
def b18(spark, d):
    path = _place(spark, "table")
    table(spark, d, "expert_articles").groupBy("prompt_id").agg(F.count(F.lit(1)).alias("rows")).write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("prompt_id bigint, rows bigint").csv(path)


@query("B19_appended_rows", "SELECT event_type, count(*) AS rows FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def b19(spark, d):
    path, e = _place(spark, "append"), table(spark, d, "events").select("event_id", "event_type")
    B.write_tsv(e.where("event_type = 'click'"), path)
    B.write_tsv(e.where("event_type = 'view'"), path, mode="append")
    return A.read_delimited(spark, path, "\t").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("B20_clean_cells", "SELECT id, detector, generated_at, CASE WHEN score_ai IS NULL OR isnan(score_ai) THEN '' ELSE 'set' END AS score, coalesce(regexp_replace(error || chr(9) || detector || chr(10), '[\\t\\n\\r]', ' ', 'g'), '') AS error FROM predictions")
def b20(spark, d):
    rows = table(spark, d, "predictions").withColumn("e", F.concat("error", F.lit("\t"), "detector", F.lit("\n")))
    score = B.tsv_cell(F.col("score_ai"), "double")
    return rows.select("id", "detector", "generated_at", F.when(score == "", "").otherwise("set").alias("score"), B.tsv_cell(F.col("e"), "string").alias("error"))


@query("B21_summary_and_records", "SELECT detector, count(*) AS records, (count(*) FILTER (isnan(score_ai) OR isinf(score_ai))) = 0 AS finite FROM predictions WHERE score_ai IS NOT NULL GROUP BY detector")
def b21(spark, d):
    """Records as JSON lines with NaN as null, and a summary that is read from them."""
    path = _place(spark, "records")
    B.write_jsonl(B.without_nan(table(spark, d, "predictions").where("score_ai is not null").select("id", "detector", "score_ai")), path)
    back = A.read_jsonl(spark, path, "id string, detector string, score_ai double")
    return back.groupBy("detector").agg(F.count(F.lit(1)).alias("records"), (F.count_if(F.col("score_ai").isNull()) == 0).alias("finite"))


@query("B23_step_log", "WITH k AS (SELECT event_id // 100 AS step, event_type, max_by(value, event_id) AS v FROM events GROUP BY ALL) SELECT step, count(*) AS keys, round(sum(v), 6) AS total FROM k GROUP BY step")
def b23(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") / 100).cast("bigint").alias("step"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), "value")
    path = _place(spark, "metrics")
    B.last_value_per_step(e).write.json(path)
    back = A.read_jsonl(spark, path, "step bigint, metrics map<string,double>")
    total = F.aggregate(F.map_values("metrics"), F.lit(0.0), lambda a, x: a + x)
    return back.select("step", F.size("metrics").cast("bigint").alias("keys"), F.round(total, 6).alias("total"))


@query("B24_merged_upload", "WITH r AS (SELECT id, max_by(score_ai, generated_at) AS s FROM predictions WHERE coalesce(error, '') = '' AND id <> '' GROUP BY id), o AS (SELECT id, row_number() OVER (ORDER BY sha256('89|' || id), id) - 1 AS k, count(*) OVER () AS n FROM r) SELECT CASE WHEN k < greatest(1, floor(0.9 * n)) THEN 'train' ELSE 'validation' END AS split, count(*) AS rows FROM o GROUP BY 1")
def b24(spark, d):
    """Good rows, the last one per id, in seeded order, nine tenths for training."""
    good = table(spark, d, "predictions").where("coalesce(error, '') = '' and id != ''").groupBy("id").agg(F.max_by("score_ai", "generated_at").alias("s"))
    placed = global_position(with_sort_key(good, 89, "id"), ["sort_key", "id"])
    n = placed.count()
    return placed.groupBy(F.when(F.col("position") < max(1, int(0.9 * n)), "train").otherwise("validation").alias("split")).agg(F.count(F.lit(1)).alias("rows"))
