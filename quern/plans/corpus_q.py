"""Queries over examples and documents: unification, cleaning, hashing, counts, splits, samples, sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.operators import allocate as A
from quern.operators import normalize as N
from quern.operators.ranks import global_position
from quern.plans.registry import query, table

_NAME = "regexp_replace(lower(trim({0})), '[\\s-]+', '_', 'g')"
_WHITE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WHITE}', ' ', 'g'))"


def _clean(x: str) -> str:
    return _squeeze(f"regexp_replace(coalesce({x}, ''), '<[^>\\s][^>]*>', ' ', 'g')")


_BUCKET = "(('0x' || substr(sha256({0}), 1, 8))::BIGINT % {1})"


@query("C21_text_hash", f"SELECT doc_id, sha256({_squeeze('lower(text)')}) AS text_hash FROM documents WHERE text IS NOT NULL")
def c21(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.stable_hash(T.normalize_for_hash(F.col("text"))).alias("text_hash"))


@query("C23_row_sort_key", "SELECT id, sha256(concat_ws('|', '13', coalesce(label::VARCHAR, ''), coalesce(domain, ''), coalesce(dataset, ''), coalesce(split, ''), coalesce(attack, ''), id)) AS sort_key FROM examples")
def c23(spark, d):
    return A.with_sort_key(table(spark, d, "examples"), 13, "label", "domain", "dataset", "split", "attack", "id").select("id", "sort_key")


@query("C24_holdout", f"SELECT dataset, count(*) AS rows, count(*) FILTER ({_BUCKET.format('id', 5)} < 1) AS holdout FROM examples GROUP BY dataset")
def c24(spark, d):
    return table(spark, d, "examples").groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.count_if(T.hash_bucket(F.col("id"), 5) < 1).alias("holdout"))


_POOL = f"CASE WHEN lower(trim(split)) IN ('test', 'test_shift') THEN 'eval' WHEN split IS NULL THEN 'excluded' WHEN {_BUCKET.format('id', 5)} < 1 THEN 'eval' ELSE 'train' END"


@query("C25_split_pools", f"SELECT dataset, {_POOL} AS pool, count(*) AS rows FROM examples GROUP BY ALL")
def c25(spark, d):
    s = F.lower(F.trim("split"))
    pool = F.when(s.isin("test", "test_shift"), "eval").when(F.col("split").isNull(), "excluded").when(T.hash_bucket(F.col("id"), 5) < 1, "eval").otherwise("train")
    return table(spark, d, "examples").groupBy("dataset", pool.alias("pool")).agg(F.count(F.lit(1)).alias("rows"))


@query("C26_clean_text", f"SELECT id, sha256({_clean('text')}) AS cleaned, length({_clean('text')}) AS n FROM examples")
def c26(spark, d):
    c = T.clean_document_text(F.col("text"))
    return table(spark, d, "examples").select("id", F.sha2(c, 256).alias("cleaned"), F.length(c).alias("n"))


@query("C28_document_uid", "SELECT id, substr(sha256(concat_ws('|', coalesce(dataset, ''), coalesce(domain, ''), coalesce(label::VARCHAR, ''), substr(coalesce(text, ''), 1, 4000))), 1, 26) AS uid FROM examples")
def c28(spark, d):
    head = F.substring(F.coalesce("text", F.lit("")), 1, 4000)  # the uid is defined on this part of the text
    return table(spark, d, "examples").select("id", F.substring(F.sha2(T.key_of("dataset", "domain", "label", head), 256), 1, 26).alias("uid"))


@query("C49_hash_choice", f"SELECT doc_id, ('0x' || substr(sha256('7|' || substr(text, 1, 128)), 1, 8))::BIGINT % 3 AS choice FROM documents WHERE text IS NOT NULL")
def c49(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.hash_bucket(T.key_of(F.lit("7"), F.substring("text", 1, 128)), 3).alias("choice"))


@query("C50_sigmoid", "SELECT id, detector, generated_at, raw_score, round(CASE WHEN raw_score >= 0 THEN 1 / (1 + exp(-raw_score)) ELSE exp(raw_score) / (1 + exp(raw_score)) END, 6) AS p FROM predictions WHERE raw_score IS NOT NULL AND NOT isnan(raw_score) AND NOT isinf(raw_score)")
def c50(spark, d):
    rows = table(spark, d, "predictions").where("raw_score is not null and not isnan(raw_score) and abs(raw_score) < double('inf')")
    return rows.select("id", "detector", "generated_at", "raw_score", F.round(T.sigmoid(F.col("raw_score")), 6).alias("p"))


@query(
    "F01_count_tables",
    f"""WITH u AS (SELECT dataset, lower(trim(split)) AS split, {_NAME.format('domain')} AS domain, label FROM examples)
    SELECT dataset, split, domain, label, grouping(dataset, split, domain, label) AS gid, count(*) AS rows FROM u GROUP BY GROUPING SETS ((dataset), (dataset, split), (domain), (dataset, domain), (domain, label))""",
)
def f01(spark, d):
    u = table(spark, d, "examples").select("dataset", F.lower(F.trim("split")).alias("split"), N.canonical_name(F.col("domain")).alias("domain"), "label")
    sets = u.groupingSets([["dataset"], ["dataset", "split"], ["domain"], ["dataset", "domain"], ["domain", "label"]], "dataset", "split", "domain", "label")
    return sets.agg(F.grouping_id().cast("bigint").alias("gid"), F.count(F.lit(1)).alias("rows"))


@query("F03_labels_by_domain", f"SELECT {_NAME.format('domain')} AS domain, count(*) FILTER (label = 0) AS human, count(*) FILTER (label = 1) AS ai, count(*) AS total FROM examples GROUP BY 1")
def f03(spark, d):
    rows = table(spark, d, "examples").select(N.canonical_name(F.col("domain")).alias("domain"), "label")
    p = rows.groupBy("domain").pivot("label", [0, 1]).agg(F.count(F.lit(1)))
    totals = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("total"))
    return p.withColumnRenamed("domain", "d").join(totals, F.col("d").eqNullSafe(F.col("domain"))).select("domain", F.coalesce("0", F.lit(0)).alias("human"), F.coalesce("1", F.lit(0)).alias("ai"), "total")


@query(
    "G03_stratified_sample",
    f"""WITH c AS (SELECT dataset, count(*) AS n FROM examples GROUP BY dataset), r AS (SELECT *, 200 * n / sum(n) OVER () AS raw FROM c),
    w AS (SELECT *, least(floor(raw), n) AS whole FROM r), l AS (SELECT *, 200 - sum(whole) OVER () AS lft, row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, n DESC, sha256(coalesce(dataset, '')) DESC) AS turn FROM w),
    a AS (SELECT dataset, whole + CASE WHEN turn <= lft AND whole < n THEN 1 ELSE 0 END AS allocated FROM l),
    k AS (SELECT e.id, e.dataset, a.allocated, row_number() OVER (PARTITION BY e.dataset ORDER BY sha256('7|' || e.id), e.id) AS place FROM examples e JOIN a USING (dataset)) SELECT id, dataset FROM k WHERE place <= allocated""",
)
def g03(spark, d):
    return A.stratified_sample(table(spark, d, "examples"), ["dataset"], 200, 7, "id").select("id", "dataset")


@query("G01_balanced_sample")
def g01(spark, d):
    e = table(spark, d, "examples")
    n = e.count()
    return A.balanced_sample(e, F.concat_ws("|", "dataset", N.canonical_name(F.col("domain"))), "label", "id", max(10, n // 20) // 2 * 2, 7).select("id", "stratum", "label")


@query("G04_sha_split", "WITH k AS (SELECT id, row_number() OVER (ORDER BY sha256('3|' || id), id) AS place, count(*) OVER () AS n FROM examples) SELECT id, CASE WHEN place <= round_even(n * 0.1, 0) THEN 'test' WHEN place <= round_even(n * 0.1, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS assigned FROM k")
def g04(spark, d):
    keyed = A.with_sort_key(table(spark, d, "examples").select("id"), 3, "id")
    n = keyed.count()
    test = int(round(n * 0.1))
    placed = global_position(keyed, ["sort_key", "id"])
    return placed.select("id", F.when(F.col("position") < test, "test").when(F.col("position") < 2 * test, "val").otherwise("train").alias("assigned"))


@query("G08_probe_docs", f"SELECT stratum, id FROM (SELECT dataset || '|' || coalesce({_NAME.format('domain')}, '') || '|' || coalesce(label::VARCHAR, '') AS stratum, id, row_number() OVER (PARTITION BY dataset || '|' || coalesce({_NAME.format('domain')}, '') || '|' || coalesce(label::VARCHAR, '') ORDER BY sha256('5|' || id), id) AS place FROM examples) WHERE place <= 3")
def g08(spark, d):
    rows = A.with_sort_key(table(spark, d, "examples"), 5, "id").withColumn("stratum", T.key_of("dataset", N.canonical_name(F.col("domain")), "label"))
    return A.top_per_group(rows, ["stratum"], ["sort_key", "id"], 3).select("stratum", "id")


@query("G12_split_by_label", "WITH k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('9|' || id), id) AS place, count(*) OVER (PARTITION BY label) AS n FROM examples WHERE label IS NOT NULL) SELECT id, label, CASE WHEN place <= round_even(n * 0.1, 0) THEN 'test' WHEN place <= round_even(n * 0.1, 0) + round_even(n * 0.2, 0) THEN 'val' ELSE 'train' END AS assigned FROM k")
def g12(spark, d):
    rows = table(spark, d, "examples").where("label is not null").select("id", "label")
    return A.sha_split(rows, "id", 9, [("test", 0.1), ("val", 0.2), ("train", 0.7)], ["label"])


@query("G24_blind_ids", "SELECT doc_id, judge_id, source_id, item_id, 'A' || row_number() OVER (PARTITION BY doc_id, judge_id ORDER BY sha256('11|' || source_id || '|' || item_id), source_id, item_id) AS blind FROM (SELECT DISTINCT doc_id, judge_id, source_id, item_id FROM judgments WHERE source_id IS NOT NULL AND item_id IS NOT NULL)")
def g24(spark, d):
    items = table(spark, d, "judgments").where("source_id is not null and item_id is not null").select("doc_id", "judge_id", "source_id", "item_id").distinct()
    keyed = A.with_sort_key(items, 11, "source_id", "item_id")
    place = F.row_number().over(Window.partitionBy("doc_id", "judge_id").orderBy("sort_key", "source_id", "item_id"))
    return keyed.select("doc_id", "judge_id", "source_id", "item_id", F.concat(F.lit("A"), place.cast("string")).alias("blind"))


@query("G26_oversample", "SELECT source, copy, count(*) AS rows FROM mix_targets, range(0, 5) AS r(copy) WHERE copy < max_uses GROUP BY ALL")
def g26(spark, d):
    return A.oversample(table(spark, d, "mix_targets"), F.col("max_uses")).groupBy("source", F.col("copy").cast("bigint").alias("copy")).agg(F.count(F.lit(1)).alias("rows"))


@query("B07_round_robin_shards", "SELECT shard, count(*) AS rows, min(id) AS first_id FROM (SELECT id, (row_number() OVER (ORDER BY sha256('7|' || id), id) - 1) % 8 AS shard FROM examples) GROUP BY shard")
def b07(spark, d):
    keyed = A.with_sort_key(table(spark, d, "examples").select("id"), 7, "id")
    return A.round_robin_shards(keyed, ["sort_key", "id"], 8).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"))


@query("H02_latest_prediction", "SELECT detector, id, score_ai, generated_at FROM (SELECT *, row_number() OVER (PARTITION BY detector, id ORDER BY generated_at DESC, score_ai DESC NULLS LAST) AS rn FROM predictions WHERE score_ai IS NOT NULL) WHERE rn = 1")
def h02(spark, d):
    rows = table(spark, d, "predictions").where("score_ai is not null")
    return rows.groupBy("detector", "id").agg(F.max(F.struct("generated_at", "score_ai")).alias("m")).select("detector", "id", "m.score_ai", "m.generated_at")


@query("H05_first_of_equal_texts", f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {_squeeze('lower(text)')} ORDER BY id) AS rn FROM examples WHERE text IS NOT NULL) WHERE rn = 1")
def h05(spark, d):
    rows = table(spark, d, "examples").where("text is not null").select("id", F.sha2(T.normalize_for_hash(F.col("text")), 256).alias("k"))
    return rows.groupBy("k").agg(F.min("id").alias("id")).select("id")  # combines before the shuffle, so equal texts can't crowd a task


@query("H06_repeated_ids", "SELECT detector, id, count(*) AS runs FROM predictions GROUP BY ALL HAVING count(*) > 1")
def h06(spark, d):
    return table(spark, d, "predictions").groupBy("detector", "id").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1")


@query("H07_split_overlap", f"SELECT count(*) AS shared_texts FROM (SELECT {_squeeze('lower(text)')} AS k FROM examples WHERE lower(trim(split)) = 'train' AND text IS NOT NULL INTERSECT SELECT {_squeeze('lower(text)')} FROM examples WHERE lower(trim(split)) IN ('test', 'test_shift') AND text IS NOT NULL)")
def h07(spark, d):
    rows = table(spark, d, "examples").where("text is not null").select(F.lower(F.trim("split")).alias("s"), F.sha2(T.normalize_for_hash(F.col("text")), 256).alias("k"))
    return rows.where("s = 'train'").select("k").intersect(rows.where("s in ('test', 'test_shift')").select("k")).agg(F.count(F.lit(1)).alias("shared_texts"))


@query("H08_unscored_examples", "SELECT id FROM examples WHERE id NOT IN (SELECT id FROM predictions WHERE id IS NOT NULL)")
def h08(spark, d):
    return table(spark, d, "examples").join(table(spark, d, "predictions"), "id", "left_anti").select("id")


@query("E01_scores_joined", "WITH p AS (SELECT id, avg(score_ai) AS s FROM predictions WHERE score_ai IS NOT NULL AND NOT isnan(score_ai) AND NOT isinf(score_ai) AND detector = 'burrow_lr' GROUP BY id), m AS (SELECT min(s) AS lo, max(s) AS hi FROM p JOIN examples USING (id) WHERE lower(trim(split)) = 'train') SELECT e.id, round(CASE WHEN p.s IS NULL THEN NULL WHEN hi > lo THEN (p.s - lo) / (hi - lo) ELSE 0.5 END, 6) AS score FROM examples e LEFT JOIN p USING (id), m")
def e01(spark, d):
    e = table(spark, d, "examples").select("id", F.lower(F.trim("split")).alias("split"))
    p = table(spark, d, "predictions").where("score_ai is not null and not isnan(score_ai) and abs(score_ai) < double('inf') and detector = 'burrow_lr'").groupBy("id").agg(F.avg("score_ai").alias("s"))
    rows = e.join(p, "id", "left")
    m = rows.where("split = 'train'").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    scaled = F.when(F.col("s").isNull(), None).when(F.col("hi") > F.col("lo"), (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    return rows.crossJoin(F.broadcast(m)).select("id", F.round(scaled, 6).alias("score"))  # m: one row


@query("E03_score_matrix", "WITH d AS (SELECT DISTINCT detector FROM predictions), s AS (SELECT detector, id, max(score_ai) AS s FROM predictions WHERE score_ai IS NOT NULL AND NOT isnan(score_ai) AND NOT isinf(score_ai) GROUP BY ALL), l AS (SELECT id, label FROM examples WHERE label IS NOT NULL) SELECT detector, count(*) AS cells, count(*) FILTER (s IS NULL) AS imputed, round(sum(coalesce(s, 0.0)), 4) AS total FROM l CROSS JOIN d LEFT JOIN s USING (detector, id) GROUP BY detector")
def e03(spark, d):
    labelled = table(spark, d, "examples").where("label is not null").select("id")
    rows = table(spark, d, "predictions")
    s = rows.where("score_ai is not null and not isnan(score_ai) and abs(score_ai) < double('inf')").groupBy("detector", "id").agg(F.max("score_ai").alias("s"))
    grid = labelled.crossJoin(F.broadcast(rows.select("detector").distinct()))  # a row per detector
    full = grid.join(s, ["detector", "id"], "left")
    return full.groupBy("detector").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("s").isNull()).alias("imputed"), F.round(F.sum(F.coalesce("s", F.lit(0.0))), 4).alias("total"))


@query("E12_without_prediction_by_detector", "SELECT d.detector, count(*) AS missing FROM (SELECT DISTINCT detector FROM predictions) d CROSS JOIN examples e WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.id = e.id AND p.detector = d.detector) GROUP BY ALL")
def e12(spark, d):
    p = table(spark, d, "predictions").select("detector", "id").distinct()
    n = table(spark, d, "examples").agg(F.count(F.lit(1)).alias("n"))
    have = p.join(table(spark, d, "examples").select("id"), "id", "left_semi").groupBy("detector").agg(F.count(F.lit(1)).alias("have"))
    return have.crossJoin(F.broadcast(n)).select("detector", (F.col("n") - F.col("have")).alias("missing")).where("missing > 0")  # n: one row
