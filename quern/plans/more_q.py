"""Further queries: responses and explanations, multiset and upsert joins, grouped scores, token weights."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.functions import wiretext as R
from quern.operators import allocate as A
from quern.operators import metrics as M
from quern.operators.textmine import document_frequency
from quern.plans.metrics_q import VALID
from quern.plans.registry import query, table
from quern.plans.text_q import _COMMENTS, _GRAMS, _TOK, _comments

_FINITE = "score_ai is not null and not isnan(score_ai) and abs(score_ai) < double('inf')"
_FINITE_SQL = "score_ai IS NOT NULL AND NOT isnan(score_ai) AND NOT isinf(score_ai)"


@query("C36_line_breaks", "SELECT id, sha256(replace(replace(text, chr(10), ' '), '  ', ' ')) AS form FROM examples WHERE text IS NOT NULL")
def c36(spark, d):
    return table(spark, d, "examples").where("text is not null").select("id", F.sha2(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" ")), 256).alias("form"))


@query("D10_split_is_disjoint", "WITH a AS (SELECT prompt_id, prompt_id % 5 = 0 AS test FROM expert_articles) SELECT count(DISTINCT prompt_id) FILTER (test) AS test_prompts, count(DISTINCT prompt_id) FILTER (NOT test) AS other_prompts, (SELECT count(*) FROM (SELECT prompt_id FROM a WHERE test INTERSECT SELECT prompt_id FROM a WHERE NOT test)) AS shared FROM a")
def d10(spark, d):
    a = table(spark, d, "expert_articles").select("prompt_id", (F.pmod("prompt_id", F.lit(5)) == 0).alias("test"))
    per = a.groupBy("prompt_id").agg(F.max("test").alias("any"), F.min("test").alias("every"))
    return per.agg(F.count_if("any").alias("test_prompts"), F.count_if(~F.col("every")).alias("other_prompts"), F.count_if(F.col("any") & ~F.col("every")).alias("shared"))


@query("E05_test_beside_validation", f"WITH t AS (SELECT detector, avg(score_ai) AS m FROM predictions WHERE {VALID} AND lower(trim(split)) = 'test' GROUP BY detector), v AS (SELECT detector, avg(score_ai) AS m FROM predictions WHERE {VALID} AND lower(trim(split)) IN ('val', 'validation') GROUP BY detector) SELECT t.detector, round(t.m, 6) AS test_mean, round(v.m, 6) AS validation_mean FROM t LEFT JOIN v USING (detector)")
def e05(spark, d):
    rows = table(spark, d, "predictions").where(M.is_valid()).withColumn("s", F.lower(F.trim("split")))
    t = rows.where("s = 'test'").groupBy("detector").agg(F.round(F.avg("score_ai"), 6).alias("test_mean"))
    v = rows.where("s in ('val', 'validation')").groupBy("detector").agg(F.round(F.avg("score_ai"), 6).alias("validation_mean"))
    return t.join(v, "detector", "left").select("detector", "test_mean", "validation_mean")


@query("E06_multiset_join", "WITH a AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_quantity ORDER BY l_linenumber) AS k FROM lineitem WHERE l_linenumber % 2 = 0), b AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_quantity ORDER BY l_linenumber) AS k FROM lineitem WHERE l_linenumber % 2 = 1) SELECT count(*) AS rows, count(b.k) AS matched FROM a LEFT JOIN b USING (l_orderkey, l_quantity, k)")
def e06(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber")
    k = F.row_number().over(Window.partitionBy("l_orderkey", "l_quantity").orderBy("l_linenumber"))
    a = rows.where("l_linenumber % 2 = 0").withColumn("k", k)
    b = rows.where("l_linenumber % 2 = 1").withColumn("k", k).withColumn("hit", F.lit(1))
    return a.join(b, ["l_orderkey", "l_quantity", "k"], "left").agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("matched"))


@query("E09_retry_wins", f"SELECT detector, id, max_by(score_ai, (generated_at, score_ai)) AS score FROM predictions WHERE {_FINITE_SQL} GROUP BY ALL")
def e09(spark, d):
    rows = table(spark, d, "predictions").where(_FINITE)
    return rows.groupBy("detector", "id").agg(F.max_by("score_ai", F.struct("generated_at", "score_ai")).alias("score"))


@query("E16_detector_gaps", f"WITH m AS (SELECT detector, domain, avg(score_ai) AS m FROM predictions WHERE {VALID} AND domain IS NOT NULL GROUP BY ALL) SELECT a.detector AS a, b.detector AS b, round(avg(a.m - b.m), 6) AS gap, count(*) AS domains FROM m a JOIN m b ON a.domain = b.domain AND a.detector < b.detector GROUP BY ALL")
def e16(spark, d):
    m = table(spark, d, "predictions").where(M.is_valid() & F.col("domain").isNotNull()).groupBy("detector", "domain").agg(F.avg("score_ai").alias("m"))
    x, y = m.alias("x"), m.alias("y")  # a row per detector and domain
    pairs = x.join(y, (F.col("x.domain") == F.col("y.domain")) & (F.col("x.detector") < F.col("y.detector")))
    return pairs.groupBy(F.col("x.detector").alias("a"), F.col("y.detector").alias("b")).agg(F.round(F.avg(F.col("x.m") - F.col("y.m")), 6).alias("gap"), F.count(F.lit(1)).alias("domains"))


@query("F09_sign_rates", f"SELECT detector, round(avg((2 * score_ai - 1 > 0)::INT), 6) AS positive, round(avg((abs(2 * score_ai - 1) < 0.2)::INT), 6) AS ambiguous, round(avg(score_ai) FILTER (label = 1) - avg(score_ai) FILTER (label = 0), 6) AS gap FROM predictions WHERE {VALID} GROUP BY detector")
def f09(spark, d):
    s = 2 * F.col("score_ai") - 1
    gap = F.avg(F.when(F.col("label") == 1, F.col("score_ai"))) - F.avg(F.when(F.col("label") == 0, F.col("score_ai")))
    return table(spark, d, "predictions").where(M.is_valid()).groupBy("detector").agg(F.round(F.avg((s > 0).cast("double")), 6).alias("positive"), F.round(F.avg((F.abs(s) < 0.2).cast("double")), 6).alias("ambiguous"), F.round(gap, 6).alias("gap"))


@query("H01_union_of_runs", "SELECT split, count(*) AS rows FROM (SELECT lower(trim(split)) AS split FROM examples UNION ALL SELECT lower(trim(split)) FROM predictions) GROUP BY split")
def h01(spark, d):
    a, b = (table(spark, d, t).select(F.lower(F.trim("split")).alias("split")) for t in ("examples", "predictions"))
    return a.unionByName(b).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("K09_linear_decay", "SELECT step, greatest(2, round_even(8 - 6 * step / 20.0, 0))::BIGINT AS k FROM range(0, 30) AS r(step)")
def k09(spark, d):
    return spark.range(30).select(F.col("id").alias("step"), F.greatest(F.lit(2), F.bround(8 - 6 * F.col("id") / 20.0)).cast("bigint").alias("k"))


@query("K15_softmax_weights", f"WITH s AS (SELECT id, detector, generated_at, score_ai, exp(2 * score_ai - max(2 * score_ai) OVER (PARTITION BY id)) AS x FROM predictions WHERE {VALID}) SELECT id, detector, generated_at, score_ai, round(x / sum(x) OVER (PARTITION BY id) * count(*) OVER (PARTITION BY id), 9) AS weight FROM s")
def k15(spark, d):
    w = Window.partitionBy("id")
    rows = table(spark, d, "predictions").where(M.is_valid()).withColumn("x", F.exp(2 * F.col("score_ai") - F.max(2 * F.col("score_ai")).over(w)))
    return rows.select("id", "detector", "generated_at", "score_ai", F.round(F.col("x") / F.sum("x").over(w) * F.count(F.lit(1)).over(w), 9).alias("weight"))


@query("L02_average_precision", f"""WITH g AS (SELECT detector, dataset, score_ai AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM predictions WHERE {VALID} GROUP BY ALL),
  c AS (SELECT *, (sum(pos) OVER w)::DOUBLE AS tp, (sum(neg) OVER w)::DOUBLE AS fp, (sum(pos) OVER (PARTITION BY detector, dataset))::DOUBLE AS p, (sum(neg) OVER (PARTITION BY detector, dataset))::DOUBLE AS n FROM g WINDOW w AS (PARTITION BY detector, dataset ORDER BY s DESC)) SELECT detector, dataset, round(sum(pos / p * tp / (tp + fp)), 6) AS auprc FROM c WHERE p > 0 AND n > 0 GROUP BY ALL""")
def l02(spark, d):
    keys = ["detector", "dataset"]
    return M.curve_metrics(M.score_curve(table(spark, d, "predictions").where(M.is_valid()), keys), keys).select(*keys, F.round("auprc", 6).alias("auprc"))


@query("L08_confusion_by_dataset", f"SELECT detector, dataset, count(*) FILTER (score_ai >= 0.5 AND label = 1) AS tp, count(*) FILTER (score_ai >= 0.5 AND label <> 1) AS fp, count(*) FILTER (score_ai < 0.5 AND label <> 1) AS tn, count(*) FILTER (score_ai < 0.5 AND label = 1) AS fn FROM predictions WHERE {VALID} GROUP BY ALL")
def l08(spark, d):
    return M.threshold_metrics(table(spark, d, "predictions").where(M.is_valid()), ["detector", "dataset"]).select("detector", "dataset", "tp", "fp", "tn", "fn")


@query("Q07_curriculum_ramp", "SELECT step, round(0.2 + 0.6 * least(1.0, greatest(0.0, step / 10.0)), 9) AS tau FROM range(0, 20) AS r(step)")
def q07(spark, d):
    from quern.operators.samplers import linear_ramp

    return spark.range(20).select(F.col("id").alias("step"), F.round(linear_ramp(F.col("id"), 0.2, 0.8, 10), 9).alias("tau"))
