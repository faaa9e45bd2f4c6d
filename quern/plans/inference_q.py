"""Queries over judgments and detector scores: duels, tests, resampling, ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import duels as D
from quern.operators import inference as I
from quern.operators import metrics as M
from quern.operators import ranks as R
from quern.operators.aggregates import lower_quantile, softmax_mean
from quern.plans.metrics_q import VALID
from quern.plans.registry import query, table

#: Resamples and permutations of the reference.
RESAMPLES = 10_000

_RATES = """r AS (SELECT doc_id, judge_id, rank, count(*) FILTER (true_kind = 'model') AS a, count(*) FILTER (true_kind = 'human') AS b FROM judgments WHERE true_kind IN ('model', 'human') AND rank IS NOT NULL GROUP BY ALL),
  x AS (SELECT m.doc_id, m.judge_id, sum(CASE WHEN m.rank < h.rank THEN m.a * h.b WHEN m.rank = h.rank THEN 0.5 * m.a * h.b ELSE 0 END)::DOUBLE AS wins, sum(m.a * h.b)::DOUBLE AS duels FROM r m JOIN r h USING (doc_id, judge_id) GROUP BY ALL),
  rates AS (SELECT *, wins / duels AS win_rate FROM x WHERE duels > 0)"""


def _rates(spark, d):
    return D.win_rates(table(spark, d, "judgments"))


@query("D13_valid_rankings", "WITH u AS (SELECT DISTINCT doc_id, judge_id, item_id, rank FROM judgments) SELECT doc_id, judge_id, count(*) AS n FROM u GROUP BY ALL HAVING count(DISTINCT item_id) = count(*) AND count(DISTINCT rank) = count(*) AND min(rank) = 1 AND max(rank) = count(*)")
def d13(spark, d):
    return D.valid_rankings(table(spark, d, "judgments"))


@query("E08_win_rates", f"WITH {_RATES} SELECT doc_id, judge_id, wins, duels::BIGINT AS duels, round(win_rate, 9) AS win_rate FROM rates")
def e08(spark, d):
    return _rates(spark, d).withColumn("win_rate", F.round("win_rate", 9))


@query("E07_rankings_identified", "SELECT doc_id, judge_id, item_id, arg_min(source_id, source_id) AS source_id, min(rank) AS best_rank FROM judgments WHERE item_id IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL")
def e07(spark, d):
    j = table(spark, d, "judgments").where("item_id is not null")
    mapping = j.where("source_id is not null").groupBy("doc_id", "judge_id", "item_id").agg(F.min("source_id").alias("source_id"))
    best = j.where("source_id is not null").groupBy("doc_id", "judge_id", "item_id").agg(F.min("rank").alias("best_rank"))
    return best.join(mapping, ["doc_id", "judge_id", "item_id"], "left").select("doc_id", "judge_id", "item_id", "source_id", "best_rank")


@query("F29_panel_rates", f"WITH {_RATES} SELECT doc_id, count(*) AS judges, round(avg(win_rate), 9) AS panel_rate, CASE WHEN min(win_rate) > 0.5 THEN 1.0::DOUBLE WHEN max(win_rate) < 0.5 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS consensus FROM rates GROUP BY doc_id")
def f29(spark, d):
    return D.panel(_rates(spark, d)).withColumn("panel_rate", F.round("panel_rate", 9))


@query("M14_panel_agreement", f"WITH {_RATES}, p AS (SELECT doc_id, count(*) AS n, min(win_rate) AS lo, max(win_rate) AS hi, avg(win_rate) AS m FROM rates GROUP BY doc_id) SELECT count(*) AS docs, round(avg(m), 9) AS panel_rate, round(avg(CASE WHEN lo > 0.5 OR hi < 0.5 THEN 1.0 ELSE 0.0 END), 9) AS agreement FROM p WHERE n > 1")
def m14(spark, d):
    p = D.panel(_rates(spark, d)).where("judges > 1")
    return p.agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("panel_rate"), 9).alias("panel_rate"), F.round(F.avg((F.col("consensus") != 0.5).cast("double")), 9).alias("agreement"))


@query("M12_effect_sizes", f"WITH {_RATES}, s AS (SELECT judge_id, count(*) AS n, avg(win_rate - 0.5) AS mean_diff, median(win_rate - 0.5) AS median_diff, stddev_samp(win_rate - 0.5) AS sd, avg((win_rate > 0.5)::INT) AS share_above FROM rates GROUP BY judge_id) SELECT judge_id, n, round(mean_diff, 9) AS mean_diff, round(median_diff, 9) AS median_diff, round(sd, 9) AS sd, round(mean_diff / nullif(sd, 0), 9) AS cohen_d, round(mean_diff / nullif(sd, 0) * (1 - 3.0::DOUBLE / (4 * n - 1)), 9) AS hedges_g, round(share_above, 9) AS share_above FROM s")
def m12(spark, d):
    e = I.effect_sizes(_rates(spark, d), ["judge_id"], "win_rate")
    return e.select("judge_id", "n", *[F.round(c, 9).alias(c) for c in ("mean_diff", "median_diff", "sd", "cohen_d", "hedges_g", "share_above")])


@query("M11_wilcoxon", f"""WITH {_RATES}, s AS (SELECT judge_id, round(win_rate - 0.5, 12) AS d FROM rates), k AS (SELECT judge_id, abs(d) AS a, count(*) AS t, count(*) FILTER (d > 0) AS up FROM s WHERE d <> 0 GROUP BY ALL),
  q AS (SELECT *, sum(t) OVER (PARTITION BY judge_id ORDER BY a) - t + (t + 1) / 2.0 AS rank FROM k), g AS (SELECT judge_id, sum(t)::DOUBLE AS n, sum(up * rank)::DOUBLE AS w, sum(t * t * t - t)::DOUBLE AS tie FROM q GROUP BY judge_id)
  SELECT judge_id, n::BIGINT AS n, round(w, 3) AS w_plus, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) AS z FROM g""")
def m11(spark, d):
    return I.wilcoxon_greater(_rates(spark, d), ["judge_id"], "win_rate").select("judge_id", "n", F.round("w_plus", 3).alias("w_plus"), F.round("z", 6).alias("z"))


@query("M09_bootstrap_win_rate")
def m09(spark, d):
    items = _rates(spark, d).withColumn("item", F.concat_ws("|", "doc_id", "judge_id"))
    return I.bootstrap_mean(items, ["judge_id"], "item", "win_rate", RESAMPLES)


@query("M10_sign_flips")
def m10(spark, d):
    items = _rates(spark, d).withColumn("item", F.concat_ws("|", "doc_id", "judge_id"))
    return I.sign_flip_test(items, ["judge_id"], "item", "win_rate", permutations=RESAMPLES)


def _aurocs(spark, d):
    return I.bootstrap_auroc(table(spark, d, "predictions").where(M.is_valid()), ["detector"], "id", RESAMPLES)


@query("M02_bootstrap_auroc")
def m02(spark, d):
    return _aurocs(spark, d).groupBy("detector").agg(F.avg("auroc").alias("mean"), F.percentile("auroc", 0.025).alias("low"), F.percentile("auroc", 0.975).alias("high"))


@query("K03_rank_stability")
def k03(spark, d):
    return I.rank_stability(_aurocs(spark, d), "detector")


@query("M07_kendall_tau", f"""WITH a AS (SELECT detector, avg(score_ai) AS x, avg(runtime_s) AS y FROM predictions WHERE {VALID} AND runtime_s IS NOT NULL GROUP BY detector), r AS (SELECT detector, rank() OVER (ORDER BY round(x, 9)) AS a, rank() OVER (ORDER BY round(y, 9)) AS b FROM a)
  SELECT round(sum(sign(x.a - y.a) * sign(x.b - y.b)) / count(*), 9) AS tau FROM r x JOIN r y ON x.detector < y.detector""")
def m07(spark, d):
    a = table(spark, d, "predictions").where(M.is_valid() & F.col("runtime_s").isNotNull()).groupBy("detector").agg(F.round(F.avg("score_ai"), 9).alias("x"), F.round(F.avg("runtime_s"), 9).alias("y"))
    r = a.select("detector", F.rank().over(Window.orderBy("x")).alias("a"), F.rank().over(Window.orderBy("y")).alias("b"))  # a row per detector
    return I.kendall_tau(r, "detector", "a", "b").select(F.round("tau", 9).alias("tau"))


@query("K04_midrank", f"SELECT detector, id, generated_at, score_ai, round((rank() OVER (PARTITION BY detector ORDER BY score_ai) - 1 + count(*) OVER (PARTITION BY detector, score_ai) / 2.0) / count(*) OVER (PARTITION BY detector), 9) AS midrank FROM predictions WHERE {VALID}")
def k04(spark, d):
    rows = table(spark, d, "predictions").where(M.is_valid()).select("detector", "id", "generated_at", "score_ai")
    return R.midrank(rows, ["detector"], "score_ai").select("detector", "id", "generated_at", "score_ai", F.round("midrank", 9).alias("midrank"))


@query("K05_ema_by_stratum", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*) AS visits, round(sum(0.1 * power(0.9, back) * value) + 0.5 * power(0.9, max(n)), 6) AS ema FROM r GROUP BY event_type")
def k05(spark, d):
    e = R.ordered_ema(table(spark, d, "events"), "event_type", ["ts", "event_id"], "value", 0.1, 0.5)
    return e.select("event_type", "visits", F.round("ema", 6).alias("ema"))


@query("K07_streaks", "WITH o AS (SELECT event_id, user_id, ts, value < 50 AS ok, count(*) FILTER (NOT value < 50 OR value IS NULL) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events), s AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM o) SELECT user_id, max(streak) AS longest FROM s GROUP BY user_id")
def k07(spark, d):
    return R.streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") < 50).groupBy("user_id").agg(F.max("streak").alias("longest"))


@query("F18_lower_quantiles", f"SELECT detector, list_sort(list(score_ai))[floor(0.1 * (count(*) - 1))::BIGINT + 1] AS p10, list_sort(list(score_ai))[floor(0.5 * (count(*) - 1))::BIGINT + 1] AS p50, list_sort(list(score_ai))[floor(0.9 * (count(*) - 1))::BIGINT + 1] AS p90 FROM predictions WHERE {VALID} GROUP BY detector")
def f18(spark, d):
    return lower_quantile(table(spark, d, "predictions").where(M.is_valid()), ["detector"], "score_ai", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("F25_expert_confidence", "SELECT id, round(coalesce(list_avg(list_filter([annotator_1.confidence, annotator_2.confidence, annotator_3.confidence, annotator_4.confidence, annotator_5.confidence], lambda x: x IS NOT NULL)) / 4.0 - 0.25, 0.5), 9) AS confidence FROM expert_articles")
def f25(spark, d):
    known = F.filter(F.array(*[F.col(f"annotator_{i}.confidence") for i in range(1, 6)]), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + (x - 1) / 4.0) / F.size(known)
    return table(spark, d, "expert_articles").select("id", F.round(F.when(F.size(known) > 0, mean).otherwise(0.5), 9).alias("confidence"))


@query("F33_population_variance", f"SELECT id, count(*) AS n, round(coalesce(CASE WHEN count(*) > 1 THEN var_pop(score_ai) END, 0.0), 6) AS variance FROM predictions WHERE {VALID} GROUP BY id")
def f33(spark, d):
    v = F.when(F.count(F.lit(1)) > 1, F.var_pop("score_ai")).otherwise(0.0)
    return table(spark, d, "predictions").where(M.is_valid()).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(v, 6).alias("variance"))


@query("F34_variance_top_share", f"WITH v AS (SELECT dataset, id, var_pop(score_ai) AS v FROM predictions WHERE {VALID} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(v, 9) DESC, id) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM v) SELECT dataset, id FROM r WHERE k <= greatest(1, round_even(0.1 * n, 0))")
def f34(spark, d):
    v = table(spark, d, "predictions").where(M.is_valid()).groupBy("dataset", "id").agg(F.round(F.var_pop("score_ai"), 9).alias("v"))
    w = Window.partitionBy("dataset")
    ranked = v.withColumns({"k": F.row_number().over(w.orderBy(F.desc("v"), "id")), "n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("k") <= F.greatest(F.lit(1), F.bround(0.1 * F.col("n")))).select("dataset", "id")


@query("O01_softmax_evidence", f"WITH s AS (SELECT id, 2 * score_ai - 1 AS s FROM predictions WHERE {VALID}) SELECT id, round(sum(exp(3 * abs(s)) * s) / sum(exp(3 * abs(s))), 9) AS evidence, round(avg(s), 9) AS plain FROM s GROUP BY id")
def o01(spark, d):
    rows = table(spark, d, "predictions").where(M.is_valid()).withColumn("s", 2 * F.col("score_ai") - 1)
    return rows.groupBy("id").agg(F.round(softmax_mean(F.col("s")), 9).alias("evidence"), F.round(softmax_mean(F.col("s"), 0.0), 9).alias("plain"))


@query("Q02_ucb_weights", """WITH r AS (SELECT event_type, value / 100.0 AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS back FROM events), e AS (SELECT event_type, count(*) AS n, sum(0.1 * power(0.9, back) * x) + 0.5 * power(0.9, count(*)) AS ema, var_pop(x) AS v FROM r GROUP BY event_type),
  u AS (SELECT *, v + 0.5 / sqrt(n + 1) + 0.3 * greatest(0.0, 0.5 - ema) AS raw FROM e), s AS (SELECT *, exp(2 * (raw - max(raw) OVER ())) AS x FROM u) SELECT event_type, round(0.9 * x / sum(x) OVER () + 0.1 / count(*) OVER (), 6) AS weight FROM s""")
def q02(spark, d):
    from quern.operators.samplers import softmax_with_floor, ucb_raw

    rows = table(spark, d, "events").withColumn("x", F.col("value") / 100.0)
    ema = R.ordered_ema(rows, "event_type", ["ts", "event_id"], "x", 0.1, 0.5)
    state = ema.join(rows.groupBy("event_type").agg(F.var_pop("x").alias("variance")), "event_type")
    weighted = softmax_with_floor(state.withColumn("raw", ucb_raw(F.col("variance"), F.col("visits"), F.col("ema"), 0.5, 0.3)), "raw", 2.0, 0.1)
    return weighted.select("event_type", F.round("weight", 6).alias("weight"))


@query("Q15_replay_priority", "WITH e AS (SELECT user_id, var_pop(value / 100.0) AS v, avg(value / 100.0) AS m, count(*) AS n FROM events GROUP BY user_id), p AS (SELECT user_id, round(greatest(0.000001, 0.8 * v + 0.2 * greatest(0.0, 1 - m)), 9) AS priority FROM e WHERE n >= 2) SELECT user_id, priority FROM p ORDER BY priority DESC, user_id LIMIT 50")
def q15(spark, d):
    from quern.operators.samplers import replay_priority

    e = table(spark, d, "events").groupBy("user_id").agg(F.var_pop(F.col("value") / 100.0).alias("v"), F.avg(F.col("value") / 100.0).alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return e.select("user_id", F.round(replay_priority(F.col("v"), F.col("m")), 9).alias("priority")).orderBy(F.desc("priority"), "user_id").limit(50)  # a top-50 report
