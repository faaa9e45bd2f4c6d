"""Queries over resampling, paired tests, panels and detector reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import duels as D
from quern.operators import inference as I
from quern.operators import metrics as M
from quern.operators import ranks as R
from quern.plans.inference_q import _RATES, RESAMPLES, _aurocs, _rates
from quern.plans.metrics_q import _LATEST, VALID, _latest
from quern.plans.registry import query, table


def _valid(spark, d):
    return table(spark, d, "predictions").where(M.is_valid())


@query("M01_bootstrap_f1")
def m01(spark, d):
    """Mean and interval of F1 at 0.5 per detector over 2,000 resamples."""
    return I.bootstrap_confusion(_valid(spark, d), ["detector"], "id", 2000, metric="f1")


@query("M03_bootstrap_tpr")
def m03(spark, d):
    """TPR at 1 % FPR per detector over 2,000 resamples."""
    per = I.bootstrap_tpr(_valid(spark, d), ["detector"], "id", 2000, target=0.01)
    return per.groupBy("detector").agg(F.avg("tpr").alias("mean"), F.percentile("tpr", 0.025).alias("low"), F.percentile("tpr", 0.975).alias("high"))


@query("M06_pairwise_tests")
def m06(spark, d):
    """All pairs of detectors: DeLong p-values with the Benjamini-Hochberg correction at 0.05."""
    pairs = M.delong_pairs(_latest(spark, d), "detector", "id").select("a", "b", (F.col("auroc_a") - F.col("auroc_b")).alias("delta"), "p_value")
    adjusted = I.benjamini_hochberg(pairs, "p_value", ["a", "b"])
    return adjusted.select("a", "b", F.round("delta", 6).alias("delta"), F.round("p_value", 6).alias("p_raw"), F.round("p_bh", 6).alias("p_bh"), (F.col("p_bh") <= 0.05).alias("significant"))


@query("M08_mean_tau")
def m08(spark, d):
    """Mean Kendall tau between the ranking of the detectors in a resample and their ranking over all rows."""
    return I.mean_tau(_aurocs(spark, d), M.curve_metrics(M.score_curve(_valid(spark, d), ["detector"]), ["detector"]).select("detector", "auroc"), "detector")


_Z = "CASE WHEN v > 0 THEN (w - n * (n + 1) / 4) / sqrt(v) ELSE 0 END"
_WILCOXON = f"""s AS (SELECT judge_id, round(win_rate - 0.5, 12) AS d FROM rates), k AS (SELECT judge_id, abs(d) AS a, count(*) AS t, count(*) FILTER (d > 0) AS up FROM s WHERE d <> 0 GROUP BY ALL),
  q AS (SELECT *, sum(t) OVER (PARTITION BY judge_id ORDER BY a) - t + (t + 1) / 2.0 AS rank FROM k), g AS (SELECT judge_id, sum(t)::DOUBLE AS n, sum(up * rank)::DOUBLE AS w, sum(t)::DOUBLE * (sum(t) + 1) * (2 * sum(t) + 1) / 24 - sum(t * t * t - t)::DOUBLE / 48 AS v FROM q GROUP BY judge_id)"""


@query("M13_holm", f"WITH {_RATES}, {_WILCOXON}, z AS (SELECT judge_id, round({_Z}, 9) AS z FROM g), o AS (SELECT *, row_number() OVER (ORDER BY z DESC, judge_id) AS k, count(*) OVER () AS m FROM z) SELECT judge_id, z, m - k + 1 AS factor FROM o")
def m13(spark, d):
    """Factors of the Holm correction for the judges' signed-rank tests (the smallest p, that is the largest z, first)."""
    tests = I.wilcoxon_greater(_rates(spark, d), ["judge_id"], "win_rate").select("judge_id", F.round("z", 9).alias("z"), "p_value").withColumn("neg", -F.col("z"))
    both = I.holm(tests, "neg", ["judge_id"])
    order = Window.orderBy("neg", "judge_id")
    return both.select("judge_id", "z", (F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(order) + 1).cast("bigint").alias("factor"))  # a row per judge


@query("M13_adjusted_p_values")
def m13b(spark, d):
    tests = I.wilcoxon_greater(_rates(spark, d), ["judge_id"], "win_rate").select("judge_id", "p_value")
    both = I.benjamini_hochberg(I.holm(tests, "p_value", ["judge_id"]), "p_value", ["judge_id"])
    return both.select("judge_id", *[F.round(c, 9).alias(c) for c in ("p_value", "p_holm", "p_bh")])


@query("M15_multi_judge_summary")
def m15(spark, d):
    """Per judge, for the panel and for the consensus: rate, interval, permutation and signed-rank p, Holm over the judges."""
    return I.judge_summary(_rates(spark, d), RESAMPLES)


@query("M16_one_judge", f"WITH {_RATES}, j AS (SELECT DISTINCT doc_id FROM rates) SELECT j.doc_id, r.win_rate IS NULL AS missing, round(coalesce(r.win_rate, 0.0), 9) AS win_rate FROM j LEFT JOIN (SELECT * FROM rates WHERE judge_id = 'panel_alder') r USING (doc_id)")
def m16(spark, d):
    rates = _rates(spark, d)
    one = rates.where("judge_id = 'panel_alder'").select("doc_id", "win_rate")
    return rates.select("doc_id").distinct().join(one, "doc_id", "left").select("doc_id", F.col("win_rate").isNull().alias("missing"), F.round(F.coalesce("win_rate", F.lit(0.0)), 9).alias("win_rate"))


@query("F28_parse_rates", "SELECT judge_id, count(*) AS rows, count(*) FILTER (rank IS NOT NULL AND quality_score BETWEEN 0 AND 1) AS parsed, round(count(*) FILTER (rank IS NOT NULL AND quality_score BETWEEN 0 AND 1) / count(*), 6) AS rate FROM judgments GROUP BY judge_id")
def f28(spark, d):
    ok = F.coalesce(F.col("rank").isNotNull() & F.col("quality_score").between(0, 1), F.lit(False))
    return table(spark, d, "judgments").groupBy("judge_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("parsed"), F.round(F.avg(ok.cast("double")), 6).alias("rate"))


@query("F30_consensus_rates", f"WITH {_RATES} SELECT doc_id, CASE WHEN min(win_rate) > 0.5 THEN 1.0::DOUBLE WHEN max(win_rate) < 0.5 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS consensus FROM rates GROUP BY doc_id")
def f30(spark, d):
    return D.panel(_rates(spark, d)).select("doc_id", "consensus")


_EXPERT = "CASE WHEN lower(trim({0})) LIKE 'ai%' THEN 1 WHEN lower(trim({0})) LIKE 'human%' THEN 0 END"


@query("F26_vote_summary", f"WITH v AS (SELECT {_EXPERT.format('majority_vote')} AS m, {_EXPERT.format('expert_majority_vote')} AS x, {_EXPERT.format('ground_truth')} AS g FROM expert_articles) SELECT count(*) AS articles, count(m) AS voted, count(*) - count(m) AS failed, round(avg((m = g)::INT), 6) AS majority_right, round(avg((x = g)::INT), 6) AS experts_right, round(avg((m = x)::INT), 6) AS votes_agree FROM v")
def f26(spark, d):
    cls = lambda c: F.when(F.lower(F.trim(c)).startswith("ai"), 1).when(F.lower(F.trim(c)).startswith("human"), 0)
    v = table(spark, d, "expert_articles").select(cls("majority_vote").alias("m"), cls("expert_majority_vote").alias("x"), cls("ground_truth").alias("g"))
    rate = lambda a, b: F.round(F.avg((F.col(a) == F.col(b)).cast("double")), 6)
    n = F.count(F.lit(1))
    return v.agg(n.alias("articles"), F.count("m").alias("voted"), (n - F.count("m")).alias("failed"), rate("m", "g").alias("majority_right"), rate("x", "g").alias("experts_right"), rate("m", "x").alias("votes_agree"))


@query("F27_judge_report", f"WITH {_RATES} SELECT judge_id, sum(duels)::BIGINT AS duels, round(sum(wins) / sum(duels), 9) AS pooled_rate, round(avg(win_rate), 9) AS mean_doc_rate, round(avg(win_rate - 0.5), 9) AS mean_diff, round(avg(win_rate - 0.5) / nullif(stddev_samp(win_rate), 0), 9) AS cohen_d, round(avg((win_rate > 0.5)::INT), 9) AS share_above FROM rates GROUP BY judge_id")
def f27(spark, d):
    g = _rates(spark, d).groupBy("judge_id").agg(F.sum("duels").alias("duels"), (F.sum("wins") / F.sum("duels")).alias("p"), F.avg("win_rate").alias("m"), F.avg(F.col("win_rate") - 0.5).alias("diff"), F.stddev_samp("win_rate").alias("sd"), F.avg((F.col("win_rate") > 0.5).cast("double")).alias("above"))
    return g.select("judge_id", "duels", F.round("p", 9).alias("pooled_rate"), F.round("m", 9).alias("mean_doc_rate"), F.round("diff", 9).alias("mean_diff"), F.round(F.when(F.col("sd") > 0, F.col("diff") / F.col("sd")), 9).alias("cohen_d"), F.round("above", 9).alias("share_above"))


@query("F08_stratum_evaluation", f"""WITH v AS (SELECT dataset, domain, label, score_ai AS s FROM predictions WHERE {VALID}), g AS (SELECT dataset, domain, s, count(*) FILTER (label = 1)::DOUBLE AS pos, count(*) FILTER (label <> 1)::DOUBLE AS neg FROM v GROUP BY ALL), c AS (SELECT *, sum(neg) OVER (PARTITION BY dataset, domain ORDER BY s DESC) AS fp, sum(pos) OVER (PARTITION BY dataset, domain) AS p, sum(neg) OVER (PARTITION BY dataset, domain) AS n FROM g),
  a AS (SELECT dataset, domain, sum(pos * (n - fp + 0.5 * neg)) / (max(p) * max(n)) AS auroc FROM c WHERE p > 0 AND n > 0 GROUP BY dataset, domain), t AS (SELECT dataset, domain, count(*) AS rows, avg(coalesce(CASE WHEN isnan(score_ai) OR isinf(score_ai) THEN NULL ELSE score_ai END, 0)) AS m, avg((coalesce(error, '') = '')::INT) AS c FROM predictions GROUP BY ALL)
  SELECT t.dataset, t.domain, rows, round(m, 6) AS mean_score, round(c, 6) AS clean_rate, round(auroc, 6) AS auroc FROM t LEFT JOIN a ON t.dataset IS NOT DISTINCT FROM a.dataset AND t.domain IS NOT DISTINCT FROM a.domain""")
def f08(spark, d):
    p = table(spark, d, "predictions")
    s = F.col("score_ai")
    finite = F.when(~F.isnan(s) & (F.abs(s) != float("inf")), s)
    t = p.groupBy("dataset", "domain").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.coalesce(finite, F.lit(0.0))), 6).alias("mean_score"), F.round(F.avg((F.coalesce("error", F.lit("")) == "").cast("double")), 6).alias("clean_rate"))
    a = M.curve_metrics(M.score_curve(p.where(M.is_valid()), ["dataset", "domain"]), ["dataset", "domain"]).select(F.struct("dataset", "domain").alias("k"), F.round("auroc", 6).alias("auroc"))
    return t.withColumn("k", F.struct("dataset", "domain")).join(a, "k", "left").select("dataset", "domain", "rows", "mean_score", "clean_rate", "auroc")


_CUM = f"""g AS (SELECT detector, score_ai AS s, count(*) FILTER (label = 1)::DOUBLE AS pos, count(*) FILTER (label <> 1)::DOUBLE AS neg FROM predictions WHERE {VALID} GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY detector) AS p, sum(neg) OVER (PARTITION BY detector) AS n FROM g WINDOW w AS (PARTITION BY detector ORDER BY s DESC))"""


@query("L04_tpr_at_fpr", f"WITH {_CUM} SELECT detector, round(coalesce(max(tp / p) FILTER (fp / n <= 0.05), 0.0), 9) AS tpr FROM c WHERE p > 0 AND n > 0 GROUP BY detector")
def l04(spark, d):
    return M.curve_metrics(M.score_curve(_valid(spark, d), ["detector"]), ["detector"]).where("auroc is not null").select("detector", F.round("tpr_at_fpr_05", 9).alias("tpr"))


@query("L05_fpr_at_tpr", f"WITH {_CUM} SELECT detector, round(coalesce(min(fp / n) FILTER (tp / p >= 0.9), 1.0), 9) AS fpr FROM c WHERE p > 0 AND n > 0 GROUP BY detector")
def l05(spark, d):
    return M.curve_metrics(M.score_curve(_valid(spark, d), ["detector"]), ["detector"]).where("auroc is not null").select("detector", F.round("fpr_at_tpr_90", 9).alias("fpr"))


@query("L07_confusion", f"SELECT detector, count(*) FILTER (score_ai >= 0.7 AND label = 1) AS tp, count(*) FILTER (score_ai >= 0.7 AND label <> 1) AS fp, count(*) FILTER (score_ai < 0.7 AND label <> 1) AS tn, count(*) FILTER (score_ai < 0.7 AND label = 1) AS fn FROM predictions WHERE {VALID} GROUP BY detector")
def l07(spark, d):
    return M.threshold_metrics(_valid(spark, d), ["detector"], 0.7).select("detector", "tp", "fp", "tn", "fn")


@query("L10_threshold_by_f1", f"WITH {_CUM}, f AS (SELECT *, round(2 * tp / (tp + fp + p), 12) AS f1, row_number() OVER (PARTITION BY detector ORDER BY round(2 * tp / (tp + fp + p), 12) DESC, s DESC) AS k FROM c) SELECT detector, CASE WHEN p > 0 AND n > 0 THEN s ELSE 0.5 END AS threshold FROM f WHERE k = 1")
def l10(spark, d):
    return M.best_f1_threshold(_valid(spark, d), ["detector"]).select("detector", "threshold")


_VAL = "SELECT * FROM predictions WHERE lower(trim(split)) IN ('val', 'validation', 'dev')"
_CUMV = _CUM.replace("FROM predictions", f"FROM ({_VAL})")


@query("L12_threshold_policies", f"WITH {_CUMV}, f AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY round(2 * tp / (tp + fp + p), 12) DESC, s DESC) AS k FROM c) SELECT detector, 0.5::DOUBLE AS fixed, max(CASE WHEN k = 1 THEN CASE WHEN p > 0 AND n > 0 THEN s ELSE 0.5 END END) AS f1, coalesce(min(s) FILTER (p > 0 AND n > 0 AND fp / n <= 0.01), 'inf'::DOUBLE) AS fpr01 FROM f GROUP BY detector")
def l12(spark, d):
    """Thresholds from validation rows: fixed, best F1, 1 % FPR."""
    v = _valid(spark, d).where("lower(trim(split)) in ('val', 'validation', 'dev')")
    return I.threshold_policies(v, ["detector"]).select("detector", "fixed", "f1", "fpr01")


@query("L13_tpr_at_one_percent", f"WITH {_CUM} SELECT detector, round(coalesce(max(tp / p) FILTER (fp / n <= 0.01), 0.0), 9) AS tpr FROM c WHERE p > 0 AND n > 0 GROUP BY detector")
def l13(spark, d):
    return M.curve_metrics(M.score_curve(_valid(spark, d), ["detector"]), ["detector"]).where("auroc is not null").select("detector", F.round("tpr_at_fpr_01", 9).alias("tpr"))


_REPORT = f"""WITH {_CUMV}, f AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY round(2 * tp / (tp + fp + p), 12) DESC, s DESC) AS k FROM c), th AS (SELECT detector, 0.5::DOUBLE AS fixed, max(CASE WHEN k = 1 THEN CASE WHEN p > 0 AND n > 0 THEN s ELSE 0.5 END END) AS f1, coalesce(min(s) FILTER (p > 0 AND n > 0 AND fp / n <= 0.01), 'inf'::DOUBLE) AS fpr01 FROM f GROUP BY detector),
  t AS (SELECT detector, label, score_ai AS s FROM predictions WHERE {VALID} AND lower(trim(split)) IN ('test', 'test_shift')), x AS (SELECT th.detector, policy, threshold, label, s FROM t JOIN (SELECT detector, unnest(['fixed', 'f1', 'fpr01']) AS policy, unnest([fixed, f1, fpr01]) AS threshold FROM th) th USING (detector)),
  k AS (SELECT detector, policy, threshold, count(*) FILTER (s >= threshold AND label = 1)::DOUBLE AS tp, count(*) FILTER (s >= threshold AND label <> 1)::DOUBLE AS fp, count(*) FILTER (s < threshold AND label <> 1)::DOUBLE AS tn, count(*) FILTER (s < threshold AND label = 1)::DOUBLE AS fn FROM x GROUP BY ALL)"""


@query("L25_detector_records", f"{_REPORT} SELECT detector, policy, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn FROM k")
def l25(spark, d):
    """Test rows of each detector at the three thresholds its validation rows give."""
    return _records(spark, d).select("detector", "policy", "threshold", "tp", "fp", "tn", "fn")


def _records(spark, d):
    rows = _valid(spark, d).withColumn("split", F.lower(F.trim("split")))
    return I.records_at_policies(rows.where("split in ('test', 'test_shift')"), rows.where("split in ('val', 'validation', 'dev')"), ["detector"])


@query("L26_flat_records", f"{_REPORT} SELECT detector, policy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(1 - CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 9) AS fpr FROM k")
def l26(spark, d):
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return _records(spark, d).select("detector", "policy", F.round(ratio(tp, tp + fp), 9).alias("precision"), F.round(ratio(tp, tp + fn), 9).alias("recall"), F.round(1 - ratio(tn, tn + fp), 9).alias("fpr"))


@query("K06_global_ema", "WITH s AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY h DESC) - 1 AS back, count(*) OVER () AS n FROM s) SELECT count(*) AS steps, round(sum(0.05 * power(0.95, back) * m) + 0.0 * power(0.95, max(n)), 6) AS mean_ema, round(sum(0.05 * power(0.95, back) * sd) + 1.0 * power(0.95, max(n)), 6) AS std_ema FROM r")
def k06(spark, d):
    s = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")).withColumn("k", F.lit(0))
    mean, std = R.ordered_ema(s, "k", ["h"], "m", 0.05, 0.0), R.ordered_ema(s, "k", ["h"], "sd", 0.05, 1.0)
    return mean.join(std.select("k", F.col("ema").alias("std")), "k").select(F.col("visits").alias("steps"), F.round("ema", 6).alias("mean_ema"), F.round("std", 6).alias("std_ema"))  # one row each


@query("K08_early_stop", "WITH h AS (SELECT user_id, date_trunc('day', ts) AS day, max(value) AS a, max(CASE WHEN event_type = 'click' THEN value END) AS b FROM events GROUP BY ALL), p AS (SELECT *, max(a) OVER w AS ba, max(b) OVER w AS bb FROM h WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), i AS (SELECT *, (a > coalesce(ba, -1)) OR coalesce(b > coalesce(bb, -1), false) AS better FROM p), g AS (SELECT *, count(*) FILTER (better) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM i), s AS (SELECT *, count(*) FILTER (NOT better) OVER (PARTITION BY user_id, island ORDER BY day ROWS UNBOUNDED PRECEDING) AS streak FROM g) SELECT user_id, count(*) FILTER (better) AS improvements, max(streak) AS longest, min(day) FILTER (streak >= 3) AS stopped FROM s GROUP BY user_id")
def k08(spark, d):
    """Best values so far of two measures; a step that improves neither adds to a streak, and a streak of three stops."""
    h = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.max("value").alias("a"), F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("b"))
    s = R.early_stop(h, "user_id", ["day"], ["a", "b"])
    return s.groupBy("user_id").agg(F.count_if("better").alias("improvements"), F.max("streak").alias("longest"), F.min(F.when(F.col("streak") >= 3, F.col("day"))).alias("stopped"))


@query("K17_correct_only_advantages", f"WITH v AS (SELECT id, detector, generated_at, CASE WHEN (score_ai >= 0.5) = (label = 1) THEN 1 ELSE 0 END AS ok, 2 * score_ai - 1 AS r FROM predictions WHERE {VALID}), s AS (SELECT id, count(*) AS n, avg(r) AS m, stddev_pop(r) AS sd FROM v WHERE ok = 1 GROUP BY id) SELECT v.id, detector, generated_at, round(CASE WHEN ok = 0 THEN greatest(-3.0, least(0.0, r)) WHEN n >= 2 THEN greatest(-3.0, least(3.0, greatest(-5.0, least(5.0, (r - m) / greatest(sd, 0.05, 0.0001))))) ELSE greatest(-3.0, least(3.0, r)) END, 6) AS advantage FROM v LEFT JOIN s USING (id)")
def k17(spark, d):
    v = _valid(spark, d).select("id", "detector", "generated_at", ((F.col("score_ai") >= 0.5) == (F.col("label") == 1)).alias("ok"), (2 * F.col("score_ai") - 1).alias("r"))
    return R.correct_only_advantages(v, ["id"], "r", "ok", floor=0.05, low=-3.0, high=3.0).select("id", "detector", "generated_at", F.round("advantage", 6).alias("advantage"))


@query("K18_pooled_advantages", f"WITH v AS (SELECT dataset, id, detector, generated_at, CASE WHEN {VALID} THEN score_ai END AS r FROM predictions), s AS (SELECT dataset, count(r) AS n, avg(r) AS m, stddev_pop(r) AS sd FROM v GROUP BY dataset) SELECT v.dataset, id, detector, generated_at, round(CASE WHEN n >= 2 THEN CASE WHEN r IS NULL THEN 0.0 ELSE greatest(-5.0, least(5.0, (r - m) / greatest(sd, 0.0001))) END END, 6) AS advantage FROM v JOIN s ON v.dataset IS NOT DISTINCT FROM s.dataset")
def k18(spark, d):
    """All of a pool's rewards against its mean and spread; a missing reward gets 0, a pool with fewer than two rewards none."""
    v = table(spark, d, "predictions").select("dataset", "id", "detector", "generated_at", F.when(M.is_valid(), F.col("score_ai")).alias("r"))
    return R.group_advantages(v, ["dataset"], "r", missing=0.0, least=2).select("dataset", "id", "detector", "generated_at", F.round("advantage", 6).alias("advantage"))


@query("K16_group_advantages", f"WITH s AS (SELECT detector, dataset, id, generated_at, score_ai, avg(score_ai) OVER w AS m, min(score_ai) OVER w AS lo, stddev_pop(score_ai) OVER w AS sd FROM predictions WHERE {VALID} WINDOW w AS (PARTITION BY detector, dataset)) SELECT detector, dataset, id, generated_at, score_ai, round(greatest(-5.0, least(5.0, (score_ai - m) / greatest(sd, 0.0001))), 6) AS advantage, round(greatest(-5.0, least(5.0, (score_ai - lo) / greatest(sd, 0.2))), 6) AS above_least FROM s")
def k16(spark, d):
    rows = _valid(spark, d).select("detector", "dataset", "id", "generated_at", "score_ai")
    a = R.group_advantages(rows, ["detector", "dataset"], "score_ai").withColumn("advantage", F.round("advantage", 6))
    b = R.group_advantages(a, ["detector", "dataset"], "score_ai", floor=0.2, baseline="min", out="above_least")
    return b.withColumn("above_least", F.round("above_least", 6))


@query("K14_normalized_weights", f"SELECT detector, dataset, id, generated_at, score_ai, round(CASE WHEN sum(score_ai) OVER w > 0 THEN score_ai / sum(score_ai) OVER w ELSE 0 END, 9) AS weight FROM predictions WHERE {VALID} WINDOW w AS (PARTITION BY detector, dataset)")
def k14(spark, d):
    rows = _valid(spark, d).select("detector", "dataset", "id", "generated_at", "score_ai").withColumn("_k", F.struct("detector", "dataset"))
    sums = rows.groupBy("_k").agg(F.sum("score_ai").alias("_s"))
    w = F.when(F.col("_s") > 0, F.col("score_ai") / F.col("_s")).otherwise(0.0)
    return rows.join(sums, "_k").select("detector", "dataset", "id", "generated_at", "score_ai", F.round(w, 9).alias("weight"))


@query("M05_delong_z", f"""WITH l AS {_LATEST}, g AS (SELECT detector, s, count(*) FILTER (label = 1)::DOUBLE AS pos, count(*) FILTER (label <> 1)::DOUBLE AS neg FROM l GROUP BY ALL), c0 AS (SELECT detector, id, label, s FROM l), pr AS (SELECT x.detector AS a, y.detector AS b, x.id, x.label, x.s AS sa, y.s AS sb FROM c0 x JOIN c0 y ON x.id = y.id AND x.detector < y.detector),
  v AS (SELECT a, b, id, label, CASE WHEN label = 1 THEN (SELECT count(*) FILTER (z.sa < pr.sa) + 0.5 * count(*) FILTER (z.sa = pr.sa) FROM pr z WHERE z.a = pr.a AND z.b = pr.b AND z.label <> 1) ELSE (SELECT count(*) FILTER (z.sa > pr.sa) + 0.5 * count(*) FILTER (z.sa = pr.sa) FROM pr z WHERE z.a = pr.a AND z.b = pr.b AND z.label = 1) END AS va, CASE WHEN label = 1 THEN (SELECT count(*) FILTER (z.sb < pr.sb) + 0.5 * count(*) FILTER (z.sb = pr.sb) FROM pr z WHERE z.a = pr.a AND z.b = pr.b AND z.label <> 1) ELSE (SELECT count(*) FILTER (z.sb > pr.sb) + 0.5 * count(*) FILTER (z.sb = pr.sb) FROM pr z WHERE z.a = pr.a AND z.b = pr.b AND z.label = 1) END AS vb FROM pr),
  n AS (SELECT a, b, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label <> 1)::DOUBLE AS n FROM pr GROUP BY a, b), w AS (SELECT v.a, v.b, label, p, n.n, va / CASE WHEN label = 1 THEN n.n ELSE p END AS va, vb / CASE WHEN label = 1 THEN n.n ELSE p END AS vb FROM v JOIN n USING (a, b)),
  t AS (SELECT a, b, avg(va) FILTER (label = 1) AS auroc_a, avg(vb) FILTER (label = 1) AS auroc_b, var_samp(va - vb) FILTER (label = 1) / max(p) + var_samp(va - vb) FILTER (label <> 1) / max(n) AS var FROM w GROUP BY a, b) SELECT a, b, round(auroc_a, 6) AS auroc_a, round(auroc_b, 6) AS auroc_b, round(CASE WHEN var > 0 THEN (auroc_a - auroc_b) / sqrt(var) ELSE 0 END, 4) AS z FROM t""")
def m05z(spark, d):
    p = M.delong_pairs(_latest(spark, d), "detector", "id")
    return p.select("a", "b", F.round("auroc_a", 6).alias("auroc_a"), F.round("auroc_b", 6).alias("auroc_b"), F.round("z", 4).alias("z"))
