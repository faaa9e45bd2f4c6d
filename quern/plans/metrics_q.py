"""Queries over detector predictions: metrics, thresholds, calibration, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import metrics as M
from quern.plans.registry import query, table

DIMENSIONS = ("split", "dataset", "domain", "generator", "attack")
VALID = "label IS NOT NULL AND score_ai IS NOT NULL AND NOT isnan(score_ai) AND NOT isinf(score_ai) AND coalesce(error, '') = ''"
_SUITE = (
    "n_total", "n_scored", "n_errors", "score_mean", "score_std", "score_min", "score_max", "brier", "auroc", "auprc", "tp", "fp", "tn", "fn", "accuracy", "balanced_accuracy",
    "precision", "recall", "specificity", "f1", "mcc", "ece", *(f"tpr_at_fpr_{k}" for k in M.FPR_TARGETS), *(f"fpr_at_tpr_{k}" for k in M.TPR_TARGETS),
)
_COUNTS = {"n_total", "n_scored", "n_errors", "tp", "fp", "tn", "fn"}


def _rounded(df, keys):
    return df.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in _COUNTS else F.round(c, 12).alias(c) for c in _SUITE])


def _edges() -> str:
    return " + ".join(f"(s >= CAST('{e!r}' AS DOUBLE))::INT" for e in M.BIN_EDGES)


def _suite_sql(source: str, keys: str) -> str:
    """The suite in SQL over ``source`` (a query with the prediction columns and ``keys``)."""
    k = [x.strip() for x in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{x} IS NOT DISTINCT FROM {b}.{x}" for x in k)
    parts = ", ".join(f"coalesce(max(tp / p) FILTER (fp / n <= {t}), 0.0) AS tpr_at_fpr_{x}" for x, t in M.FPR_TARGETS.items())
    parts += ", " + ", ".join(f"coalesce(min(fp / n) FILTER (tp / p >= {t}), 1.0) AS fpr_at_tpr_{x}" for x, t in M.TPR_TARGETS.items())
    out = ", ".join(f"coalesce({'t' if c[0] == 'n' and c[1] == '_' else 'c'}.{c}, 0) AS {c}" if c in _COUNTS else f"round({c}, 12) AS {c}" for c in _SUITE)
    return f"""
    WITH src AS ({source}),
    t AS (SELECT {keys}, count(*) AS n_total, count(*) FILTER ({VALID}) AS n_scored, count(*) FILTER (coalesce(error, '') <> '') AS n_errors,
      avg(score_ai) FILTER ({VALID}) AS score_mean, stddev_pop(score_ai) FILTER ({VALID}) AS score_std, min(score_ai) FILTER ({VALID}) AS score_min,
      max(score_ai) FILTER ({VALID}) AS score_max, avg((least(1.0, greatest(0.0, score_ai)) - label) ** 2) FILTER ({VALID}) AS brier FROM src GROUP BY {keys}),
    v AS (SELECT {keys}, label, score_ai AS s FROM src WHERE {VALID}),
    g AS (SELECT {keys}, s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM v GROUP BY {keys}, s),
    cum AS (SELECT *, (sum(pos) OVER w)::DOUBLE AS tp, (sum(neg) OVER w)::DOUBLE AS fp, (sum(pos) OVER (PARTITION BY {keys}))::DOUBLE AS p, (sum(neg) OVER (PARTITION BY {keys}))::DOUBLE AS n
      FROM g WINDOW w AS (PARTITION BY {keys} ORDER BY s DESC)),
    r AS (SELECT {keys}, sum(pos * ((n - fp) + 0.5 * neg)) / (min(p) * min(n)) AS auroc, sum(pos / p * tp / (tp + fp)) AS auprc, {parts} FROM cum WHERE p > 0 AND n > 0 GROUP BY {keys}),
    c0 AS (SELECT {keys}, count(*) FILTER (s >= 0.5 AND label = 1)::DOUBLE AS tp, count(*) FILTER (s >= 0.5 AND label <> 1)::DOUBLE AS fp,
      count(*) FILTER (s < 0.5 AND label <> 1)::DOUBLE AS tn, count(*) FILTER (s < 0.5 AND label = 1)::DOUBLE AS fn FROM v GROUP BY {keys}),
    c AS (SELECT {keys}, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, (tp + tn) / (tp + fp + tn + fn) AS accuracy,
      (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2 AS balanced_accuracy,
      CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
      CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
      CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc FROM c0),
    b AS (SELECT {keys}, bin, count(*) AS rows, avg(s) AS conf, avg(label) AS acc FROM (SELECT {keys}, label, s, {_edges()} AS bin FROM (SELECT {keys}, label, least(1.0, greatest(0.0, s)) AS s FROM v)) GROUP BY {keys}, bin),
    e AS (SELECT {keys}, sum(rows * abs(acc - conf)) / sum(rows) AS ece FROM b GROUP BY {keys})
    SELECT {", ".join(f"t.{x}" for x in k)}, {out} FROM t LEFT JOIN r ON {on("t", "r")} LEFT JOIN c ON {on("t", "c")} LEFT JOIN e ON {on("t", "e")}"""


@query("L09_metrics_by_detector", _suite_sql("SELECT * FROM predictions", "detector"))
def l09(spark, d):
    return _rounded(M.binary_metrics(table(spark, d, "predictions"), ["detector"]), ["detector"])


_UNPIVOT = " UNION ALL ".join(f"SELECT detector, '{x}' AS field, {x}::VARCHAR AS value, label, score_ai, error FROM predictions WHERE {x} IS NOT NULL" for x in DIMENSIONS)


def _by_dimension(predictions):
    pairs = F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).cast("string").alias("value")) for x in DIMENSIONS])
    rows = predictions.select("detector", "label", "score_ai", "error", F.explode(pairs).alias("g"))
    return rows.select("detector", "g.field", "g.value", "label", "score_ai", "error").where("value is not null")


@query("F07_grouped_metrics", _suite_sql(_UNPIVOT, "detector, field, value"))
def f07(spark, d):
    keys = ["detector", "field", "value"]
    return _rounded(M.binary_metrics(_by_dimension(table(spark, d, "predictions")), keys), keys)


def _valid(spark, d):
    return table(spark, d, "predictions").where(M.is_valid())


_CUM = f"""g AS (SELECT detector, score_ai AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM predictions WHERE {VALID} GROUP BY ALL),
    cum AS (SELECT *, (sum(pos) OVER w)::DOUBLE AS tp, (sum(neg) OVER w)::DOUBLE AS fp, (sum(pos) OVER (PARTITION BY detector))::DOUBLE AS p, (sum(neg) OVER (PARTITION BY detector))::DOUBLE AS n
      FROM g WINDOW w AS (PARTITION BY detector ORDER BY s DESC))"""


@query("L01_auroc", f"WITH {_CUM} SELECT detector, round(sum(pos * ((n - fp) + 0.5 * neg)) / (min(p) * min(n)), 6) AS auroc, round(sum(pos / p * tp / (tp + fp)), 6) AS auprc FROM cum WHERE p > 0 AND n > 0 GROUP BY detector")
def l01(spark, d):
    m = M.curve_metrics(M.score_curve(_valid(spark, d), ["detector"]), ["detector"])
    return m.select("detector", F.round("auroc", 6).alias("auroc"), F.round("auprc", 6).alias("auprc"))


@query(
    "L03_roc_curve",
    f"""WITH {_CUM}, o AS (SELECT detector, tp, fp, p, n, s FROM cum WHERE p > 0 AND n > 0 UNION ALL SELECT DISTINCT detector, 0.0, 0.0, p, n, 'inf'::DOUBLE FROM cum WHERE p > 0 AND n > 0),
    l AS (SELECT *, lag(tp) OVER w AS ptp, lag(fp) OVER w AS pfp, lead(tp) OVER w AS ntp, lead(fp) OVER w AS nfp FROM o WINDOW w AS (PARTITION BY detector ORDER BY s DESC))
    SELECT detector, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr, s AS threshold FROM l WHERE ptp IS NULL OR ntp IS NULL OR (tp - ptp) * (nfp - fp) <> (ntp - tp) * (fp - pfp)""",
)
def l03(spark, d):
    return M.roc_points(_valid(spark, d), ["detector"]).select("detector", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"), "threshold")


@query(
    "L06_calibration_bins",
    f"SELECT detector, bin, count(*) AS rows, round(avg(s), 6) AS confidence, round(avg(label), 6) AS accuracy FROM (SELECT detector, label, s, {_edges()} AS bin FROM (SELECT detector, label, least(1.0, greatest(0.0, score_ai)) AS s FROM predictions WHERE {VALID})) GROUP BY ALL",
)
def l06(spark, d):
    b = M.calibration_bins(_valid(spark, d), ["detector"])
    return b.select("detector", "bin", "rows", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(
    "K01_threshold_by_f1",
    f"""WITH {_CUM}, f AS (SELECT *, round(2 * tp / (tp + fp + p), 12) AS f1 FROM cum)
    SELECT detector, CASE WHEN max(p) > 0 AND max(n) > 0 THEN arg_max(s, f1 + 0 * s) ELSE 0.5 END AS threshold, round(max(f1) FILTER (p > 0 AND n > 0), 9) AS f1
    FROM (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY f1 DESC, s DESC) AS rn FROM f) WHERE rn = 1 GROUP BY detector""",
)
def k01(spark, d):
    return M.best_f1_threshold(_valid(spark, d), ["detector"]).withColumn("f1", F.round("f1", 9))


@query("L11_threshold_at_fpr", f"WITH {_CUM} SELECT detector, coalesce(min(s) FILTER (fp / n <= 0.01), 'inf'::DOUBLE) AS threshold FROM cum WHERE p > 0 AND n > 0 GROUP BY detector")
def l11(spark, d):
    return M.threshold_at_fpr(_valid(spark, d), ["detector"])


@query(
    "L15_auroc_by_domain",
    f"""WITH g AS (SELECT domain, detector, score_ai AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM predictions WHERE {VALID} AND domain IS NOT NULL GROUP BY ALL),
    c AS (SELECT *, (sum(neg) OVER (PARTITION BY domain, detector ORDER BY s DESC))::DOUBLE AS fp, (sum(pos) OVER (PARTITION BY domain, detector))::DOUBLE AS p, (sum(neg) OVER (PARTITION BY domain, detector))::DOUBLE AS n FROM g)
    SELECT domain, detector, round(sum(pos * ((n - fp) + 0.5 * neg)) / (min(p) * min(n)), 6) AS auroc FROM c WHERE p > 0 AND n > 0 GROUP BY ALL""",
)
def l15(spark, d):
    keys = ["domain", "detector"]
    m = M.curve_metrics(M.score_curve(_valid(spark, d).where("domain is not null"), keys), keys)
    return m.select(*keys, F.round("auroc", 6).alias("auroc"))


#: Latest valid prediction of each detector on each example.
_LATEST = f"(SELECT detector, id, label, score_ai AS s FROM (SELECT *, row_number() OVER (PARTITION BY detector, id ORDER BY generated_at DESC, score_ai DESC) AS rn FROM predictions WHERE {VALID}) WHERE rn = 1)"


def _latest(spark, d):
    best = _valid(spark, d).groupBy("detector", "id").agg(F.max(F.struct("generated_at", "score_ai", "label")).alias("m"))
    return best.select("detector", "id", "m.label", "m.score_ai")


@query(
    "M04_delong_variance",
    f"""WITH l AS {_LATEST}, g AS (SELECT detector, s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM l GROUP BY ALL),
    c AS (SELECT *, (sum(pos) OVER w)::DOUBLE AS tp, (sum(neg) OVER w)::DOUBLE AS fp, (sum(pos) OVER (PARTITION BY detector))::DOUBLE AS p, (sum(neg) OVER (PARTITION BY detector))::DOUBLE AS n FROM g WINDOW w AS (PARTITION BY detector ORDER BY s DESC)),
    v AS (SELECT l.detector, label, CASE WHEN label = 1 THEN (n - fp + 0.5 * neg) / n ELSE (tp - pos + 0.5 * pos) / p END AS v FROM l JOIN c USING (detector, s))
    SELECT detector, round(avg(v) FILTER (label = 1), 6) AS auroc, round(var_samp(v) FILTER (label = 1) / count(*) FILTER (label = 1) + var_samp(v) FILTER (label <> 1) / count(*) FILTER (label <> 1), 9) AS variance FROM v GROUP BY detector""",
)
def m04(spark, d):
    return M.delong_variance(_latest(spark, d), ["detector"], "id").select("detector", F.round("auroc", 6).alias("auroc"), F.round("variance", 9).alias("variance"))


@query("M05_delong_pairs")
def m05(spark, d):
    p = M.delong_pairs(_latest(spark, d), "detector", "id")
    return p.select("a", "b", *[F.round(c, 6).alias(c) for c in ("auroc_a", "auroc_b", "z", "p_value")])


@query("L16_three_way_classes", f"SELECT detector, CASE WHEN 2 * score_ai - 1 >= 0.2 THEN 'ai' WHEN 2 * score_ai - 1 <= -0.2 THEN 'human' ELSE 'unknown' END AS verdict, count(*) AS rows, count(*) FILTER (label = 1) AS ai_rows FROM predictions WHERE {VALID} GROUP BY ALL")
def l16(spark, d):
    signed = 2 * F.col("score_ai") - 1
    verdict = F.when(signed >= 0.2, "ai").when(signed <= -0.2, "human").otherwise("unknown")
    return _valid(spark, d).groupBy("detector", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("ai_rows"))


@query(
    "L17_macro_f1",
    f"""WITH v AS (SELECT detector, CASE WHEN label = 1 THEN 'ai' ELSE 'human' END AS truth, CASE WHEN 2 * score_ai - 1 >= 0.2 THEN 'ai' WHEN 2 * score_ai - 1 <= -0.2 THEN 'human' ELSE 'unknown' END AS verdict FROM predictions WHERE {VALID}),
    k AS (SELECT detector, c, count(*) FILTER (truth = c AND verdict = c)::DOUBLE AS tp, count(*) FILTER (truth <> c AND verdict = c)::DOUBLE AS fp, count(*) FILTER (truth = c AND verdict <> c)::DOUBLE AS fn FROM v, (VALUES ('ai'), ('human'), ('unknown')) AS x(c) GROUP BY ALL)
    SELECT detector, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1, round(max(CASE WHEN c = 'ai' THEN CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END END), 6) AS ai_f1 FROM k GROUP BY detector""",
)
def l17(spark, d):
    signed = 2 * F.col("score_ai") - 1
    verdict = F.when(signed >= 0.2, "ai").when(signed <= -0.2, "human").otherwise("unknown")
    v = _valid(spark, d).select("detector", F.when(F.col("label") == 1, "ai").otherwise("human").alias("truth"), verdict.alias("verdict"))
    sums = []
    for c in ("ai", "human", "unknown"):
        t, p = F.col("truth") == c, F.col("verdict") == c
        sums += [F.count_if(t & p).alias(f"{c}_tp"), (F.count_if(t) + F.count_if(p)).alias(f"{c}_all")]
    f1 = {c: F.when(F.col(f"{c}_all") > 0, 2 * F.col(f"{c}_tp") / F.col(f"{c}_all")).otherwise(0.0) for c in ("ai", "human", "unknown")}
    return v.groupBy("detector").agg(*sums).select("detector", F.round((f1["ai"] + f1["human"] + f1["unknown"]) / 3, 6).alias("macro_f1"), F.round(f1["ai"], 6).alias("ai_f1"))


@query("L18_gold_confidence", f"SELECT detector, round(avg(CASE WHEN label = 1 THEN score_ai ELSE 1 - score_ai END), 6) AS gold_confidence FROM predictions WHERE {VALID} GROUP BY ALL")
def l18(spark, d):
    return _valid(spark, d).groupBy("detector").agg(F.round(F.avg(F.when(F.col("label") == 1, F.col("score_ai")).otherwise(1 - F.col("score_ai"))), 6).alias("gold_confidence"))


@query(
    "K02_detector_rank",
    f"WITH {_CUM}, a AS (SELECT detector, sum(pos * ((n - fp) + 0.5 * neg)) / (min(p) * min(n)) AS auroc FROM cum WHERE p > 0 AND n > 0 GROUP BY detector) SELECT detector, round(auroc, 6) AS auroc, row_number() OVER (ORDER BY round(auroc, 9) DESC, detector) - 1 AS place FROM a",
)
def k02(spark, d):
    from pyspark.sql.window import Window

    m = M.curve_metrics(M.score_curve(_valid(spark, d), ["detector"]), ["detector"]).select("detector", F.round("auroc", 9).alias("x"))
    return m.select("detector", F.round("x", 6).alias("auroc"), (F.row_number().over(Window.orderBy(F.desc("x"), "detector")) - 1).cast("bigint").alias("place"))  # a row per detector


@query("D08_valid_rows", f"SELECT detector, count(*) AS rows, count(*) FILTER ({VALID}) AS valid_rows, count(*) FILTER (score_ai IS NULL OR isnan(score_ai) OR isinf(score_ai)) AS unscored FROM predictions GROUP BY detector")
def d08(spark, d):
    s = F.col("score_ai")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    return table(spark, d, "predictions").groupBy("detector").agg(F.count(F.lit(1)).alias("rows"), F.count_if(M.is_valid()).alias("valid_rows"), F.count_if(bad).alias("unscored"))
