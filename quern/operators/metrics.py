"""Classification and calibration metrics of scores against binary labels, by any grouping columns.

Everything follows from counts per distinct score and their running sums from the highest score down.  Running sums are taken in two
levels - within a slice of the score range, plus what lies above the slice - so that no task has to sort all scores of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Inner edges of ten equal bins on [0, 1], as doubles.
BIN_EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)
FPR_TARGETS = {"001": 0.001, "005": 0.005, "01": 0.01, "05": 0.05}
TPR_TARGETS = {"80": 0.80, "90": 0.90, "95": 0.95}
SLICES = 1024


def is_valid(label: str = "label", score: str = "score_ai", error: str = "error") -> Column:
    """Label and score are known, the score is finite and there was no error."""
    s = F.col(score)
    return F.col(label).isNotNull() & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf")) & (F.coalesce(F.col(error), F.lit("")) == "")


def score_counts(scored: DataFrame, keys: list[str], label: str = "label", score: str = "score_ai") -> DataFrame:
    """``keys, score, pos, neg`` per distinct score of valid rows."""
    return scored.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def score_curve(scored: DataFrame, keys: list[str], label: str = "label", score: str = "score_ai") -> DataFrame:
    """``score_counts`` with ``tp, fp`` (rows with at least this score) and ``p, n`` (all rows of the group)."""
    counts = score_counts(scored, keys, label, score).withColumn("slice", F.greatest(F.lit(-1), F.least(F.lit(SLICES), F.floor(F.col("score") * SLICES))))
    by_slice = counts.groupBy(*keys, "slice").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))
    above = Window.partitionBy(*keys).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)  # at most SLICES + 2 rows
    whole = Window.partitionBy(*keys)
    offsets = by_slice.select(
        *keys, "slice", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("an"), F.sum("sp").over(whole).alias("p"), F.sum("sn").over(whole).alias("n")
    )
    joined = _joined([counts, offsets], [*keys, "slice"])
    down = Window.partitionBy(*keys, "slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*keys, "score", "pos", "neg", (F.col("ap") + F.sum("pos").over(down)).alias("tp"), (F.col("an") + F.sum("neg").over(down)).alias("fp"), "p", "n")


def _share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def curve_metrics(curve: DataFrame, keys: list[str]) -> DataFrame:
    """AUROC, average precision, TPR at FPR targets and FPR at TPR targets; null where a group has one class only."""
    tpr, fpr = F.col("tp") / F.col("p"), F.col("fp") / F.col("n")
    two = (F.col("p") > 0) & (F.col("n") > 0)
    both = curve.where(two)
    rank = F.col("pos") * ((F.col("n") - F.col("fp")) + 0.5 * F.col("neg"))
    return both.groupBy(*keys).agg(
        (F.sum(rank) / (F.first("p") * F.first("n"))).alias("auroc"),
        F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("auprc"),
        *[F.coalesce(F.max(F.when(fpr <= t, tpr)), F.lit(0.0)).alias(f"tpr_at_fpr_{k}") for k, t in FPR_TARGETS.items()],
        *[F.coalesce(F.min(F.when(tpr >= t, fpr)), F.lit(1.0)).alias(f"fpr_at_tpr_{k}") for k, t in TPR_TARGETS.items()],
    )


def threshold_metrics(scored: DataFrame, keys: list[str], threshold: float = 0.5, label: str = "label", score: str = "score_ai") -> DataFrame:
    """Confusion counts at ``score >= threshold`` and what follows from them; a share with nothing below the line is 0."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    c = scored.groupBy(*keys).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    recall, specificity, precision = _share(tp, tp + fn), _share(tn, tn + fp), _share(tp, tp + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        *keys, "tp", "fp", "tn", "fn",
        _share(tp + tn, tp + fp + tn + fn).alias("accuracy"), ((recall + specificity) / 2).alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"),
        specificity.alias("specificity"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"), _share(tp * tn - fp * fn, root).alias("mcc"),
    )


def calibration_bins(scored: DataFrame, keys: list[str], label: str = "label", score: str = "score_ai") -> DataFrame:
    """``keys, bin, rows, confidence, accuracy`` over ten equal bins of the clipped score, the last one closed."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score)))
    at = sum(((s >= e).cast("int") for e in BIN_EDGES[1:]), (s >= BIN_EDGES[0]).cast("int"))
    return scored.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg(s).alias("confidence"), F.avg((F.col(label) == 1).cast("double")).alias("accuracy"))


def expected_calibration_error(scored: DataFrame, keys: list[str], label: str = "label", score: str = "score_ai") -> DataFrame:
    bins = calibration_bins(scored, keys, label, score)
    return bins.groupBy(*keys).agg((F.sum(F.col("rows") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("rows")).alias("ece"))


def _joined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left joins on keys that may be null."""
    out = parts[0]
    for p in parts[1:]:
        r = p.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in p.columns if c not in keys])
        cond = [out[k].eqNullSafe(r[f"_{k}"]) for k in keys]
        out = out.join(r, cond, "left").drop(*[f"_{k}" for k in keys])
    return out


def binary_metrics(predictions: DataFrame, keys: list[str], threshold: float = 0.5, label: str = "label", score: str = "score_ai", error: str = "error") -> DataFrame:
    """The whole suite by ``keys``: counts, score moments, curve, threshold and calibration metrics.

    Rows that aren't valid count in ``n_total`` only (with an error in ``n_errors``); curve metrics are null where one class is missing.
    """
    ok = is_valid(label, score, error)
    s = F.when(ok, F.col(score))
    clipped = F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))  # greatest() skips nulls
    totals = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_scored"), F.count_if(F.coalesce(F.col(error), F.lit("")) != "").alias("n_errors"),
        F.avg(s).alias("score_mean"), F.stddev_pop(s).alias("score_std"), F.min(s).alias("score_min"), F.max(s).alias("score_max"),
        F.avg((clipped - F.col(label)) ** 2).alias("brier"),
    )
    valid = predictions.where(ok)
    curve = curve_metrics(score_curve(valid, keys, label, score), keys)
    return _joined([totals, curve, threshold_metrics(valid, keys, threshold, label, score), expected_calibration_error(valid, keys, label, score)], keys)


def roc_points(scored: DataFrame, keys: list[str], label: str = "label", score: str = "score_ai") -> DataFrame:
    """``keys, fpr, tpr, threshold``: the origin (threshold infinity) and the distinct scores, without points on a straight line between their neighbours."""
    curve = score_curve(scored, keys, label, score).where("p > 0 and n > 0")
    points = curve.select(*keys, "tp", "fp", "p", "n", "score")
    origin = curve.select(*keys, F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), "p", "n", F.lit(float("inf")).alias("score")).distinct()
    w = Window.partitionBy(*keys).orderBy(F.desc("score"))
    everything = points.unionByName(origin).withColumns({"ptp": F.lag("tp").over(w), "pfp": F.lag("fp").over(w), "ntp": F.lead("tp").over(w), "nfp": F.lead("fp").over(w)})
    straight = (F.col("tp") - F.col("ptp")) * (F.col("nfp") - F.col("fp")) == (F.col("ntp") - F.col("tp")) * (F.col("fp") - F.col("pfp"))
    kept = everything.where(F.col("ptp").isNull() | F.col("ntp").isNull() | ~straight)
    return kept.select(*keys, (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"), F.col("score").alias("threshold"))


def best_f1_threshold(scored: DataFrame, keys: list[str], label: str = "label", score: str = "score_ai") -> DataFrame:
    """``keys, threshold, f1``: the highest score with the best F1; 0.5 with a null F1 where a class is missing."""
    curve = score_curve(scored, keys, label, score)
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p")), 12)
    best = curve.groupBy(*keys).agg(F.max_by(F.col("score"), F.struct(f1, F.col("score"))).alias("t"), F.max(f1).alias("f"), F.max("p").alias("p"), F.max("n").alias("n"))
    two = (F.col("p") > 0) & (F.col("n") > 0)
    return best.select(*keys, F.when(two, F.col("t")).otherwise(F.lit(0.5)).alias("threshold"), F.when(two, F.col("f")).alias("f1"))


def threshold_at_fpr(scored: DataFrame, keys: list[str], target: float = 0.01, label: str = "label", score: str = "score_ai") -> DataFrame:
    """``keys, threshold``: the lowest score whose false-positive rate is within ``target``; infinity where none is."""
    curve = score_curve(scored, keys, label, score).where("p > 0 and n > 0")
    return curve.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("fp") / F.col("n") <= target, F.col("score"))), F.lit(float("inf"))).alias("threshold"))


def placements(scored: DataFrame, keys: list[str], id_col: str, label: str = "label", score: str = "score_ai") -> DataFrame:
    """``keys, id, label, v``: for a positive the share of negatives below it, for a negative the share of positives above, ties by half."""
    curve = score_curve(scored, keys, label, score)
    below = (F.col("n") - F.col("fp") + 0.5 * F.col("neg")) / F.col("n")
    over = (F.col("tp") - F.col("pos") + 0.5 * F.col("pos")) / F.col("p")
    c = curve.select(*keys, F.col("score").alias("_s"), below.alias("below"), over.alias("over"))
    rows = scored.select(*keys, F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(score).alias("_s"))
    return rows.join(c, [*keys, "_s"]).select(*keys, "id", "label", F.when(F.col("label") == 1, F.col("below")).otherwise(F.col("over")).alias("v"))


def delong_variance(scored: DataFrame, keys: list[str], id_col: str, label: str = "label", score: str = "score_ai") -> DataFrame:
    """``keys, auroc, variance`` by DeLong's placements."""
    v = placements(scored, keys, id_col, label, score)
    pos, neg = F.when(F.col("label") == 1, F.col("v")), F.when(F.col("label") != 1, F.col("v"))
    return v.groupBy(*keys).agg(F.avg(pos).alias("auroc"), (F.var_samp(pos) / F.count(pos) + F.var_samp(neg) / F.count(neg)).alias("variance"))


def delong_pairs(scored: DataFrame, system: str, id_col: str, label: str = "label", score: str = "score_ai") -> DataFrame:
    """Two-sided DeLong tests of all pairs of systems on the items both scored: ``a, b, auroc_a, auroc_b, z, p_value``; p is 1 without variance.

    ``scored`` has one row per system and item.
    """
    both = scored.select(F.col(system).alias("system"), F.col(id_col).alias("item"), F.col(label).alias("label"), F.col(score).alias("score"))
    x, y = both.alias("x"), both.alias("y")
    shared = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.system") < F.col("y.system")))
    side = lambda t: shared.select(F.col("x.system").alias("a"), F.col("y.system").alias("b"), F.col("x.item").alias("item"), F.col("x.label").alias("label"), F.col(f"{t}.score").alias("score"))
    va, vb = (placements(side(t), ["a", "b"], "item", "label", "score").withColumnRenamed("v", f"v{t}") for t in "xy")
    v = va.join(vb, ["a", "b", "id", "label"])
    pos = lambda c: F.when(F.col("label") == 1, F.col(c))
    neg = lambda c: F.when(F.col("label") != 1, F.col(c))
    spread = lambda f: (F.var_samp(f("vx")) + F.var_samp(f("vy")) - 2 * F.covar_samp(f("vx"), f("vy"))) / F.count(f("vx"))
    g = v.groupBy("a", "b").agg(F.avg(pos("vx")).alias("auroc_a"), F.avg(pos("vy")).alias("auroc_b"), (spread(pos) + spread(neg)).alias("var"))
    z = F.when(F.col("var") > 0, (F.col("auroc_a") - F.col("auroc_b")) / F.sqrt("var")).otherwise(F.lit(0.0))
    return g.withColumn("z", z).select("a", "b", "auroc_a", "auroc_b", "z", two_sided_p(F.col("z")).alias("p_value"))


def two_sided_p(z: Column) -> Column:
    """erfc(|z| / sqrt 2) by a continued rational approximation in plain arithmetic (error under 1.2e-7 relative), so that it stays in the JVM."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x - 1.26551223 + t * poly)
