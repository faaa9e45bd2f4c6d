import numpy as np
import pytest

from quern.operators import metrics as M


def frame(spark, scores, labels, errors=None):
    rows = [(f"i{k}", "g", None if s is None else float(s), None if y is None else int(y), None if errors is None else errors[k]) for k, (s, y) in enumerate(zip(scores, labels, strict=True))]
    return spark.createDataFrame(rows, "id string, grp string, score_ai double, label int, error string")


def brute_auroc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()


def test_curves_with_ties_against_brute_force(spark):
    rng = np.random.default_rng(0)
    s = np.round(rng.random(400) * 1.2 - 0.1, 2)
    y = (rng.random(400) < 0.3 + 0.4 * s.clip(0, 1)).astype(int)
    m = M.binary_metrics(frame(spark, s, y), ["grp"]).first()
    assert m["auroc"] == pytest.approx(brute_auroc(s, y))
    tp = sum((s >= 0.5) & (y == 1))
    assert (m["tp"], m["fn"]) == (tp, y.sum() - tp)
    best = 0.0
    for t in np.unique(s):
        if ((s >= t) & (y == 0)).sum() / (y == 0).sum() <= 0.05:
            best = max(best, ((s >= t) & (y == 1)).sum() / y.sum())
    assert m["tpr_at_fpr_05"] == pytest.approx(best)
    assert m["brier"] == pytest.approx(((s.clip(0, 1) - y) ** 2).mean())


def test_invalid_rows_and_one_class(spark):
    df = frame(spark, [0.1, 0.9, None, float("nan"), float("inf"), 0.4, 0.5], [1, 1, 1, 1, 1, None, 1], [None, "", None, None, None, None, "boom"])
    m = M.binary_metrics(df, ["grp"]).first()
    assert (m["n_total"], m["n_scored"], m["n_errors"]) == (7, 2, 1)
    assert m["auroc"] is None and m["recall"] == 0.5 and m["specificity"] == 0.0
    assert M.binary_metrics(df.limit(0), ["grp"]).count() == 0


def test_delong_variance_against_pairs(spark):
    rng = np.random.default_rng(2)
    s, y = np.round(rng.random(120), 1), rng.integers(0, 2, 120)
    got = M.delong_variance(frame(spark, s, y), ["grp"], "id").first()
    pos, neg = s[y == 1], s[y == 0]
    psi = (pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])
    want = psi.mean(axis=1).var(ddof=1) / len(pos) + psi.mean(axis=0).var(ddof=1) / len(neg)
    assert got["variance"] == pytest.approx(want)


def test_normal_tail(spark):
    import math

    from pyspark.sql import functions as F

    zs = [0.0, 0.3, -1.0, 1.96, 3.5, 6.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", M.two_sided_p(F.col("z")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=2e-7)


def test_roc_drops_points_on_a_line(spark):
    df = frame(spark, [0.9, 0.8, 0.7, 0.6], [1, 1, 0, 0])
    rows = M.roc_points(df, ["grp"]).orderBy("fpr", "tpr").collect()
    assert [(r["fpr"], r["tpr"]) for r in rows] == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]
