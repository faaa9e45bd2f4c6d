import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import inference as I
from quern.operators import ranks as R
from quern.operators import samplers as S


def items(spark, values):
    return spark.createDataFrame([(f"d{k}", "g", float(v)) for k, v in enumerate(values)], "id string, grp string, v double")


def test_bootstrap_interval(spark):
    v = np.random.default_rng(0).normal(0.6, 0.2, 300)
    r = I.bootstrap_mean(items(spark, v), ["grp"], "id", "v", 300, 1).first()
    se = v.std() / np.sqrt(300)
    assert abs(r["mean"] - v.mean()) < 0.3 * se
    assert r["high"] - r["low"] == pytest.approx(2 * 1.96 * se, rel=0.2)


def test_bootstrap_auroc_centres_on_the_estimate(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    s = np.clip(0.5 + 0.2 * (y - 0.5) + rng.normal(0, 0.2, 400), 0, 0.999)
    df = spark.createDataFrame([(f"i{k}", "g", int(a), float(b)) for k, (a, b) in enumerate(zip(y, s, strict=True))], "id string, grp string, label int, score_ai double")
    out = I.bootstrap_auroc(df, ["grp"], "id", 60, 3).agg(F.avg("auroc"), F.count("auroc")).first()
    pos, neg = s[y == 1], s[y == 0]
    assert out[1] == 60 and out[0] == pytest.approx((pos[:, None] > neg[None, :]).mean(), abs=0.01)


def test_wilcoxon_and_sign_flips(spark):
    v = [0.5, 0.6, 0.7, 0.4, 0.9, 0.8, 0.55, 0.65, 0.7, 0.45, 0.75, 0.6]
    r = I.wilcoxon_greater(items(spark, v), ["grp"], "v").first()
    d = np.round(np.array(v) - 0.5, 12)
    d = d[d != 0]
    order = np.abs(d)
    rank = np.array([(order < x).sum() + ((order == x).sum() + 1) / 2 for x in order])
    assert r["w_plus"] == rank[d > 0].sum() and r["n"] == len(d) and r["p_value"] < 0.05
    p = I.sign_flip_test(items(spark, v), ["grp"], "id", "v", permutations=400).first()["p_value"]
    assert 0 < p < 0.05


def test_corrections(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "t string, p double")
    got = {r["t"]: (r["p_holm"], r["p_bh"]) for r in I.benjamini_hochberg(I.holm(df, "p", ["t"]), "p", ["t"]).collect()}
    want = {"a": (0.04, 0.04), "c": (0.09, 0.16 / 3), "b": (0.09, 0.16 / 3), "d": (0.5, 0.5)}
    for t, pair in want.items():
        assert got[t] == pytest.approx(pair)


def test_ema_equals_the_fold(spark):
    rows = [("x", k, float(k % 7)) for k in range(50)] + [("y", 0, 3.0)]
    got = {r["k"]: r["ema"] for r in R.ordered_ema(spark.createDataFrame(rows, "k string, t int, v double"), "k", ["t"], "v", 0.2, 0.5).collect()}
    ema = 0.5
    for k in range(50):
        ema = 0.8 * ema + 0.2 * (k % 7)
    assert got["x"] == pytest.approx(ema) and got["y"] == pytest.approx(0.8 * 0.5 + 0.2 * 3)


def test_global_position(spark):
    import random

    ids = [f"{random.Random(k).getrandbits(40):010x}" for k in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(4)
    got = {r["id"]: r["position"] for r in R.global_position(df, ["id"]).collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}
    nums = spark.createDataFrame([((k * 37) % 101, k) for k in range(300)], "x int, k int")
    got = {r["k"]: r["position"] for r in R.global_position(nums, ["x", "k"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda p: p[1])] == sorted(range(300), key=lambda k: ((k * 37) % 101, k))


def test_sampler_weights(spark):
    st = spark.createDataFrame([("a", 0.2, 0.0), ("b", 0.1, 1.0), ("c", 0.1, 0.5)], "k string, raw double, hard double")
    w = S.softmax_with_floor(st, "raw", 2.0, 0.3)
    rows = {r["k"]: r["weight"] for r in w.collect()}
    assert sum(rows.values()) == pytest.approx(1) and min(rows.values()) >= 0.1 and rows["a"] > rows["b"]
    c = {r["k"]: r["weight"] for r in S.curriculum(w, "weight", "hard", 1.0, 4.0).collect()}
    assert sum(c.values()) == pytest.approx(1) and c["b"] > c["a"]
    draws = S.weighted_draws(w, "k", "weight", 2000, 5).groupBy("k").count().collect()
    assert sum(r["count"] for r in draws) == 2000
    assert all(abs(r["count"] / 2000 - rows[r["k"]]) < 0.05 for r in draws)
    obs = spark.createDataFrame([("u1", 1, 0.5), ("u2", 2, 0.1), ("u3", 3, 0.9), ("u1", 4, 0.7)], "u string, t int, v double")
    assert {r["u"] for r in S.fifo_pool(obs, "u", ["t"], "v", 0.5, 2).collect()} == {"u2", "u3"}


def test_bootstrap_auroc_is_exact_for_saturated_scores_and_ties(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    saturated = 1 - 1e-6 * (2 - y) - 1e-8 * rng.random(300)  # all within 1/2048 of 1, and perfectly ordered
    tied = np.where(rng.random(300) < 0.4, 1.0, rng.integers(0, 30, 300) / 1e5)
    rows = [(f"i{k}", g, int(a), float(b)) for g, s in (("sat", saturated), ("tied", tied)) for k, (a, b) in enumerate(zip(y, s, strict=True))]
    df = spark.createDataFrame(rows, "id string, grp string, label int, score_ai double")
    h = {r["id"]: r["h"] for r in df.select("id", F.xxhash64(F.lit(3), "id").alias("h")).collect()}
    w = I.poisson_draws(np.array([h[f"i{k}"] for k in range(300)]).view(np.uint64), 41, 0, 41).astype(float)
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1
    for task_draws in (1 << 28, 41 * 50):  # one task, and some twelve
        got = {(r["grp"], r["b"]): r["auroc"] for r in I.bootstrap_auroc(df, ["grp"], "id", 41, 3, task_draws=task_draws).collect()}
        for g, s in (("sat", saturated), ("tied", tied)):
            pos, neg = s[y == 1][:, None], s[y == 0][None, :]
            won = (pos > neg) + 0.5 * (pos == neg)
            for b in range(41):
                wp, wn = w[y == 1, b], w[y == 0, b]
                assert got[g, b] == pytest.approx(wp @ won @ wn / (wp.sum() * wn.sum()), abs=1e-12)


def test_draws_do_not_depend_on_the_tasks(spark):
    v = items(spark, np.random.default_rng(2).normal(0.52, 0.2, 90))
    for f in (I.bootstrap_mean, I.sign_flip_test):
        one, many = (f(v, ["grp"], "id", "v", 0.5, 333, 5, task_draws=t).first() if f is I.sign_flip_test else f(v, ["grp"], "id", "v", 333, 5, task_draws=t).first() for t in (1 << 28, 3330))
        assert list(one)[1:] == pytest.approx(list(many)[1:])


def test_queries_resample_as_often_as_the_reference(spark, small, monkeypatch):
    from quern.plans import QUERIES

    seen = []
    draws = I._tasks
    monkeypatch.setattr(I, "_tasks", lambda rows, n, most: seen.append(n) or draws(rows, n, most))
    for name in ("M02_bootstrap_auroc", "K03_rank_stability", "M09_bootstrap_win_rate", "M10_sign_flips"):
        QUERIES[name](spark, small)
    assert seen == [10_000] * 4
