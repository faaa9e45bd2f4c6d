"""Resampling, permutation and rank tests, corrections for many tests.

Random draws are hashes of seed, resample and item, so a result can be replayed anywhere and a lost executor changes nothing.
Thousands of draws per item are made in numpy, in Arrow batches: as rows they would be thousands of times the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from quern.operators.metrics import two_sided_p


#: Draws made by a task, and resamples and items held at a time.
TASK_DRAWS, BLOCK, ROWS, CHUNK, HELD = 1 << 28, 128, 4096, 512, 1 << 22
#: Steps of the distribution of Poisson(1), as 32-bit numbers: as many as that width can tell apart.
POISSON = tuple(np.uint32(s) for s in (int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(12)) if s < 2**32 - 1)


def _streams(count: int, salt: int) -> np.ndarray:
    """Offsets of the hashes of an item, one per draw or set of draws."""
    with np.errstate(over="ignore"):
        return _mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, in place."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def poisson_draws(items: np.ndarray, resamples: int, first: int, count: int) -> np.ndarray:
    """How often each item (its 64-bit hash) is drawn in the resamples ``first .. first + count - 1``: Poisson(1) by inversion (the limit of drawing n of n with replacement).

    Rows are items.  A hash holds two draws of 32 bits; ``first`` is even.
    """
    streams = _streams((resamples + 1) // 2, 1)[first // 2 : (first + count + 1) // 2]
    out = np.empty((len(items), 2 * len(streams)), dtype=np.uint8)
    for at in range(0, len(items), CHUNK):
        with np.errstate(over="ignore"):
            u = _mixed(items[at : at + CHUNK, None] + streams).view(np.uint32)
        w = out[at : at + CHUNK]
        np.greater_equal(u, POISSON[0], out=w.view(bool))
        for step in POISSON[1:]:
            w += u >= step
    return out[:, :count]


def sign_draws(items: np.ndarray, permutations: int, first: int, count: int) -> np.ndarray:
    """0 or 1 per item (rows) and permutation ``first .. first + count - 1``; a hash holds 64, ``first`` is a multiple of 64."""
    streams = _streams((permutations + 63) // 64, 2)[first // 64 : (first + count + 63) // 64]
    with np.errstate(over="ignore"):
        h = _mixed(items[:, None] + streams)
    return np.unpackbits(h.view(np.uint8), axis=1)[:, :count]


def _tasks(items: DataFrame, draws: int, task_draws: int) -> int:
    """Tasks for ``draws`` draws of each item: the work lies in the draws, however few bytes the items have."""
    return max(1, -(-items.count() * draws // task_draws))


def _parts(batches) -> pa.Table | None:
    got = list(batches)
    return pa.Table.from_batches(got) if got else None


def _drawn_sums(items: DataFrame, groups: list[str], draws: int, task_draws: int, draw) -> DataFrame:
    """``groups, b, s, w``: sums of ``_v`` weighted by ``draw`` and of the weights, per draw.  ``items`` has ``groups, _h, _v``; a task sends one row per group."""
    rows = items.withColumn("_g", F.xxhash64(*groups) if groups else F.lit(0).cast("bigint"))
    kept = [f for f in rows.schema.fields if f.name in groups]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _parts(batches)
        if t is None or not t.num_rows:
            return
        group, h, v = t["_g"].to_numpy(), t["_h"].to_numpy().view(np.uint64), t["_v"].to_numpy()
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            s, w = np.zeros(draws), np.zeros(draws)
            for part in (at[k : k + ROWS] for k in range(0, len(at), ROWS)):
                both = np.stack([v[part], np.ones(len(part))])
                for b in range(0, draws, BLOCK):
                    x = both @ draw(h[part], draws, b, min(BLOCK, draws - b)).astype(np.float64)
                    s[b : b + BLOCK] += x[0]
                    w[b : b + BLOCK] += x[1]
            one = pa.table({c: pa.array([x.tolist()], pa.list_(pa.float64())) for c, x in (("s", s), ("w", w))})
            for f in reversed(kept):
                one = one.add_column(0, t.schema.field(f.name), t[f.name].slice(at[0], 1))
            yield from one.to_batches()

    made = rows.repartition(_tasks(items, draws, task_draws), "_h").mapInArrow(sums, StructType([*kept, StructField("s", ArrayType(DoubleType())), StructField("w", ArrayType(DoubleType()))]))
    each = made.select(*groups, F.posexplode(F.arrays_zip("s", "w")).alias("b", "x"))
    return each.groupBy(*groups, "b").agg(F.sum("x.s").alias("s"), F.sum("x.w").alias("w"))


def _hash(seed: int, id_col: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))


def bootstrap_mean(items: DataFrame, groups: list[str], id_col: str, value: str, resamples: int = 200, seed: int = 42, task_draws: int = TASK_DRAWS) -> DataFrame:
    """``groups, mean, low, high``: bootstrap mean and the 2.5 and 97.5 percentiles of the resampled means."""
    rows = items.where(F.col(value).isNotNull()).select(*groups, _hash(seed, id_col).alias("_h"), F.col(value).cast("double").alias("_v"))
    per = _drawn_sums(rows, groups, resamples, task_draws, poisson_draws).where("w > 0").withColumn("m", F.col("s") / F.col("w"))
    return per.groupBy(*groups).agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def bootstrap_auroc(scored: DataFrame, keys: list[str], id_col: str, resamples: int = 100, seed: int = 42, label: str = "label", score: str = "score_ai", task_draws: int = TASK_DRAWS) -> DataFrame:
    """``keys, b, auroc`` with the same draws for all systems; resamples without both classes are left out.  Rows without label or score don't count.

    Exact over distinct scores, in two levels: a task holds a range of scores and sends, per resample, the drawn classes and the pairs in order of that range;
    what lies below the range is added after.  Ties at either end of a range may go on in the next and are sent apart, so that a score that many rows share
    is split over tasks.
    """
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        *keys, F.xxhash64(*keys).alias("_g") if keys else F.lit(0).cast("bigint").alias("_g"), (F.col(score) + 0.0).cast("double").alias("_s"), _hash(seed, id_col).alias("_h"), (F.col(label) == 1).alias("_y")
    )
    kept = [f for f in rows.schema.fields if f.name in keys]
    names = [*keys, "_g"]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _parts(batches)
        if t is None or not t.num_rows:
            return
        group, scores, h, y = t["_g"].to_numpy(), t["_s"].to_numpy(), t["_h"].to_numpy().view(np.uint64), t["_y"].to_numpy()
        for g in np.unique(group):
            mine = np.flatnonzero(group == g)
            mine = mine[np.argsort(scores[mine], kind="stable")]
            s = scores[mine]
            first, last = s == s[0], s == s[-1]
            for run, at in ((True, mine[first]), (False, mine[~first & ~last]), *([] if first[-1] else [(True, mine[last])])):
                if not len(at):
                    continue
                p, n, r = (np.zeros(resamples) for _ in range(3))
                yes, no = at[y[at]], at[~y[at]]
                low, high = (np.searchsorted(scores[no], scores[yes], side) for side in ("left", "right"))
                wide = max(2, min(BLOCK, HELD // max(1, len(at)) // 2 * 2))
                for b in range(0, resamples, wide):
                    k = min(wide, resamples - b)
                    wy, wn = poisson_draws(h[yes], resamples, b, k), poisson_draws(h[no], resamples, b, k)
                    p[b : b + k], n[b : b + k] = wy.sum(0, dtype=np.int64), wn.sum(0, dtype=np.int64)
                    if not run and len(yes) and len(no):
                        below = np.zeros((len(no) + 1, k), dtype=np.int32)
                        np.cumsum(wn, axis=0, dtype=np.int32, out=below[1:])
                        pairs = below[low]
                        pairs += below[high]
                        r[b : b + k] = np.einsum("ij,ij->j", pairs, wy, dtype=np.float64, casting="unsafe")
                one = pa.table({"_s": [float(scores[at[0]])], "run": [run]} | {c: pa.array([x.tolist()], pa.list_(pa.float64())) for c, x in (("p", p), ("n", n), ("r", r))})
                for c in reversed(names):
                    one = one.add_column(0, t.schema.field(c), t[c].slice(at[0], 1))
                yield from one.to_batches()

    numbers = [StructField(c, ArrayType(DoubleType())) for c in ("p", "n", "r")]
    made = rows.repartitionByRange(_tasks(rows, resamples, task_draws), "_g", "_s", "_h").mapInArrow(ranges, StructType([*kept, StructField("_g", LongType()), StructField("_s", DoubleType()), StructField("run", BooleanType()), *numbers]))
    each = made.select(*names, "_s", "run", F.posexplode(F.arrays_zip("p", "n", "r")).alias("b", "x"))
    runs = each.groupBy(*names, "b", "_s").agg(F.first("run").alias("run"), *[F.sum(f"x.{c}").alias(c) for c in "pnr"])
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*names, "b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = runs.withColumn("_r", F.when(F.col("run"), F.col("p") * F.col("n")).otherwise(F.col("r")) + 2 * F.col("p") * below)
    out = ranked.groupBy(*names, "b").agg(F.sum("_r").alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.where("p > 0 and n > 0").select(*keys, "b", (F.col("r") / (2 * F.col("p") * F.col("n"))).alias("auroc"))


def rank_stability(aurocs: DataFrame, system: str) -> DataFrame:
    """``system, mean_place, p_ahead``: mean place over the resamples, and how often the system beats the one that follows it on average."""
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("auroc"), system))
    ranks = aurocs.withColumn("place", place)
    mean = ranks.groupBy(system).agg(F.avg("place").alias("mean_place"))
    order = mean.withColumns({"next": F.lead(system).over(Window.orderBy("mean_place", system))})  # a row per system
    a = ranks.join(order, system).select("b", system, "next", "place", "mean_place")
    b = ranks.select("b", F.col(system).alias("next"), F.col("place").alias("other"))
    return a.join(b, ["b", "next"], "left").groupBy(system).agg(F.first("mean_place").alias("mean_place"), F.avg((F.col("place") < F.col("other")).cast("double")).alias("p_ahead"))


def sign_flip_test(items: DataFrame, groups: list[str], id_col: str, value: str, centre: float = 0.5, permutations: int = 500, seed: int = 7, task_draws: int = TASK_DRAWS) -> DataFrame:
    """``groups, p_value``: share of sign flips of ``value - centre`` whose mean is at least the observed one (one-sided)."""
    d = items.where(F.col(value).isNotNull()).select(*groups, _hash(seed, id_col).alias("_h"), (F.col(value) - centre).cast("double").alias("_v"))
    kept = _drawn_sums(d, groups, permutations, task_draws, sign_draws).withColumnRenamed("s", "up")
    seen = d.groupBy(*groups).agg(F.avg("_v").alias("seen"), F.sum("_v").alias("all"), F.count("_v").alias("n"))
    joined = kept.join(F.broadcast(seen), groups) if groups else kept.crossJoin(F.broadcast(seen))  # one row per group
    m = (2 * F.col("up") - F.col("all")) / F.col("n")
    return joined.groupBy(*groups).agg(F.avg((m >= F.col("seen") - 1e-12).cast("double")).alias("p_value"))


def wilcoxon_greater(items: DataFrame, groups: list[str], value: str, centre: float = 0.5) -> DataFrame:
    """``groups, n, w_plus, z, p_value``: one-sided signed-rank test by the normal approximation with tie correction; zeros are dropped."""
    d = items.withColumn("_d", F.round(F.col(value) - centre, 12)).where("_d != 0")
    ties = d.groupBy(*groups, F.abs("_d").alias("_a")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("_d") > 0).alias("up"))
    w = Window.partitionBy(*groups).orderBy("_a").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ties.withColumn("rank", F.sum("t").over(w) - F.col("t") + (F.col("t") + 1) / 2)
    g = ranked.groupBy(*groups).agg(F.sum("t").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48.0
    z = F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)).otherwise(F.lit(0.0))
    tail = two_sided_p(F.col("z")) / 2
    return g.withColumn("z", z).select(*groups, "n", "w_plus", "z", F.when(F.col("z") >= 0, tail).otherwise(1 - tail).alias("p_value"))


def effect_sizes(items: DataFrame, groups: list[str], value: str, centre: float = 0.5) -> DataFrame:
    """``groups, n, mean_diff, median_diff, sd, cohen_d, hedges_g, share_above``; d and g are null without spread."""
    d = items.withColumn("_d", F.col(value) - centre)
    g = d.groupBy(*groups).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_diff"), F.median("_d").alias("median_diff"), F.stddev_samp("_d").alias("sd"), F.avg((F.col("_d") > 0).cast("double")).alias("share_above"))
    cohen = F.when(F.col("sd") > 0, F.col("mean_diff") / F.col("sd"))
    return g.select(*groups, "n", "mean_diff", "median_diff", "sd", cohen.alias("cohen_d"), (cohen * (1 - 3.0 / (4 * F.col("n") - 1))).alias("hedges_g"), "share_above")


def benjamini_hochberg(tests: DataFrame, p: str, tie: list[str]) -> DataFrame:
    """Column ``p_bh``.  One row per test; there are few."""
    up = Window.orderBy(p, *tie)
    ranked = tests.withColumns({"_k": F.row_number().over(up), "_m": F.count(F.lit(1)).over(Window.partitionBy())})
    step = F.col(p) * F.col("_m") / F.col("_k")
    return ranked.withColumn("p_bh", F.least(F.lit(1.0), F.min(step).over(Window.orderBy("_k").rowsBetween(0, Window.unboundedFollowing)))).drop("_k", "_m")


def holm(tests: DataFrame, p: str, tie: list[str]) -> DataFrame:
    """Column ``p_holm``.  One row per test; there are few."""
    up = Window.orderBy(p, *tie)
    ranked = tests.withColumns({"_k": F.row_number().over(up), "_m": F.count(F.lit(1)).over(Window.partitionBy())})
    step = F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_k") + 1))
    return ranked.withColumn("p_holm", F.max(step).over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))).drop("_k", "_m")


def kendall_tau(ranks: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """One row ``tau`` of two rankings of the same few items; ties add nothing."""
    x, y = ranks.alias("x"), ranks.alias("y")
    pairs = x.join(y, F.col(f"x.{item}") < F.col(f"y.{item}"))  # items are systems: few
    agree = F.signum(F.col(f"x.{a}") - F.col(f"y.{a}")) * F.signum(F.col(f"x.{b}") - F.col(f"y.{b}"))
    return pairs.agg((F.sum(agree) / F.count(F.lit(1))).alias("tau"))


#: Numerator and denominator of the metrics that are ratios of counts, per row.
RATIOS = {
    "f1": (lambda y, p: 2 * (y & p), lambda y, p: 2 * (y & p) + (y ^ p)), "accuracy": (lambda y, p: 1 - (y ^ p), lambda y, p: y * 0 + 1), "precision": (lambda y, p: y & p, lambda y, p: p),
    "recall": (lambda y, p: y & p, lambda y, p: y), "specificity": (lambda y, p: (1 - y) & (1 - p), lambda y, p: 1 - y),
}


def bootstrap_confusion(scored: DataFrame, groups: list[str], id_col: str, resamples: int, metric: str = "f1", threshold: float = 0.5, seed: int = 42, label: str = "label", score: str = "score_ai") -> DataFrame:
    """``groups, mean, low, high`` of a metric in RATIOS over resamples; resamples where it isn't defined are left out.  Numerator and denominator share their draws."""
    y, p = (F.col(label) == 1).cast("int"), (F.col(score) >= threshold).cast("int")
    over = [lambda a, b, f=f: f(a, b) for f in RATIOS[metric]]
    bit = lambda f: f(_Bits(y), _Bits(p)).c.cast("double")
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*groups, _hash(seed, id_col).alias("_h"), bit(over[0]).alias("_a"), bit(over[1]).alias("_b"))
    top = _drawn_sums(rows.withColumnRenamed("_a", "_v").drop("_b"), groups, resamples, TASK_DRAWS, poisson_draws).select(*groups, "b", F.col("s").alias("top"))
    low = _drawn_sums(rows.withColumnRenamed("_b", "_v").drop("_a"), groups, resamples, TASK_DRAWS, poisson_draws).select(*groups, "b", F.col("s").alias("under"))
    per = top.join(low, [*groups, "b"]).where("under > 0").withColumn("m", F.col("top") / F.col("under"))
    return per.groupBy(*groups).agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


class _Bits:
    """0/1 columns with the operators RATIOS uses."""

    def __init__(self, c: Column):
        self.c = c

    def _of(self, other, f):
        return _Bits(f(self.c, other.c if isinstance(other, _Bits) else F.lit(other)))

    def __and__(self, o):
        return self._of(o, lambda a, b: a * b)

    def __xor__(self, o):
        return self._of(o, lambda a, b: F.abs(a - b))

    def __add__(self, o):
        return self._of(o, lambda a, b: a + b)

    def __rsub__(self, o):
        return self._of(o, lambda a, b: b - a)

    def __mul__(self, o):
        return self._of(o, lambda a, b: a * b)

    __rmul__ = __mul__


def bootstrap_tpr(scored: DataFrame, keys: list[str], id_col: str, resamples: int, target: float = 0.01, seed: int = 42, slice_rows: int = 4096, label: str = "label", score: str = "score_ai") -> DataFrame:
    """``keys, b, tpr``: the highest true-positive rate with a false-positive rate within ``target`` in each resample; resamples without both classes are left out.

    Exact, in two levels: slices of the scores (ties in one) send their drawn classes; only the slice where a resample passes the target is opened by score, for that resample.
    Sums of a slice add up over parts of it, so a score that many rows share is split over tasks.
    """
    import pandas as pd

    from quern.operators.ranks import positions

    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.struct(*keys).alias("k"), (-(F.col(score) + 0.0)).alias("s"), _hash(seed, id_col).alias("h"), (F.col(label) == 1).cast("int").alias("y"))
    ties = positions(rows.groupBy("k", "s").agg(F.count(F.lit(1)).alias("c")), ["s"], ["k"])  # distinct scores, the highest first
    sliced = rows.join(ties.select("k", "s", F.floor(F.col("position") / slice_rows).alias("slice")), ["k", "s"])
    parts = sliced.groupBy("k", "slice").agg(F.ceil(F.count(F.lit(1)) / (4 * slice_rows)).alias("parts"))
    parted = sliced.join(parts, ["k", "slice"]).withColumn("part", F.pmod("h", "parts")).drop("parts")
    kind = rows.schema["k"].dataType.simpleString()

    def draws(f: pd.DataFrame) -> np.ndarray:
        return poisson_draws(f["h"].to_numpy().view(np.uint64), resamples, 0, resamples)

    def totals(key, f):
        w, y = draws(f), f["y"].to_numpy() == 1
        return pd.DataFrame({"slice": key[1], "b": np.arange(resamples), "p": w[y].sum(0, dtype=np.int64), "n": w[~y].sum(0, dtype=np.int64)}).assign(k=[key[0]] * resamples)

    each = parted.groupBy("k", "slice", "part").applyInPandas(totals, f"slice bigint, b bigint, p bigint, n bigint, k {kind}").groupBy("k", "slice", "b").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    run, whole = Window.partitionBy("k", "b").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("k", "b")
    cum = each.withColumns({"cp": F.sum("p").over(run), "cn": F.sum("n").over(run), "pos": F.sum("p").over(whole), "neg": F.sum("n").over(whole)}).where("pos > 0 and neg > 0")
    cross = cum.where(F.col("cn") / F.col("neg") > target).groupBy("k", "b").agg(F.min_by(F.struct("slice", (F.col("cp") - F.col("p")).alias("bp"), (F.col("cn") - F.col("n")).alias("bn"), "pos", "neg"), "slice").alias("x")).select("k", "b", "x.*")
    wanted = cross.groupBy("k", "slice").agg(F.collect_list(F.col("b").cast("int")).alias("bs"))  # at most one entry per resample

    def by_score(key, f):
        bs = np.array(f["bs"].iloc[0])
        w, y = draws(f)[:, bs].astype(np.int64), f["y"].to_numpy() == 1
        out = []
        for s, at in f.groupby("s").indices.items():
            out.append(pd.DataFrame({"slice": key[1], "s": s, "b": bs, "p": w[at][y[at]].sum(0), "n": w[at][~y[at]].sum(0)}))
        r = pd.concat(out)
        return r.assign(k=[key[0]] * len(r))

    opened = parted.join(wanted, ["k", "slice"]).groupBy("k", "slice", "part").applyInPandas(by_score, f"slice bigint, s double, b bigint, p bigint, n bigint, k {kind}").groupBy("k", "slice", "s", "b").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    up = Window.partitionBy("k", "b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    curve = opened.join(cross, ["k", "slice", "b"]).withColumns({"tp": F.col("bp") + F.sum("p").over(up), "fp": F.col("bn") + F.sum("n").over(up)})
    inside = curve.groupBy("k", "b").agg(F.max(F.when(F.col("fp") / F.col("neg") <= target, F.col("tp") / F.col("pos")).otherwise(F.when(F.col("bn") / F.col("neg") <= target, F.col("bp") / F.col("pos")).otherwise(0.0))).alias("tpr"))
    every = cum.groupBy("k", "b").agg(F.max("neg").alias("neg"))
    out = every.join(inside, ["k", "b"], "left").select("k", "b", F.coalesce("tpr", F.lit(1.0)).alias("tpr"))
    return out.select("k.*", "b", "tpr")


def mean_tau(aurocs: DataFrame, point: DataFrame, system: str) -> DataFrame:
    """One row ``tau``: mean over resamples of Kendall's tau between the resample's order of the (few) systems and that of ``point`` (``system, auroc``)."""
    ranked = aurocs.join(point.select(system, F.col("auroc").alias("_o")), system).select("b", F.col(system).alias("_s"), "auroc", "_o")
    x, y = ranked.alias("x"), ranked.alias("y")
    pairs = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x._s") < F.col("y._s")))
    agree = F.signum(F.col("x.auroc") - F.col("y.auroc")) * F.signum(F.col("x._o") - F.col("y._o"))
    return pairs.groupBy("x.b").agg(F.avg(agree).alias("t")).agg(F.avg("t").alias("tau"))


def judge_summary(rates: DataFrame, resamples: int, seed: int = 7) -> DataFrame:
    """One row per judge, one for the panel (mean over judges) and one for the consensus: documents, mean rate with interval, permutation and signed-rank p, their Holm correction over the judges, share of agreement."""
    from quern.operators.duels import panel

    p = panel(rates)
    units = rates.select(F.col("judge_id").alias("unit"), "doc_id", "win_rate").unionByName(p.select(F.lit("(panel)").alias("unit"), "doc_id", F.col("panel_rate").alias("win_rate"))).unionByName(p.select(F.lit("(consensus)").alias("unit"), "doc_id", F.col("consensus").alias("win_rate")))
    keyed = units.withColumn("item", F.concat_ws("|", "unit", "doc_id"))
    interval = bootstrap_mean(keyed, ["unit"], "item", "win_rate", resamples).select("unit", "low", "high")
    flips = sign_flip_test(keyed, ["unit"], "item", "win_rate", permutations=resamples, seed=seed).select("unit", F.col("p_value").alias("permutation_p"))
    ranks = wilcoxon_greater(units, ["unit"], "win_rate").select("unit", F.col("p_value").alias("wilcoxon_p"))
    means = units.groupBy("unit").agg(F.count(F.lit(1)).alias("documents"), F.avg("win_rate").alias("rate"))
    agree = p.agg(F.avg((F.col("consensus") != 0.5).cast("double")).alias("agreement"))
    out = means.join(interval, "unit").join(flips, "unit").join(ranks, "unit", "left").withColumn("wilcoxon_p", F.coalesce("wilcoxon_p", F.lit(1.0)))
    judges = out.where("unit not like '(%'")
    a = holm(judges, "permutation_p", ["unit"]).select("unit", F.col("p_holm").alias("permutation_holm"))
    b = holm(judges, "wilcoxon_p", ["unit"]).select("unit", F.col("p_holm").alias("wilcoxon_holm"))
    return out.join(a, "unit", "left").join(b, "unit", "left").crossJoin(F.broadcast(agree))  # one row


def threshold_policies(validation: DataFrame, keys: list[str], fpr: float = 0.01) -> DataFrame:
    """``keys, fixed, f1, fpr01``: the fixed threshold, the one with the best F1, and the lowest within a false-positive rate (infinity where none is)."""
    from quern.operators.metrics import best_f1_threshold, threshold_at_fpr

    best = best_f1_threshold(validation, keys).select(*keys, F.col("threshold").alias("f1"))
    low = threshold_at_fpr(validation, keys, fpr).select(*keys, F.col("threshold").alias("_t"))
    return best.join(low, keys, "left").select(*keys, F.lit(0.5).alias("fixed"), "f1", F.coalesce("_t", F.lit(float("inf"))).alias("fpr01"))


def records_at_policies(test: DataFrame, validation: DataFrame, keys: list[str], label: str = "label", score: str = "score_ai") -> DataFrame:
    """``keys, policy, threshold, tp, fp, tn, fn`` of the test rows at the thresholds that the validation rows give."""
    th = threshold_policies(validation, keys)
    long = th.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("policy"), F.col(c).alias("threshold")) for c in ("fixed", "f1", "fpr01")])).alias("x")).select(*keys, "x.*")
    y, p = F.col(label) == 1, F.col(score) >= F.col("threshold")
    rows = test.select(*keys, label, score).join(long, keys)
    return rows.groupBy(*keys, "policy", "threshold").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
