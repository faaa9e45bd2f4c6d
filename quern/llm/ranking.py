"""One ranking of all contestants from many small rankings: weighted least squares on the comparison graph.

Rankings become comparisons, comparisons edges with a log-odds margin and a weight, and the strengths solve
the graph's Laplacian system by conjugate gradient.  Margins of edges with few comparisons are poor, so the system is solved
again with margins and weights taken at the strengths found (the normal equations of paired comparison), until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import checkpoint

#: Rankings of at most REACH + 1 items are compared item by item, longer ones by counts in slices of some SLICE items.
REACH, SLICE = 12, 256
#: Edges up to which the system is solved on the driver (32 bytes each); beyond, each product with the Laplacian is a Spark job.
LOCAL_EDGES = 4_000_000
#: Solves after which strengths that still move are an error, and the most a solve moves a strength (their end doesn't depend on it).
SOLVES, STRIDE = 500, 4.0
#: Weight of a virtual comparison with an average contestant, won and lost once each; keeps those without a loss finite.
PRIOR = 0.3


def clean_rankings(judgments: DataFrame) -> DataFrame:
    """``doc_id, judge_id, item_id, source_id, position`` with one row per item of a ranking.

    Rows without document, judge, item or source are left out, and those with neither a rank nor a score within 0..1; spellings of ``item_id``
    are brought together; of an item delivered more than once the latest row counts.  ``rank`` decides unless it runs against
    ``quality_score`` over the whole ranking: then it was written upside down, and the scores decide.  An item without the
    one that decides takes its place by the other, behind all items that are at least as good by it.  Repeated ranks stay ties.
    """
    item = F.regexp_replace(F.upper(F.col("item_id")), r"[^A-Z0-9]", "")
    quality = F.when(F.col("quality_score").between(0, 1), F.col("quality_score"))
    rows = judgments.select("doc_id", F.lower(F.trim("judge_id")).alias("judge_id"), item.alias("item_id"), F.trim("source_id").alias("source_id"), F.col("rank").cast("double").alias("rank"), quality.alias("quality"), "judged_at")
    rows = rows.where("doc_id is not null and judge_id is not null and source_id is not null and item_id != '' and (rank is not null or quality is not null)")
    # One shuffle brings a ranking together for what follows; its items hardly combine before it.
    latest = rows.repartition("doc_id", "judge_id").groupBy("doc_id", "judge_id", "item_id").agg(F.max(F.struct(F.coalesce("judged_at", F.lit("1970-01-01").cast("timestamp")).alias("at"), "rank", "quality", "source_id")).alias("m"))
    flat = latest.select("doc_id", "judge_id", "item_id", "m.source_id", "m.rank", "m.quality")
    ranking = Window.partitionBy("doc_id", "judge_id")
    both = F.col("quality").isNotNull() & F.col("rank").isNotNull()
    ranked, scored = F.when(both, F.col("rank")), F.when(both, F.col("quality"))
    spread = F.stddev_pop(ranked).over(ranking) * F.stddev_pop(scored).over(ranking)
    agree = F.try_divide(F.covar_pop(ranked, scored).over(ranking), spread)  # null where all are tied
    flat = flat.withColumns({"agree": agree, "scores": F.count(scored).over(ranking), "odd": F.count_if(~both).over(ranking), "better": -F.col("quality"), "later": -F.col("rank")})
    flat = checkpoint(flat)
    upside_down = F.coalesce((F.col("agree") > 0.5) & (F.col("scores") >= 3), F.lit(False))
    whole = flat.where("odd = 0").withColumn("position", F.when(upside_down, F.col("better")).otherwise(F.col("rank")))
    upto = (Window.unboundedPreceding, 0)
    behind_rank = F.coalesce(F.max(ranked).over(ranking.orderBy("better").rangeBetween(*upto)), F.lit(0.0)) + 0.5
    behind_score = F.coalesce(F.max(-scored).over(ranking.orderBy("later").rangeBetween(*upto)), F.lit(-2.0)) + 1e-9
    gaps = flat.where("odd > 0").withColumn("position", F.when(upside_down, F.coalesce("better", behind_score)).otherwise(F.coalesce("rank", behind_rank)))
    return whole.unionByName(gaps).select("doc_id", "judge_id", "item_id", "source_id", "position")


def _long_comparisons(rankings: DataFrame, slice_items: int) -> DataFrame:
    """``a, b, n, wins`` per ranking and slice, all pairs of each ranking: within a slice from counts per contestant and position, between slices from counts of what lies before.

    Slices, not rankings, are the keys of the joins, so a long ranking is split over tasks.  Ties are never cut.
    """
    by = ["doc_id", "judge_id"]
    cells = rankings.groupBy(*by, "position", "source_id").agg(F.count(F.lit(1)).cast("double").alias("c"))
    ranking = Window.partitionBy(*by)
    upto = F.sum("c").over(ranking.orderBy("position").rangeBetween(Window.unboundedPreceding, 0))
    cells = checkpoint(cells.withColumn("slice", F.floor((upto - F.sum("c").over(Window.partitionBy(*by, "position"))) / slice_items)))
    x, y = cells.withColumnsRenamed({"source_id": "a", "position": "pa", "c": "ca"}), cells.withColumnsRenamed({"source_id": "b", "position": "pb", "c": "cb"})
    n = F.col("ca") * F.col("cb")
    within = x.join(y, [*by, "slice"]).where("a < b").select("a", "b", n.alias("n"), (F.when(F.col("pa") < F.col("pb"), 1.0).when(F.col("pa") == F.col("pb"), 0.5).otherwise(0.0) * n).alias("wins"))
    counts = cells.groupBy(*by, "slice", "source_id").agg(F.sum("c").alias("c"))
    grid = counts.select(*by, "source_id").distinct().join(counts.select(*by, "slice").distinct(), by).join(counts, [*by, "slice", "source_id"], "left")
    earlier = F.sum("c").over(Window.partitionBy(*by, "source_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    before = grid.select(*by, "slice", F.col("source_id").alias("winner"), earlier.alias("earlier")).where("earlier > 0")
    m = F.col("earlier") * F.col("c")
    met = before.join(counts, [*by, "slice"]).where("winner != source_id")
    between = met.select(F.least("winner", "source_id").alias("a"), F.greatest("winner", "source_id").alias("b"), m.alias("n"), F.when(F.col("winner") < F.col("source_id"), m).otherwise(0.0).alias("wins"))
    return within.unionByName(between)


def comparisons(rankings: DataFrame, reach: int = REACH, slice_items: int = SLICE) -> DataFrame:
    """Edges ``a, b, n, wins`` (a < b): comparisons of two contestants and how many a won, ties being half won.

    All pairs of items of a ranking, however long it is; a contestant isn't compared with itself.
    """
    sized = rankings.withColumn("items", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "judge_id")))
    order = Window.partitionBy("doc_id", "judge_id").orderBy("position", "item_id")
    ahead = [F.lead(F.struct("source_id", "position"), k).over(order) for k in range(1, reach + 1)]
    short = sized.where(F.col("items") <= reach + 1)
    pairs = short.withColumn("ahead", F.array(*ahead)).select("source_id", "position", F.explode("ahead").alias("o")).where("o is not null and o.source_id != source_id")
    won = F.when(F.col("position") < F.col("o.position"), 1.0).otherwise(0.5)
    first = F.col("source_id") < F.col("o.source_id")
    each = pairs.select(F.least("source_id", "o.source_id").alias("a"), F.greatest("source_id", "o.source_id").alias("b"), F.lit(1.0).alias("n"), F.when(first, won).otherwise(1 - won).alias("wins"))
    if rankings.groupBy("doc_id", "judge_id").count().where(F.col("count") > reach + 1).limit(1).count():
        each = each.unionByName(_long_comparisons(sized.where(F.col("items") > reach + 1), slice_items))
    return each.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"))


def _at(s: np.ndarray, a, b, n, wins) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each edge, and weight times margin, at strengths ``s``; without strengths from the smoothed win share alone."""
    if s is None:
        p = (wins + 0.5) / (n + 1)
        w = n * p * (1 - p)
        return w, w * np.log(p / (1 - p))
    d = s[a] - s[b]
    p = 1 / (1 + np.exp(-d))
    w = n * np.maximum(p * (1 - p), 1e-4)
    return w, w * d + (wins - n * p)


class LocalGraph:
    def __init__(self, edges: pd.DataFrame):
        self.e = [edges[c].to_numpy() for c in ("ai", "bi", "n", "wins")]

    def system(self, s, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Right-hand side and diagonal of the Laplacian at ``s``."""
        a, b, *_ = self.e
        self.w, wy = _at(s, *self.e)
        return np.bincount(a, wy, size) - np.bincount(b, wy, size), np.bincount(a, self.w, size) + np.bincount(b, self.w, size)

    def times(self, s, x: np.ndarray) -> np.ndarray:
        a, b, *_ = self.e
        flow = self.w * (x[a] - x[b])
        return np.bincount(a, flow, len(x)) - np.bincount(b, flow, len(x))


class SparkGraph:
    """The same by one pass over the edges each; a task sends back sums for the contestants it saw."""

    def __init__(self, edges: DataFrame):
        self.edges = edges

    def _sum(self, size: int, of) -> list[np.ndarray]:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for e in batches:
                parts = of(*[e[c].to_numpy() for c in ("ai", "bi", "n", "wins")])
                total = parts if total is None else [t + p for t, p in zip(total, parts, strict=True)]
            if total is not None:
                seen = np.flatnonzero(np.any([t != 0 for t in total], axis=0))
                yield pd.DataFrame({"i": seen, "x": total[0][seen], "y": total[-1][seen]})

        got = self.edges.mapInPandas(add, "i bigint, x double, y double").groupBy("i").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).toPandas()
        out = [np.zeros(size), np.zeros(size)]
        for o, c in zip(out, "xy", strict=True):
            o[got["i"].to_numpy(dtype=int)] = got[c].to_numpy()
        return out

    def system(self, s, size: int) -> tuple[np.ndarray, np.ndarray]:
        def of(a, b, n, wins):
            w, wy = _at(s, a, b, n, wins)
            return [np.bincount(a, wy, size) - np.bincount(b, wy, size), np.bincount(a, w, size) + np.bincount(b, w, size)]

        x, y = self._sum(size, of)
        return x, y

    def times(self, s, x: np.ndarray) -> np.ndarray:
        def of(a, b, n, wins):
            flow = _at(s, a, b, n, wins)[0] * (x[a] - x[b])
            return [np.bincount(a, flow, len(x)) - np.bincount(b, flow, len(x))]

        return self._sum(len(x), of)[0]


def conjugate_gradient(times, b: np.ndarray, diagonal: np.ndarray, x: np.ndarray, tolerance: float) -> np.ndarray:
    """Solution of the system whose matrix ``times`` applies; raises if it isn't found in far more steps than there are unknowns."""
    r = b - times(x)
    z = r / diagonal
    p, rz = z.copy(), r @ z
    goal = tolerance * max(np.linalg.norm(b), 1e-12)
    for _ in range(100 + 10 * len(b)):
        if np.linalg.norm(r) <= goal:
            return x
        q = times(p)
        step = rz / max(p @ q, 1e-300)
        x, r = x + step * p, r - step * q
        z = r / diagonal
        rz, old = r @ z, rz
        p = z + (rz / old) * p
    raise RuntimeError("the Laplacian system has not been solved")


def solve_strengths(graph, size: int, prior: float = PRIOR) -> np.ndarray:
    """Strengths of ``size`` contestants with mean 0, once they move by less than a thousandth; a solve moves none by more than STRIDE."""
    s, at = None, np.zeros(size)
    for _ in range(SOLVES):
        b, diagonal = graph.system(s, size)
        ridge = prior / 2
        new = conjugate_gradient(lambda x, s=s: graph.times(s, x) + ridge * x, b, diagonal + ridge, at.copy(), 1e-4)
        new = at + np.clip(new - new.mean() - at, -STRIDE, STRIDE)
        moved = np.abs(new - at).max(initial=0.0)
        s = at = new
        if moved < 1e-3:
            return at - at.mean()
    raise RuntimeError(f"strengths still move by {moved:.3g} after {SOLVES} solves")


def rank_contestants(judgments: DataFrame, local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame]:
    """Strengths and inconsistency of the contestants in ``judgments``.

    First result: ``source_id, strength, standing, comparisons, wins`` - strength in log-odds with mean 0, standing 1 for the
    strongest (equal strengths share a standing).  Second: one row ``edges, comparisons, total_margin, residual_margin, inconsistency``:
    the share of the weighted squared margins that no ranking can explain (cycles and noise).  A contestant in no comparison has no row.
    Without comparisons the first result is empty and the second has zeros and a null share.
    Strengths of parts of the graph that never meet are comparable only through the prior.  Strengths that don't settle are an error.
    """
    spark = judgments.sparkSession
    edges = checkpoint(comparisons(clean_rankings(judgments)))
    degree = edges.select(F.explode(F.array(F.struct(F.col("a").alias("source_id"), "n", "wins"), F.struct(F.col("b").alias("source_id"), "n", (F.col("n") - F.col("wins")).alias("wins")))).alias("d")).groupBy("d.source_id").agg(F.sum("d.n").alias("comparisons"), F.sum("d.wins").alias("wins"))
    people = degree.toPandas().sort_values("source_id", ignore_index=True)  # contestants: their strengths are one vector
    index = spark.createDataFrame(pd.DataFrame({"source_id": people["source_id"].astype(object), "i": np.arange(len(people))}), "source_id string, i bigint")
    coded = edges.join(index.withColumnsRenamed({"source_id": "a", "i": "ai"}), "a").join(index.withColumnsRenamed({"source_id": "b", "i": "bi"}), "b").select("ai", "bi", "n", "wins")
    n_edges = edges.count()
    if n_edges <= local_edges:
        graph = LocalGraph(coded.toPandas())
    else:
        graph = SparkGraph(checkpoint(coded.repartition(spark.sparkContext.defaultParallelism)))
    s = solve_strengths(graph, len(people)) if len(people) else np.zeros(0)
    ranked = pd.DataFrame({"source_id": people["source_id"].astype(object), "strength": s.round(6), "standing": pd.Series(-s.round(6)).rank(method="min").astype("int64"), "comparisons": people["comparisons"].astype(float), "wins": people["wins"].astype(float)})
    strengths = spark.createDataFrame(ranked, "source_id string, strength double, standing bigint, comparisons double, wins double")
    both = edges.join(strengths.select(F.col("source_id").alias("a"), F.col("strength").alias("sa")), "a").join(strengths.select(F.col("source_id").alias("b"), F.col("strength").alias("sb")), "b")
    p = (F.col("wins") + 0.5) / (F.col("n") + 1)
    w, y = F.col("n") * p * (1 - p), F.log(p / (1 - p))
    total, rest = F.sum(w * y * y), F.sum(w * (y - F.col("sa") + F.col("sb")) ** 2)
    residual = both.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("comparisons"), F.coalesce(total, F.lit(0.0)).alias("total_margin"), F.coalesce(rest, F.lit(0.0)).alias("residual_margin"))
    return strengths, residual.withColumn("inconsistency", F.when(F.col("total_margin") > 0, F.col("residual_margin") / F.col("total_margin")))
