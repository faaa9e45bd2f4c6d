"""A sample whose categories follow target shares: systematic unequal-probability sampling with repaired floors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import canonical, checkpoint

SAMPLE_SHARE = 0.1


def _cells(df: DataFrame) -> list:
    return [canonical(F.col("domain")).alias("domain"), F.col("label").cast("int").alias("label"), F.lower(F.trim(F.col("dataset"))).alias("dataset")]


def target_report(examples: DataFrame, targets: DataFrame, share: float = SAMPLE_SHARE) -> DataFrame:
    """Per target: ``target_id, domain, label, dataset, target_share, min_rows, sample_size, available, wanted, drawn_aim, feasible``.

    The sample has ``share`` of the rows of ``examples``, rounded down.  ``wanted`` is the larger of ``min_rows`` and the
    target's share of the sample, rounded up; ``feasible`` says whether that many rows exist, ``drawn_aim`` is the smaller of the two.
    ``domain`` and ``dataset`` are compared trimmed and lower-cased, ``domain`` also with blanks and hyphens as underscores; rows with a null
    in one of the three belong to no target.  Targets that name the same category each see all of its rows; with an empty ``examples`` nothing is available.
    """
    counts = examples.select(*_cells(examples)).groupBy("domain", "label", "dataset").agg(F.count(F.lit(1)).alias("available"))
    counts = checkpoint(counts)  # a row per category, nulls included
    size = counts.agg(F.floor(F.coalesce(F.sum("available"), F.lit(0)) * F.lit(share) + 1e-9).cast("bigint").alias("sample_size"))
    wish = targets.select(F.col("target_id").cast("int").alias("target_id"), *_cells(targets), F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("min_rows"), F.lit(0)).alias("min_rows"))
    rows = wish.crossJoin(F.broadcast(size)).join(counts, ["domain", "label", "dataset"], "left")  # size: one row
    wanted = F.greatest(F.col("min_rows").cast("bigint"), F.ceil(F.col("target_share") * F.col("sample_size") - 1e-9))
    available = F.coalesce(F.col("available"), F.lit(0).cast("bigint"))
    return rows.select(
        "target_id", "domain", "label", "dataset", "target_share", "min_rows", "sample_size",
        available.alias("available"), wanted.alias("wanted"), F.least(available, wanted).alias("drawn_aim"), (available >= wanted).alias("feasible"),
    )


def quotas(targets: list[dict], size: int) -> dict[int, float]:
    """Rows to draw for each target, fractions included: ``size`` in all, or as near to it as there are rows.

    A target gets its share of the sample times one factor, but at least the smaller of ``min_rows`` and its rows and at most its rows; the factor makes
    the sum right, so what small categories take beyond their share, or lack, is shared out among the others in proportion.
    Floors come first: if they alone exceed ``size``, they are the sample.  ``targets``: ``target_id, target_share, min_rows, available``.
    """
    floor = {t["target_id"]: float(min(t["available"], max(t["min_rows"], 0))) for t in targets}

    def at(factor: float) -> dict[int, float]:
        return {t["target_id"]: min(float(t["available"]), max(floor[t["target_id"]], factor * max(t["target_share"], 0.0) * size)) for t in targets}

    low, high = 0.0, 1.0
    while sum(at(high).values()) < size and high < 1e12:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(at(middle).values()) < size else (low, middle)
    return at(high)


def proportional_sample(examples: DataFrame, targets: DataFrame, id_col: str = "id", share: float = SAMPLE_SHARE, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The sample (``id, target_id, reason``) and its report.

    Rows of a category are put in the order of a seeded hash, categories one after the other; the inclusion probability of a row is
    its target's quota (``quotas``) over the rows counted there.  Summed over partitions, each crossing of an integer
    past one random start draws a row (``reason`` 'systematic').  A category that rounding leaves under its floor takes its next rows (``reason`` 'floor'),
    and those with most to spare give up their last, so the sample keeps its size.
    The report has a row per target: ``target_id, domain, label, dataset, target_share, min_rows, sample_size, available, wanted, quota, drawn, actual_share, shortfall, feasible``.
    ``available`` counts the rows the draw met; a target with fewer than ``wanted`` can't be met: it isn't ``feasible``, and its lack is in ``shortfall`` (``wanted - drawn``, at least 0).
    A feasible target may lack a row or more where floors of others take them.  Rows of no target are never drawn.  Rows that repeat an id are rows of
    their own.  If targets repeat a category, the lowest ``target_id`` draws and the others report its draw.
    """
    spark = examples.sparkSession
    wish = targets.select(F.col("target_id").cast("int").alias("target_id"), *_cells(targets), F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("min_rows"), F.lit(0)).alias("min_rows")).where("target_id is not null").orderBy("target_id").collect()  # a configuration
    cell = lambda r: (r["domain"], r["label"], r["dataset"])
    drawing: dict[tuple, int] = {}
    for r in wish:
        if None not in cell(r):
            drawing.setdefault(cell(r), r["target_id"])
    first = spark.createDataFrame([(*c, t) for c, t in drawing.items()], "domain string, label int, dataset string, target_id int")
    keyed = examples.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), *_cells(examples))
    mine = keyed.join(F.broadcast(first), ["domain", "label", "dataset"]).select("target_id", "h", "id")  # first: a row per target
    ordered = checkpoint(mine.repartitionByRange("target_id", "h", "id").sortWithinPartitions("target_id", "h", "id"))
    counts = ordered.groupBy("target_id", F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("n"))
    before: dict[tuple[int, int], int] = {}
    run = dict.fromkeys(drawing.values(), 0)
    for r in counts.orderBy("target_id", "pid").collect():  # partitions are ranges: targets plus partitions at most
        before[r["target_id"], r["pid"]] = run[r["target_id"]]
        run[r["target_id"]] += r["n"]
    size = int(examples.count() * share + 1e-9)
    plan = [{"target_id": r["target_id"], "target_share": r["target_share"], "min_rows": r["min_rows"], "available": run[r["target_id"]]} for r in wish if r["target_id"] in run]
    quota = quotas(plan, size)
    start = spark.range(1).select(F.pmod(F.xxhash64(F.lit(seed), F.lit("start")), F.lit(1 << 30)).alias("u")).first()["u"] / float(1 << 30) * 0.98 + 0.01
    probability = {t: q / run[t] if run[t] else 0.0 for t, q in quota.items()}
    mass, total = {}, 0.0
    for t in sorted(quota):
        mass[t], total = total, total + quota[t]

    def crossed(x):
        """Integers passed up to mass ``x``."""
        return (x - start + 1e-7) // 1

    floors = {r["target_id"]: min(r["available"], max(r["min_rows"], 0)) for r in plan}
    drawn = {t: int(crossed(mass[t] + run[t] * probability[t]) - crossed(mass[t])) for t in quota}
    extra = {t: floors[t] - n for t, n in drawn.items() if n < floors[t]}
    last = {t: crossed(mass[t] + run[t] * probability[t]) for t in quota}  # crossings beyond it are given up
    for _ in range(sum(extra.values())):
        t = max(drawn, key=lambda t: (drawn[t] - floors[t], -t))
        if drawn[t] > floors[t]:
            drawn[t] -= 1
            last[t] -= 1
    drawn = {t: n + extra.get(t, 0) for t, n in drawn.items()}

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            t = b["target_id"]
            local = b.groupby("target_id").cumcount() + t.map(seen).fillna(0).astype("int64")
            for k, n in t.value_counts().items():
                seen[k] = seen.get(k, 0) + int(n)
            rank = local + pd.Series([before[k, part] for k in t], index=b.index, dtype="int64")
            p, m, most = t.map(probability).astype(float), t.map(mass).astype(float), t.map(last).astype(float)
            after = crossed(m + (rank + 1) * p)
            yield pd.DataFrame({"target_id": t, "rank": rank, "id": b["id"], "drawn": (after > crossed(m + rank * p)) & (after <= most)})

    id_type = ordered.schema["id"].dataType.simpleString()
    ranked = ordered.mapInPandas(draw, f"target_id int, rank bigint, id {id_type}, drawn boolean")
    chosen = ranked.where("drawn").select("id", "target_id", F.lit("systematic").alias("reason"))
    if extra:
        lacking = F.create_map(*[F.lit(x) for kv in extra.items() for x in kv])
        # Of the first R rows at most R * p + 1 are drawn, so the first undrawn ones are among few.
        reach = F.create_map(*[F.lit(x) for t, n in extra.items() for x in (t, int((n + 2) / max(1 - probability[t], 1 / (run[t] + 1))) + 1)])
        spare = ranked.where(F.try_element_at(lacking, F.col("target_id")).isNotNull() & ~F.col("drawn") & (F.col("rank") < F.try_element_at(reach, F.col("target_id"))))
        order = F.row_number().over(Window.partitionBy("target_id").orderBy("rank"))
        more = spare.withColumn("order", order).where(F.col("order") <= F.try_element_at(lacking, F.col("target_id"))).select("id", "target_id", F.lit("floor").alias("reason"))
        chosen = chosen.unionByName(more)
    all_drawn, facts = sum(drawn.values()), []
    for r in wish:
        t = drawing.get(cell(r))
        have, got = run.get(t, 0), drawn.get(t, 0)
        wanted = max(r["min_rows"], math.ceil(r["target_share"] * size - 1e-9))
        facts.append((r["target_id"], *cell(r), r["target_share"], r["min_rows"], size, have, wanted, float(quota.get(t, 0.0)), got, got / all_drawn if all_drawn else 0.0, max(0, wanted - got), have >= wanted))
    report = spark.createDataFrame(facts, "target_id int, domain string, label int, dataset string, target_share double, min_rows int, sample_size bigint, available bigint, wanted bigint, quota double, drawn bigint, actual_share double, shortfall bigint, feasible boolean")
    return chosen, report
