"""Half-open intervals of characters: as array expressions within a row, and as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import let, strip

INTERVALS = "array<struct<start:int,end:int>>"


def merged(intervals: Column) -> Column:
    """Sorted union of an array of ``struct(start, end)``: starts clamped to 0, empty ones dropped, touching ones joined."""
    kept = F.filter(F.transform(intervals, lambda x: F.struct(F.greatest(x["start"], F.lit(0)).cast("int").alias("start"), x["end"].cast("int").alias("end"))), lambda x: x["end"] > x["start"])

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(x)))

    def safe_add(acc: Column, x: Column) -> Column:
        return F.when(F.size(acc) == 0, F.array(x)).otherwise(add(acc, x))

    return F.aggregate(F.array_sort(kept), F.array().cast(INTERVALS), safe_add)


def overlaps(start: Column, end: Column, intervals: Column) -> Column:
    return F.exists(intervals, lambda x: (start < x["end"]) & (end > x["start"]))


def covered(intervals: Column) -> Column:
    """Characters covered by an array of merged intervals."""
    return F.aggregate(intervals, F.lit(0), lambda a, x: a + x["end"] - x["start"])


def kept_spans(text: Column, intervals: Column, sep: str = " [...] ") -> Column:
    """The pieces of ``text`` in merged intervals, stripped and joined, blank ones left out; a blank if there is none."""
    pieces = F.filter(F.transform(intervals, lambda x: strip(F.substr(text, x["start"] + 1, x["end"] - x["start"]))), lambda p: p != "")
    return let(pieces, lambda p: F.when(F.size(p) > 0, F.array_join(p, sep)).otherwise(F.lit(" ")))


def without_spans(text: Column, intervals: Column, mask: str = "") -> Column:
    """``text`` without the merged intervals (or with ``mask`` in their place), stripped; a blank if nothing is left, and as it is without intervals."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    folded = F.aggregate(
        intervals, state, lambda a, x: F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mask)).alias("out"), x["end"].alias("at")),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.greatest(F.length(text) - a["at"], F.lit(0)))),
    )
    done = strip(folded)
    return F.when(F.size(intervals) == 0, text).when(done == "", " ").otherwise(done)


def merge_interval_rows(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """``keys, start, end``: the union of a key's interval rows (gaps and islands over running maxima)."""
    clean = rows.select(*keys, F.greatest(F.col(start), F.lit(0)).alias("start"), F.col(end).alias("end")).where("end > start")
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = clean.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    island = marked.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def trapezoid_area(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``keys, area`` under the points in order of ``x``; null under two points."""
    w = Window.partitionBy(*keys).orderBy(x)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return rows.withColumn("_a", step).groupBy(*keys).agg(F.sum("_a").alias("area"))


def parents(spans: DataFrame, keys: list[str], span_id: str = "span") -> DataFrame:
    """``keys, span, parent``: the innermost other span of the same key that contains a span; null at the top.  Spans of one document are few."""
    c, p = spans.alias("c"), spans.alias("p")
    same = [F.col(f"c.{k}") == F.col(f"p.{k}") for k in keys]
    wider = (F.col("p.end") - F.col("p.start") > F.col("c.end") - F.col("c.start")) | ((F.col("p.end") - F.col("p.start") == F.col("c.end") - F.col("c.start")) & (F.col(f"p.{span_id}") < F.col(f"c.{span_id}")))
    inside = (F.col("p.start") <= F.col("c.start")) & (F.col("c.end") <= F.col("p.end")) & wider
    best = F.min(F.struct((F.col("p.end") - F.col("p.start")).alias("w"), (-F.col(f"p.{span_id}")).alias("o"), F.col(f"p.{span_id}").alias("id")))
    cond = inside
    for s in same:
        cond = cond & s
    return c.join(p, cond, "left").groupBy(*[F.col(f"c.{k}").alias(k) for k in keys], F.col(f"c.{span_id}").alias(span_id)).agg(F.when(F.max(F.col(f"p.{span_id}")).isNotNull(), best["id"]).alias("parent"))
