"""Documents with tells (annotated spans): evidence, probes with spans taken out, faithfulness, contradiction, genericity.

``tells`` is an array of ``struct(ord, start, end, type, score, why, span, polarity)`` in a document's row, so all but the corpus-wide counts
stay within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import evidence as E
from quern.functions.text import normalized_explanation
from quern.operators import intervals as V

#: Shares of a text's characters at which the budget curve is taken.
BUDGETS = (0.01, 0.02, 0.05, 0.10, 0.20, 0.50)
PROBES = ("full", "only", "removed", "ai_removed", "human_removed")


def spans_for(tells: Column, polarity: int | None = None, least: float | None = None) -> Column:
    """Merged intervals of the tells of one polarity and of at least a score."""
    kept = tells
    if polarity is not None:
        kept = F.filter(kept, lambda t: t["polarity"] == polarity)
    if least is not None:
        kept = F.filter(kept, lambda t: t["score"] >= least)
    return V.merged(F.transform(kept, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))))


def probes(docs: DataFrame) -> DataFrame:
    """``id, y, probe, text``: the text, its annotated part alone, and the text without all, the AI or the human spans."""
    every, ai, human = spans_for(F.col("tells")), spans_for(F.col("tells"), 1), spans_for(F.col("tells"), -1)
    rows = docs.withColumns({"_e": every, "_a": ai, "_h": human})
    whole = lambda iv: F.when(F.size(iv) > 0, V.without_spans(F.col("text"), iv)).otherwise(F.col("text"))
    texts = (F.col("text"), V.kept_spans(F.col("text"), F.col("_e")), whole(F.col("_e")), whole(F.col("_a")), whole(F.col("_h")))
    return rows.select("id", "y", F.explode(F.array(*[F.struct(F.lit(p).alias("probe"), t.alias("text")) for p, t in zip(PROBES, texts, strict=True)])).alias("p")).select("id", "y", "p.probe", "p.text")


def deletion_effects(docs: DataFrame, score=E.keyword_score) -> DataFrame:
    """One row per document: P(AI) of each probe, how much of the evidence for the true class the spans alone lose (``sufficiency_drop``, at least 0) and
    their removal takes away (``comprehensiveness_drop``), and the directional effects ``ai_drop`` and ``human_rise`` (null without such spans).

    ``score`` maps a text column to P(AI); all probes of a document are scored in its row, so nothing is shuffled.
    """
    every, ai, human = spans_for(F.col("tells")), spans_for(F.col("tells"), 1), spans_for(F.col("tells"), -1)
    rows = docs.withColumns({"_e": every, "_a": ai, "_h": human})
    whole = lambda iv: F.when(F.size(iv) > 0, V.without_spans(F.col("text"), iv)).otherwise(F.col("text"))
    p = rows.select("id", "y", "_a", "_h", score(F.col("text")).alias("full"), score(V.kept_spans(F.col("text"), F.col("_e"))).alias("only"), score(whole(F.col("_e"))).alias("removed"), score(whole(F.col("_a"))).alias("ai_removed"), score(whole(F.col("_h"))).alias("human_removed"))
    gold = lambda c: F.when(F.col("y") == 1, F.col(c)).otherwise(1 - F.col(c))
    return p.select(
        "id", "y", *PROBES, F.greatest(F.lit(0.0), gold("full") - gold("only")).alias("sufficiency_drop"), (gold("full") - gold("removed")).alias("comprehensiveness_drop"),
        F.when(F.size("_a") > 0, F.col("full") - F.col("ai_removed")).alias("ai_drop"), F.when(F.size("_h") > 0, F.col("human_removed") - F.col("full")).alias("human_rise"),
    )


def faithfulness(effects: DataFrame) -> DataFrame:
    """One row of means and rates over ``deletion_effects``; null where nothing applies."""
    over = lambda c: F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > 1e-6).cast("double")))
    out = effects.agg(
        F.count(F.lit(1)).alias("documents"), F.avg("sufficiency_drop").alias("sufficiency_mean"), F.avg("comprehensiveness_drop").alias("comprehensiveness_mean"),
        F.avg("ai_drop").alias("ai_drop_mean"), over("ai_drop").alias("ai_drop_rate"), F.avg("human_rise").alias("human_rise_mean"), over("human_rise").alias("human_rise_rate"),
    )
    a, b = F.col("ai_drop_mean"), F.col("human_rise_mean")
    return out.withColumn("signed_deletion", F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a + b) / 2))


def budget_texts(docs: DataFrame) -> DataFrame:
    """``id, y, budget, tells, chars, text``: for each budget the annotated text of the best tells that fit."""
    each = docs.select("id", "y", "text", F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), E.tells_in_budget(F.col("tells"), F.length("text"), b).alias("got")) for b in BUDGETS])).alias("b")).select("id", "y", "text", "b.budget", "b.got")
    chars = F.aggregate("got", F.lit(0), lambda a, t: a + t["end"] - t["start"])
    return each.select("id", "y", "budget", F.size("got").alias("tells"), chars.alias("chars"), V.kept_spans(F.col("text"), spans_for(F.col("got"))).alias("text"))


def contradiction(docs: DataFrame, high: float = 0.5) -> DataFrame:
    """One row: share of tells that oppose the true class, plain and weighted by score, over all tells and over those of at least ``high``."""
    t = docs.select("y", F.explode("tells").alias("t")).select(F.col("t.score").alias("s"), ((2 * F.col("y") - 1) * F.col("t.polarity") < 0).cast("double").alias("c"))
    top = F.col("s") >= high
    weighted = lambda cond: F.sum(F.when(cond, F.col("s") * F.col("c"))) / F.greatest(F.sum(F.when(cond, F.col("s"))), F.lit(1e-12))
    return t.agg(
        F.avg("c").alias("rate_all"), weighted(F.lit(True)).alias("weighted_all"), F.avg(F.when(top, F.col("c"))).alias("rate_high"), weighted(top).alias("weighted_high"), F.count_if(top).alias("high_tells"),
    )


def genericity(docs: DataFrame, high: float = 0.5, repeats: int = 5, least_overlap: float = 0.05) -> DataFrame:
    """One row: share of high tells whose explanation is generic, plain and weighted by score.

    Generic: it has a stock phrase or is given ``repeats`` times or more (normalized), and shares hardly a content word with its span.
    Counts are taken per form and joined back as aggregates per form and overlap, so a hot form isn't one task's group of rows.
    """
    t = docs.select(F.explode(F.filter("tells", lambda x: x["score"] >= high)).alias("t"))
    flags = t.select(normalized_explanation(F.col("t.why")).alias("form"), F.col("t.score").alias("s"), (E.explanation_overlap(F.col("t.why"), F.col("t.span")) < least_overlap).alias("far"), E.has_generic_phrase(F.col("t.why")).alias("stock"))
    per = flags.groupBy("form", "stock").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("w"), F.count_if("far").alias("far"), F.sum(F.when(F.col("far"), F.col("s")).otherwise(0.0)).alias("far_w"))
    generic = F.col("stock") | (F.col("n") >= repeats)
    return per.agg((F.sum(F.when(generic, F.col("far")).otherwise(0)) / F.sum("n")).alias("rate"), (F.sum(F.when(generic, F.col("far_w")).otherwise(0.0)) / F.greatest(F.sum("w"), F.lit(1e-12))).alias("weighted"), F.sum("n").alias("tells"))
