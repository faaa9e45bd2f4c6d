"""Queries over annotated wires, scorers, models and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import scorers as S
from quern.functions import text as T
from quern.plans.registry import query, table
from quern.plans.text_q import _TOK, _comments

@query("R05_scorer_run", "SELECT id, round(length(text) / (length(text) + 1000.0::DOUBLE), 9) AS score_ai, text IS NULL AS failed FROM examples")
def r05(spark, d):
    out = S.run_scorer(table(spark, d, "examples"), "length")
    return out.select("id", F.round("score_ai", 9).alias("score_ai"), F.col("error").isNotNull().alias("failed"))


@query("H14_distinct_scoring", "SELECT count(*) AS rows, count(DISTINCT text) AS texts, round(sum(length(text) / (length(text) + 1000.0::DOUBLE)), 4) AS total FROM examples WHERE text IS NOT NULL")
def h14(spark, d):
    scored = S.score_distinct(table(spark, d, "examples").where("text is not null").select("id", "text"), "text", "length")
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("text").alias("texts"), F.round(F.sum("score_ai"), 4).alias("total"))


@query("R16_word_chunks", f"WITH t AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN len(w) <= 256 THEN 1 ELSE ceil((len(w) - 256) / 128)::BIGINT + 1 END AS chunks FROM t")
def r16(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.size(S.word_chunks(T.ascii_tokens(F.col("text")), 256, 128)).cast("bigint").alias("chunks"))


@query("R11_feature_model")
def r11(spark, d):
    rows = table(spark, d, "predictions").select("id", "label", *[F.try_element_at("features", F.lit(f)).try_cast("double").alias(f) for f in ("perplexity", "burstiness")]).where("label is not null and perplexity is not null and burstiness is not null")
    model = S.fit_feature_model(rows, ["perplexity", "burstiness"], "label")
    return S.apply_feature_model(model, rows).select("id", "label", F.round("score_ai", 6).alias("score_ai"))


@query("N16_comment_clusters")
def n16(spark, d):
    from quern.operators.cluster import tfidf_clusters

    return tfidf_clusters(_comments(spark, d), T.ascii_tokens(F.col("comment")), 8).groupBy("cluster").agg(F.count(F.lit(1)).alias("comments"))


@query("Q25_hourly_events", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q25(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))
