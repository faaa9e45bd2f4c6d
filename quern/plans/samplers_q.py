"""Queries over sampler state (strata, replay pools, snapshots) and over scorers' arithmetic on their features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern import scorers as S
from quern.functions import text as T
from quern.operators import metrics as M
from quern.operators import samplers as P
from quern.operators.ranks import ordered_ema, positions
from quern.plans.metrics_q import VALID
from quern.plans.records_q import _WORDS
from quern.plans.registry import query, table

_R = "least(1.0, greatest(0.0, value / 100.0))"
#: State of each stratum after all events: a step is an hour.
_STATE = f"""r AS (SELECT event_type AS k, date_trunc('hour', ts) AS h, event_id, ts, {_R} AS x FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY k) AS n FROM r), f AS (SELECT k, arg_min(x, (ts, event_id)) AS x0 FROM r GROUP BY k),
  e AS (SELECT o.k, sum(0.12 * power(0.88, back) * x) + power(0.88, max(n)) * any_value(x0) AS reward FROM o JOIN f USING (k) GROUP BY o.k), hs AS (SELECT k, h, avg(x) AS m, CASE WHEN count(*) > 1 THEN var_pop(x) ELSE 0 END AS v FROM r GROUP BY ALL), hb AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h DESC) - 1 AS back, count(*) OVER (PARTITION BY k) AS n FROM hs),
  st AS (SELECT k, count(*) AS visits, sum(0.05 * power(0.95, back) * m) + 0.5 * power(0.95, max(n)) AS ema, sum(0.12 * power(0.88, back) * v) + 0.25 * power(0.88, max(n)) AS var FROM hb GROUP BY k)"""


def _rewards(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("k"), F.date_trunc("hour", "ts").alias("h"), "ts", "event_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100.0)).alias("x"))


def _state(spark, d):
    return P.stratum_state(_rewards(spark, d), "k", "h", "x", alpha=0.05, reward_alpha=0.12)


@query("Q01_stratum_state", f"WITH {_STATE} SELECT k, visits, round(ema, 6) AS ema, round(var, 6) AS variance FROM st")
def q01(spark, d):
    return _state(spark, d).select("k", "visits", F.round("ema", 6).alias("ema"), F.round("variance", 6).alias("variance"))


_RAW = "u AS (SELECT *, var + 0.5 / sqrt(visits + 1) + 0.3 * greatest(0.0, 0.5 - ema) AS raw FROM st), w AS (SELECT *, exp(2 * (raw - max(raw) OVER ())) AS x FROM u), p AS (SELECT *, 0.1 / count(*) OVER () + 0.9 * x / sum(x) OVER () AS wt FROM w)"


def _weighted(spark, d):
    s = _state(spark, d)
    return P.softmax_with_floor(s.withColumn("raw", P.ucb_raw(F.col("variance"), F.col("visits"), F.col("ema"), 0.5, 0.3)), "raw", 2.0, 0.1)


@query("Q03_capped_weights", f"WITH {_STATE}, {_RAW}, c AS (SELECT k, least(wt, 0.21) AS c FROM p) SELECT k, round(c / sum(c) OVER (), 6) AS weight FROM c")
def q03(spark, d):
    return P.capped(_weighted(spark, d), "weight", 0.21).select("k", F.round("weight", 6).alias("weight"))


_PRIOR = "q AS (SELECT k, exp(6 * (m - max(m) OVER ())) AS y FROM (SELECT k, avg(x) AS m FROM r GROUP BY k)), pr AS (SELECT k, y / sum(y) OVER () AS prior FROM q)"


@query("Q04_probe_prior", f"WITH {_STATE}, {_PRIOR} SELECT k, round(prior, 6) AS prior FROM pr")
def q04(spark, d):
    means = _rewards(spark, d).groupBy("k").agg(F.avg("x").alias("m"))
    return P.softmax_with_floor(means, "m", 6.0, 0.0).select("k", F.round("weight", 6).alias("prior"))


@query("Q05_blended_weights", f"WITH {_STATE}, {_RAW}, {_PRIOR} SELECT k, round(0.7 * prior + 0.3 * wt, 6) AS weight FROM p JOIN pr USING (k)")
def q05(spark, d):
    """Prior and learned weights, blended by how far the ramp has come (step 30 of 100)."""
    means = P.softmax_with_floor(_rewards(spark, d).groupBy("k").agg(F.avg("x").alias("m")), "m", 6.0, 0.0).select("k", F.col("weight").alias("prior"))
    lam = P.linear_ramp(F.lit(30), 0.0, 1.0, 100)
    return _weighted(spark, d).join(means, "k").select("k", F.round((1 - lam) * F.col("prior") + lam * F.col("weight"), 6).alias("weight"))


@query("Q06_curriculum_weights", f"WITH {_STATE}, {_RAW}, g AS (SELECT p.k, wt * exp(-4 * power((1 - reward) - 0.55, 2)) AS g FROM p JOIN e USING (k)) SELECT k, round(g / sum(g) OVER (), 6) AS weight FROM g")
def q06(spark, d):
    """Weights drawn towards strata whose difficulty (1 - reward) is near the one the ramp asks for (0.25 to 0.85, half way)."""
    r = P.reward_ema(_rewards(spark, d), "k", ["ts", "event_id"], "x", 0.12)
    rows = _weighted(spark, d).join(r, "k").withColumn("difficulty", 1 - F.col("reward"))
    return P.curriculum(rows, "weight", "difficulty", 0.55, 4.0).select("k", F.round("weight", 6).alias("weight"))


@query("Q08_reward_ema", f"WITH {_STATE} SELECT k, round(reward, 6) AS reward, round(1 - reward, 6) AS difficulty FROM e")
def q08(spark, d):
    r = P.reward_ema(_rewards(spark, d), "k", ["ts", "event_id"], "x", 0.12)
    return r.select("k", F.round("reward", 6).alias("reward"), F.round(1 - F.col("reward"), 6).alias("difficulty"))


@query("Q09_update_diagnostics", f"WITH {_STATE} SELECT round(min(ema), 6) AS least, round(max(ema), 6) AS most, round(avg(ema), 6) AS mean, round(avg(var), 6) AS mean_variance FROM st")
def q09(spark, d):
    return _state(spark, d).agg(F.round(F.min("ema"), 6).alias("least"), F.round(F.max("ema"), 6).alias("most"), F.round(F.avg("ema"), 6).alias("mean"), F.round(F.avg("variance"), 6).alias("mean_variance"))


_DRAW = "dr AS (SELECT i, ('0x' || substr(sha256('97|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM range(0, 60) AS r(i)), cu AS (SELECT k, wt, sum(wt) OVER (ORDER BY k) / sum(wt) OVER () AS hi, (sum(wt) OVER (ORDER BY k) - wt) / sum(wt) OVER () AS lo FROM p)"


@query("Q10_batch_draws", f"WITH {_STATE}, {_RAW}, {_DRAW} SELECT i, k FROM dr JOIN cu ON u >= lo AND u < hi")
def q10(spark, d):
    return P.hashed_draws(_weighted(spark, d).select("k", F.col("weight")), "k", "weight", 60, 97).select(F.col("draw").alias("i"), "k")


@query("Q11_snapshot_and_restore", f"WITH {_STATE} SELECT k, visits, round(ema, 6) AS ema FROM st")
def q11(spark, d):
    """State after half of the steps is written, read back and continued with the rest: the same as without the break."""
    from quern.plans.sources_q import _place

    steps = _rewards(spark, d).groupBy("k", "h").agg(F.avg("x").alias("m"))
    cut = steps.select(F.expr("timestamp_micros(cast((unix_micros(min(h)) + unix_micros(max(h))) / 2 as bigint))").alias("cut")).first()["cut"]
    path = _place(spark, "state")
    ordered_ema(steps.where(F.col("h") < F.lit(cut)), "k", ["h"], "m", 0.05, 0.5).write.parquet(path)
    restored = spark.read.parquet(path)
    return P.continued_ema(restored, steps.where(F.col("h") >= F.lit(cut)), "k", ["h"], "m", 0.05, 0.5).select("k", "visits", F.round("ema", 6).alias("ema"))


@query("Q12_known_strata_only", f"WITH {_STATE} SELECT k, round(coalesce(CASE WHEN k IN ('click', 'view') THEN 0.9 END, ema), 6) AS ema FROM st")
def q12(spark, d):
    """A restored state counts for the strata that are known; others keep theirs, and strata nobody knows are left out."""
    given = spark.createDataFrame([("click", 0.9), ("view", 0.9), ("nobody", 0.1)], "k string, restored double")
    return _state(spark, d).join(given, "k", "left").select("k", F.round(F.coalesce("restored", "ema"), 6).alias("ema"))


_POOL = """ob AS (SELECT user_id AS u, event_id, value / 100.0 AS x, event_type FROM events), pb AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY u) AS n, min(event_id) OVER (PARTITION BY u) AS first FROM ob), pe AS (SELECT u, max(n) AS n, min(first) AS first, sum(0.1 * power(0.9, back) * x) + power(0.9, max(n)) * max(CASE WHEN event_id = first THEN x END) AS reward FROM pb GROUP BY u),
  pool AS (SELECT * FROM pe ORDER BY first DESC LIMIT 60)"""


def _pool(spark, d):
    ob = table(spark, d, "events").select(F.col("user_id").alias("u"), "event_id", (F.col("value") / 100.0).alias("x"))
    r = P.reward_ema(ob, "u", ["event_id"], "x", 0.1)
    first = ob.groupBy("u").agg(F.min("event_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return r.join(first, "u").orderBy(F.desc("first")).limit(60)  # the pool's size is a parameter of the sampler


@query("Q14_replay_pool", f"WITH {_POOL} SELECT u, n, round(reward, 6) AS reward FROM pool")
def q14(spark, d):
    """State of the items observed; of more than 60, those seen first go first."""
    return _pool(spark, d).select("u", "n", F.round("reward", 6).alias("reward"))


@query("Q16_replay_candidates", f"WITH {_POOL} SELECT u, round(greatest(0.000001, 0.2 * (1 - least(1, greatest(0, reward)))), 6) AS priority FROM pool WHERE n >= 2")
def q16(spark, d):
    hard = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("reward")))
    return _pool(spark, d).where("n >= 2").select("u", F.round(F.greatest(F.lit(1e-6), 0.2 * hard), 6).alias("priority"))


@query("Q17_cache_uses", "SELECT user_id AS u, count(*) AS uses, count(*) // 3 AS refreshed, count(*) % 3 AS since FROM events WHERE event_type = 'click' GROUP BY user_id")
def q17(spark, d):
    """A cached result is used three times, then dropped and made anew."""
    n = F.count(F.lit(1))
    return table(spark, d, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("u")).agg(n.alias("uses"), F.floor(n / 3).alias("refreshed"), (n % 3).alias("since"))


@query("Q18_two_stage_draws", f"WITH {_STATE}, {_RAW}, {_DRAW}, s AS (SELECT i, k FROM dr JOIN cu ON u >= lo AND u < hi), m AS (SELECT event_type AS k, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT s.i, s.k, m.event_id FROM s JOIN m ON m.k = s.k AND m.pos = ('0x' || substr(sha256('item|' || s.i), 1, 8))::BIGINT % m.n")
def q18(spark, d):
    """First a stratum by weight, then an item of it with equal chances: positions are joined, no stratum is listed."""
    s = P.hashed_draws(_weighted(spark, d).select("k", F.col("weight")), "k", "weight", 60, 97)
    items = positions(table(spark, d, "events").select(F.col("event_type").alias("k"), "event_id"), ["event_id"], ["k"])
    sizes = items.groupBy("k").agg(F.max("group_rows").alias("n"))
    u = F.conv(F.substring(F.sha2(F.concat(F.lit("item|"), F.col("draw").cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    want = s.join(sizes, "k").withColumn("position", F.pmod(u, F.col("n")))
    return want.join(items.select("k", "position", "event_id"), ["k", "position"]).select(F.col("draw").alias("i"), "k", "event_id")


@query("Q19_replay_fraction", "SELECT step, round(0.1 + 0.4 * least(1.0, step / 20.0), 9) AS fraction, round_even(8 * (0.1 + 0.4 * least(1.0, step / 20.0)), 0)::BIGINT AS replayed FROM range(0, 40) AS r(step)")
def q19(spark, d):
    f = P.linear_ramp(F.col("id"), 0.1, 0.5, 20)
    return spark.range(40).select(F.col("id").alias("step"), F.round(f, 9).alias("fraction"), F.bround(8 * f).cast("bigint").alias("replayed"))


@query("Q20_pool_snapshot", f"WITH {_POOL} SELECT u, n, round(greatest(0.000001, 0.2 * (1 - least(1, greatest(0, reward)))), 6) AS priority FROM pool ORDER BY priority DESC, u LIMIT 10")
def q20(spark, d):
    hard = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("reward")))
    p = _pool(spark, d).select("u", "n", F.round(F.greatest(F.lit(1e-6), 0.2 * hard), 6).alias("priority"))
    return p.orderBy(F.desc("priority"), "u").limit(10)  # a top-10 report


@query("Q22_kept_snapshots", "SELECT h, k FROM (SELECT h, row_number() OVER (ORDER BY h DESC) AS k FROM (SELECT DISTINCT date_trunc('day', ts) AS h FROM events)) WHERE k <= 3")
def q22(spark, d):
    h = table(spark, d, "events").select(F.date_trunc("day", "ts").alias("h")).distinct()
    return h.orderBy(F.desc("h")).limit(3).withColumn("k", F.row_number().over(Window.orderBy(F.desc("h"))).cast("bigint"))  # three snapshots are kept


@query("Q23_snapshot_by_key", "SELECT user_id, max_by(event_id, ts) AS event_id FROM events WHERE user_id = 7 GROUP BY user_id")
def q23(spark, d):
    return table(spark, d, "events").where("user_id = 7").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"))


@query("Q24_initial_state", f"SELECT dataset, round(avg(score_ai), 6) AS ema, least(8, count(*)) AS visits FROM predictions WHERE {VALID} GROUP BY dataset")
def q24(spark, d):
    return table(spark, d, "predictions").where(M.is_valid()).groupBy("dataset").agg(F.round(F.avg("score_ai"), 6).alias("ema"), F.least(F.lit(8), F.count(F.lit(1))).alias("visits"))


_FEATURES = "f AS (SELECT id, detector, generated_at, TRY_CAST(features['perplexity'] AS DOUBLE) AS x, TRY_CAST(features['burstiness'] AS DOUBLE) AS b FROM predictions), g AS (SELECT id, detector, generated_at, -ln(x) AS ll, ln(1 + b * 10) AS lr FROM f WHERE x > 0 AND b > 0)"


def _features(spark, d):
    get = lambda k: F.try_element_at("features", F.lit(k)).try_cast("double")
    f = table(spark, d, "predictions").select("id", "detector", "generated_at", get("perplexity").alias("x"), get("burstiness").alias("b")).where("x > 0 and b > 0")
    return f.select("id", "detector", "generated_at", (-F.ln("x")).alias("ll"), F.ln(1 + F.col("b") * 10).alias("lr"))


@query("O23_likelihood_rank_ratio", f"WITH {_FEATURES} SELECT id, detector, generated_at, round(-ll / greatest(lr, 1e-12), 6) AS raw, round(1 / (1 + exp(-(-ll / greatest(lr, 1e-12)) / 6)), 6) AS score FROM g")
def o23(spark, d):
    raw = -F.col("ll") / F.greatest("lr", F.lit(1e-12))
    return _features(spark, d).select("id", "detector", "generated_at", F.round(raw, 6).alias("raw"), F.round(T.sigmoid(raw / 6.0), 6).alias("score"))


@query("O24_log_rank_score", f"WITH {_FEATURES} SELECT id, detector, generated_at, round(1 / (1 + exp(-((2.75 - lr) / 1.0))), 6) AS score FROM g")
def o24(spark, d):
    return _features(spark, d).select("id", "detector", "generated_at", F.round(T.sigmoid(2.75 - F.col("lr")), 6).alias("score"))


@query("O25_perturbation_scores", f"WITH {_FEATURES}, s AS (SELECT id, arg_min(ll, (detector, generated_at, ll)) AS ll, arg_min(lr, (detector, generated_at, ll)) AS lr FROM g GROUP BY id), p AS (SELECT id, avg(ll) AS m, CASE WHEN count(*) > 1 THEN stddev_pop(ll) ELSE 1 END AS sd, avg(lr) AS mr FROM g GROUP BY id) SELECT id, round((ll - m) / greatest(sd, 1e-12), 4) AS curvature, round(mr / greatest(lr, 1e-12), 6) AS rank_ratio FROM s JOIN p USING (id) WHERE sd > 1e-6")
def o25(spark, d):
    """A text's features against those of its perturbed forms (here: all runs on the same id)."""
    g = _features(spark, d)
    first = F.struct("detector", "generated_at", "ll")
    a = g.groupBy("id").agg(F.min_by("ll", first).alias("ll"), F.min_by("lr", first).alias("lr"), F.avg("ll").alias("m"), F.when(F.count(F.lit(1)) > 1, F.stddev_pop("ll")).otherwise(1.0).alias("sd"), F.avg("lr").alias("mr"))
    return a.where("sd > 1e-6").select("id", F.round((F.col("ll") - F.col("m")) / F.greatest("sd", F.lit(1e-12)), 4).alias("curvature"), F.round(F.col("mr") / F.greatest("lr", F.lit(1e-12)), 6).alias("rank_ratio"))


@query("O26_bucket_expectation", f"WITH {_FEATURES}, p AS (SELECT id, detector, generated_at, [exp(ll), exp(lr), exp(-lr), 1.0] AS e FROM g) SELECT id, detector, generated_at, round((e[2] + 2 * e[3] + 3 * e[4]) / list_sum(e) / 3, 6) AS score, list_position(e, list_max(e)) - 1 AS bucket FROM p")
def o26(spark, d):
    e = F.array(F.exp("ll"), F.exp("lr"), F.exp(-F.col("lr")), F.lit(1.0))
    score, bucket = S.bucket_expectation(e)
    return _features(spark, d).select("id", "detector", "generated_at", F.round(score, 6).alias("score"), bucket.cast("int").alias("bucket"))


_RAW_OK = "raw_score IS NOT NULL AND NOT isnan(raw_score) AND NOT isinf(raw_score)"


def _raw(spark, d):
    return table(spark, d, "predictions").where("raw_score is not null and not isnan(raw_score) and abs(raw_score) < double('inf')").select("id", "detector", "generated_at", "raw_score")


@query("O27_negated_logit", f"SELECT id, detector, generated_at, round(1 / (1 + exp(-((0.5 - (-raw_score)) / 2.0))), 6) AS score, -raw_score < 0.5 AS machine FROM predictions WHERE {_RAW_OK}")
def o27(spark, d):
    m = -F.col("raw_score")
    return _raw(spark, d).select("id", "detector", "generated_at", F.round(T.sigmoid((0.5 - m) / 2.0), 6).alias("score"), (m < 0.5).alias("machine"))


@query("O28_human_complement", f"SELECT id, detector, generated_at, round(1 - exp(0.3) / (exp(raw_score) + exp(0.3) + exp(-raw_score)), 6) AS score FROM predictions WHERE {_RAW_OK}")
def o28(spark, d):
    """1 - P(human) from the logits of three labels."""
    p = S.softmax_of(F.array(F.col("raw_score"), F.lit(0.3), -F.col("raw_score")))
    return _raw(spark, d).select("id", "detector", "generated_at", F.round(1 - F.element_at(p, 2), 6).alias("score"))


@query("O29_two_way_softmax", f"SELECT id, detector, generated_at, round(exp(raw_score) / (exp(raw_score) + exp(0.4)), 5) AS p FROM predictions WHERE {_RAW_OK}")
def o29(spark, d):
    return _raw(spark, d).select("id", "detector", "generated_at", F.round(F.element_at(S.softmax_of(F.array(F.col("raw_score"), F.lit(0.4))), 1), 5).alias("p"))


@query("R09_ai_label_index", "SELECT detector, min(CASE WHEN regexp_matches(raw_label, '(?i)(fake|generated|machine|gpt|label_1)') THEN i END) AS ai_index FROM (SELECT detector, raw_label, row_number() OVER (PARTITION BY detector ORDER BY raw_label) - 1 AS i FROM (SELECT DISTINCT detector, raw_label FROM predictions WHERE raw_label IS NOT NULL)) GROUP BY detector")
def r09(spark, d):
    """The first of a detector's labels that names the AI class; the labels of a detector are few."""
    labels = table(spark, d, "predictions").where("raw_label is not null").select("detector", "raw_label").distinct()
    placed = labels.withColumn("i", F.row_number().over(Window.partitionBy("detector").orderBy("raw_label")) - 1)
    return placed.groupBy("detector").agg(F.min(F.when(F.col("raw_label").rlike("(?i)(fake|generated|machine|gpt|label_1)"), F.col("i"))).cast("bigint").alias("ai_index"))


@query("R02_scorer_kinds", "SELECT name FROM (VALUES ('keywords'), ('length'), ('repetition')) AS v(name)")
def r02(spark, d):
    return spark.createDataFrame([(n,) for n in sorted(S.REGISTRY)], "name string")


@query("R08_scorer_as_argument", "SELECT id, round(length(text) / (length(text) + 500.0::DOUBLE), 9) AS score_ai FROM examples WHERE text IS NOT NULL")
def r08(spark, d):
    out = S.run_scorer(table(spark, d, "examples").where("text is not null"), "length", scale=500.0)
    return out.select("id", F.round("score_ai", 9).alias("score_ai"))


_TW = f"w AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents WHERE text IS NOT NULL)"


@query("R13_masked_words", f"WITH {_TW} SELECT doc_id, len(w) AS words, CASE WHEN len(w) < 4 THEN 0 ELSE least(greatest(1, round_even(len(w) * 0.3 / 2, 0)), len(w) - 2)::BIGINT END AS spans FROM w")
def r13(spark, d):
    """How many spans of two words are masked; where they stand is drawn by a hash."""
    w = table(spark, d, "documents").where("text is not null").select("doc_id", T.white_words(F.col("text")).alias("w"))
    m = w.select("doc_id", F.size("w").cast("bigint").alias("words"), S.masked_starts(F.col("w"), F.col("doc_id"), 0.3, 2).alias("s"))
    return m.select("doc_id", "words", F.size("s").cast("bigint").alias("spans"))


@query("R14_filled_texts", f"WITH {_TW} SELECT doc_id, sha256(array_to_string(w, ' ')) AS form FROM w WHERE len(w) >= 4")
def r14(spark, d):
    """Masked words put back where they were give the text again."""
    w = table(spark, d, "documents").where("text is not null").select("doc_id", T.white_words(F.col("text")).alias("w")).where("size(w) >= 4")
    s = w.withColumn("s", S.masked_starts(F.col("w"), F.col("doc_id"), 0.3, 2))
    return s.select("doc_id", F.sha2(S.filled(F.col("w"), F.col("s"), 2), 256).alias("form"))


@query("R15_points_needed", f"WITH {_TW} SELECT doc_id, CASE WHEN len(w) < 42 THEN 'needs 42 points, got ' || len(w) END AS error, CASE WHEN len(w) >= 42 THEN (len(w) - 40) // 7 END AS step FROM w")
def r15(spark, d):
    """A scorer over samples of points: too few are an error of the row, not of the run."""
    n = F.size(T.white_words(F.col("text")))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", n.alias("n"))
    return rows.select("doc_id", F.when(F.col("n") < 42, F.format_string("needs 42 points, got %d", "n")).alias("error"), F.when(F.col("n") >= 42, F.floor((F.col("n") - 40) / 7)).alias("step"))


@query("R17_chunk_means", f"WITH {_TW}, c AS (SELECT doc_id, unnest(CASE WHEN len(w) <= 64 THEN [1] ELSE range(1, (ceil((len(w) - 64) / 32.0)::BIGINT) * 32 + 2, 32) END) AS s, w FROM w) SELECT doc_id, count(*) AS chunks, round(avg(len(w[s:s+63]) / (len(w[s:s+63]) + 100.0::DOUBLE)), 9) AS score FROM c GROUP BY doc_id")
def r17(spark, d):
    w = table(spark, d, "documents").where("text is not null").select("doc_id", T.white_words(F.col("text")).alias("w"))
    c = w.select("doc_id", F.explode(S.word_chunks(F.col("w"), 64, 32)).alias("c"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(F.size("c") / (F.size("c") + 100.0)), 9).alias("score"))


@query("R18_aligned_streams", f"WITH {_TW} SELECT doc_id, least(len(w), len(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n FROM w JOIN documents USING (doc_id)")
def r18(spark, d):
    """Streams of different tokenizers, cut to the length of the shortest."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", T.white_words(F.col("text")).alias("a"), T.ascii_tokens(F.col("text")).alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    cut = rows.select("doc_id", F.slice("a", F.lit(1), n).alias("a"), F.slice("b", F.lit(1), n).alias("b"))
    return cut.select("doc_id", F.size(F.arrays_zip("a", "b")).cast("bigint").alias("n"))


@query("R19_perplexity_ratio", f"WITH {_FEATURES} SELECT id, detector, generated_at, round(-ll / CASE WHEN lr > 0.5 THEN lr ELSE ln(50257) END, 6) AS ratio FROM g")
def r19(spark, d):
    """Perplexity over cross-perplexity; where that isn't usable, over the logarithm of the vocabulary."""
    return _features(spark, d).select("id", "detector", "generated_at", F.round(-F.col("ll") / F.when(F.col("lr") > 0.5, F.col("lr")).otherwise(F.ln(F.lit(50257.0))), 6).alias("ratio"))
