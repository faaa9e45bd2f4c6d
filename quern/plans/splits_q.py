"""Queries over filters with reasons, counts, splits, samples and merges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.functions import wiretext as R
from quern.operators import allocate as A
from quern.operators import normalize as N
from quern.operators.aggregates import linear_quantile, lower_quantile
from quern.operators.ranks import global_position, positions
from quern.plans.metrics_q import VALID
from quern.plans.records_q import _CLEAN, _NAME, _QUOTED, _U, _WORDS, _examples, _quoted, _unified
from quern.plans.registry import query, table
from quern.plans.text_q import _COMMENTS, _comments

_STRATUM = f"lower(trim(dataset)) || '|' || coalesce({_NAME('domain')}, 'unknown') || '|' || coalesce(label, 0)"


def _stratum():
    return F.concat_ws("|", F.lower(F.trim("dataset")), F.coalesce(N.canonical_name(F.col("domain")), F.lit("unknown")), F.coalesce("label", F.lit(0)).cast("string"))


@query("D01_allowed_strata", f"SELECT id FROM examples WHERE lower(trim(dataset)) IN ('harborlight/forum_pairs', 'meridian/newsroom_mix') AND {_STRATUM} IN ('harborlight/forum_pairs|forum_qa|0', 'harborlight/forum_pairs|forum_qa|1', 'meridian/newsroom_mix|news|1')")
def d01(spark, d):
    rows = _examples(spark, d).withColumn("stratum", _stratum())
    return A.allowed(A.allowed(rows, F.lower(F.trim("dataset")), ["harborlight/forum_pairs", "meridian/newsroom_mix"]), F.col("stratum"), "harborlight/forum_pairs|forum_qa|0 , harborlight/forum_pairs|forum_qa|1,,meridian/newsroom_mix|news|1".split(",")).select("id")


@query("D02_filter_lists", "SELECT * FROM (VALUES ('none', NULL), ('star', NULL), ('text', 'a'), ('list', 'a,b')) AS v(given, kept)")
def d02(spark, d):
    given = {"none": None, "star": ["*", "a"], "text": " a ", "list": ["b", " a", "", None]}
    rows = [(k, ",".join(sorted(x)) if (x := A.filter_set(v)) else None) for k, v in given.items()]
    return spark.createDataFrame(rows, "given string, kept string")


@query("D03_filtered_documents", f"SELECT id, sha256({_CLEAN('text')}) AS h FROM examples WHERE {_CLEAN('text')} <> '' AND lower(trim(dataset)) = 'osprey/mailroom'")
def d03(spark, d):
    rows = A.allowed(_examples(spark, d), F.lower(F.trim("dataset")), ["osprey/mailroom"])
    clean = rows.select("id", T.clean_document_text(F.col("text")).alias("t")).where("t != ''")
    return clean.select("id", F.sha2("t", 256).alias("h"))


@query("D04_first_documents", f"SELECT id FROM examples WHERE {_CLEAN('text')} <> '' ORDER BY id LIMIT 25")
def d04(spark, d):
    return _examples(spark, d).where(T.clean_document_text(F.col("text")) != "").orderBy("id").limit(25).select("id")  # the first n documents are the feature


@query("D05_clean_rows", f"WITH {_U} SELECT label, count(*) AS rows FROM v WHERE is_default_training_candidate AND lower(trim(dataset_id)) <> 'saltmarsh/multi_small' AND trim(text) <> '' AND label IS NOT NULL GROUP BY label")
def d05(spark, d):
    u = _unified(spark, d).where("is_default_training_candidate and lower(trim(dataset_id)) != 'saltmarsh/multi_small' and trim(text) != '' and label is not null")
    return u.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query("D06_adversarial_rows", f"WITH {_U} SELECT attack, count(*) AS rows FROM v WHERE is_adversarial AND lower(trim(dataset_id)) = 'harborlight/forum_pairs' AND domain NOT IN ('code', 'non_english') AND label = 1 AND trim(text) <> '' GROUP BY attack")
def d06(spark, d):
    u = _unified(spark, d).where("is_adversarial and lower(trim(dataset_id)) = 'harborlight/forum_pairs' and domain not in ('code', 'non_english') and label = 1 and trim(text) != ''")
    return u.groupBy("attack").agg(F.count(F.lit(1)).alias("rows"))


@query("D07_minimum_length", f"SELECT count(*) AS documents, count(*) FILTER (len({_WORDS('text')}) < 64) AS dropped FROM documents WHERE text IS NOT NULL")
def d07(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select(F.size(T.white_words(F.col("text"))).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") < 64).alias("dropped"))


@query("D09_source_assertions", "SELECT prompt_id, count(*) AS rows, count(DISTINCT (ground_truth, generation_model)) AS kinds, count(*) = count(DISTINCT (ground_truth, generation_model)) AS complete, count(*) FILTER (article IS NULL OR title IS NULL) AS missing FROM expert_articles GROUP BY prompt_id")
def d09(spark, d):
    """Every prompt holds each pair of class and model once."""
    kinds = F.count_distinct(F.struct("ground_truth", "generation_model"))
    return table(spark, d, "expert_articles").groupBy("prompt_id").agg(F.count(F.lit(1)).alias("rows"), kinds.alias("kinds"), (F.count(F.lit(1)) == kinds).alias("complete"), F.count_if(F.col("article").isNull() | F.col("title").isNull()).alias("missing"))


@query("D12_detector_examples", "SELECT coalesce(nullif(id, ''), split || ':' || sha1(text)) AS id, label FROM (SELECT CASE WHEN label = 0 THEN '' ELSE id END AS id, lower(trim(split)) AS split, text, label FROM examples) WHERE text IS NOT NULL AND trim(text) <> '' AND label IN (0, 1)")
def d12(spark, d):
    """Rows without an id get one from split and text; empty texts and other labels are left out."""
    if_ai = F.when(F.col("label") == 0, "").otherwise(F.col("id"))
    rows = _examples(spark, d).withColumns({"id": if_ai, "split": F.lower(F.trim("split"))}).where("trim(text) != '' and label in (0, 1)")
    made = F.coalesce(F.nullif("id", F.lit("")), F.concat("split", F.lit(":"), F.sha1("text")))
    return rows.select(made.alias("id"), "label")


_LEANING = f"(SELECT cid, CASE id % 3 WHEN 0 THEN comment || ' Compared to the original version it is stiff.' ELSE comment END AS c FROM {_COMMENTS})"


@query("D14_standalone_comments", f"SELECT cid FROM {_LEANING} WHERE NOT regexp_matches(lower(c), 'compared to|compared with|original version|source version|human version|ai version|reference text')")
def d14(spark, d):
    c = F.when(F.col("id") % 3 == 0, F.concat("comment", F.lit(" Compared to the original version it is stiff."))).otherwise(F.col("comment"))
    return _comments(spark, d).where(R.is_standalone(c)).select("cid")


@query("D15_good_rows", "SELECT id, detector, generated_at FROM predictions WHERE id <> '' AND raw_label <> '' AND coalesce(error, '') = ''")
def d15(spark, d):
    return table(spark, d, "predictions").where("id != '' and raw_label != '' and coalesce(error, '') = ''").select("id", "detector", "generated_at")


@query("D16_leaking_comments", f"SELECT cid FROM (SELECT cid, CASE id % 2 WHEN 0 THEN comment || ' said the Reviewer.' ELSE comment || ' in reviewers eyes' END AS c FROM {_COMMENTS}) WHERE regexp_matches(c, '(?i)\\breviewer\\b')")
def d16(spark, d):
    c = F.when(F.col("id") % 2 == 0, F.concat("comment", F.lit(" said the Reviewer."))).otherwise(F.concat("comment", F.lit(" in reviewers eyes")))
    return _comments(spark, d).where(c.rlike(r"(?i)\breviewer\b")).select("cid")


@query("D17_comment_candidates", f"SELECT cid FROM {_QUOTED} WHERE len({_WORDS(chr(40) + '''regexp_replace(q, '“[^”]*”|\"[^\"]*\"', '', 'g')''' + chr(41))}) >= 50")
def d17(spark, d):
    """Annotator slots as rows, those with fewer than 50 words outside quotations left out."""
    return _quoted(spark, d).where(R.unquoted_words(F.col("q")) >= 50).select("cid")


@query("D18_edited_pairs", f"WITH p AS (SELECT *, row_number() OVER (ORDER BY source_id) AS k FROM pair_docs) SELECT coalesce(source, 'unknown') AS source, source_id FROM (SELECT * FROM (SELECT * FROM p WHERE k <= 150) WHERE trim(source_id) <> '' AND trim(text_type) = 'ai_edited' AND {_CLEAN('source_text')} <> '' ORDER BY k LIMIT 40)")
def d18(spark, d):
    """Of the first 150 rows, the first 40 edited pairs with a source text: both limits are parameters of the operator."""
    head = table(spark, d, "pair_docs").orderBy("source_id").limit(150)
    good = head.where((F.trim("source_id") != "") & (F.trim("text_type") == "ai_edited") & (T.clean_document_text(F.col("source_text")) != ""))
    return good.orderBy("source_id").limit(40).select(F.coalesce("source", F.lit("unknown")).alias("source"), "source_id")


_PAIR_N = f"p AS (SELECT source_id, greatest(len({_WORDS(_CLEAN('source_text'))}), len({_WORDS(_CLEAN('ai_edited.text'))})) AS n FROM pair_docs WHERE {_CLEAN('source_text')} <> '' AND {_CLEAN('ai_edited.text')} <> '')"


@query("D19_pairs_within_q3", f"WITH {_PAIR_N} SELECT source_id, n FROM p WHERE n <= (SELECT list_sort(list(n))[floor(0.75 * (count(*) - 1))::BIGINT + 1] FROM p)")
def d19(spark, d):
    words = lambda c: F.size(T.white_words(T.clean_document_text(c)))
    p = table(spark, d, "pair_docs").select("source_id", words(F.col("source_text")).alias("a"), words(F.col("ai_edited.text")).alias("b")).where("a > 0 and b > 0").select("source_id", F.greatest("a", "b").cast("bigint").alias("n"))
    return p.crossJoin(F.broadcast(lower_quantile(p, [], "n", {"q3": 0.75}))).where("n <= q3").select("source_id", "n")  # one row


@query("F22_third_quartile", f"WITH {_PAIR_N} SELECT list_sort(list(n))[floor(0.75 * (count(*) - 1))::BIGINT + 1] AS q3 FROM p")
def f22(spark, d):
    words = lambda c: F.size(T.white_words(T.clean_document_text(c)))
    p = table(spark, d, "pair_docs").select(words(F.col("source_text")).alias("a"), words(F.col("ai_edited.text")).alias("b")).where("a > 0 and b > 0").select(F.greatest("a", "b").cast("bigint").alias("n"))
    return lower_quantile(p, [], "n", {"q3": 0.75})


@query("D20_skipped_with_reasons", "SELECT id, CASE WHEN coalesce(error, '') <> '' THEN error WHEN score_ai IS NULL THEN 'not_ok' WHEN features IS NULL OR cardinality(features) = 0 THEN 'no_features' END AS reason, count(*) AS rows FROM predictions GROUP BY ALL HAVING reason IS NOT NULL")
def d20(spark, d):
    reason = F.when(F.coalesce("error", F.lit("")) != "", F.col("error")).when(F.col("score_ai").isNull(), "not_ok").when(F.col("features").isNull() | (F.size("features") == 0), "no_features")
    return N.route_rows(table(spark, d, "predictions"), reason)[1].groupBy("id", "reason").agg(F.count(F.lit(1)).alias("rows"))


@query("D21_fixed_pool", "SELECT id FROM examples WHERE text IS NOT NULL AND substr(sha256(text), 1, 16) IN (SELECT substr(sha256(source_text), 1, 16) FROM pair_docs WHERE source_text IS NOT NULL UNION SELECT substr(sha256(text), 1, 16) FROM examples WHERE lower(trim(split)) = 'test')")
def d21(spark, d):
    h = lambda c: F.substring(F.sha2(c, 256), 1, 16).alias("h")
    saved = table(spark, d, "pair_docs").where("source_text is not null").select(h("source_text")).union(_examples(spark, d).where("lower(trim(split)) = 'test' and text is not null").select(h("text")))
    return _examples(spark, d).where("text is not null").select("id", h("text")).join(saved, "h", "left_semi").select("id")


@query("D22_metric_keywords", "SELECT doc_id FROM documents WHERE contains(lower(text), 'report') OR contains(lower(text), 'result') OR contains(lower(text), 'informe')")
def d22(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").where(F.contains(low, F.lit("report")) | F.contains(low, F.lit("result")) | F.contains(low, F.lit("informe"))).select("doc_id")


@query("D24_shard_completeness", "SELECT detector, count(DISTINCT s) AS shards, count(*) AS rows, count(*) - count(DISTINCT id) AS repeated, count(DISTINCT s) = 12 AND count(*) = count(DISTINCT id) AS complete FROM (SELECT detector, id, month(generated_at) AS s FROM predictions) GROUP BY detector")
def d24(spark, d):
    rows = table(spark, d, "predictions").select("detector", "id", F.month("generated_at").alias("s"))
    n, ids, shards = F.count(F.lit(1)), F.count_distinct("id"), F.count_distinct("s")
    return rows.groupBy("detector").agg(shards.alias("shards"), n.alias("rows"), (n - ids).alias("repeated"), ((shards == 12) & (n == ids)).alias("complete"))


@query("D11_split_summary_check", "SELECT s.split, s.label, coalesce(n, 0) AS rows, coalesce(n, 0) >= 50 AS met FROM (SELECT * FROM (VALUES ('train'), ('test'), ('val')) AS a(split), (VALUES (0), (1)) AS b(label)) s LEFT JOIN (SELECT lower(trim(split)) AS split, label, count(*) AS n FROM examples GROUP BY ALL) c ON c.split = s.split AND c.label = s.label")
def d11(spark, d):
    quotas = spark.createDataFrame([(s, i) for s in ("train", "test", "val") for i in (0, 1)], "split string, label int")
    counts = _examples(spark, d).groupBy(F.lower(F.trim("split")).alias("split"), "label").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return quotas.join(counts, ["split", "label"], "left").select("split", "label", n.alias("rows"), (n >= 50).alias("met"))


_REASON = "CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN label IS NULL THEN 'no_label' WHEN attack <> 'none' THEN 'attack=' || attack END"


@query("F02_build_counts", f"WITH r AS (SELECT dataset, split, {_REASON} AS reason FROM examples) SELECT 'dataset' AS level, dataset, NULL AS split, NULL AS reason, count(*) AS seen, count(reason) AS excluded FROM r GROUP BY dataset UNION ALL SELECT 'dataset+split', dataset, split, NULL, count(*), count(reason) FROM r GROUP BY dataset, split UNION ALL SELECT 'dataset+reason', dataset, NULL, reason, count(*), count(reason) FROM r WHERE reason IS NOT NULL GROUP BY dataset, reason UNION ALL SELECT 'dataset+split+reason', dataset, split, reason, count(*), count(reason) FROM r WHERE reason IS NOT NULL GROUP BY ALL")
def f02(spark, d):
    reason = F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty").when(F.col("label").isNull(), "no_label").when(F.col("attack") != "none", F.concat(F.lit("attack="), "attack"))
    return N.build_counts(_examples(spark, d), "dataset", "split", reason)


@query("F04_split_summary", f"WITH e AS (SELECT coalesce(lower(trim(split)), 'remaining') AS split, label, domain, dataset, coalesce(attack, 'none') AS attack FROM examples) SELECT split, 'label' AS field, NULL AS value, label, count(*) AS rows FROM e GROUP BY split, label UNION ALL SELECT split, 'domain', domain, label, count(*) FROM e GROUP BY split, domain, label UNION ALL SELECT split, 'dataset', dataset, label, count(*) FROM e GROUP BY split, dataset, label UNION ALL SELECT split, 'attack', attack, label, count(*) FROM e GROUP BY split, attack, label")
def f04(spark, d):
    e = _examples(spark, d).select(F.coalesce(F.lower(F.trim("split")), F.lit("remaining")).alias("split"), "label", "domain", "dataset", F.coalesce("attack", F.lit("none")).alias("attack"))
    sets = e.groupingSets([["split", "label"], ["split", "label", "domain"], ["split", "label", "dataset"], ["split", "label", "attack"]], "split", "label", "domain", "dataset", "attack").agg(F.grouping_id().cast("int").alias("gid"), F.count(F.lit(1)).alias("rows"))
    field = F.when(F.col("gid") == 7, "label").when(F.col("gid") == 3, "domain").when(F.col("gid") == 5, "dataset").otherwise("attack")
    value = F.when(F.col("gid") == 3, F.col("domain")).when(F.col("gid") == 5, F.col("dataset")).when(F.col("gid") == 6, F.col("attack"))
    return sets.select("split", field.alias("field"), value.alias("value"), "label", "rows")


_FIELDS = ("label", "domain", "dataset", "generator", "attack")


@query("F05_value_counts", "WITH v AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce({f}::VARCHAR, 'null') AS value, count(*) AS rows FROM examples GROUP BY 2" for f in _FIELDS) + "), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY rows DESC, value) AS k FROM v) SELECT field, value, rows FROM r WHERE field <> 'generator' OR k <= 20")
def f05(spark, d):
    """Values of five fields and their counts, of generators the 20 most frequent."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("null")).alias("value")) for f in _FIELDS]))
    v = _examples(spark, d).select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("rows"))
    top = A.top_per_group(v.where("field = 'generator'"), ["field"], [F.desc("rows"), "value"], 20)
    return v.where("field != 'generator'").unionByName(top)


@query("F06_split_report", f"WITH {_U} SELECT source_split, count(*) AS rows, count(*) FILTER (label = 1) AS ai, count(*) FILTER (label = 0) AS human, count(*) FILTER (is_adversarial) AS adversarial, count(*) FILTER (is_default_training_candidate) AS candidates FROM v GROUP BY source_split")
def f06(spark, d):
    return _unified(spark, d).groupBy("source_split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("ai"), F.count_if(F.col("label") == 0).alias("human"), F.count_if("is_adversarial").alias("adversarial"), F.count_if("is_default_training_candidate").alias("candidates"))


@query("F10_stratum_rewards", f"SELECT dataset, domain, round(avg(1 - abs(score_ai - label)), 6) AS reward FROM predictions WHERE {VALID} GROUP BY dataset, domain")
def f10(spark, d):
    from quern.operators import metrics as M

    return table(spark, d, "predictions").where(M.is_valid()).groupBy("dataset", "domain").agg(F.round(F.avg(1 - F.abs(F.col("score_ai") - F.col("label"))), 6).alias("reward"))


@query("F11_stratum_pass_rates", "SELECT dataset, domain, round(avg(coalesce(CASE WHEN pred_builtin IS NOT NULL THEN pred_builtin = label END, CASE WHEN score_ai IS NOT NULL THEN (score_ai >= 0.5) = (label = 1) END, false)::INT), 6) AS pass_rate FROM predictions GROUP BY dataset, domain")
def f11(spark, d):
    """The first flag of a chain that is known counts."""
    flag = F.coalesce(F.col("pred_builtin") == F.col("label"), (F.col("score_ai") >= 0.5) == (F.col("label") == 1), F.lit(False))
    return table(spark, d, "predictions").groupBy("dataset", "domain").agg(F.round(F.avg(flag.cast("double")), 6).alias("pass_rate"))


@query("F12_probe_statistics", "SELECT dataset, count(score_ai) AS n, round(avg(CASE WHEN isnan(score_ai) OR isinf(score_ai) THEN NULL ELSE score_ai END), 6) AS mean FROM predictions GROUP BY dataset")
def f12(spark, d):
    s = F.col("score_ai")
    return table(spark, d, "predictions").groupBy("dataset").agg(F.count("score_ai").alias("n"), F.round(F.avg(F.when(~F.isnan(s) & (F.abs(s) != float("inf")), s)), 6).alias("mean"))


@query("F14_binary_f1", f"WITH c AS (SELECT detector, count(*) FILTER (pred_builtin = 1 AND label = 1)::DOUBLE AS tp, count(*) FILTER (pred_builtin = 1 AND label = 0)::DOUBLE AS fp, count(*) FILTER (pred_builtin = 0 AND label = 1)::DOUBLE AS fn, count(*) FILTER (pred_builtin = label)::DOUBLE / nullif(count(*) FILTER (pred_builtin IS NOT NULL AND label IS NOT NULL), 0) AS follows FROM predictions GROUP BY detector) SELECT detector, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(follows, 6) AS follows FROM c")
def f14(spark, d):
    p, y = F.col("pred_builtin"), F.col("label")
    c = table(spark, d, "predictions").groupBy("detector").agg(F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"), F.count_if((p == 0) & (y == 1)).alias("fn"), F.avg((p == y).cast("double")).alias("follows"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("detector", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.round("follows", 6).alias("follows"))


@query("F16_comment_variety", f"WITH c AS (SELECT id, comment, len({_WORDS('comment')}) AS n, count(*) OVER (PARTITION BY id, comment) AS same, count(*) OVER (PARTITION BY id) AS k FROM {_COMMENTS}) SELECT count(*) AS comments, count(DISTINCT comment) AS forms, round(count(DISTINCT comment) / count(*), 6) AS distinct_share, round(avg(n), 6) AS mean_words, round(quantile_cont(n, 0.95), 6) AS p95_words, round(avg(CASE WHEN k > 1 THEN (same - 1) / (k - 1) END), 6) AS collapse FROM c")
def f16(spark, d):
    """Variety of explanations; ``collapse``: how often another explanation of the same document is the same."""
    c = _comments(spark, d).select("id", "comment", F.size(T.white_words(F.col("comment"))).alias("n"))
    same = c.groupBy("id", "comment").agg(F.count(F.lit(1)).alias("s"))
    per = same.join(same.groupBy("id").agg(F.sum("s").alias("k")), "id").where("k > 1")
    collapse = per.agg((F.sum(F.col("s") * (F.col("s") - 1) / (F.col("k") - 1)) / F.sum("s")).alias("collapse"))
    forms = c.groupBy("comment").agg(F.count(F.lit(1)).alias("s"), F.sum("n").alias("n")).agg(F.sum("s").alias("comments"), F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n"))
    p95 = linear_quantile(c, [], "n", {"p95": 0.95})
    one = forms.crossJoin(p95).crossJoin(collapse)  # one row each
    return one.select("comments", "forms", F.round(F.col("forms") / F.col("comments"), 6).alias("distinct_share"), F.round(F.col("n") / F.col("comments"), 6).alias("mean_words"), F.round("p95", 6).alias("p95_words"), F.round("collapse", 6).alias("collapse"))


_RT = "runtime_s IS NOT NULL AND coalesce(error, '') = ''"


@query("F19_linear_quantiles", f"SELECT detector, round(quantile_cont(runtime_s, 0.25), 9) AS q25, round(quantile_cont(runtime_s, 0.5), 9) AS q50, round(quantile_cont(runtime_s, 0.9), 9) AS q90 FROM predictions WHERE {_RT} GROUP BY detector")
def f19(spark, d):
    rows = table(spark, d, "predictions").where("runtime_s is not null and coalesce(error, '') = ''")
    return linear_quantile(rows, ["detector"], "runtime_s", {"q25": 0.25, "q50": 0.5, "q90": 0.9}).select("detector", *[F.round(c, 9).alias(c) for c in ("q25", "q50", "q90")])


@query("F20_bounded_quantiles", "SELECT event_type, min(value) AS least, round(quantile_cont(value, 0.33), 9) AS q33, max(value) AS greatest FROM events GROUP BY event_type")
def f20(spark, d):
    return linear_quantile(table(spark, d, "events"), ["event_type"], "value", {"least": -1.0, "q33": 0.33, "greatest": 2.0}).withColumn("q33", F.round("q33", 9))


@query("F21_medians", "SELECT e.user_id, round(coalesce(median(CASE WHEN event_type = 'purchase' THEN value END), 0.0), 9) AS median FROM events e GROUP BY e.user_id")
def f21(spark, d):
    e = table(spark, d, "events")
    m = linear_quantile(e.where("event_type = 'purchase'"), ["user_id"], "value", {"median": 0.5})
    return e.select("user_id").distinct().join(m, "user_id", "left").select("user_id", F.round(F.coalesce("median", F.lit(0.0)), 9).alias("median"))


@query("F23_runtime_summary", f"SELECT detector, count(*) AS rows, round(avg(runtime_s), 6) AS mean_s, round(quantile_cont(runtime_s, 0.5), 6) AS p50, round(quantile_cont(runtime_s, 0.9), 6) AS p90, round(quantile_cont(runtime_s, 0.95), 6) AS p95, round(quantile_cont(runtime_s, 0.99), 6) AS p99 FROM predictions WHERE {_RT} GROUP BY detector")
def f23(spark, d):
    rows = table(spark, d, "predictions").where("runtime_s is not null and coalesce(error, '') = ''")
    q = linear_quantile(rows, ["detector"], "runtime_s", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    means = rows.groupBy("detector").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("runtime_s"), 6).alias("mean_s"))
    return means.join(q, "detector").select("detector", "rows", "mean_s", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99")])


@query("F24_runtime_by_split", f"SELECT detector, lower(trim(split)) AS split, count(*) AS rows, round(sum(runtime_s), 6) AS total_s, round(quantile_cont(runtime_s, 0.5), 6) AS p50 FROM predictions WHERE {_RT} AND split IS NOT NULL GROUP BY ALL")
def f24(spark, d):
    rows = table(spark, d, "predictions").where("runtime_s is not null and coalesce(error, '') = '' and split is not null").withColumn("split", F.lower(F.trim("split")))
    sums = rows.groupBy("detector", "split").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("runtime_s"), 6).alias("total_s"))
    return sums.join(linear_quantile(rows, ["detector", "split"], "runtime_s", {"p50": 0.5}), ["detector", "split"]).select("detector", "split", "rows", "total_s", F.round("p50", 6).alias("p50"))


@query("G05_seeded_order", "SELECT id, row_number() OVER (ORDER BY sha256('31|' || id), id) - 1 AS position FROM examples")
def g05(spark, d):
    return global_position(A.with_sort_key(_examples(spark, d).select("id"), 31, "id"), ["sort_key", "id"]).select("id", "position")


@query("G06_balanced_pool", f"""WITH p AS (SELECT id, label, {_STRATUM} AS s FROM examples WHERE label IN (0, 1)), t AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sha256('21|' || id), id) AS turn FROM p),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY turn, sha256('21|' || s), s) AS k FROM t) SELECT id, label FROM r WHERE k <= 15""")
def g06(spark, d):
    """Half of the pool from each label, strata taking turns."""
    rows = A.with_sort_key(_examples(spark, d).where("label in (0, 1)").select("id", "label", _stratum().alias("s")), 21, "id")
    return A.taking_turns(rows, ["label"], "s", 21, "id", 15).select("id", "label")


@query("G07_loaded_documents", f"WITH p AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('41|' || id), id) AS k FROM examples WHERE label IN (0, 1) AND {_CLEAN('text')} <> '' AND lower(trim(split)) IN ('test', 'test_shift')) SELECT id, label FROM p WHERE k <= 20")
def g07(spark, d):
    """The evaluation pool: cleaned documents of the test splits, in proportion, half from each label."""
    pool = _examples(spark, d).where("label in (0, 1) and lower(trim(split)) in ('test', 'test_shift')").where(T.clean_document_text(F.col("text")) != "").select("id", "label")
    return A.top_per_group(A.with_sort_key(pool, 41, "id"), ["label"], ["sort_key", "id"], 20).select("id", "label")


@query("G09_balanced_steps", "WITH p AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM examples WHERE label IN (0, 1)), s AS (SELECT step, slot, slot % 2 AS label, ('0x' || substr(sha256('43|' || step || '|' || slot), 1, 8))::BIGINT AS u FROM range(0, 6) AS a(step), range(0, 8) AS b(slot)) SELECT step, slot, id FROM s JOIN p ON p.label = s.label AND p.k = s.u % p.n")
def g09(spark, d):
    """Batches of equal halves, drawn with replacement by hashed positions: an equality join, not a search."""
    placed = positions(_examples(spark, d).where("label in (0, 1)").select("id", "label"), ["id"], ["label"])
    slots = spark.range(48).select((F.col("id") / 8).cast("bigint").alias("step"), (F.col("id") % 8).alias("slot")).withColumn("label", (F.col("slot") % 2).cast("int"))
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("43"), "step", "slot"), 256), 1, 8), 16, 10).cast("bigint")
    sizes = placed.groupBy("label").agg(F.max("group_rows").alias("n"))
    drawn = slots.join(sizes, "label").withColumn("position", F.pmod(u, F.col("n")))
    return drawn.join(placed.select("id", "label", "position"), ["label", "position"]).select("step", "slot", "id")


@query("G10_balanced_evaluation", "WITH n AS (SELECT least(30, count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS m FROM examples WHERE label IN (0, 1)), k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('23|' || id), id) AS place FROM examples WHERE label IN (0, 1)), c AS (SELECT id, label FROM k, n WHERE place <= m), f AS (SELECT id, label FROM (SELECT k.*, row_number() OVER (ORDER BY sha256('23|' || id), id) AS turn FROM k, n WHERE place > m), n WHERE turn <= 60 - 2 * m) SELECT * FROM c UNION ALL SELECT * FROM f")
def g10(spark, d):
    rows = _examples(spark, d).where("label in (0, 1)").select("id", "label")
    return A.balanced_evaluation(rows, "label", "id", 60, 23)


@query("G11_half_and_rest", "WITH k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM examples WHERE label IN (0, 1)), a AS (SELECT * FROM k WHERE label = 1 AND k <= 12), n AS (SELECT 25 - count(*) AS rest FROM a) SELECT id, label FROM a UNION ALL SELECT id, label FROM k, n WHERE label = 0 AND k <= rest")
def g11(spark, d):
    rows = _examples(spark, d).where("label in (0, 1)").select("id", "label")
    ai = rows.where("label = 1").orderBy("id").limit(12)  # the sizes are parameters of the selection
    return ai.unionByName(rows.where("label = 0").orderBy("id").limit(25 - ai.count()))


@query("G13_three_way_slices", "SELECT id, CASE WHEN k < 20 THEN 'train' WHEN k < 30 THEN 'val' ELSE 'test' END AS part FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM expert_articles) WHERE k < 40")
def g13(spark, d):
    placed = global_position(table(spark, d, "expert_articles").select("id"), ["id"]).where("position < 40")
    return placed.select("id", F.when(F.col("position") < 20, "train").when(F.col("position") < 30, "val").otherwise("test").alias("part"))


@query("G14_shuffled_rows", "SELECT source_id, row_number() OVER (ORDER BY sha256('47|' || source_id), source_id) AS place FROM (SELECT DISTINCT source_id FROM pair_docs)")
def g14(spark, d):
    rows = A.with_sort_key(table(spark, d, "pair_docs").select("source_id").distinct(), 47, "source_id")
    return global_position(rows, ["sort_key", "source_id"]).select("source_id", (F.col("position") + 1).alias("place"))


@query("G15_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 30")
def g15(spark, d):
    return table(spark, d, "documents").orderBy("doc_id").limit(30).select("doc_id")  # the head is the feature


_VALIDATION, _TEST = (4, 8, 13, 14, 15, 16, 20, 23, 25, 26), (1, 2, 3, 5, 6, 7, 9, 10, 11, 12, 17, 18, 19, 21, 22, 24, 27, 28, 29, 30)


@query("G16_group_split", "SELECT id, prompt_id, CASE WHEN prompt_id IN (4, 8, 13, 14, 15, 16, 20, 23, 25, 26) THEN 'validation' ELSE 'test' END AS assigned FROM expert_articles WHERE prompt_id IN (4, 8, 13, 14, 15, 16, 20, 23, 25, 26, 1, 2, 3, 5, 6, 7, 9, 10, 11, 12, 17, 18, 19, 21, 22, 24, 27, 28, 29, 30)")
def g16(spark, d):
    rows = table(spark, d, "expert_articles").where(F.col("prompt_id").isin(*_VALIDATION, *_TEST))
    return rows.select("id", "prompt_id", F.when(F.col("prompt_id").isin(*_VALIDATION), "validation").otherwise("test").alias("assigned"))


@query("G17_sample_in_order", "SELECT id, k FROM (SELECT id, row_number() OVER (ORDER BY id) AS k, row_number() OVER (ORDER BY sha256('53|' || id), id) AS r FROM examples) WHERE r <= 35")
def g17(spark, d):
    rows = global_position(_examples(spark, d).select("id"), ["id"]).withColumnRenamed("position", "k")
    chosen = A.with_sort_key(rows, 53, "id").orderBy("sort_key", "id").limit(35)  # the sample's size is its parameter
    return chosen.select("id", (F.col("k") + 1).alias("k"))


@query("G21_apportioned_slots", "WITH p AS (SELECT k, mode, p, k * p AS raw FROM range(1, 21) AS r(k), (VALUES ('drop', 0.5::DOUBLE), ('flip', 0.3::DOUBLE), ('keep', 0.2::DOUBLE)) AS v(mode, p)), w AS (SELECT *, floor(raw + 1e-9) AS whole FROM p), t AS (SELECT *, k - sum(whole) OVER (PARTITION BY k) AS lft, row_number() OVER (PARTITION BY k ORDER BY round(raw - whole, 9) DESC, mode) AS turn FROM w) SELECT k, mode, (whole + (turn <= lft)::INT)::BIGINT AS slots FROM t")
def g21(spark, d):
    modes = spark.createDataFrame([("drop", 0.5), ("flip", 0.3), ("keep", 0.2)], "mode string, p double")
    grid = spark.range(1, 21).withColumnRenamed("id", "k").crossJoin(F.broadcast(modes))  # 20 x 3 rows
    return A.apportion(grid, ["k"], F.col("k") * F.col("p"), F.col("k"), ["mode"]).select("k", "mode", "slots")


@query("G22_offset_and_limit", "SELECT id FROM expert_articles ORDER BY id LIMIT 10 OFFSET 5")
def g22(spark, d):
    return table(spark, d, "expert_articles").select("id").orderBy("id").offset(5).limit(10)  # a page is the feature


@query("G23_rows_by_position", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM expert_articles) WHERE k IN (0, 3, 7, 11)")
def g23(spark, d):
    wanted = spark.createDataFrame([(0,), (3,), (7,), (11,)], "position bigint")
    return global_position(table(spark, d, "expert_articles").select("id"), ["id"]).join(F.broadcast(wanted), "position").select("id")  # four rows


@query("G25_undersampled_class", "SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('59|' || id), id) AS k, (SELECT min(n) FROM (SELECT count(*) AS n FROM examples WHERE label IN (0, 1) GROUP BY label)) AS m FROM examples WHERE label IN (0, 1)) WHERE k <= m")
def g25(spark, d):
    placed = positions(A.with_sort_key(_examples(spark, d).where("label in (0, 1)").select("id", "label"), 59, "id"), ["sort_key", "id"], ["label"])
    least = placed.groupBy("label").agg(F.max("group_rows").alias("n")).agg(F.min("n").alias("m"))
    return placed.crossJoin(F.broadcast(least)).where("position < m").select("id", "label")  # one row


@query("G28_weighted_sample", "WITH w AS (SELECT source, doc_id, -ln((('0x' || substr(sha256('17|' || doc_id), 1, 8))::BIGINT + 1) / 4294967297.0) / (1 + 2 * (doc_id % 11) / 10.0) AS x FROM documents WHERE source IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(x, 9), doc_id) AS place, count(*) OVER (PARTITION BY source) AS n FROM w) SELECT source, doc_id FROM k WHERE place <= greatest(1, n // 20)")
def g28(spark, d):
    """One of 20 of a source's documents (at least one), without replacement, with weight 1 + 2 * strength."""
    rows = table(spark, d, "documents").where("source is not null").select("source", "doc_id")
    return A.weighted_share(rows, ["source"], 1 + 2 * (F.col("doc_id") % 11) / 10.0, 20, 17, "doc_id").select("source", "doc_id")


@query("G29_lottery", "WITH w AS (SELECT doc_id AS d, judge_id, item_id, min(quality_score) AS q FROM judgments WHERE item_id IS NOT NULL AND quality_score BETWEEN 0 AND 1 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY d, judge_id ORDER BY round(-ln((('0x' || substr(sha256('61|' || d || '|' || judge_id || '|' || item_id), 1, 8))::BIGINT + 1) / 4294967297.0) / (0.1 + q), 9), item_id) AS place FROM w) SELECT d AS doc_id, judge_id, item_id, CASE WHEN place <= 2 THEN q ELSE -0.1 END AS reward FROM k")
def g29(spark, d):
    """Two of a ranking's items win by weight; the others pay."""
    w = table(spark, d, "judgments").where("item_id is not null and quality_score between 0 and 1").groupBy("doc_id", "judge_id", "item_id").agg(F.min("quality_score").alias("q"))
    u = (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("61"), "doc_id", "judge_id", "item_id"), 256), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    place = F.row_number().over(Window.partitionBy("doc_id", "judge_id").orderBy(F.round(-F.ln(u) / (0.1 + F.col("q")), 9), "item_id"))
    return w.withColumn("place", place).select("doc_id", "judge_id", "item_id", F.when(F.col("place") <= 2, F.col("q")).otherwise(-0.1).alias("reward"))


@query("G30_sharded_rows", "SELECT shard, count(*) AS rows, min(doc_id) AS first FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 5 AS shard FROM documents) GROUP BY shard")
def g30(spark, d):
    return A.round_robin_shards(table(spark, d, "documents").select("doc_id"), ["doc_id"], 5).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first"))


_POOL = "CASE WHEN lower(trim(split)) IN ('test', 'test_shift') THEN 'eval' WHEN split IS NULL THEN 'excluded' WHEN ('0x' || substr(sha256(id), 1, 8))::BIGINT % 5 < 1 THEN 'eval' ELSE 'train' END"


@query("G02_assigned_splits")
def g02(spark, d):
    """Main evaluation, then validation from what is left of the evaluation pool, then training from the training pool."""
    e = _examples(spark, d).where("label in (0, 1)")
    s = F.lower(F.trim("split"))
    pool = F.when(s.isin("test", "test_shift"), "eval").when(F.col("split").isNull(), "excluded").when(T.hash_bucket(F.col("id"), 5) < 1, "eval").otherwise("train")
    rows = e.select("id", "label", N.canonical_name(F.col("domain")).alias("stratum"), pool.alias("pool")).where("stratum is not null")
    n = rows.count()
    part = max(4, n // 40) // 2 * 2
    return A.assign_in_turn(rows, "stratum", "label", "id", [("main_eval", "eval", part, "equal"), ("validation", "eval", part, "equal"), ("train", "train", 4 * part, "sqrt")], 71)


@query("E02_assigned_or_remaining", "SELECT coalesce(a.split, 'remaining') AS split, count(*) AS rows FROM examples e LEFT JOIN (SELECT DISTINCT id, 'scored' AS split FROM predictions) a USING (id) GROUP BY 1")
def e02(spark, d):
    assigned = table(spark, d, "predictions").select("id").distinct().withColumn("split", F.lit("scored"))
    return _examples(spark, d).select("id").join(assigned, "id", "left").groupBy(F.coalesce("split", F.lit("remaining")).alias("split")).agg(F.count(F.lit(1)).alias("rows"))


@query("E04_domains_looked_up", "SELECT e.domain, count(*) AS rows, (SELECT count(*) FROM predictions WHERE id NOT IN (SELECT id FROM examples)) AS unknown FROM predictions p JOIN examples e USING (id) GROUP BY e.domain")
def e04(spark, d):
    """An inner look-up; rows without a partner are counted, as there must be none."""
    p, e = table(spark, d, "predictions").select("id"), _examples(spark, d).select("id", "domain")
    unknown = p.join(e, "id", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    return p.join(e, "id").groupBy("domain").agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(unknown))  # one row


@query("E10_aligned_by_position", "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents), b AS (SELECT source_id, row_number() OVER (ORDER BY source_id) - 1 AS k FROM pair_docs) SELECT a.doc_id, b.source_id FROM a LEFT JOIN b USING (k)")
def e10(spark, d):
    from quern.sources.readers import align_by_position, with_positions

    a, b = with_positions(table(spark, d, "documents").select("doc_id"), ["doc_id"]), with_positions(table(spark, d, "pair_docs").select("source_id"), ["source_id"])
    return align_by_position(a, b).select("doc_id", "source_id")


@query("E11_locked_ids", "WITH m AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS place FROM (SELECT id FROM expert_articles UNION ALL SELECT -1)) SELECT m.id, place, e.id IS NULL AS missing FROM m LEFT JOIN expert_articles e ON e.id = m.id WHERE m.place <= 20 OR e.id IS NULL")
def e11(spark, d):
    """A manifest of ids in an order of its own; ids that aren't there are marked."""
    rows = table(spark, d, "expert_articles").select("id")
    with_place = global_position(rows.union(spark.createDataFrame([(-1,)], "id bigint")), ["id"])
    n = with_place.count()
    manifest = with_place.select("id", (n - F.col("position")).alias("place"))
    joined = manifest.join(rows.withColumn("hit", F.lit(1)), "id", "left")
    return joined.where("place <= 20 or hit is null").select("id", "place", F.col("hit").isNull().alias("missing"))


@query("E13_sliced_rows", "SELECT id, row_number() OVER (ORDER BY id) + 4 AS source_row FROM (SELECT id FROM expert_articles ORDER BY id LIMIT 6 OFFSET 5)")
def e13(spark, d):
    return global_position(table(spark, d, "expert_articles").select("id"), ["id"]).where("position >= 5 and position < 11").select("id", F.col("position").alias("source_row"))


@query("E17_pair_agreement", "WITH v AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(c), '[a-z]+'))) AS s, slot FROM (SELECT id, comment AS c, slot FROM " + _COMMENTS + ")) SELECT a.id, count(*) AS pairs, round(avg((a.s = b.s)::INT), 6) AS same FROM v a JOIN v b ON a.id = b.id AND a.slot < b.slot GROUP BY a.id")
def e17(spark, d):
    """Pairs of a document's explanations (five at most) with the same set of words."""
    v = _comments(spark, d).select("id", F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("comment"), F.lit("[a-z]+"), F.lit(0)))).alias("s"))
    same = v.groupBy("id", "s").agg(F.count(F.lit(1)).alias("k")).groupBy("id").agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("eq")).where("n > 1")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return same.select("id", pairs.cast("bigint").alias("pairs"), F.round(F.col("eq") / pairs, 6).alias("same"))


@query("E18_chunks_to_documents", f"WITH w AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, w[s:s+63] AS c FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) + 1), 64)) AS s FROM w)) SELECT doc_id, count(*) AS chunks, round(avg(len(list_distinct(c)) / greatest(len(c), 1)), 9) AS mean FROM c GROUP BY doc_id")
def e18(spark, d):
    """A score per chunk of 64 words, averaged per document."""
    w = table(spark, d, "documents").where("text is not null").select("doc_id", T.white_words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w")), F.lit(64))
    c = w.select("doc_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, 64))).alias("c"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(F.size(F.array_distinct("c")) / F.greatest(F.size("c"), F.lit(1))), 9).alias("mean"))


@query("H03_last_good_row", "SELECT id, detector, max_by(raw_label, generated_at) AS raw_label FROM predictions WHERE id <> '' AND raw_label IS NOT NULL AND error IS NULL GROUP BY ALL")
def h03(spark, d):
    return table(spark, d, "predictions").where("id != '' and raw_label is not null and error is null").groupBy("id", "detector").agg(F.max_by("raw_label", "generated_at").alias("raw_label"))


@query("H04_merge_by_key", "SELECT coalesce(id || '|' || detector, id) AS key, max(generated_at) AS at, count(*) AS versions FROM predictions GROUP BY 1")
def h04(spark, d):
    key = F.concat_ws("|", "id", "detector")
    return table(spark, d, "predictions").groupBy(key.alias("key")).agg(F.max("generated_at").alias("at"), F.count(F.lit(1)).alias("versions"))


@query("H09_cache_path", "SELECT detector, substr(sha256('{\"detector\":\"' || detector || '\",\"rows\":' || count(*) || '}'), 1, 24) AS key FROM predictions GROUP BY detector")
def h09(spark, d):
    from quern.sources.writers import json_line

    g = table(spark, d, "predictions").groupBy("detector").agg(F.count(F.lit(1)).alias("rows"))
    return g.select("detector", F.substring(F.sha2(json_line(g), 256), 1, 24).alias("key"))


@query("H12_cache_keys", "SELECT DISTINCT judge_id, substr(sha256('{\"blind_seed_offset\":500,\"judge_id\":\"' || judge_id || '\",\"judge_max_tokens\":1024,\"rollout_key\":\"r1\"}'), 1, 12) AS cache_key FROM judgments WHERE judge_id IS NOT NULL")
def h12(spark, d):
    from quern.sources.writers import json_line

    j = table(spark, d, "judgments").where("judge_id is not null").select("judge_id").distinct()
    config = j.select(F.lit(500).alias("blind_seed_offset"), "judge_id", F.lit(1024).alias("judge_max_tokens"), F.lit("r1").alias("rollout_key"))
    return config.select("judge_id", F.substring(F.sha2(json_line(config), 256), 1, 12).alias("cache_key"))


@query("H13_stale_cache", "SELECT id, detector, generated_at, generated_at < (SELECT max(generated_at) FROM predictions) - INTERVAL 30 DAY AS stale FROM predictions")
def h13(spark, d):
    rows = table(spark, d, "predictions").select("id", "detector", "generated_at")
    newest = rows.agg(F.max("generated_at").alias("newest"))
    return rows.crossJoin(F.broadcast(newest)).select("id", "detector", "generated_at", (F.col("generated_at") < F.expr("newest - interval 30 days")).alias("stale"))  # one row


@query("H15_config_key", "SELECT DISTINCT dataset, substr(sha256(lower(trim(dataset)) || '|v1'), 1, 12) AS key FROM examples WHERE dataset IS NOT NULL")
def h15(spark, d):
    return _examples(spark, d).where("dataset is not null").select("dataset", F.substring(F.sha2(T.key_of(F.lower(F.trim("dataset")), F.lit("v1")), 256), 1, 12).alias("key")).distinct()


@query("H16_bank_index", "SELECT doc_id, count(*) AS entries, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM judgments WHERE judge_id = 'panel_alder' AND item_id IS NOT NULL) GROUP BY doc_id")
def h16(spark, d):
    """Entries of one version of a bank, indexed by document (a document has few)."""
    bank = table(spark, d, "judgments").where("judge_id = 'panel_alder' and item_id is not null").select("doc_id", "item_id").distinct()
    return bank.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
