"""Queries over documents with tells: located spans, probes, evidence, rewards, contradiction, genericity.

The tells of an article are spans placed by a hash of article and slot; type, strength and explanation are the annotator's guess, confidence and comment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import evidence as E
from quern.functions import text as T
from quern.operators import intervals as V
from quern.operators import metrics as M
from quern.operators import tells as D
from quern.plans.registry import query, table

_W = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_STRIP = lambda x: f"regexp_replace({x}, '^{_W}|{_W}$', '', 'g')"
_CLASS = lambda x: f"CASE WHEN lower(trim({x})) LIKE 'ai%' THEN 1 WHEN lower(trim({x})) LIKE 'human%' THEN 0 END"
_T = f"""tells AS (SELECT id, slot, text, y, st, least(st + w, length(text)) AS en, substr(text, st + 1, least(st + w, length(text)) - st) AS span, why, type, score, CASE type WHEN 'AI' THEN 1 WHEN 'human' THEN -1 ELSE 0 END AS pol, title FROM (
  SELECT id, slot, article AS text, title, coalesce({_CLASS("ground_truth")}, {_CLASS("expert_majority_vote")}) AS y, ('0x' || substr(sha256(id::VARCHAR || '|' || slot), 1, 6))::BIGINT % greatest(length(article), 1) AS st,
    12 + ('0x' || substr(sha256(id::VARCHAR || '|' || slot), 7, 2))::BIGINT % 60 AS w, coalesce(a.comment, '') AS why, CASE WHEN lower(trim(a.guess)) LIKE 'ai%' THEN 'AI' WHEN lower(trim(a.guess)) LIKE 'human%' THEN 'human' ELSE a.guess END AS type, coalesce(a.confidence, 0) / 5.0::DOUBLE AS score
    FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS slot, unnest([annotator_1, annotator_2, annotator_3, annotator_4, annotator_5]) AS a FROM expert_articles) WHERE a.guess IS NOT NULL AND article <> '') WHERE y IS NOT NULL)"""
#: Merged intervals of the tells that fulfil a condition, in SQL: ``{name}`` with id, st, en.
_MERGE = lambda name, cond: f"""{name}0 AS (SELECT id, st, en, max(en) OVER (PARTITION BY id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM tells WHERE en > st AND {cond}),
  {name}1 AS (SELECT *, sum(CASE WHEN r IS NULL OR st > r THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS g FROM {name}0), {name} AS (SELECT id, min(st) AS st, max(en) AS en FROM {name}1 GROUP BY id, g)"""  # noqa: E731
_KEEP = lambda name: f"(SELECT d.id, coalesce((SELECT string_agg(p, ' [...] ' ORDER BY st) FROM (SELECT st, {_STRIP('substr(d.text, st + 1, en - st)')} AS p FROM {name} m WHERE m.id = d.id) WHERE p <> ''), ' ') AS text FROM docs d)"
_DROP = lambda name: f"(SELECT d.id, CASE WHEN (SELECT count(*) FROM {name} m WHERE m.id = d.id) = 0 THEN d.text ELSE coalesce(nullif({_STRIP(f'''(SELECT string_agg(substr(d.text, f + 1, t - f), '' ORDER BY f) FROM (SELECT coalesce(lag(en) OVER (ORDER BY st), 0) AS f, st AS t FROM (SELECT st, en FROM {name} m WHERE m.id = d.id UNION ALL SELECT length(d.text), length(d.text)) ORDER BY st))''')}, ''), ' ') END AS text FROM docs d)"
_SCORE = lambda x: "1 / (1 + power(2.718281828, -0.35 * (" + " + ".join(f"(length(lower({x})) - length(replace(lower({x}), '{w}', ''))) // {len(w)}" for w in ("ai", "generated", "formal", "therefore", "overall")) + " - " + " - ".join(f"(length(lower({x})) - length(replace(lower({x}), '{w}', ''))) // {len(w)}" for w in ("typo", "lol", "i ", "cant", "human")) + ")))"
_DOCS = "docs AS (SELECT DISTINCT id, text, y FROM tells)"


def _docs(spark, d):
    """``id, title, text, y, tells``: articles with a known class and at least one guess."""
    cls = lambda c: F.when(F.lower(F.trim(c)).startswith("ai"), 1).when(F.lower(F.trim(c)).startswith("human"), 0)
    n = F.greatest(F.length("article"), F.lit(1))

    def tell(i: int):
        a = F.col(f"annotator_{i}")
        h = F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(i))), 256)
        start = F.pmod(F.conv(F.substring(h, 1, 6), 16, 10).cast("bigint"), n).cast("int")
        end = F.least(start + 12 + F.pmod(F.conv(F.substring(h, 7, 2), 16, 10).cast("int"), F.lit(60)), F.length("article")).cast("int")
        low = F.lower(F.trim(a["guess"]))
        kind = F.when(low.startswith("ai"), "AI").when(low.startswith("human"), "human").otherwise(a["guess"])
        polarity = F.when(kind == "AI", 1).when(kind == "human", -1).otherwise(0)
        fields = (F.lit(i).alias("ord"), start.alias("start"), end.alias("end"), kind.alias("type"), (F.coalesce(a["confidence"].cast("double"), F.lit(0.0)) / 5.0).alias("score"), F.coalesce(a["comment"], F.lit("")).alias("why"), F.substr("article", start + 1, end - start).alias("span"), polarity.alias("polarity"))
        return F.struct(*fields)

    rows = table(spark, d, "expert_articles").where("article != ''").withColumn("y", F.coalesce(cls("ground_truth"), cls("expert_majority_vote")))
    tells = F.filter(F.array(*[tell(i) for i in range(1, 6)]), lambda t: t["type"].isNotNull())
    return rows.select("id", "title", F.col("article").alias("text"), "y", tells.alias("tells")).where("y is not null and size(tells) > 0")


def _tells(spark, d):
    return _docs(spark, d).select("id", "title", "text", "y", F.explode("tells").alias("t")).select("id", "title", "text", "y", "t.*")


_ORDERED = "SELECT id, list(struct_pack(s := span, w := why, t := type, c := score, p := pol, o := slot, f := st, e := en) ORDER BY slot) AS ts FROM tells GROUP BY id"


@query("O30_keyword_scorer", f"SELECT id, round({_SCORE('coalesce(text, ' + chr(39) * 2 + ')')}, 9) AS score FROM examples")
def o30(spark, d):
    return table(spark, d, "examples").select("id", F.round(E.keyword_score(F.col("text")), 9).alias("score"))


@query("O10_label_agreement", f"WITH {_T} SELECT id, slot, CASE WHEN type NOT IN ('AI', 'human') THEN 0 WHEN (type = 'AI') = (y = 1) THEN 1 ELSE -1 END AS agreement FROM tells")
def o10(spark, d):
    return _tells(spark, d).select("id", F.col("ord").alias("slot"), E.label_agreement(F.col("type"), F.col("y")).alias("agreement"))


_WORDS = lambda x: f"list_filter(string_split_regex({x}, '{_W}'), lambda w: w <> '')"
_REP = lambda t, n: f"CASE WHEN len({t}) >= {n} THEN len(list_distinct(list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i+{n - 1}], ' ')))) / (len({t}) - {n} + 1) ELSE 1 END"
_QUALITY = f"CASE WHEN len(t) = 0 THEN 0 ELSE (CASE WHEN len(t) < 10 THEN (len(t) / 10.0::DOUBLE) ** 2 WHEN len(t) <= 40 THEN 1 WHEN len(t) >= 80 THEN 0 ELSE ((80 - len(t)) / 40.0::DOUBLE) ** 2 END) * {_REP('t', 3)} END"
_GATE = f"CASE WHEN len(t) = 0 THEN 0 ELSE (CASE WHEN len(t) < 50 THEN (len(t) / 50.0::DOUBLE) ** 2 WHEN len(t) <= 150 THEN 1 WHEN len(t) >= 200 THEN 0 ELSE ((200 - len(t)) / 50.0::DOUBLE) ** 2 END) * {_REP('t', 3)} END"


@query("O11_why_quality", f"WITH {_T}, w AS (SELECT id, slot, {_WORDS('why')} AS t FROM tells) SELECT id, slot, round({_QUALITY}, 9) AS quality FROM w")
def o11(spark, d):
    return _tells(spark, d).select("id", F.col("ord").alias("slot"), F.round(E.why_quality(F.col("why")), 9).alias("quality"))


@query("O12_explanation_reward", f"WITH {_T}, w AS (SELECT id, slot, score, {_WORDS('why')} AS t FROM tells) SELECT id, slot, round(least(1, greatest(0, score)) * {_QUALITY}, 9) AS reward FROM w")
def o12(spark, d):
    return _tells(spark, d).select("id", F.col("ord").alias("slot"), F.round(E.explanation_reward(F.col("score"), F.col("why")), 9).alias("reward"))


#: A second strength per tell for the comparison of two scores.
_OTHER = "(('0x' || substr(sha256(id::VARCHAR || '#' || slot), 1, 4))::BIGINT % 150) / 100.0::DOUBLE"


@query("O13_score_agreement", f"WITH {_T} SELECT id, slot, round(1 - abs(least(1, greatest(0, {_OTHER})) - least(1, greatest(0, score))), 9) AS agreement FROM tells")
def o13(spark, d):
    h = F.sha2(F.concat_ws("#", F.col("id").cast("string"), F.col("ord").cast("string")), 256)
    other = F.pmod(F.conv(F.substring(h, 1, 4), 16, 10).cast("int"), F.lit(150)) / 100.0
    return _tells(spark, d).select("id", F.col("ord").alias("slot"), F.round(E.score_agreement(other, F.col("score")), 9).alias("agreement"))


@query("O14_verdict_reward", f"SELECT id, CASE WHEN v NOT IN ('AI', 'human') THEN 0.0::DOUBLE WHEN (v = 'AI') = (label = 1) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS reward FROM (SELECT id, label, CASE WHEN pred_builtin = 1 THEN 'AI' WHEN pred_builtin = 0 THEN 'human' ELSE 'none' END AS v FROM predictions WHERE label IS NOT NULL)")
def o14(spark, d):
    v = F.when(F.col("pred_builtin") == 1, "AI").when(F.col("pred_builtin") == 0, "human").otherwise("none")
    return table(spark, d, "predictions").where("label is not null").select("id", E.label_agreement(v, F.col("label")).cast("double").alias("reward"))


@query("O15_length_gate", f"WITH w AS (SELECT id, {_WORDS('text')} AS t FROM examples WHERE text IS NOT NULL) SELECT id, round({_GATE}, 9) AS gate FROM w")
def o15(spark, d):
    return table(spark, d, "examples").where("text is not null").select("id", F.round(E.length_gate(F.col("text")), 9).alias("gate"))


#: The verdict's explanation of an article: the first comments and two quotations, one of them from a span.
_VERDICT = "verdicts AS (SELECT id, string_agg(why, ' ' ORDER BY slot) FILTER (slot <= 2) || ' “' || substr(any_value(text), 6, 24) || '” and ‘' || max(span) FILTER (slot = m) || '’' AS v FROM (SELECT *, min(slot) OVER (PARTITION BY id) AS m FROM tells) GROUP BY id)"
_PLAIN = lambda x: f"list_distinct(list_filter(list_transform({_WORDS(f'lower({x})')}, lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), lambda w: length(w) >= 3))"
_RECALL = f"r AS (SELECT id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS recall FROM (SELECT id, {_PLAIN('w')} AS a, {_PLAIN('v')} AS b FROM (SELECT id, string_agg(why, ' ' ORDER BY slot) AS w FROM tells GROUP BY id) JOIN verdicts USING (id)))"
_COVER = "k AS (SELECT id, CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda x: len(list_filter(s, lambda y: y <> '' AND (contains(y, trim(x)) OR contains(trim(x), y)))) > 0)) / len(q) ELSE 0 END AS cover FROM (SELECT id, regexp_extract_all(v, '[“”‘’]([^“”‘’]{3,})[“”‘’]', 1) AS q, s FROM verdicts JOIN (SELECT id, list(span) AS s FROM tells GROUP BY id) USING (id)))"


def _verdicts(spark, d):
    """Adds ``verdict``."""
    first = F.filter("tells", lambda t: t["ord"] <= 2)
    comments = F.when(F.size(first) > 0, F.array_join(F.transform(first, lambda t: t["why"]), " "))
    return _docs(spark, d).withColumn("verdict", F.concat(comments, F.lit(" “"), F.substring("text", 6, 24), F.lit("” and ‘"), F.element_at("tells", 1)["span"], F.lit("’")))


_SPANS_OF = lambda: F.transform("tells", lambda t: t["span"])
_WHYS_OF = lambda: F.transform("tells", lambda t: t["why"])


@query("O17_verdict_recall", f"WITH {_T}, {_VERDICT}, {_RECALL} SELECT id, round(recall, 9) AS recall FROM r")
def o17(spark, d):
    return _verdicts(spark, d).select("id", F.round(E.word_recall(_WHYS_OF(), F.col("verdict")), 9).alias("recall"))


@query("O18_quote_coverage", f"WITH {_T}, {_VERDICT}, {_COVER} SELECT id, round(cover, 9) AS coverage FROM k")
def o18(spark, d):
    return _verdicts(spark, d).select("id", F.round(E.quote_coverage(F.col("verdict"), _SPANS_OF()), 9).alias("coverage"))


@query("O16_combined_verdict", f"WITH {_T}, {_VERDICT}, {_RECALL}, {_COVER}, g AS (SELECT id, {_GATE} AS gate FROM (SELECT id, {_WORDS('v')} AS t FROM verdicts WHERE v IS NOT NULL)) SELECT id, round(gate * (recall + cover), 9) AS reward FROM g JOIN r USING (id) JOIN k USING (id)")
def o16(spark, d):
    return _verdicts(spark, d).where("verdict is not null").select("id", F.round(E.verdict_reward(F.col("verdict"), _WHYS_OF(), _SPANS_OF()), 9).alias("reward"))


_SIGNED = "CASE type WHEN 'AI' THEN least(1, greatest(0, score)) WHEN 'human' THEN -least(1, greatest(0, score)) END"


@query("O03_signed_scores", f"WITH {_T} SELECT id, slot, round({_SIGNED}, 9) AS signed FROM tells")
def o03(spark, d):
    return _tells(spark, d).select("id", F.col("ord").alias("slot"), F.round(E.signed(F.col("type"), F.col("score")), 9).alias("signed"))


_EVIDENCE = f"s AS (SELECT id, y, {_SIGNED} AS s FROM tells), e AS (SELECT id, any_value(y) AS y, sum(exp(3 * abs(s)) * s) / sum(exp(3 * abs(s))) AS e FROM s WHERE s IS NOT NULL GROUP BY id)"
_ALIGNED = "a AS (SELECT id, sum(exp(3 * score) * score) / sum(exp(3 * score)) AS a FROM tells WHERE (y = 1 AND type = 'AI') OR (y = 0 AND type = 'human') GROUP BY id)"


@query("O02_signed_evidence", f"WITH {_T}, {_EVIDENCE} SELECT t.id, round(coalesce(e, 0.0), 9) AS evidence, round(coalesce((SELECT avg(s) FROM s WHERE s.id = t.id), 0.0), 9) AS plain FROM (SELECT DISTINCT id FROM tells) t LEFT JOIN e USING (id)")
def o02(spark, d):
    s = E.signed_scores(F.col("tells"))
    return _docs(spark, d).select("id", F.round(E.softmax_mean_of(s, 3.0), 9).alias("evidence"), F.round(E.softmax_mean_of(s, 0.0), 9).alias("plain"))


@query("O04_aligned_strength", f"WITH {_T}, {_ALIGNED} SELECT id, round(coalesce(a, 0.0), 9) AS strength FROM (SELECT DISTINCT id FROM tells) LEFT JOIN a USING (id)")
def o04(spark, d):
    return _docs(spark, d).select("id", F.round(E.aligned_strength(F.col("tells"), F.col("y"), 3.0), 9).alias("strength"))


_VSCORE = "CASE WHEN e IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, 0.5 + (CASE WHEN t.y = 0 THEN -1 ELSE 1 END) * 0.45 * tanh(e / 0.5) * coalesce(a, 0))) END"


@query("O05_verdict_score", f"WITH {_T}, {_EVIDENCE}, {_ALIGNED} SELECT t.id, round({_VSCORE}, 9) AS verdict FROM (SELECT DISTINCT id, y FROM tells) t LEFT JOIN e ON e.id = t.id LEFT JOIN a ON a.id = t.id")
def o05(spark, d):
    return _docs(spark, d).select("id", F.round(E.verdict_score(F.col("tells"), F.col("y"), 3.0, 0.45, 0.5), 9).alias("verdict"))


@query("O06_patched_scores", f"WITH {_T}, {_EVIDENCE}, {_ALIGNED}, n AS (SELECT t.id, {_VSCORE} AS new, 0.5 AS old FROM (SELECT DISTINCT id, y FROM tells) t LEFT JOIN e ON e.id = t.id LEFT JOIN a ON a.id = t.id) SELECT id, round(new, 9) AS verdict_score, 'score=\"' || printf('%.2f', new) || '\"' AS attribute FROM n WHERE abs(new - old) >= 0.0001")
def o06(spark, d):
    rows = _docs(spark, d).select("id", E.verdict_score(F.col("tells"), F.col("y"), 3.0, 0.45, 0.5).alias("new"))
    return rows.where("abs(new - 0.5) >= 0.0001").select("id", F.round("new", 9).alias("verdict_score"), F.format_string('score="%.2f"', "new").alias("attribute"))


@query("O07_tell_probability", f"WITH {_T}, g AS (SELECT id, sum(exp(3 * score) * pol * score) / sum(exp(3 * score)) AS m FROM tells GROUP BY id) SELECT id, round(1 / (1 + exp(-4 * m)), 9) AS p FROM g")
def o07(spark, d):
    return _docs(spark, d).select("id", F.round(E.tell_probability(F.col("tells")), 9).alias("p"))


@query("O08_rubric_score", f"WITH {_T} SELECT id, round((0.7 * avg(score) + 0.3 * max(score)) / 1.0, 9) AS rubric FROM tells GROUP BY id")
def o08(spark, d):
    mean = F.aggregate("tells", F.lit(0.0), lambda a, t: a + t["score"]) / F.size("tells")
    top = F.array_max(F.transform("tells", lambda t: t["score"]))
    return _docs(spark, d).select("id", F.round((0.7 * mean + 0.3 * top) / (0.7 + 0.3), 9).alias("rubric"))


@query("F32_mean_credibility", f"WITH {_T} SELECT id, round(avg(CASE WHEN score > 0 THEN score END), 9) AS known, round(coalesce(avg(CASE WHEN score > 0 THEN score END), 0.0), 9) AS mean FROM tells GROUP BY id")
def f32(spark, d):
    known = F.filter(F.transform("tells", lambda t: F.when(t["score"] > 0, t["score"])), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    return _docs(spark, d).select("id", F.round(mean, 9).alias("known"), F.round(F.coalesce(mean, F.lit(0.0)), 9).alias("mean"))


@query("F31_tell_summary", f"WITH {_T} SELECT count(DISTINCT id) AS documents, count(*) AS tells, round(count(*) / count(DISTINCT id), 2) AS mean_tells, count(*) FILTER (type = 'AI') AS ai, count(*) FILTER (type = 'human') AS human FROM tells")
def f31(spark, d):
    n = lambda k: F.sum(F.size(F.filter("tells", lambda t: t["type"] == k)))
    return _docs(spark, d).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("tells")).alias("tells"), F.round(F.avg(F.size("tells")), 2).alias("mean_tells"), n("AI").alias("ai"), n("human").alias("human"))


@query("I04_spans_by_polarity", f"WITH {_T}, {_MERGE('m', 'pol = 1 AND score >= 0.6')} SELECT id, st AS start, en AS \"end\" FROM m")
def i04(spark, d):
    return _docs(spark, d).select("id", F.explode(D.spans_for(F.col("tells"), 1, 0.6)).alias("s")).select("id", "s.start", "s.end")


@query("I07_replaced_span", f"WITH {_T} SELECT id, sha256(coalesce(nullif({_STRIP(chr(40) + 'substr(text, 1, st) || ' + chr(39) + '[changed]' + chr(39) + ' || substr(text, en + 1))')}, ''), ' ')) AS form FROM tells WHERE slot = 1")
def i07(spark, d):
    t = _tells(spark, d).where("ord = 1")
    spliced = T.strip(F.concat(F.substr("text", F.lit(1), F.col("start")), F.lit("[changed]"), F.substr("text", F.col("end") + 1, F.length("text"))))
    return t.select("id", F.sha2(F.when(spliced == "", " ").otherwise(spliced), 256).alias("form"))


@query("I02_overlapping_tells", f"WITH {_T} SELECT a.id, a.slot, count(b.slot) > 0 AS overlaps FROM tells a LEFT JOIN tells b ON a.id = b.id AND b.slot < a.slot AND a.st < b.en AND a.en > b.st GROUP BY a.id, a.slot")
def i02(spark, d):
    at = lambda t: F.filter("tells", lambda x: x["ord"] < t["ord"])
    rows = _docs(spark, d).select("id", F.explode(F.transform("tells", lambda t: F.struct(t["ord"].alias("slot"), V.overlaps(t["start"], t["end"], at(t)).alias("overlaps")))).alias("r"))
    return rows.select("id", "r.slot", "r.overlaps")


@query("G20_budget_selection", f"""WITH {_T}, b AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2, 0.5])::DOUBLE AS budget),
  RECURSIVE_DUMMY AS (SELECT 1), o AS (SELECT id, slot, en - st AS n, length(text) AS len, row_number() OVER (PARTITION BY id ORDER BY score DESC, slot) AS k FROM tells),
  l AS (SELECT id, any_value(len) AS len, list(n ORDER BY k) AS ns FROM o GROUP BY id),
  f AS (SELECT id, budget, greatest(1, floor(len * budget)::BIGINT) AS room, ns, list_min(list_transform(ns, lambda x: greatest(1, x))) AS least FROM l, b),
  r AS (SELECT id, budget, least, list_reduce(list_transform(list_concat([0], ns), lambda x: [x, 0]), lambda a, x: CASE WHEN x[1] > 0 AND a[1] + x[1] <= room THEN [a[1] + x[1], a[2] + 1] ELSE a END) AS g FROM f)
  SELECT id, budget, CASE WHEN g[2] > 0 THEN g[2] ELSE 1 END AS tells, CASE WHEN g[2] > 0 THEN g[1] ELSE least END AS chars FROM r""".replace("\n  RECURSIVE_DUMMY AS (SELECT 1), o AS", " o AS"))
def g20(spark, d):
    return D.budget_texts(_docs(spark, d)).select("id", "budget", F.col("tells").cast("bigint").alias("tells"), F.col("chars").cast("bigint").alias("chars"))


@query("L14_probe_metrics", f"""WITH {_T}, {_DOCS}, {_MERGE('m', 'true')}, p AS (SELECT id, {_SCORE('text')} AS p FROM {_KEEP('m')}), s AS (SELECT p.id, y, round(p, 9) AS p FROM p JOIN docs USING (id)),
  g AS (SELECT p, count(*) FILTER (y = 1)::DOUBLE AS pos, count(*) FILTER (y = 0)::DOUBLE AS neg FROM s GROUP BY p), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn FROM g WINDOW w AS (ORDER BY p DESC))
  SELECT round(sum(pos * (nn - fp + 0.5 * neg)) / (max(pp) * max(nn)), 6) AS auroc, round(coalesce(max(tp / pp) FILTER (fp / nn <= 0.01), 0.0), 6) AS tpr FROM c""")
def l14(spark, d):
    p = D.probes(_docs(spark, d)).where("probe = 'only'").select("y", F.round(E.keyword_score(F.col("text")), 9).alias("p"))
    m = M.curve_metrics(M.score_curve(p, [], "y", "p"), [])
    return m.select(F.round("auroc", 6).alias("auroc"), F.round("tpr_at_fpr_01", 6).alias("tpr"))


_EFFECTS = f"""{_DOCS}, {_MERGE('m', 'true')}, {_MERGE('a', 'pol = 1')}, {_MERGE('h', 'pol = -1')}, onl AS {_KEEP('m')}, rem AS {_DROP('m')}, arem AS {_DROP('a')}, hrem AS {_DROP('h')},
  x AS (SELECT d.id, d.y, {_SCORE('d.text')} AS full_, {_SCORE("onl.text")} AS only_, {_SCORE('rem.text')} AS rem_, {_SCORE('arem.text')} AS arem_, {_SCORE('hrem.text')} AS hrem_, d.id IN (SELECT id FROM a) AS has_a, d.id IN (SELECT id FROM h) AS has_h
    FROM docs d JOIN onl USING (id) JOIN rem USING (id) JOIN arem USING (id) JOIN hrem USING (id)),
  f AS (SELECT id, greatest(0, CASE WHEN y = 1 THEN full_ - only_ ELSE only_ - full_ END) AS suff, CASE WHEN y = 1 THEN full_ - rem_ ELSE rem_ - full_ END AS comp, CASE WHEN has_a THEN full_ - arem_ END AS ad, CASE WHEN has_h THEN hrem_ - full_ END AS hr FROM x)"""


@query("L19_deletion_effects", f"WITH {_T}, {_EFFECTS} SELECT id, round(suff, 9) AS sufficiency_drop, round(comp, 9) AS comprehensiveness_drop, round(ad, 9) AS ai_drop, round(hr, 9) AS human_rise FROM f")
def l19(spark, d):
    return D.deletion_effects(_docs(spark, d)).select("id", *[F.round(c, 9).alias(c) for c in ("sufficiency_drop", "comprehensiveness_drop", "ai_drop", "human_rise")])


@query("L19_faithfulness", f"""WITH {_T}, {_EFFECTS}, s AS (SELECT count(*) AS documents, avg(suff) AS sm, avg(comp) AS cm, avg(ad) AS adm, avg((ad > 0.000001)::INT) FILTER (ad IS NOT NULL) AS adr, avg(hr) AS hrm, avg((hr > 0.000001)::INT) FILTER (hr IS NOT NULL) AS hrr FROM f)
  SELECT documents, round(sm, 9) AS sufficiency_mean, round(cm, 9) AS comprehensiveness_mean, round(adm, 9) AS ai_drop_mean, round(adr, 9) AS ai_drop_rate, round(hrm, 9) AS human_rise_mean, round(hrr, 9) AS human_rise_rate, round(CASE WHEN adm IS NULL THEN hrm WHEN hrm IS NULL THEN adm ELSE (adm + hrm) / 2 END, 9) AS signed_deletion FROM s""")
def l19b(spark, d):
    f = D.faithfulness(D.deletion_effects(_docs(spark, d)))
    return f.select("documents", *[F.round(c, 9).alias(c) for c in f.columns if c != "documents"])


@query("L20_contradiction", f"WITH {_T}, c AS (SELECT score AS s, ((2 * y - 1) * pol < 0)::INT AS c FROM tells) SELECT round(avg(c), 9) AS rate_all, round(sum(s * c) / greatest(sum(s), 1e-12), 9) AS weighted_all, round(avg(c) FILTER (s >= 0.5), 9) AS rate_high, round(sum(s * c) FILTER (s >= 0.5) / greatest(sum(s) FILTER (s >= 0.5), 1e-12), 9) AS weighted_high, count(*) FILTER (s >= 0.5) AS high_tells FROM c")
def l20(spark, d):
    c = D.contradiction(_docs(spark, d))
    return c.select(*[F.round(x, 9).alias(x) for x in c.columns[:-1]], "high_tells")


_STOP_SQL = "['the', 'a', 'an', 'and', 'or', 'it', 'this', 'that', 'is', 'are', 'was', 'were', 'of', 'to', 'in', 'for', 'with', 'as', 'on', 'by', 'because', 'suggests', 'indicates', 'text', 'span', 'phrase', 'writing', 'authorship', 'human', 'ai', 'generated', 'common', 'typical']"
_CONTENT = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP_SQL}, w)))"
_FORM = f"regexp_replace(trim(regexp_replace(lower(why), '{_W}', ' ', 'g')), '[^a-z0-9\\s-]', '', 'g')"
_STOCK = " OR ".join(f"contains({_FORM}, '{p}')" for p in ("too polished", "generic phrasing", "sounds generic", "ai-like", "lacks personality", "overly formal", "formulaic", "unnatural", "repetitive", "predictable structure", "typical of human writing", "typical of ai writing", "typical of ai-generated", "typical of machine-generated", "common in ai", "common in human"))
_OVERLAP = f"o AS (SELECT id, slot, score, {_FORM} AS form, {_STOCK} AS stock, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS overlap FROM (SELECT *, {_CONTENT('why')} AS a, {_CONTENT('span')} AS b FROM tells))"


@query("L22_explanation_overlap", f"WITH {_T}, {_OVERLAP} SELECT id, slot, round(overlap, 9) AS overlap FROM o")
def l22(spark, d):
    return _tells(spark, d).select("id", F.col("ord").alias("slot"), F.round(E.explanation_overlap(F.col("why"), F.col("span")), 9).alias("overlap"))


@query("L23_content_words", f"WITH {_T} SELECT id, slot, array_to_string(list_sort({_CONTENT('why')}), ' ') AS words FROM tells")
def l23(spark, d):
    return _tells(spark, d).select("id", F.col("ord").alias("slot"), F.array_join(F.array_sort(T.content_tokens(F.col("why"))), " ").alias("words"))


@query("L21_generic_explanations", f"WITH {_T}, {_OVERLAP}, h AS (SELECT *, count(*) OVER (PARTITION BY form) AS n FROM o WHERE score >= 0.5), f AS (SELECT score, ((stock OR n >= 5) AND overlap < 0.05)::INT AS g FROM h) SELECT round(avg(g), 9) AS rate, round(sum(g * score) / greatest(sum(score), 1e-12), 9) AS weighted, count(*) AS tells FROM f")
def l21(spark, d):
    g = D.genericity(_docs(spark, d))
    return g.select(F.round("rate", 9).alias("rate"), F.round("weighted", 9).alias("weighted"), "tells")


@query("L24_strongest_tells", f"WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, slot) AS k FROM tells), p AS (SELECT id, slot, pol, {_SCORE('text')} AS before, {_SCORE(chr(40) + 'coalesce(nullif(' + _STRIP('substr(text, 1, st) || upper(span) || substr(text, en + 1)') + ', ' + chr(39) * 2 + '), ' + chr(39) + ' ' + chr(39) + '))')} AS after FROM r WHERE k <= 2 AND upper(span) <> span) SELECT id, slot, round(pol * (before - after), 9) AS effect FROM p")
def l24(spark, d):
    """Counterfactual rewrites of the two strongest tells of a document; the rewriter stands in as upper case, unchanged spans are skipped."""
    order = F.array_sort("tells", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["ord"] - b["ord"]))
    t = _docs(spark, d).select("id", "text", F.explode(F.slice(order, 1, 2)).alias("t")).select("id", "text", "t.*").where("upper(span) != span")
    spliced = T.strip(F.concat(F.substr("text", F.lit(1), F.col("start")), F.upper("span"), F.substr("text", F.col("end") + 1, F.length("text"))))
    effect = F.col("polarity") * (E.keyword_score(F.col("text")) - E.keyword_score(F.when(spliced == "", " ").otherwise(spliced)))
    return t.select("id", F.col("ord").alias("slot"), F.round(effect, 9).alias("effect"))
