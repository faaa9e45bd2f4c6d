"""Queries over texts: n-grams, weights, genericity, evidence, spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import intervals as V
from quern.operators import textmine as X
from quern.plans.registry import query, table

_W = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_GRAMS = lambda t, n: f"CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i+{n - 1}], ' ')) ELSE [] END"
_COMMENTS = "(SELECT id::VARCHAR || ':' || slot AS cid, id, slot, a.comment AS comment, a.guess AS guess FROM (SELECT id, unnest([1, 2, 3, 4, 5]) AS slot, unnest([annotator_1, annotator_2, annotator_3, annotator_4, annotator_5]) AS a FROM expert_articles) WHERE trim(a.comment) <> '')"


def _comments(spark, d):
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"annotator_{i}").alias("a")) for i in range(1, 6)])
    rows = table(spark, d, "expert_articles").select("id", F.explode(slots).alias("s")).select("id", "s.slot", F.col("s.a.comment").alias("comment"), F.col("s.a.guess").alias("guess"))
    return rows.where("trim(comment) != ''").select(F.concat_ws(":", F.col("id").cast("string"), F.col("slot").cast("string")).alias("cid"), "id", "slot", "comment", "guess")


@query("N19_edit_overlap", f"WITH p AS (SELECT source_id, {_TOK.format('source_text')} AS a, {_TOK.format('ai_edited.text')} AS b FROM pair_docs WHERE source_text IS NOT NULL AND ai_edited.text IS NOT NULL), x AS (SELECT source_id, g, count(*) AS a FROM (SELECT source_id, unnest({_GRAMS('a', 3)}) AS g FROM p) GROUP BY ALL), y AS (SELECT source_id, g, count(*) AS b FROM (SELECT source_id, unnest({_GRAMS('b', 3)}) AS g FROM p) GROUP BY ALL) SELECT source_id AS id, round(sum(least(a, coalesce(b, 0))) / sum(a), 6) AS ratio FROM x LEFT JOIN y USING (source_id, g) GROUP BY ALL")
def n19(spark, d):
    p = table(spark, d, "pair_docs").where("source_text is not null and ai_edited.text is not null")
    a, b = p.select("source_id", F.col("source_text").alias("t")), p.select("source_id", F.col("ai_edited.text").alias("t"))
    return X.overlap_ratio(a, b, "source_id", X.words("t"), 3).withColumn("ratio", F.round("ratio", 6))


@query("K10_repetition", f"WITH t AS (SELECT id, {_TOK.format('text')} AS t FROM examples WHERE text IS NOT NULL), g AS (SELECT id, {_GRAMS('t', 8)} AS g FROM t) SELECT id, round(CASE WHEN len(g) > 0 THEN 1 - len(list_distinct(g)) / len(g) ELSE 0 END, 6) AS repetition FROM g")
def k10(spark, d):
    rows = table(spark, d, "examples").where("text is not null")
    return rows.select("id", F.round(1 - T.distinct_ratio(X.words("text"), 8), 6).alias("repetition"))


#: Two spans per document, from a hash of its id: the same in both engines.
_SPANS = "(SELECT doc_id, k, ('0x' || substr(sha256(doc_id::VARCHAR || '|' || k), 1, 6))::BIGINT % greatest(length(text), 1) AS s, ('0x' || substr(sha256(doc_id::VARCHAR || '|' || k), 7, 2))::BIGINT AS w, text FROM documents, (VALUES (1), (2), (3)) AS v(k) WHERE text IS NOT NULL)"


def _spans(spark, d, documents=None):
    docs = (table(spark, d, "documents") if documents is None else documents).where("text is not null").select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    h = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("k").cast("string")), 256)
    s = F.pmod(F.conv(F.substring(h, 1, 6), 16, 10).cast("bigint"), F.greatest(F.length("text"), F.lit(1)))
    rows = docs.withColumns({"s": s, "w": F.conv(F.substring(h, 7, 2), 16, 10).cast("bigint")})
    return rows.select("doc_id", "k", "text", F.col("s").cast("int").alias("start"), F.least(F.col("s") + F.col("w"), F.length("text")).cast("int").alias("end"))


_MERGED = f"""s AS (SELECT doc_id, s AS st, least(s + w, length(text)) AS en FROM {_SPANS}), c AS (SELECT * FROM s WHERE en > st), m AS (SELECT *, max(en) OVER (PARTITION BY doc_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR st > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS isl FROM m), u AS (SELECT doc_id, min(st) AS st, max(en) AS en FROM i GROUP BY doc_id, isl)"""


@query("I01_merged_intervals", f"WITH {_MERGED} SELECT doc_id, st AS start, en AS \"end\" FROM u")
def i01(spark, d):
    return V.merge_interval_rows(_spans(spark, d), ["doc_id"])


def _per_document(spark, d, documents=None):
    """``doc_id, text, iv``: the merged intervals of a document's three spans, worked out in its row."""
    docs = (table(spark, d, "documents") if documents is None else documents).where("text is not null").select("doc_id", "text")

    def span(k):
        h = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(str(k))), 256)
        s = F.pmod(F.conv(F.substring(h, 1, 6), 16, 10).cast("bigint"), F.greatest(F.length("text"), F.lit(1)))
        return F.struct(s.cast("int").alias("start"), F.least(s + F.conv(F.substring(h, 7, 2), 16, 10).cast("bigint"), F.length("text")).cast("int").alias("end"))

    return docs.withColumn("iv", V.merged(F.array(*[span(k) for k in (1, 2, 3)])))


@query("F15_span_coverage", f"WITH {_MERGED}, w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '{_W}'), lambda x: x <> '')) AS words, length(text) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS spans, sum(en - st) AS covered, round(100 * count(*) / any_value(greatest(words, 1)), 6) AS per_100_words, round(sum(en - st) / any_value(n), 6) AS share FROM u JOIN w USING (doc_id) GROUP BY doc_id HAVING sum(en - st) < any_value(n)")
def f15(spark, d):
    """Documents whose spans aren't the whole text: spans, per 100 words, and the share of characters they cover."""
    rows = _per_document(spark, d).select("doc_id", F.size("iv").cast("bigint").alias("spans"), V.covered(F.col("iv")).cast("bigint").alias("covered"), F.size(T.white_words(F.col("text"))).alias("w"), F.length("text").alias("n"))
    return rows.where("spans > 0 and covered < n").select("doc_id", "spans", "covered", F.round(100 * F.col("spans") / F.greatest("w", F.lit(1)), 6).alias("per_100_words"), F.round(F.col("covered") / F.col("n"), 6).alias("share"))


_STRIP = lambda x: f"regexp_replace({x}, '^{_W}|{_W}$', '', 'g')"


@query("I05_extracted_spans", f"WITH {_MERGED} SELECT doc_id, sha256(coalesce(string_agg(p, ' [...] ' ORDER BY st) FILTER (p <> ''), ' ')) AS kept FROM (SELECT doc_id, st, {_STRIP('substr(text, st + 1, en - st)')} AS p FROM u JOIN documents USING (doc_id)) GROUP BY doc_id")
def i05(spark, d):
    return _per_document(spark, d).where("size(iv) > 0").select("doc_id", F.sha2(V.kept_spans(F.col("text"), F.col("iv")), 256).alias("kept"))


@query("I06_deleted_spans", f"""WITH {_MERGED}, g AS (SELECT doc_id, coalesce(lag(en) OVER (PARTITION BY doc_id ORDER BY st), 0) AS f, st AS t FROM (SELECT doc_id, st, en FROM u UNION ALL SELECT doc_id, length(text), length(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM u))),
  p AS (SELECT doc_id, string_agg(substr(text, f + 1, t - f), '' ORDER BY f, t) AS x FROM g JOIN documents USING (doc_id) GROUP BY doc_id) SELECT doc_id, sha256(coalesce(nullif({_STRIP('x')}, ''), ' ')) AS kept FROM p""")
def i06(spark, d):
    return _per_document(spark, d).where("size(iv) > 0").select("doc_id", F.sha2(V.without_spans(F.col("text"), F.col("iv")), 256).alias("kept"))


@query("I08_roc_area", """WITH v AS (SELECT detector, label, score_ai AS s FROM predictions WHERE label IS NOT NULL AND score_ai IS NOT NULL AND NOT isnan(score_ai) AND NOT isinf(score_ai) AND coalesce(error, '') = ''), b AS (SELECT detector, least(10, greatest(0, floor(s * 10))) AS x, avg(label) AS y FROM v GROUP BY ALL), l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM b WINDOW w AS (PARTITION BY detector ORDER BY x)) SELECT detector, round(sum((x - px) * (y + py) / 2), 9) AS area FROM l GROUP BY detector""")
def i08(spark, d):
    from quern.operators.metrics import is_valid

    x = F.least(F.lit(10), F.greatest(F.lit(0), F.floor(F.col("score_ai") * 10)))
    b = table(spark, d, "predictions").where(is_valid()).groupBy("detector", x.alias("x")).agg(F.avg("label").alias("y"))
    return V.trapezoid_area(b, ["detector"], "x", "y").withColumn("area", F.round("area", 9))


@query("E15_span_parents", f"WITH s AS (SELECT doc_id, k AS span, s AS st, least(s + w, length(text)) AS en FROM {_SPANS}), j AS (SELECT c.doc_id, c.span, p.span AS parent, row_number() OVER (PARTITION BY c.doc_id, c.span ORDER BY p.en - p.st, -p.span) AS rn FROM s c LEFT JOIN s p ON p.doc_id = c.doc_id AND p.st <= c.st AND c.en <= p.en AND (p.en - p.st > c.en - c.st OR (p.en - p.st = c.en - c.st AND p.span < c.span))) SELECT doc_id, span, parent FROM j WHERE rn = 1")
def e15(spark, d):
    return V.parents(_spans(spark, d).withColumnRenamed("k", "span"), ["doc_id"])


@query("J12_escaped_text", "SELECT doc_id, sha256(replace(replace(replace(replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped FROM documents WHERE text IS NOT NULL")
def j12(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(T.escape_document(F.col("text")), 256).alias("escaped"))


