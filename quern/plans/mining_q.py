"""Queries over explanations: words, n-grams, weights, variety, clusters, genericity of openings and wordings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.mining import label_words, phrase_in, punctuated_words
from quern.operators import textmine as X
from quern.plans.registry import query, table
from quern.plans.text_q import _COMMENTS, _comments
from quern.plans.evidence_q import _T as _TELLS
from quern.plans.evidence_q import _tells

_STOP = "['a', 'again', 'also', 'an', 'and', 'are', 'as', 'at', 'be', 'because', 'but', 'by', 'for', 'feel', 'feels', 'from', 'has', 'have', 'i', 'in', 'is', 'it', 'like', 'more', 'not', 'of', 'often', 'on', 'or', 'same', 'so', 'sound', 'sounds', 'that', 'the', 'think', 'this', 'to', 'while', 'with', 'would', 'writer']"
_FORM = lambda x: f"trim(regexp_replace(regexp_replace(replace(replace(lower({x}), 'ai-written', 'ai written'), 'ai-like', 'ai like'), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = lambda x: f"regexp_extract_all({_FORM(x)}, '[a-z0-9]+(?:''[a-z0-9]+)?')"
_LABEL = lambda x: f"list_filter({_WORDS(x)}, lambda w: length(w) > 1 AND NOT list_contains(list_concat({_STOP}, ['ai', 'human']), w))"
_GRAMS = lambda t, n: f"CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i+{n - 1}], ' ')) ELSE [] END"


def _upto(t: str, first: int, last: int) -> str:
    out = _GRAMS(t, first)
    for n in range(first + 1, last + 1):
        out = f"list_concat({out}, {_GRAMS(t, n)})"
    return out


def _kind():
    low = F.lower(F.trim("guess"))
    return F.when(low.startswith("ai"), "AI").when(low.startswith("human"), "human")


_K = "CASE WHEN lower(trim(guess)) LIKE 'ai%' THEN 'AI' WHEN lower(trim(guess)) LIKE 'human%' THEN 'human' END"


@query("N01_words", f"SELECT cid, array_to_string(list_filter({_WORDS('comment')}, lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w)), ' ') AS words FROM {_COMMENTS}")
def n01(spark, d):
    return _comments(spark, d).select("cid", F.array_join(punctuated_words(F.col("comment"), stop=True), " ").alias("words"))


@query("N02_normalized_explanations", f"SELECT cid, {_FORM('comment')} AS form FROM {_COMMENTS}")
def n02(spark, d):
    from quern.functions.mining import unpunctuated

    return _comments(spark, d).select("cid", unpunctuated(F.col("comment")).alias("form"))


@query("N03_label_words", f"SELECT cid, array_to_string({_LABEL('comment')}, ' ') AS words FROM {_COMMENTS}")
def n03(spark, d):
    return _comments(spark, d).select("cid", F.array_join(label_words(F.col("comment")), " ").alias("words"))


@query("N04_ngram_counts", f"WITH c AS (SELECT cid, {_K} AS kind, {_WORDS('comment')} AS t FROM {_COMMENTS}), n AS (SELECT count(*) AS n FROM c), g AS (SELECT DISTINCT cid, kind, unnest({_upto('t', 1, 5)}) AS phrase FROM c) SELECT len(string_split(phrase, ' ')) AS n, phrase, count(*) AS count, round(100.0 * count(*) / any_value(n.n), 3) AS support, count(*) FILTER (kind = 'AI') AS ai, count(*) FILTER (kind = 'human') AS human FROM g, n GROUP BY phrase")
def n04(spark, d):
    c = _comments(spark, d).withColumn("kind", _kind())
    g = X.document_frequency(c, "cid", T.ngrams_upto(punctuated_words(F.col("comment")), 5), {"ai": F.coalesce(F.col("kind") == "AI", F.lit(False)), "human": F.coalesce(F.col("kind") == "human", F.lit(False))})
    total = c.agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(F.broadcast(total)).select(F.size(F.split("gram", " ")).cast("bigint").alias("n"), F.col("gram").alias("phrase"), F.col("df").alias("count"), F.round(100.0 * F.col("df") / F.col("total"), 3).alias("support"), "ai", "human")  # one row


@query("N05_char_substrings", "WITH c AS (SELECT cid, " + _FORM("comment") + f" AS t FROM {_COMMENTS}), g AS (" + " UNION ALL ".join(f"SELECT DISTINCT cid, {n} AS length, unnest(list_transform(range(1, length(t) - {n - 2}), lambda i: substr(t, i, {n}))) AS gram FROM c WHERE length(t) >= {n}" for n in (16, 24, 32)) + ") SELECT length::INT AS length, gram, count(*) AS count FROM g WHERE contains(gram, ' ') AND left(gram, 1) <> ' ' AND right(gram, 1) <> ' ' GROUP BY length, gram")
def n05(spark, d):
    from quern.functions.mining import unpunctuated

    c = _comments(spark, d).select("cid", unpunctuated(F.col("comment")).alias("t"))
    return X.substring_frequency(c, "t", (16, 24, 32))


@query("N06_label_ngrams", f"WITH c AS (SELECT cid, {_LABEL('comment')} AS t FROM {_COMMENTS}), g AS (SELECT DISTINCT cid, unnest({_upto('t', 1, 5)}) AS phrase FROM c) SELECT phrase, count(*) AS count FROM g GROUP BY phrase")
def n06(spark, d):
    return X.document_frequency(_comments(spark, d), "cid", T.ngrams_upto(label_words(F.col("comment")), 5)).select(F.col("gram").alias("phrase"), F.col("df").alias("count"))


_IDF = f"c AS (SELECT cid, {_LABEL('comment')} AS t FROM {_COMMENTS}), n AS (SELECT count(*) AS n FROM c), g AS (SELECT cid, unnest({_upto('t', 1, 4)}) AS phrase FROM c), i AS (SELECT phrase, len(string_split(phrase, ' ')) AS n, count(*) AS count, count(DISTINCT cid) AS doc_count, round(ln((any_value(n.n) + 1) / (count(DISTINCT cid) + 1)) + 1, 6) AS idf FROM g, n GROUP BY phrase)"


def _idf(spark, d):
    return X.idf_table(_comments(spark, d), "cid", T.ngrams_upto(label_words(F.col("comment")), 4))


@query("N07_idf_ngrams", f"WITH {_IDF} SELECT phrase, n, count, doc_count, idf FROM i")
def n07(spark, d):
    return _idf(spark, d)


@query("G18_ngram_report", f"WITH {_IDF} SELECT phrase, count, idf FROM i WHERE n = 2 AND count >= 3 ORDER BY idf DESC, count DESC, phrase LIMIT 40")
def g18(spark, d):
    return _idf(spark, d).where("n = 2 and count >= 3").orderBy(F.desc("idf"), F.desc("count"), "phrase").limit(40).select("phrase", "count", "idf")  # a top-40 report


_TFIDF = f"""c AS (SELECT cid, list_filter({_LABEL('comment')}, lambda w: length(w) > 1) AS t FROM {_COMMENTS}), n AS (SELECT count(*) AS n FROM c), tf AS (SELECT cid, term, count(*) AS tf FROM (SELECT cid, unnest({_upto('t', 1, 4)}) AS term FROM c) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
  w AS (SELECT cid, term, df, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n), u AS (SELECT cid, term, df, w / sqrt(sum(w * w) OVER (PARTITION BY cid)) AS x FROM w)"""


def _weights(spark, d):
    return X.tfidf(_comments(spark, d), "cid", label_words(F.col("comment")), 4)


@query("N08_tfidf", f"WITH {_TFIDF} SELECT term, round(max(x), 6) AS max_tfidf, round(sum(x) / any_value(n.n), 6) AS mean_tfidf, count(*) AS doc_count FROM u, n GROUP BY term")
def n08(spark, d):
    c = _comments(spark, d)
    n = c.agg(F.count(F.lit(1)).alias("n"))
    g = _weights(spark, d).groupBy("term").agg(F.round(F.max("weight"), 6).alias("max_tfidf"), F.sum("weight").alias("s"), F.count(F.lit(1)).alias("doc_count"))
    return g.crossJoin(F.broadcast(n)).select("term", "max_tfidf", F.round(F.col("s") / F.col("n"), 6).alias("mean_tfidf"), "doc_count")  # one row


@query("N08_uniqueness", f"WITH {_TFIDF}, k AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY round(x, 9) DESC, term) AS k FROM u) SELECT cid, round(avg(x), 6) AS uniqueness FROM k WHERE k <= 5 GROUP BY cid")
def n08b(spark, d):
    """Mean of an explanation's five highest weights."""
    from quern.operators.allocate import top_per_group

    top = top_per_group(_weights(spark, d).withColumn("r", F.round("weight", 9)), ["id"], [F.desc("r"), "term"], 5)
    return top.groupBy(F.col("id").alias("cid")).agg(F.round(F.avg("weight"), 6).alias("uniqueness"))


@query("N09_label_candidates", f"WITH {_TFIDF}, t AS (SELECT term AS phrase, len(string_split(term, ' ')) AS n, count(*) AS count, round(max(x), 6) AS tfidf FROM u GROUP BY term) SELECT phrase, n, count, tfidf FROM t WHERE n >= 2 ORDER BY tfidf DESC, phrase LIMIT 50")
def n09(spark, d):
    g = _weights(spark, d).groupBy(F.col("term").alias("phrase")).agg(F.count(F.lit(1)).alias("count"), F.round(F.max("weight"), 6).alias("tfidf"))
    return g.withColumn("n", F.size(F.split("phrase", " ")).cast("bigint")).where("n >= 2").orderBy(F.desc("tfidf"), "phrase").limit(50).select("phrase", "n", "count", "tfidf")  # a top-50 report


@query("N10_phrase_matches", f"SELECT phrase, count(*) AS comments FROM {_COMMENTS}, (VALUES ('rhythm'), ('made me decide'), ('personal aside')) AS v(phrase) WHERE contains(' ' || array_to_string({_LABEL('comment')}, ' ') || ' ', ' ' || phrase || ' ') GROUP BY phrase")
def n10(spark, d):
    phrases = F.explode(F.array(*[F.lit(p) for p in ("rhythm", "made me decide", "personal aside")]))
    rows = _comments(spark, d).select(label_words(F.col("comment")).alias("w"), phrases.alias("phrase"))
    return rows.where(phrase_in(F.col("w"), F.col("phrase"))).groupBy("phrase").agg(F.count(F.lit(1)).alias("comments"))


@query("N11_label_centroids", f"WITH c AS (SELECT cid, {_LABEL('comment')} AS t, ('0x' || substr(sha256(cid), 1, 4))::BIGINT / 65536.0::DOUBLE AS x, ('0x' || substr(sha256(cid), 5, 4))::BIGINT / 65536.0::DOUBLE AS y FROM {_COMMENTS}), g AS (SELECT DISTINCT cid, x, y, unnest({_upto('t', 2, 3)}) AS phrase FROM c), p AS (SELECT phrase, count(*) AS count, avg(x) AS x, avg(y) AS y FROM g GROUP BY phrase HAVING count(*) >= 3) SELECT phrase, count, round(x, 6) AS x, round(y, 6) AS y FROM p ORDER BY count DESC, phrase LIMIT 20")
def n11(spark, d):
    """The most frequent phrases with three matches or more, at the centre of their explanations' points."""
    h = F.sha2("cid", 256)
    at = lambda i: F.conv(F.substring(h, i, 4), 16, 10).cast("double") / 65536.0
    grams = F.array_distinct(T.let(label_words(F.col("comment")), lambda t: F.concat(T.word_ngrams(t, 2), T.word_ngrams(t, 3))))
    g = _comments(spark, d).select(at(1).alias("x"), at(5).alias("y"), F.explode(grams).alias("phrase"))
    p = g.groupBy("phrase").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y")).where("count >= 3")
    return p.orderBy(F.desc("count"), "phrase").limit(20)  # a top-20 report


@query("N12_unit_embeddings", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / n, 5)) AS unit FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def n12(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    unit = T.let(e, lambda v: T.let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(v, lambda x: F.round(x / n, 5))))
    return table(spark, d, "embeddings").select("vec_id", unit.alias("unit"))


@query("N13_projection")
def n13(spark, d):
    """Two principal components of the embeddings; the signs are fixed by the largest entry."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    out = model.transform(rows).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


_SPLIT = lambda x: f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> '')"


@query("N14_lexical_diversity", f"""WITH c AS (SELECT {_K} AS kind, {_SPLIT('comment')} AS t FROM {_COMMENTS}), a AS (SELECT kind, t, len(t) AS n FROM c WHERE kind IS NOT NULL), l AS (SELECT kind, list_sort(list(n)) AS ns, count(*) AS k FROM a GROUP BY kind), w AS (SELECT kind, unnest(t) AS w FROM a)
  SELECT l.kind, k AS explanations, count(DISTINCT w) AS vocabulary, count(*) AS tokens, round(count(DISTINCT w) / count(*), 4) AS ttr, round(count(*) / any_value(k), 1) AS mean_words, any_value(ns[k // 2 + 1]) AS median_words, any_value(ns[least(k - 1, floor(0.95 * k)::BIGINT) + 1]) AS p95_words FROM l JOIN w USING (kind) GROUP BY l.kind, k""")
def n14(spark, d):
    c = _comments(spark, d).select(_kind().alias("kind"), T.white_words(F.lower("comment")).alias("t")).where("kind is not null")
    return X.variety(c, ["kind"], "t")


@query("N15_common_ngrams", f"""WITH c AS (SELECT regexp_extract_all(lower(comment), '[a-z0-9_]{{2,}}') AS t FROM {_COMMENTS}), n AS (SELECT count(*) AS n FROM c), g AS (SELECT 'two_three' AS kind, unnest({_upto('t', 2, 3)}) AS phrase FROM c UNION ALL SELECT 'three_five', unnest({_upto('t', 3, 5)}) FROM c), k AS (SELECT kind, phrase, count(*) AS count, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, phrase) AS k FROM g GROUP BY kind, phrase)
  SELECT kind, phrase, count, round(100 * count / n.n, 1) AS pct FROM k, n WHERE k <= 25""")
def n15(spark, d):
    from quern.operators.allocate import top_per_group

    c = _comments(spark, d).select(F.regexp_extract_all(F.lower("comment"), F.lit("[a-z0-9_]{2,}"), F.lit(0)).alias("t"))
    runs = lambda a, b: F.flatten(F.array(*[T.word_ngrams(F.col("t"), n) for n in range(a, b + 1)]))
    kinds = F.array(F.struct(F.lit("two_three").alias("kind"), runs(2, 3).alias("g")), F.struct(F.lit("three_five").alias("kind"), runs(3, 5).alias("g")))
    g = c.select(F.explode(kinds).alias("k")).select("k.kind", F.explode("k.g").alias("phrase")).groupBy("kind", "phrase").agg(F.count(F.lit(1)).alias("count"))
    n = c.agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(g, ["kind"], [F.desc("count"), "phrase"], 25).crossJoin(F.broadcast(n)).select("kind", "phrase", "count", F.round(100 * F.col("count") / F.col("n"), 1).alias("pct"))  # one row


_INTRA = f"""c AS (SELECT cid, id, list_filter(regexp_extract_all(lower(comment), '[a-z0-9_]+'), lambda w: length(w) > 1) AS t FROM {_COMMENTS}), k AS (SELECT id, count(*) AS k FROM c GROUP BY id HAVING count(*) > 1), tf AS (SELECT id, cid, term, 1 + ln(count(*)) AS tf FROM (SELECT id, cid, unnest({_upto('t', 1, 2)}) AS term FROM c) GROUP BY ALL), df AS (SELECT id, term, count(*) AS df FROM tf GROUP BY ALL),
  w AS (SELECT tf.id, cid, term, tf * (ln((1 + k) / (1 + df)) + 1) AS w FROM tf JOIN df USING (id, term) JOIN k ON k.id = tf.id), u AS (SELECT id, cid, term, w / sqrt(sum(w * w) OVER (PARTITION BY id, cid)) AS x FROM w), s AS (SELECT a.id, sum(a.x * b.x) AS s FROM u a JOIN u b ON a.id = b.id AND a.term = b.term AND a.cid < b.cid GROUP BY a.id),
  p AS (SELECT k.id, coalesce(s, 0) / (k * (k - 1) / 2) AS sim FROM k LEFT JOIN s USING (id))"""


@query("N17_intra_document_overlap", f"WITH {_INTRA} SELECT id, round(sim, 6) AS similarity FROM p")
def n17(spark, d):
    words = F.filter(F.regexp_extract_all(F.lower("comment"), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: F.length(w) > 1)
    return X.intra_similarity(_comments(spark, d).select("id", "cid", words.alias("t")), "id", "cid", "t").select("id", F.round("similarity", 6).alias("similarity"))


@query("N17_overlap_summary", f"WITH {_INTRA}, l AS (SELECT list_sort(list(sim)) AS s, count(*) AS n, avg(sim) AS m FROM p) SELECT n AS documents, round(m, 4) AS mean, round(s[n // 2 + 1], 4) AS median, round(s[least(n - 1, floor(0.75 * n)::BIGINT) + 1], 4) AS p75, round(s[least(n - 1, floor(0.95 * n)::BIGINT) + 1], 4) AS p95 FROM l")
def n17b(spark, d):
    from quern.operators.ranks import positions

    words = F.filter(F.regexp_extract_all(F.lower("comment"), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: F.length(w) > 1)
    s = X.intra_similarity(_comments(spark, d).select("id", "cid", words.alias("t")), "id", "cid", "t")
    placed = positions(s.select("similarity"), ["similarity"])
    at = lambda q: F.round(F.max(F.when(F.col("position") == F.least(F.col("group_rows") - 1, F.floor(F.lit(q) * F.col("group_rows"))), F.col("similarity"))), 4)
    return placed.agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("similarity"), 4).alias("mean"), at(0.5).alias("median"), at(0.75).alias("p75"), at(0.95).alias("p95"))


@query("N18_ngram_multiset", f"WITH t AS (SELECT source_id, regexp_extract_all(lower(source_text), '[a-z0-9]+') AS t FROM pair_docs WHERE source_text IS NOT NULL) SELECT source_id, g, count(*) AS n FROM (SELECT source_id, unnest({_GRAMS('t', 2)}) AS g FROM t) GROUP BY ALL HAVING count(*) > 1")
def n18(spark, d):
    rows = table(spark, d, "pair_docs").where("source_text is not null").select("source_id", F.explode(T.word_ngrams(T.ascii_tokens(F.col("source_text")), 2)).alias("g"))
    return rows.groupBy("source_id", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _ratio_sql(n: int) -> str:
    return f"SELECT source_id, {n} AS n, sum(least(x, coalesce(y, 0))) / sum(x) AS ratio FROM (SELECT source_id, g, count(*) AS x FROM (SELECT source_id, unnest({_GRAMS('a', n)}) AS g FROM p) GROUP BY ALL) LEFT JOIN (SELECT source_id, g, count(*) AS y FROM (SELECT source_id, unnest({_GRAMS('b', n)}) AS g FROM p) GROUP BY ALL) USING (source_id, g) GROUP BY source_id"


@query("N20_overlap_score", "WITH p AS (SELECT source_id, regexp_extract_all(lower(source_text), '[a-z0-9]+') AS a, regexp_extract_all(lower(ai_edited.text), '[a-z0-9]+') AS b FROM pair_docs WHERE source_text IS NOT NULL AND ai_edited.text IS NOT NULL), r AS (" + " UNION ALL ".join(_ratio_sql(n) for n in (3, 4)) + ") SELECT p.source_id AS id, round(coalesce((SELECT sum(n * ln(n) * ratio) FROM r WHERE r.source_id = p.source_id), 0) / (3 * ln(3) + 4 * ln(4)), 6) AS score FROM p")
def n20(spark, d):
    """Shared n-grams of 3 and 4 words, weighted by n * ln(n) and divided by the weights."""
    p = table(spark, d, "pair_docs").where("source_text is not null and ai_edited.text is not null")
    a, b = p.select("source_id", F.col("source_text").alias("t")), p.select("source_id", F.col("ai_edited.text").alias("t"))
    weights = {n: n * math.log(n) for n in (3, 4)}
    parts = [X.overlap_ratio(a, b, "source_id", T.ascii_tokens(F.col("t")), n).select("id", (F.col("ratio") * w).alias("s")) for n, w in weights.items()]
    sums = parts[0].unionByName(parts[1]).groupBy("id").agg(F.sum("s").alias("s"))
    return p.select(F.col("source_id").alias("id")).join(sums, "id", "left").select("id", F.round(F.coalesce("s", F.lit(0.0)) / sum(weights.values()), 6).alias("score"))


@query("N21_tokens", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents WHERE text IS NOT NULL")
def n21(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.ascii_tokens(F.col("text"))).cast("bigint").alias("n"))


@query("N22_span_word_sets", f"WITH {_TELLS} SELECT DISTINCT span, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(span), '[\\p{{L}}\\p{{N}}]+'))), ' ') AS words FROM tells")
def n22(spark, d):
    """Word sets per distinct span; the tokenizer is an argument, a lemmatizer can take its place."""
    spans = _tells(spark, d).select("span").distinct()
    return X.word_sets(spans, "span").select("span", F.array_join(F.array_sort("words"), " ").alias("words"))


@query("N23_metric_in_text", "SELECT doc_id, CASE WHEN n > 1 THEN round(n / 100, 4) ELSE round(n, 4) END AS auroc FROM (SELECT doc_id, TRY_CAST(nullif(regexp_extract('We report an AUROC of ' || (doc_id % 100) || '.' || (doc_id % 7) || ' on ' || coalesce(lang, ''), '(?i)AU(?:ROC|C)[^0-9]{0,20}([0-9]+\\.[0-9]+)', 1), '') AS DOUBLE) AS n FROM documents)")
def n23(spark, d):
    from quern.functions.wiretext import first_match

    t = F.concat(F.lit("We report an AUROC of "), (F.col("doc_id") % 100).cast("string"), F.lit("."), (F.col("doc_id") % 7).cast("string"), F.lit(" on "), F.coalesce("lang", F.lit("")))
    return table(spark, d, "documents").select("doc_id", first_match(t, (r"(?i)AU(?:ROC|C)[^0-9]{0,20}([0-9]+\.[0-9]+)",)).alias("auroc"))


@query("J34_normalized_fragments", "SELECT cid, trim(regexp_replace(regexp_replace(lower(trim(replace(comment || ' A&amp;B', '&amp;', '&'))), '[!-/:-@\\[-`{-~]', ' ', 'g'), '\\s+', ' ', 'g')) AS form FROM " + _COMMENTS)
def j34(spark, d):
    from quern.functions.mining import fragment

    return _comments(spark, d).select("cid", fragment(F.concat("comment", F.lit(" A&amp;B"))).alias("form"))


@query("J35_normalized_comments", f"SELECT cid, regexp_replace(trim(regexp_replace(lower(comment), '\\s+', ' ', 'g')), '[^a-z0-9\\s-]', '', 'g') AS form FROM {_COMMENTS}")
def j35(spark, d):
    return _comments(spark, d).select("cid", T.normalized_explanation(F.col("comment")).alias("form"))


_FRAG = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '\\s+', ' ', 'g'))"
_CHARS = lambda t, a, b: " || ".join(f"CASE WHEN length({t}) >= {n} THEN list_transform(range(1, length({t}) - {n - 2}), lambda i: substr({t}, i, {n})) ELSE [] END" for n in range(a, b + 1))


@query("P01_char_ngrams", f"WITH c AS (SELECT cid, {_FRAG('comment')} AS t FROM {_COMMENTS}) SELECT cid, len(list_distinct({_CHARS('t', 3, 5)})) AS grams FROM c")
def p01(spark, d):
    from quern.functions.mining import char_gram_set, fragment

    return _comments(spark, d).select("cid", F.size(char_gram_set(fragment(F.col("comment")), 3, 5)).cast("bigint").alias("grams"))


_ROWGRAMS = f"c AS (SELECT cid, id, {_FRAG('comment')} AS t FROM {_COMMENTS}), e AS (SELECT DISTINCT id, unnest({_CHARS('t', 3, 5)}) AS g FROM c), n AS (SELECT count(DISTINCT id) AS n FROM c), df AS (SELECT g, count(*) AS df FROM e GROUP BY g)"


@query("P02_row_grams", f"WITH {_ROWGRAMS} SELECT id, count(*) AS grams FROM e GROUP BY id")
def p02(spark, d):
    from quern.functions.mining import char_gram_set, fragment

    c = _comments(spark, d).select("id", F.explode(char_gram_set(fragment(F.col("comment")), 3, 5)).alias("g")).distinct()
    return c.groupBy("id").agg(F.count(F.lit(1)).alias("grams"))


_MEANIDF = f"{_ROWGRAMS}, m AS (SELECT c.cid, c.id, coalesce(avg(ln((1.0 + n) / (1.0 + df))), 0) AS m FROM c LEFT JOIN (SELECT DISTINCT cid, unnest({_CHARS('t', 3, 5)}) AS g FROM c) x USING (cid) LEFT JOIN df USING (g), n GROUP BY c.cid, c.id)"


def _fitted(spark, d):
    from quern.functions.mining import fragment

    return X.gram_model(_comments(spark, d).select("cid", "id", fragment(F.col("comment")).alias("t")), "id", "cid", "t", 3, 5)


@query("P03_char_idf", f"WITH {_MEANIDF} SELECT cid, round(m, 6) AS mean_idf FROM m")
def p03(spark, d):
    return _fitted(spark, d)[1].select("cid", F.round("mean_idf", 6).alias("mean_idf"))


@query("P04_fitted_model", f"WITH {_MEANIDF} SELECT (SELECT count(*) FROM df) AS grams, (SELECT n FROM n) AS rows, round(median(m), 6) AS median_idf FROM m")
def p04(spark, d):
    from quern.operators.aggregates import linear_quantile
    from quern.session import checkpoint

    df, scored = _fitted(spark, d)
    scored = checkpoint(scored)  # read by the count and by the quantile
    grams = df.agg(F.count(F.lit(1)).alias("grams"))
    rows = scored.agg(F.count_distinct("id").alias("rows"))
    med = linear_quantile(scored, [], "mean_idf", {"median_idf": 0.5})
    return grams.crossJoin(rows).crossJoin(med).select("grams", "rows", F.round("median_idf", 6).alias("median_idf"))  # one row each


@query("G19_top_grams", f"WITH {_ROWGRAMS} SELECT g, df FROM df ORDER BY df DESC, g LIMIT 60")
def g19(spark, d):
    return _fitted(spark, d)[0].orderBy(F.desc("df"), "g").limit(60)  # a top-60 report


@query("P05_opening_keys", f"SELECT cid, substr({_FRAG('comment')}, 1, 24) AS opening FROM {_COMMENTS}")
def p05(spark, d):
    from quern.functions.mining import fragment

    return _comments(spark, d).select("cid", F.substring(fragment(F.col("comment")), 1, 24).alias("opening"))  # the key is defined by the first characters


@query("P06_word_jaccard", f"WITH {_TELLS}, s AS (SELECT id, slot, list_distinct(regexp_extract_all(lower(span), '[\\p{{L}}\\p{{N}}]+')) AS a, list_distinct(regexp_extract_all(lower(why), '[\\p{{L}}\\p{{N}}]+')) AS b FROM tells) SELECT id, slot, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 9) AS jaccard FROM s")
def p06(spark, d):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return _tells(spark, d).select("id", F.col("ord").alias("slot"), F.round(T.jaccard(words("span"), words("why")), 9).alias("jaccard"))


_GENERIC = f"""o AS (SELECT id, slot, score, why, span, substr({_FRAG('why')}, 1, 12) AS k, list_sort(list_distinct(regexp_extract_all(lower(span), '[\\p{{L}}\\p{{N}}]+'))) AS s FROM tells), b AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM o),
  j AS (SELECT x.id, x.slot, max(CASE WHEN len(x.s) = 0 AND len(y.s) = 0 THEN 1 ELSE len(list_intersect(x.s, y.s)) / greatest(1, len(list_distinct(list_concat(x.s, y.s)))) END) AS best FROM b x JOIN b y ON x.k = y.k AND (x.id <> y.id OR x.slot <> y.slot) GROUP BY x.id, x.slot),
  g AS (SELECT b.id, b.slot, b.score, b.why, b.n, ln(1 + greatest(b.n, 2)) * CASE WHEN b.n < 2 THEN 1 ELSE least(1, greatest(0, 1 - 0.5 * coalesce(best, 0))) END AS g FROM b LEFT JOIN j USING (id, slot))"""


def _generic(spark, d, *more):
    from quern.functions.mining import fragment

    t = _tells(spark, d).select("id", F.col("ord").alias("slot"), "score", *more, "span", F.substring(fragment(F.col("why")), 1, 12).alias("k"))
    return X.span_genericity(t, ["id", "slot"], "k", "span", weight=0.5, least=2)


@query("P07_span_genericity", f"WITH {_TELLS}, {_GENERIC} SELECT id, slot, n AS bucket, round(g, 6) AS genericity FROM g")
def p07(spark, d):
    return _generic(spark, d).select("id", "slot", F.col("n").alias("bucket"), F.round("g", 6).alias("genericity"))


_DROPS = f"{_GENERIC}, r AS (SELECT *, median(g) OVER () AS med, quantile_cont(g, 0.75) OVER () AS ref FROM g), p AS (SELECT id, slot, why, greatest(0, 1 - 0.5 * score) AS keep, least(0.9, 0.45 * g / greatest(1e-6, med)) AS scaled, least(0.9, 0.45 * greatest(0, g - ref) / greatest(1e-6, med)) AS above_quantile, least(0.9, 0.45 * greatest(0, g - med) / greatest(1e-6, med)) AS above_median FROM r)"


def _drops(spark, d, *more):
    return X.drop_probabilities(_generic(spark, d, *more), "g", "score", strength=0.45, cap=0.9, score_weight=0.5, quantile=0.75)


@query("P08_drop_probabilities", f"WITH {_TELLS}, {_DROPS} SELECT id, slot, round(scaled * keep, 6) AS scaled, round(above_quantile * keep, 6) AS above_quantile, round(above_median * keep, 6) AS above_median FROM p")
def p08(spark, d):
    return _drops(spark, d).select("id", "slot", *[F.round(c, 6).alias(c) for c in ("scaled", "above_quantile", "above_median")])


_KEYED = f"{_DROPS}, q AS (SELECT id, slot, why, scaled * keep AS p, CASE WHEN regexp_matches(why, '(?i)\\bimplausible\\b|\\bimpossible\\b|\\bfabricat|\\bmade.?up\\b|\\bslip\\b') THEN greatest(0, scaled * keep - 0.6) WHEN regexp_matches(why, '(?i)\\bstylistic(ally)?\\b|\\bsounds\\b|\\brhythm\\b') THEN least(1, scaled * keep + 0.4) ELSE scaled * keep END AS key FROM p)"
_SUBSTANCE, _STYLE = r"(?i)\bimplausible\b|\bimpossible\b|\bfabricat|\bmade.?up\b|\bslip\b", r"(?i)\bstylistic(ally)?\b|\bsounds\b|\brhythm\b"


@query("P09_content_order", f"WITH {_TELLS}, {_KEYED} SELECT id, slot, round(key, 6) AS key FROM q")
def p09(spark, d):
    return _drops(spark, d, "why").select("id", "slot", F.round(X.content_key(F.col("scaled"), F.col("why"), _SUBSTANCE, _STYLE), 6).alias("key"))


_KEPT = f"{_KEYED}, m AS (SELECT id, count(*) AS n, least(1, greatest(0, avg(p) / 0.9)) AS gen FROM q GROUP BY id), t AS (SELECT id, n, least(2, n) AS lo, greatest(least(2, n), least(4, n)) AS hi, gen, ('0x' || substr(sha256('83|' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM m), k AS (SELECT id, lo, hi, lo + (hi - lo) * (1 - gen) AS tk, u FROM t), kk AS (SELECT id, greatest(lo, least(hi, floor(tk) + CASE WHEN u < tk - floor(tk) THEN 1 ELSE 0 END)) AS k FROM k), o AS (SELECT q.*, row_number() OVER (PARTITION BY id ORDER BY round(key, 9), slot) AS r FROM q)"


@query("G27_kept_tells", f"WITH {_TELLS}, {_KEPT.replace('o AS (SELECT q.*', 'oo AS (SELECT q.*')} SELECT oo.id, slot, r <= k AS kept FROM oo JOIN kk USING (id)")
def g27(spark, d):
    """How many tells a document keeps falls with how generic they are (rounded by a hash); those of substance and the least generic stay."""
    rows = _drops(spark, d, "why").select("id", "slot", F.col("scaled").alias("p"), X.content_key(F.col("scaled"), F.col("why"), _SUBSTANCE, _STYLE).alias("key"))
    return X.keep_most_specific(rows, "id", "slot", "p", "key", cap=0.9, least=2, most=4, seed=83).select("id", "slot", "kept")


@query("P12_dropout_report", f"WITH {_TELLS}, {_DROPS} SELECT count(*) AS tells, round(avg(scaled * keep), 6) AS mean_p, round(quantile_cont(scaled * keep, 0.5), 6) AS median_p, round(avg((scaled >= 0.9)::INT), 6) AS capped, round(corr(scaled, keep), 4) AS corr FROM p")
def p12(spark, d):
    from quern.operators.aggregates import linear_quantile

    p = _drops(spark, d)
    one = p.agg(F.count(F.lit(1)).alias("tells"), F.round(F.avg("scaled"), 6).alias("mean_p"), F.round(F.avg((F.col("mass") >= 0.9).cast("double")), 6).alias("capped"), F.round(F.corr("mass", "keep"), 4).alias("corr"))
    return one.crossJoin(linear_quantile(p, [], "scaled", {"m": 0.5})).select("tells", "mean_p", F.round("m", 6).alias("median_p"), "capped", "corr")  # one row each


@query("E19_corpus_fragments", f"WITH {_TELLS}, {_GENERIC} SELECT k.id, k.slot, n AS bucket, round(g, 6) AS genericity, round(n / (SELECT count(*) FROM g)::DOUBLE, 6) AS bucket_share FROM g k")
def e19(spark, d):
    g = _generic(spark, d)
    n = g.agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(F.broadcast(n)).select("id", "slot", F.col("n").alias("bucket"), F.round("g", 6).alias("genericity"), F.round(F.col("n") / F.col("total"), 6).alias("bucket_share"))  # one row
