"""Queries over annotated wires: parsing, validation with a wire for every reason, rendering, repair; token classes of wires."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import markup as W
from quern.functions import text as T
from quern.functions import wiretext as R
from quern.operators import tokenclasses as K
from quern.plans.registry import query, table
from quern.plans.text_q import _MERGED, _per_document

_CTRL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: Documents without the characters that a wire can't carry, and their merged spans.
_DC = f"dc AS (SELECT doc_id, regexp_replace(text, '{_CTRL}', '', 'g') AS text FROM documents WHERE text IS NOT NULL), {_MERGED.replace('FROM documents,', 'FROM dc,')}, k AS (SELECT dc.doc_id, text, count(st) AS spans FROM dc LEFT JOIN u USING (doc_id) GROUP BY dc.doc_id, text)"
_ESC = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_KIND = "CASE WHEN st % 2 = 0 THEN 'AI' ELSE 'human' END"


def _clean(spark, d):
    return table(spark, d, "documents").withColumn("text", F.regexp_replace("text", _CTRL, ""))


def _wires(spark, d):
    """``doc_id, text, spans, wire``: an annotation around each merged span; type, explanation and score come from where it starts."""
    docs = _per_document(spark, d, _clean(spark, d))
    tells = F.transform("iv", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["start"] % 2 == 0, "AI").otherwise("human").alias("type"), F.concat(F.lit("starts at "), x["start"].cast("string")).alias("explanation"), ((x["start"] % 10) / 10.0).alias("score")))
    verdict = F.struct(F.lit("AI").alias("type"), F.lit("from a hash").alias("why"), F.lit(0.5).alias("score"))
    return docs.select("doc_id", "text", F.size("iv").alias("spans"), W.render_udf("text", tells, verdict).alias("wire"))


def _parsed(spark, d, change=None):
    w = _wires(spark, d)
    return w.select("doc_id", "text", "spans", W.parse_udf("wire" if change is None else change(F.col("wire"))).alias("p"))


@query("J01_root_splits", f"WITH {_DC} SELECT doc_id, true AS ok, sha256(text) AS plain, spans AS tells, 'AI' AS verdict FROM k")
def j01(spark, d):
    return _parsed(spark, d).select("doc_id", "p.ok", F.sha2("p.plain", 256).alias("plain"), F.size("p.tells").cast("bigint").alias("tells"), F.col("p.verdict.type").alias("verdict"))


@query("J06_attributes", f"WITH {_DC} SELECT doc_id, st AS start, 'starts at ' || st AS why, (st % 10) / 10.0::DOUBLE AS score FROM u")
def j06(spark, d):
    return _parsed(spark, d).select("doc_id", F.explode("p.tells").alias("t")).select("doc_id", "t.start", F.col("t.explanation").alias("why"), "t.score")


@query("J07_wrapper_stripped", f"WITH {_DC} SELECT doc_id, contains(inner_, '<verdict') AS has_verdict FROM (SELECT doc_id, {_ESC('text')} AS inner_ FROM k)")
def j07(spark, d):
    """What stands between the opening tag and the last verdict."""
    inner = R.unwrapped(F.col("wire"))
    return _wires(spark, d).select("doc_id", F.contains(inner, F.lit("<verdict")).alias("has_verdict"))


@query("J08_plain_texts", f"WITH {_DC} SELECT doc_id, sha256(text) AS plain FROM k")
def j08(spark, d):
    return _parsed(spark, d).select("doc_id", F.sha2("p.plain", 256).alias("plain"))


@query("J09_verdicts", f"WITH {_DC} SELECT doc_id, 'AI' AS type, 'from a hash' AS why, 0.5::DOUBLE AS score FROM k")
def j09(spark, d):
    return _parsed(spark, d).select("doc_id", "p.verdict.type", "p.verdict.why", "p.verdict.score")


@query("J10_parsed_tells", f"WITH {_DC} SELECT doc_id, st AS start, en AS \"end\", {_KIND} AS type, (st % 10) / 10.0::DOUBLE AS score, sha256(substr(text, st + 1, en - st)) AS span FROM u JOIN dc USING (doc_id)")
def j10(spark, d):
    t = _parsed(spark, d).select("doc_id", F.explode("p.tells").alias("t"))
    return t.select("doc_id", "t.start", "t.end", "t.type", "t.score", F.sha2("t.span_text", 256).alias("span"))


@query("J11_scores_stripped", f"WITH {_DC} SELECT doc_id, 1 AS scores, spans AS annotations FROM k")
def j11(spark, d):
    bare = W.strip_scores(F.col("wire"))
    n = lambda w: (F.length(bare) - F.length(F.replace(bare, F.lit(w), F.lit("")))) / len(w)
    return _wires(spark, d).select("doc_id", n(' score="').cast("int").alias("scores"), n("<annotation ").cast("bigint").alias("annotations"))


@query("J13_logical_documents", f"SELECT doc_id, sha256(regexp_replace(text, '{_CTRL}', '', 'g')) AS form FROM documents WHERE text IS NOT NULL")
def j13(spark, d):
    return _clean(spark, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("form"))


@query("J14_annotation_tags", f"WITH {_DC} SELECT doc_id, st, '<annotation type=\"' || {_KIND} || '\" why=\"' || {_ESC("'it''s at ' || st || ' & on'")} || '\" score=\"0.5\" />' AS tag FROM u")
def j14(spark, d):
    iv = _per_document(spark, d, _clean(spark, d)).select("doc_id", F.explode("iv").alias("x"))
    return iv.select("doc_id", F.col("x.start").alias("st"), R.annotation_tag(F.when(F.col("x.start") % 2 == 0, "AI").otherwise("human"), F.concat(F.lit("it's at "), F.col("x.start").cast("string"), F.lit(" & on")), F.lit("0.5")).alias("tag"))


@query("J15_bare_wires", f"WITH {_DC} SELECT doc_id, sha256('<text>' || {_ESC('text')} || '<verdict type=\"AI\" why=\"none\" score=\"0.5\" /></text>') AS wire FROM k")
def j15(spark, d):
    return _clean(spark, d).where("text is not null").select("doc_id", F.sha2(R.bare_wire(F.col("text"), F.lit("AI"), F.lit("none"), F.lit("0.5")), 256).alias("wire"))


@query("J16_loose_spacing", "SELECT doc_id, '<a type=\"' || CASE doc_id % 2 WHEN 0 THEN 'AI' ELSE 'human' END || '\" score=\"0.' || doc_id % 10 || '\" />' AS tag FROM documents")
def j16(spark, d):
    i = F.col("doc_id")
    loose = F.concat(F.lit('<a type=" '), F.when(i % 2 == 0, "ai").otherwise("HUMAN"), F.lit('  " score=" 0.'), (i % 10).cast("string"), F.lit(' " />'))
    return table(spark, d, "documents").select("doc_id", R.normalize_attribute_spacing(loose).alias("tag"))


@query("J17_return_tokens", "SELECT doc_id, 'x<|return|>y' AS form FROM documents")
def j17(spark, d):
    return table(spark, d, "documents").select("doc_id", R.strip_return_token(F.lit("x<|return|>y<|return|>")).alias("form"))


_REASON = "CASE doc_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty_final' WHEN 2 THEN 'missing_outer_annotation' WHEN 3 THEN CASE WHEN spans > 0 THEN 'annotation_parse_failed' ELSE 'ok' END WHEN 4 THEN CASE WHEN spans > 0 THEN 'invalid_type' ELSE 'ok' END WHEN 5 THEN 'text_mismatch' ELSE 'bad_xml_escaping' END"


def _broken(spark, d):
    """Wires broken in a way for each reason, and the document they are held against."""
    k, w = F.col("doc_id") % 7, F.col("wire")
    wire = F.when(k == 1, "<|return|>").when(k == 2, F.regexp_replace(w, "^<text>", "")).when(k == 3, F.regexp_replace(w, "(?s)^(.*?)</span>", "$1")).when(k == 4, F.regexp_replace(w, 'annotation type="(AI|human)"', 'annotation type="robot"')).when(k == 6, F.regexp_replace(w, '(?s)<verdict (?!.*<verdict )', "'<verdict ")).otherwise(w)
    doc = F.when(k == 5, F.concat("text", F.lit("x"))).when(k == 6, F.concat("text", F.lit("'"))).otherwise(F.col("text"))
    return _wires(spark, d).select("doc_id", doc.alias("text"), wire.alias("wire"))


@query("J18_format_reasons", f"WITH {_DC} SELECT doc_id, {_REASON} AS reason FROM k")
def j18(spark, d):
    return _broken(spark, d).select("doc_id", W.reason_udf("wire", "text").alias("reason"))


@query("F11_format_pass_rates", f"WITH {_DC} SELECT lang, count(*) AS wires, round(avg(({_REASON} = 'ok')::INT), 6) AS pass_rate FROM k JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang")
def f11b(spark, d):
    ok = _broken(spark, d).select("doc_id", (W.reason_udf("wire", "text") == "ok").alias("ok"))
    return ok.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("wires"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("pass_rate"))


@query("A26_gated_wires", f"WITH {_DC} SELECT doc_id FROM k WHERE {_REASON} = 'ok'")
def a26(spark, d):
    """Rows whose wire isn't valid for their text are dropped."""
    return _broken(spark, d).where((W.reason_udf("wire", "text") == "ok")).select("doc_id")


@query("D23_canonical_escaping", f"WITH {_DC} SELECT doc_id, doc_id % 7 <> 6 AS canonical FROM k WHERE doc_id % 7 IN (0, 6)")
def d23(spark, d):
    reason = W.reason_udf("wire", "text")
    return _broken(spark, d).where((F.col("doc_id") % 7).isin(0, 6)).select("doc_id", (reason != "bad_xml_escaping").alias("canonical"))


@query("J19_character_differences", f"WITH {_DC} SELECT doc_id, least(3, length(text)) + 2 AS difference FROM k WHERE NOT regexp_matches(text, '[#~]')")
def j19(spark, d):
    """The text without its last three characters, but with two that it doesn't have."""
    rows = _clean(spark, d).where("text is not null").where(~F.col("text").rlike("[#~]"))
    other = F.concat(F.substr("text", F.lit(1), F.greatest(F.length("text") - 3, F.lit(0))), F.lit("#~"))
    return rows.select("doc_id", W.difference_udf(other, "text").cast("bigint").alias("difference"))


@query("J20_valid_indicators", f"WITH {_DC} SELECT doc_id, st AS start, en AS \"end\", least(1.0, (st % 10) / 10.0)::DOUBLE AS score FROM u WHERE st % 2 = 0")
def j20(spark, d):
    """Tells of a known type only, scores within 0..1, with their place in the text."""
    t = _parsed(spark, d, lambda w: F.replace(w, F.lit('annotation type="human"'), F.lit('annotation type="robot"'))).select("doc_id", F.explode("p.tells").alias("t")).where("t.type in ('AI', 'human')")
    return t.select("doc_id", "t.start", "t.end", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "t.score")).alias("score"))


def _repaired(spark, d, change):
    """Plain text and tells of what ``repair`` makes of a changed wire; null where it gives up."""
    w = _wires(spark, d)
    fixed = w.select("doc_id", W.repair_udf(change(F.col("wire")), "text").alias("f"))
    p = fixed.select("doc_id", W.parse_udf("f").alias("p"), F.col("f").isNotNull().alias("ok"))
    return p.select("doc_id", F.when(F.col("ok"), F.sha2("p.plain", 256)).alias("plain"), F.when(F.col("ok"), F.size("p.tells").cast("bigint")).alias("tells"))


_WHOLE = f"WITH {_DC} SELECT doc_id, sha256(text) AS plain, spans AS tells FROM k"


@query("J21_repaired_wires", _WHOLE)
def j21(spark, d):
    """Blanks in attributes and double escapes: repaired without loss."""
    return _repaired(spark, d, lambda w: F.regexp_replace(F.regexp_replace(w, r'score="(0\.[0-9])"', 'score=" $1 "'), "&apos;", "&amp;apos;"))


@query("J24_orphan_closers", _WHOLE)
def j24(spark, d):
    return _repaired(spark, d, lambda w: F.regexp_replace(w, "(?s)<verdict (?!.*<verdict )", "</span><verdict "))


@query("J26_unclosed_openers", _WHOLE)
def j26(spark, d):
    return _repaired(spark, d, lambda w: F.regexp_replace(w, "(?s)<verdict (?!.*<verdict )", "<span><verdict "))


@query("J28_clamped_verdicts", f"WITH {_DC} SELECT doc_id, 1.0::DOUBLE AS score FROM k")
def j28(spark, d):
    w = _wires(spark, d)
    fixed = W.repair_udf(F.regexp_replace("wire", 'score="0.5" /></text>', 'score="7" /></text>'), "text")
    return w.select("doc_id", W.parse_udf(fixed)["verdict"]["score"].alias("score"))


@query("J29_double_entities", "SELECT doc_id, '&apos;&quot;&amp;lt;' AS form FROM documents")
def j29(spark, d):
    return table(spark, d, "documents").select("doc_id", R.collapse_double_entities(F.lit("&amp;apos;&amp;quot;&amp;lt;")).alias("form"))


@query("J30_response_texts", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'answer ' || doc_id WHEN 1 THEN 'last ' || doc_id ELSE 'plain ' || doc_id END AS form FROM documents")
def j30(spark, d):
    i = F.col("doc_id").cast("string")
    final = F.concat(F.lit("<|channel|>analysis<|message|>thinking<|end|><|channel|> Final <|message|> answer "), i, F.lit(" <|return|>"))
    last = F.concat(F.lit("<|channel|>analysis<|message|>a<|end|><|channel|>commentary<|message|>last "), i, F.lit("<|end|>"))
    return table(spark, d, "documents").select("doc_id", R.response_text(F.when(F.col("doc_id") % 3 == 0, final).when(F.col("doc_id") % 3 == 1, last).otherwise(F.concat(F.lit(" ``plain "), i, F.lit("`` ")))).alias("form"))


@query("J31_tag_attributes", f"WITH {_DC} SELECT doc_id, st, CASE WHEN st % 2 = 0 THEN 'AI' ELSE 'human' END AS type, 'it \"is\" at ' || st AS why FROM u")
def j31(spark, d):
    """Attributes in double or single quotes, with escaped quotes inside."""
    iv = _per_document(spark, d, _clean(spark, d)).select("doc_id", F.explode("iv").alias("x")).select("doc_id", F.col("x.start").alias("st"))
    even = F.col("st") % 2 == 0
    tag = F.when(even, F.concat(F.lit('type="AI" why="it \\"is\\" at '), F.col("st").cast("string"), F.lit('"'))).otherwise(F.concat(F.lit("type='human' why='it \"is\" at "), F.col("st").cast("string"), F.lit("'")))
    return iv.select("doc_id", "st", R.tag_attribute(tag, "type").alias("type"), R.tag_attribute(tag, "why").alias("why"))


@query("J32_annotation_rows", f"WITH {_DC} SELECT doc_id, {_KIND} AS type, 'starts at ' || st AS why, (st % 10) / 10.0::DOUBLE AS score FROM u")
def j32(spark, d):
    return _wires(spark, d).select("doc_id", F.explode(W.annotation_rows(F.col("wire"))).alias("t")).select("doc_id", "t.type", "t.why", "t.score")


@query("J33_span_types", "SELECT id, detector, generated_at, CASE lower(trim(raw_label)) WHEN 'ai' THEN 'AI' WHEN 'human' THEN 'human' ELSE trim(raw_label) END AS type FROM predictions")
def j33(spark, d):
    low = F.lower(F.trim("raw_label"))
    return table(spark, d, "predictions").select("id", "detector", "generated_at", F.when(low == "ai", "AI").when(low == "human", "human").otherwise(F.trim("raw_label")).alias("type"))


@query("J36_patched_verdicts", f"WITH {_DC} SELECT doc_id, spans + 1 AS scores, 0.73::DOUBLE AS score FROM k")
def j36(spark, d):
    """Only the score of the last verdict changes."""
    patched = R.patch_last_verdict(F.col("wire"), F.lit(0.7251))
    n = (F.length(patched) - F.length(F.replace(patched, F.lit(' score="'), F.lit("")))) / 8
    return _wires(spark, d).select("doc_id", n.cast("bigint").alias("scores"), W.parse_udf(patched)["verdict"]["score"].alias("score"))


@query("J37_first_explanation", f"WITH {_DC}, w AS (SELECT doc_id, min(st) AS st FROM u GROUP BY doc_id) SELECT doc_id, 'starts at ' || st AS why FROM w")
def j37(spark, d):
    """Where the first explanation's characters stand in a wire."""
    span = R.first_why_span(F.col("wire"))
    return _wires(spark, d).where("spans > 0").select("doc_id", F.substr("wire", span["start"] + 1, span["end"] - span["start"]).alias("why"))


@query("J38_token_spans", "WITH t AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(t) AS tokens, list_sum(list_transform(t, lambda x: length(x))) + len(t) - 1 AS last_end FROM t")
def j38(spark, d):
    """Character offsets of tokens that follow each other."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("t"))
    spans = t.select("doc_id", K.token_spans_udf("t").alias("s"))
    return spans.select("doc_id", F.size("s").cast("bigint").alias("tokens"), F.element_at("s", -1)["end"].cast("bigint").alias("last_end"))


@query("E14_tokens_in_span", "WITH t AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, i, length(x) AS n, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT doc_id, unnest(t) AS x, unnest(range(0, len(t))) AS i FROM t)) SELECT doc_id, count(*) FILTER (s < 40 AND s + n > 10) AS tokens FROM o GROUP BY doc_id")
def e14(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("t"))
    spans = t.select("doc_id", K.token_spans_udf("t").alias("s"))
    return spans.select("doc_id", F.size(F.filter("s", lambda x: (x["start"] < 40) & (x["end"] > 10))).cast("bigint").alias("tokens"))


@query("J39_prompts", f"SELECT doc_id, sha256('Annotate:' || chr(10) || '<text>' || {_ESC('''regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')''')} || '</text>') AS prompt FROM documents WHERE text IS NOT NULL")
def j39(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.format_string("Annotate:\n<text>%s</text>", T.escape_document(F.col("text"))), 256).alias("prompt"))


@query("I13_rendered_wires", f"WITH {_DC}, g AS (SELECT doc_id, st, en, coalesce(lag(en) OVER (PARTITION BY doc_id ORDER BY st), 0) AS f FROM u), p AS (SELECT g.doc_id, string_agg({_ESC('substr(text, f + 1, st - f)')} || '<span>' || {_ESC('substr(text, st + 1, en - st)')} || '<annotation type=\"' || {_KIND} || '\" why=\"starts at ' || st || '\" score=\"' || CASE WHEN st % 10 = 0 THEN '0' ELSE '0.' || st % 10 END || '\" /></span>', '' ORDER BY st) AS body, max(en) AS last FROM g JOIN dc ON dc.doc_id = g.doc_id GROUP BY g.doc_id) SELECT dc.doc_id, sha256('<text>' || coalesce(body, '') || {_ESC('substr(text, coalesce(last, 0) + 1)')} || '<verdict type=\"AI\" why=\"from a hash\" score=\"0.5\" /></text>') AS wire FROM dc LEFT JOIN p USING (doc_id)")
def i13(spark, d):
    return _wires(spark, d).select("doc_id", F.sha2("wire", 256).alias("wire"))


@query("I03_located_spans", f"WITH {_DC} SELECT doc_id, st, en FROM u JOIN dc USING (doc_id) WHERE strpos(text, substr(text, st + 1, en - st)) = st + 1 AND doc_id IN (SELECT doc_id FROM u GROUP BY doc_id HAVING count(*) = 1)")
def i03(spark, d):
    """Texts of spans found again in the document; for documents of one span whose text stands nowhere before it."""
    one = _per_document(spark, d, _clean(spark, d)).where("size(iv) = 1").select("doc_id", "text", F.col("iv")[0].alias("x"))
    span = F.substr("text", F.col("x.start") + 1, F.col("x.end") - F.col("x.start"))
    found = one.select("doc_id", "x", W.locate_udf("text", F.array(span)).alias("at")).select("doc_id", "x", F.col("at")[0].alias("p")).where("p.start = x.start")
    return found.select("doc_id", F.col("p.start").alias("st"), F.col("p.end").alias("en"))


@query("I09_crossing_tells", "WITH s AS (SELECT id, slot, st, least(st + w, n) AS en FROM (SELECT id, unnest([1, 2, 3, 4, 5]) AS slot, ('0x' || substr(sha256(id::VARCHAR || '|' || unnest([1, 2, 3, 4, 5])), 1, 6))::BIGINT % greatest(length(article), 1) AS st, 12 + ('0x' || substr(sha256(id::VARCHAR || '|' || unnest([1, 2, 3, 4, 5])), 7, 2))::BIGINT % 60 AS w, length(article) AS n FROM expert_articles WHERE article <> '')), o AS (SELECT *, lag(en) OVER (PARTITION BY id ORDER BY st, en) AS before FROM s) SELECT id, count(*) FILTER (st < before) = 0 AS apart FROM o GROUP BY id")
def i09(spark, d):
    """Whether a document's spans, in order, keep apart (each held against the one before)."""
    n = F.greatest(F.length("article"), F.lit(1))

    def span(i: int):
        h = F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(i))), 256)
        start = F.pmod(F.conv(F.substring(h, 1, 6), 16, 10).cast("bigint"), n).cast("int")
        return F.struct(start.alias("start"), F.least(start + 12 + F.pmod(F.conv(F.substring(h, 7, 2), 16, 10).cast("int"), F.lit(60)), F.length("article")).cast("int").alias("end"))

    spans = F.array_sort(F.array(*[span(i) for i in range(1, 6)]))
    apart = F.forall(F.sequence(F.lit(1), F.lit(4)), lambda i: F.element_at(spans, i + 1)["start"] >= F.element_at(spans, i)["end"])
    return table(spark, d, "expert_articles").where("article != ''").select("id", apart.alias("apart"))


@query("I10_nearest_occurrence")
def i10(spark, d):
    """The occurrence of a text's first three characters that lies nearest to character 50."""
    rows = table(spark, d, "documents").where("length(text) >= 60").select("doc_id", "text", F.substring("text", 1, 3).alias("s"))
    return rows.select("doc_id", W.nearest_udf("text", "s", F.lit(0), F.lit(50)).alias("place"))


@query("I11_fuzzy_places", f"WITH {_DC} SELECT doc_id, 10 AS place FROM k WHERE length(text) >= 80 AND NOT regexp_matches(text, '[#~]')")
def i11(spark, d):
    """A stretch of 30 characters with one changed is found where it came from (or earlier, if that fits as well)."""
    rows = _clean(spark, d).where("length(text) >= 80").where(~F.col("text").rlike("[#~]"))
    span = F.concat(F.substring("text", 11, 15), F.lit("#"), F.substring("text", 27, 14))
    return rows.select("doc_id", F.when(W.fuzzy_udf("text", span).between(0, 10), 10).alias("place"))


@query("P10_rebuilt_wires", f"WITH {_DC}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS ord FROM u) SELECT k.doc_id, sha256(text) AS plain, (SELECT count(*) FROM r WHERE r.doc_id = k.doc_id AND ord % 2 = 0) AS tells FROM k")
def p10(spark, d):
    """Every second tell is taken out and the wire rendered anew; the text stays."""
    w = _parsed(spark, d)
    kept = F.transform(F.filter("p.tells", lambda t: t["ord"] % 2 == 0), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["type"].alias("type"), t["explanation"].alias("explanation"), t["score"].alias("score")))
    again = w.select("doc_id", W.parse_udf(W.render_udf("p.plain", kept, F.col("p.verdict"))).alias("q"))
    return again.select("doc_id", F.sha2("q.plain", 256).alias("plain"), F.size("q.tells").cast("bigint").alias("tells"))


#: Sequences of 64 tokens per document from hashes: 0..7 are the structural ones, the others text; the first four are reasoning.
_TOK = "t AS (SELECT doc_id, i, ('0x' || substr(sha256(doc_id::VARCHAR), i + 1, 1))::INT AS t FROM documents, range(0, 64) AS r(i)), v AS (SELECT * FROM t WHERE i >= 4), e AS (SELECT *, last_value(CASE WHEN t IN (4, 1) THEN i WHEN t IN (7, 2) THEN -1 END IGNORE NULLS) OVER w AS opened, last_value(CASE WHEN t IN (4, 1, 7, 2) THEN t END IGNORE NULLS) OVER w AS ev, last_value(CASE WHEN t IN (5, 6) THEN t END IGNORE NULLS) OVER w AS q, max(CASE WHEN t IN (5, 6) THEN i END) OVER w AS qi, max(CASE WHEN t = 5 THEN i END) OVER w AS wi, max(CASE WHEN t = 6 THEN i END) OVER w AS si FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)), c AS (SELECT doc_id, i, t, CASE WHEN t = 3 THEN 2 WHEN t <= 7 THEN 1 WHEN ev = 1 THEN CASE WHEN qi > opened THEN CASE WHEN q = 6 THEN 9 ELSE 4 END ELSE 3 END WHEN ev = 4 THEN CASE WHEN si > opened THEN 8 WHEN wi > opened THEN 6 ELSE 5 END ELSE 7 END AS c FROM e)"


def _tokens(spark, d):
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    return table(spark, d, "documents").select("doc_id", F.transform(F.split(h, ""), lambda x: F.conv(x, 16, 10).cast("int")).alias("t"))


@query("K11_token_classes", f"WITH {_TOK} SELECT doc_id, array_to_string(list(c ORDER BY i), ',') AS classes FROM c GROUP BY doc_id")
def k11(spark, d):
    c = _tokens(spark, d).select("doc_id", K.classes_udf("t", F.lit(4)).alias("c"))
    return c.select("doc_id", F.array_join(F.slice("c", 5, 60), ",").alias("classes"))


@query("K12_segments", f"WITH {_TOK}, s AS (SELECT doc_id, i, t, max((t = 1)::INT) OVER w AS v, count(*) FILTER (t = 3) OVER w AS k FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) SELECT doc_id, array_to_string(list(CASE WHEN v = 1 THEN 1 WHEN k > 0 THEN 1 + k ELSE 0 END ORDER BY i), ',') AS segments FROM s GROUP BY doc_id")
def k12(spark, d):
    s = _tokens(spark, d).select("doc_id", K.segments_udf("t", F.lit(4)).alias("s"))
    return s.select("doc_id", F.array_join("s", ",").alias("segments"))


@query("K13_annotation_mask", f"WITH {_TOK} SELECT doc_id, array_to_string(list(CASE WHEN t IN (5, 6) AND coalesce(ev, 7) NOT IN (1, 4) THEN 0 WHEN c = 7 THEN 0 ELSE 1 END ORDER BY i), '') AS mask FROM c JOIN (SELECT doc_id AS d, i AS j, ev FROM e) x ON x.d = doc_id AND x.j = i GROUP BY doc_id")
def k13(spark, d):
    m = _tokens(spark, d).select("doc_id", K.mask_udf("t", F.lit(4)).alias("m"))
    return m.select("doc_id", F.array_join("m", "").alias("mask"))


@query("F17_surprisal", f"WITH {_TOK}, s AS (SELECT doc_id, c, (('0x' || substr(sha256('lp' || doc_id), i + 1, 1))::INT + 1) / 8.0::DOUBLE AS s FROM c), q AS (SELECT doc_id, list_sort(list(s)) AS l, avg(s) AS m, avg(s) FILTER (c <> 7) AS a, avg(s) FILTER (c = 7) AS d, count(*) FILTER (c <> 7) AS n FROM s GROUP BY doc_id) SELECT doc_id, round(m, 9) AS mean, l[6] AS p10, l[30] AS p50, l[54] AS p90, round(coalesce(a, 0.0), 9) AS ann_mean, round(coalesce(d, 0.0), 9) AS doc_mean, n AS ann_tokens FROM q")
def f17(spark, d):
    """Surprisal of a completion's tokens: mean, discrete quantiles, and means by class."""
    h = F.sha2(F.concat(F.lit("lp"), F.col("doc_id").cast("string")), 256)
    rows = _tokens(spark, d).withColumn("s", F.slice(F.transform(F.split(h, ""), lambda x: (F.conv(x, 16, 10).cast("int") + 1) / 8.0), 5, 60)).select("doc_id", "s", F.slice(K.classes_udf("t", F.lit(4)), 5, 60).alias("c"))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)).otherwise(0.0)
    both = F.arrays_zip("s", "c")
    part = lambda f: F.transform(F.filter(both, f), lambda z: z["s"])
    o = F.array_sort("s")
    ann = part(lambda z: z["c"] != 7)
    return rows.select("doc_id", F.round(mean(F.col("s")), 9).alias("mean"), *[F.element_at(o, F.floor(F.lit(q) * (F.size("s") - 1)).cast("int") + 1).alias(n) for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))], F.round(mean(ann), 9).alias("ann_mean"), F.round(mean(part(lambda z: z["c"] == 7)), 9).alias("doc_mean"), F.size(ann).cast("bigint").alias("ann_tokens"))


@query("F13_classes_by_weight", f"WITH {_TOK} SELECT c AS class, count(*) AS tokens, round(avg(t), 6) AS mean, round(avg(abs(t - 8)), 6) AS abs_mean FROM c GROUP BY c")
def f13(spark, d):
    c = _tokens(spark, d).select(F.slice(F.arrays_zip("t", K.classes_udf("t", F.lit(4)).alias("c")), 5, 60).alias("z")).select(F.explode("z").alias("z"))
    return c.groupBy(F.col("z.c").alias("class")).agg(F.count(F.lit(1)).alias("tokens"), F.round(F.avg("z.t"), 6).alias("mean"), F.round(F.avg(F.abs(F.col("z.t") - 8)), 6).alias("abs_mean"))
