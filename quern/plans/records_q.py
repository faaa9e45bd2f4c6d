"""Queries over records: unification by source rules, cleaning, keys, filters with reasons, counts, samples, merges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.functions import wiretext as R
from quern.operators import allocate as A
from quern.operators import normalize as N
from quern.operators.aggregates import lower_quantile
from quern.plans.registry import query, table
from quern.plans.text_q import _COMMENTS, _comments

_W = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NAME = lambda x: f"regexp_replace(lower(trim({x})), '[\\s-]+', '_', 'g')"
_LANG = lambda x: f"CASE WHEN trim({x}) <> '' THEN coalesce(CASE replace(lower(trim({x})), '_', '-') WHEN 'en-en' THEN 'en' WHEN 'en-us' THEN 'en' WHEN 'english' THEN 'en' WHEN 'spanish' THEN 'es' WHEN 'german' THEN 'de' WHEN 'czech' THEN 'cs' END, nullif(regexp_extract(replace(lower(trim({x})), '_', '-'), '^([a-z]{{2}})(-|$)', 1), ''), replace(lower(trim({x})), '_', '-')) END"
_CLEAN = lambda x: f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>\\s][^>]*>', ' ', 'g'), '{_W}', ' ', 'g'))"
_WORDS = lambda x: f"list_filter(string_split_regex({x}, '{_W}'), lambda w: w <> '')"
_STRIP = lambda x: f"regexp_replace({x}, '^{_W}|{_W}$', '', 'g')"


def _examples(spark, d):
    return table(spark, d, "examples")


def _unified(spark, d):
    e = _examples(spark, d)
    m = lambda k: F.try_element_at("meta", F.lit(k))
    domain = F.coalesce(N.canonical_name(F.col("domain")), F.lit("unknown"))
    generator = F.coalesce(F.when(F.trim("generator") != "", F.col("generator")), F.when(F.col("label") == 0, "human"))
    return N.unified_record(
        e, F.col("dataset"), F.split("id", "::")[1], F.split("id", "::")[2], F.col("text"), F.col("label"), domain, m("language"), generator, F.col("attack"),
        source=F.split("dataset", "/")[0], detail=m("source_detail"), title=m("title"), domain_detail=F.col("domain"), decoding=m("decoding"), penalty=m("repetition_penalty"),
    )


_U = f"""u AS (SELECT dataset || '::' || split_part(id, '::', 2) || '::' || split_part(id, '::', 3) AS unified_id, dataset AS dataset_id, split_part(id, '::', 2) AS source_split, split_part(id, '::', 3)::BIGINT AS row_index, coalesce(text, '') AS text, label, CASE WHEN label = 1 THEN 'AI' ELSE 'human' END AS label_text,
  coalesce({_NAME('domain')}, 'unknown') AS domain, domain AS domain_detail, split_part(dataset, '/', 1) AS source, meta['source_detail'] AS source_detail, coalesce({_LANG("meta['language']")}, CASE WHEN {_NAME('domain')} = 'non_english' THEN 'unknown' ELSE 'en' END) AS language, meta['language'] AS lang0,
  coalesce(CASE WHEN trim(generator) <> '' THEN generator END, CASE WHEN label = 0 THEN 'human' END) AS generator_model, attack, coalesce(attack <> 'none', false) AS is_adversarial FROM examples),
  v AS (SELECT *, coalesce(lang0, language) AS lang, domain NOT IN ('code', 'non_english', 'unknown') AND NOT is_adversarial AND language = 'en' AS is_default_training_candidate FROM u)"""


@query("C01_unified_records", f"WITH {_U} SELECT unified_id, dataset_id, source_split, row_index, sha256(text) AS text_hash, label, label_text, domain, domain_detail, source, source_detail, lang, language, generator_model, attack, is_adversarial, is_default_training_candidate FROM v")
def c01(spark, d):
    return _unified(spark, d).select("unified_id", "dataset_id", "source_split", "row_index", F.sha2("text", 256).alias("text_hash"), "label", "label_text", "domain", "domain_detail", "source", "source_detail", "lang", "language", "generator_model", "attack", "is_adversarial", "is_default_training_candidate")


@query("C02_rules_by_source", "SELECT id, coalesce(nullif(generator, ''), CASE WHEN lower(trim(dataset)) = 'quillmark/essay_bank' THEN CASE WHEN label = 1 THEN 'chatgpt' ELSE 'human' END END) AS generator_model, coalesce(nullif(meta['language'], ''), CASE WHEN lower(trim(dataset)) = 'quillmark/essay_bank' THEN 'en' END) AS lang FROM examples")
def c02(spark, d):
    """One source documents its generator and language; rows of it that lack them get the defaults."""
    documented = F.lower(F.trim("dataset")) == "quillmark/essay_bank"
    generator = F.coalesce(F.nullif("generator", F.lit("")), F.when(documented, F.when(F.col("label") == 1, "chatgpt").otherwise("human")))
    return _examples(spark, d).select("id", generator.alias("generator_model"), F.coalesce(F.nullif(F.try_element_at("meta", F.lit("language")), F.lit("")), F.when(documented, "en")).alias("lang"))


@query("C03_fixed_source_row", "SELECT id, 1 AS label, 'student_essay' AS domain, meta['source_detail'] AS domain_detail, 'essay_bank' AS source, generator AS generator_model, 'en' AS lang FROM examples WHERE lower(trim(dataset)) = 'quillmark/essay_bank' AND label = 1")
def c03(spark, d):
    rows = _examples(spark, d).where("lower(trim(dataset)) = 'quillmark/essay_bank' and label = 1")
    return rows.select("id", F.lit(1).alias("label"), F.lit("student_essay").alias("domain"), F.try_element_at("meta", F.lit("source_detail")).alias("domain_detail"), F.lit("essay_bank").alias("source"), F.col("generator").alias("generator_model"), F.lit("en").alias("lang"))


@query("C04_labels_from_words", "SELECT id, detector, generated_at, CASE WHEN lower(raw_label) LIKE 'human%' THEN 0 WHEN lower(raw_label) IN ('ai', 'machine-generated') THEN 1 END AS label FROM predictions WHERE raw_label IS NOT NULL")
def c04(spark, d):
    low = F.lower("raw_label")
    label = F.when(low.startswith("human"), 0).when(low.isin("ai", "machine-generated"), 1)
    return table(spark, d, "predictions").where("raw_label is not null").select("id", "detector", "generated_at", label.alias("label"))


_PAIR_DOMAIN = "CASE {0} WHEN 'newsroom_mix' THEN 'news' WHEN 'review_set' THEN 'review_opinion' WHEN 'mailroom' THEN 'email' WHEN 'story_lines' THEN 'creative_writing' WHEN 'essay_bank' THEN 'student_essay' ELSE 'unknown' END"


@query("C05_paired_source_row", f"SELECT source_id, CASE WHEN text_type = 'ai_generated' THEN 1 ELSE 0 END AS label, {_PAIR_DOMAIN.format(_NAME('source'))} AS domain, source AS domain_detail FROM pair_docs WHERE text_type IN ('human_written', 'ai_generated')")
def c05(spark, d):
    kinds = {"newsroom_mix": "news", "review_set": "review_opinion", "mailroom": "email", "story_lines": "creative_writing", "essay_bank": "student_essay"}
    rows = table(spark, d, "pair_docs").where("text_type in ('human_written', 'ai_generated')")
    return rows.select("source_id", (F.col("text_type") == "ai_generated").cast("int").alias("label"), N.mapped(N.canonical_name(F.col("source")), kinds).alias("domain"), F.col("source").alias("domain_detail"))


@query("C06_prefix_dropped", "SELECT DISTINCT source_id, CASE WHEN starts_with(source_id, 'src-') THEN substr(source_id, 5) ELSE source_id END AS detail FROM pair_docs")
def c06(spark, d):
    return table(spark, d, "pair_docs").select("source_id", F.regexp_replace("source_id", "^src-", "").alias("detail")).distinct()


@query("C07_label_from_flag", "SELECT doc_id, CASE WHEN label = 1 THEN 1 ELSE 0 END AS label, CASE WHEN label = 1 THEN generator_model ELSE 'human' END AS generator_model FROM documents")
def c07(spark, d):
    made = F.coalesce(F.col("label") == 1, F.lit(False))
    return table(spark, d, "documents").select("doc_id", made.cast("int").alias("label"), F.when(made, F.col("generator_model")).otherwise("human").alias("generator_model"))


@query("C08_attacked_detail", "SELECT id, CASE WHEN attack IS NULL THEN generator ELSE generator || ':' || attack END AS source_detail FROM examples WHERE generator IS NOT NULL")
def c08(spark, d):
    return _examples(spark, d).where("generator is not null").select("id", F.concat_ws(":", "generator", "attack").alias("source_detail"))


_CODE = "CASE generator WHEN 'lumen-7b' THEN 'A' WHEN 'lumen-30b' THEN 'B' WHEN 'human' THEN 'NO-MODEL' ELSE generator END"


@query("C09_decoded_models", "SELECT id, CASE WHEN label = 0 THEN 'human' ELSE generator END AS generator_model FROM examples WHERE generator IS NOT NULL AND label IS NOT NULL")
def c09(spark, d):
    """Model codes are decoded by a table; a human label overrides whatever the code says."""
    codes = {"lumen-7b": "A", "lumen-30b": "B", "human": "NO-MODEL"}
    encode = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    decode = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (v, k)])
    coded = _examples(spark, d).where("generator is not null and label is not null").withColumn("code", F.coalesce(F.try_element_at(encode, "generator"), "generator"))
    return coded.select("id", F.when(F.col("label") == 0, "human").otherwise(F.coalesce(F.try_element_at(decode, "code"), "code")).alias("generator_model"))


@query("C10_label_rules", "SELECT id, coalesce(label, CASE WHEN generator = 'human' THEN 0 ELSE 1 END) AS label FROM examples WHERE label IS NOT NULL OR generator IS NOT NULL")
def c10(spark, d):
    return _examples(spark, d).where("label is not null or generator is not null").select("id", F.coalesce("label", (F.col("generator") != "human").cast("int")).alias("label"))


_DOMAINS = {"forum_qa": "forum_qa", "social_media": "forum_qa", "news": "news", "finance": "news", "email": "email", "legal": "legal", "student_essay": "student_essay", "creative_writing": "creative_writing"}


@query("C11_domain_rules", f"SELECT id, CASE WHEN lower(trim(dataset)) = 'tallow/abstract_pool' THEN 'academic_abstract' ELSE CASE {_NAME('domain')} WHEN 'forum_qa' THEN 'forum_qa' WHEN 'social_media' THEN 'forum_qa' WHEN 'news' THEN 'news' WHEN 'finance' THEN 'news' WHEN 'email' THEN 'email' WHEN 'legal' THEN 'legal' WHEN 'student_essay' THEN 'student_essay' WHEN 'creative_writing' THEN 'creative_writing' ELSE 'unknown' END END AS domain, CASE WHEN lower(trim(dataset)) = 'tallow/abstract_pool' THEN 'abstract' ELSE domain END AS detail FROM examples")
def c11(spark, d):
    fixed = F.lower(F.trim("dataset")) == "tallow/abstract_pool"
    return _examples(spark, d).select("id", F.when(fixed, "academic_abstract").otherwise(N.mapped(N.canonical_name(F.col("domain")), _DOMAINS)).alias("domain"), F.when(fixed, "abstract").otherwise(F.col("domain")).alias("detail"))


@query("C12_source_rules", "SELECT id, CASE WHEN lower(trim(dataset)) = 'tallow/abstract_pool' THEN 'tallow' WHEN lower(trim(dataset)) LIKE 'meridian/%' THEN meta['source_detail'] END AS source, CASE WHEN lower(trim(dataset)) = 'tallow/abstract_pool' THEN 'abstract' WHEN lower(trim(dataset)) LIKE 'meridian/%' THEN domain END AS source_detail FROM examples")
def c12(spark, d):
    name = F.lower(F.trim("dataset"))
    a, b = name == "tallow/abstract_pool", name.startswith("meridian/")
    return _examples(spark, d).select("id", F.when(a, "tallow").when(b, F.try_element_at("meta", F.lit("source_detail"))).alias("source"), F.when(a, "abstract").when(b, F.col("domain")).alias("source_detail"))


@query("C13_language_codes", f"SELECT lang, {_LANG('lang')} AS language, count(*) AS documents FROM documents GROUP BY ALL")
def c13(spark, d):
    return table(spark, d, "documents").groupBy("lang", T.normalize_language(F.col("lang")).alias("language")).agg(F.count(F.lit(1)).alias("documents"))


@query("C14_inferred_language", f"SELECT id, coalesce({_LANG("CASE WHEN label = 0 THEN meta['language'] END")}, CASE lower(trim(meta['source_detail'])) WHEN 'german' THEN 'de' WHEN 'czech' THEN 'cs' END, CASE WHEN {_NAME('domain')} = 'non_english' THEN 'unknown' ELSE 'en' END) AS language FROM examples")
def c14(spark, d):
    m = lambda k: F.try_element_at("meta", F.lit(k))
    lang = N.infer_language(F.when(F.col("label") == 0, m("language")), F.coalesce(N.canonical_name(F.col("domain")), F.lit("unknown")), m("source_detail"), {"german": "de", "czech": "cs"})
    return _examples(spark, d).select("id", lang.alias("language"))


@query("C15_text_or_null", "SELECT id, label::VARCHAR AS label FROM examples")
def c15(spark, d):
    return _examples(spark, d).select("id", F.col("label").cast("string").alias("label"))


@query("C16_json_safe", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def c16(spark, d):
    """Vectors to JSON text and back: numbers stay numbers."""
    back = table(spark, d, "embeddings").select("vec_id", F.from_json(F.to_json("embedding"), "array<double>").alias("e"))
    return back.select("vec_id", F.size("e").cast("bigint").alias("n"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("C17_canonical_json", """SELECT doc_id, sha256('{"doc_id":' || doc_id || CASE WHEN lang IS NOT NULL THEN ',"lang":"' || lang || '"' ELSE ',"lang":null' END || CASE WHEN source IS NOT NULL THEN ',"source":"' || source || '"' ELSE ',"source":null' END || '}') AS form FROM documents""")
def c17(spark, d):
    from quern.sources.writers import json_line

    rows = table(spark, d, "documents").select("source", "doc_id", "lang")
    return rows.select("doc_id", F.sha2(json_line(rows), 256).alias("form"))


@query("C18_summary_keys", "SELECT coalesce(dataset, '') || '::' || coalesce(split, '') || '::' || coalesce(domain, '') AS key, count(*) AS rows FROM examples GROUP BY 1")
def c18(spark, d):
    return _examples(spark, d).groupBy(T.key_of("dataset", "split", "domain", sep="::").alias("key")).agg(F.count(F.lit(1)).alias("rows"))


@query("C19_language_filled", "SELECT id, coalesce(nullif(trim(meta['language']), ''), CASE WHEN lower(trim(dataset)) LIKE 'saltmarsh/%' THEN CASE WHEN lower(trim(split)) LIKE '%shift' THEN 'es' ELSE 'en' END END, 'en') AS language FROM examples")
def c19(spark, d):
    by_split = F.when(F.lower(F.trim("dataset")).startswith("saltmarsh/"), F.when(F.lower(F.trim("split")).endswith("shift"), "es").otherwise("en"))
    return _examples(spark, d).select("id", F.coalesce(F.nullif(F.trim(F.try_element_at("meta", F.lit("language"))), F.lit("")), by_split, F.lit("en")).alias("language"))


@query("C20_generator_filled", "SELECT id, CASE WHEN trim(generator) <> '' THEN trim(generator) WHEN label = 0 THEN 'human' WHEN lower(trim(dataset)) IN ('quillmark/essay_bank', 'brindle/review_set') THEN 'chatgpt' ELSE '' END AS generator_model FROM examples WHERE label IS NOT NULL")
def c20(spark, d):
    g = F.when(F.trim("generator") != "", F.trim("generator")).when(F.col("label") == 0, "human").when(F.lower(F.trim("dataset")).isin("quillmark/essay_bank", "brindle/review_set"), "chatgpt").otherwise("")
    return _examples(spark, d).where("label is not null").select("id", g.alias("generator_model"))


@query("C22_stable_hash", "SELECT id, sha256(id) AS h FROM examples")
def c22(spark, d):
    return _examples(spark, d).select("id", T.stable_hash(F.col("id")).alias("h"))


@query("C27_clean_documents", f"SELECT id, sha256({_CLEAN('text')}) AS text_hash, coalesce(label, 0) AS label, domain FROM examples WHERE {_CLEAN('text')} <> ''")
def c27(spark, d):
    rows = _examples(spark, d).withColumn("text", T.clean_document_text(F.col("text"))).where("text != ''")
    return rows.select("id", F.sha2("text", 256).alias("text_hash"), F.coalesce("label", F.lit(0)).alias("label"), "domain")


@query("C29_document_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents WHERE text IS NOT NULL")
def c29(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("h"))


@query("C30_unknown_keys_to_meta", "SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN lang IS NOT NULL THEN 'lang=' || lang END, CASE WHEN source IS NOT NULL THEN 'source=' || source END, CASE WHEN title IS NOT NULL THEN 'title=' || title END], lambda x: x IS NOT NULL)), ';') AS meta, coalesce(label NOT IN (0, 1), false) AS rejected FROM documents")
def c30(spark, d):
    """Known fields stay columns, all others become entries of a map; a label other than 0 and 1 is rejected."""
    meta = F.map_filter(F.create_map(*[x for c in ("lang", "source", "title") for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    entries = F.array_sort(F.transform(F.map_entries(meta), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, d, "documents").select("doc_id", F.array_join(entries, ";").alias("meta"), F.coalesce(~F.col("label").isin(0, 1), F.lit(False)).alias("rejected"))


@query("C31_metadata_attached", "SELECT p.id, p.detector, p.generated_at, e.label, e.split, e.dataset, e.domain, e.generator, e.attack FROM predictions p JOIN examples e USING (id)")
def c31(spark, d):
    columns = ["label", "split", "dataset", "domain", "generator", "attack"]
    p = table(spark, d, "predictions").select("id", "detector", "generated_at")
    return p.join(_examples(spark, d).select("id", *columns), "id").select("id", "detector", "generated_at", *columns)


@query("C32_provenance", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS source_row_index, 'validation' AS origin_split, typeof(prompt_id) AS issue_type FROM expert_articles WHERE prompt_id % 3 = 0")
def c32(spark, d):
    from quern.operators.ranks import global_position

    rows = table(spark, d, "expert_articles").where("prompt_id % 3 = 0").select("id", "prompt_id")
    return global_position(rows, ["id"]).select("id", F.col("position").alias("source_row_index"), F.lit("validation").alias("origin_split"), F.upper(F.typeof("prompt_id")).alias("issue_type"))


#: Comments with straight quotes, brackets and apostrophes laid into them, as the tables have none.
_QUOTED = f"(SELECT cid, '\"' || comment || '\" it''s (\"so\") {{''x''}} & ' || upper(comment) || ' “' || comment || '” end' AS q FROM {_COMMENTS})"


def _quoted(spark, d):
    c = F.col("comment")
    return _comments(spark, d).select("cid", F.concat(F.lit('"'), c, F.lit("\" it's (\"so\") {'x'} & "), F.upper(c), F.lit(" “"), c, F.lit("” end")).alias("q"))


def _curly(x: str) -> str:
    """Typographic quotes without look-behind: the character before an opening quote is kept."""
    out = f"""regexp_replace({x}, '(^|[\\s(\\{{\\[])"', '\\1“', 'g')"""
    out = f"""replace({out}, '"', '”')"""
    out = f"regexp_replace({out}, '([\\p{{L}}\\p{{N}}_])''([\\p{{L}}\\p{{N}}_])', '\\1’\\2', 'g')"
    out = f"regexp_replace({out}, '(^|[\\s(\\{{\\[])''', '\\1‘', 'g')"
    return f"replace({out}, '''', '’')"


@query("C33_curly_quotes", f"SELECT cid, {_curly('q')} AS form FROM {_QUOTED}")
def c33(spark, d):
    return _quoted(spark, d).select("cid", R.curly_quotes(F.col("q")).alias("form"))


@query("C34_escaped_comments", f"SELECT cid, {_curly('''replace(replace(replace(q, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')''')} AS form FROM {_QUOTED}")
def c34(spark, d):
    return _quoted(spark, d).select("cid", R.escaped_comment(F.col("q")).alias("form"))


@query("C35_unquoted_words", f"SELECT cid, len({_WORDS(chr(40) + '''regexp_replace(q, '“[^”]*”|"[^"]*"', '', 'g')''' + chr(41))}) AS words FROM {_QUOTED}")
def c35(spark, d):
    return _quoted(spark, d).select("cid", R.unquoted_words(F.col("q")).cast("bigint").alias("words"))


@query("C37_collapsed_blanks", f"SELECT doc_id, sha256(trim(regexp_replace(text, '{_W}', ' ', 'g'))) AS form FROM documents WHERE text IS NOT NULL")
def c37(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(T.squeeze(F.col("text")), 256).alias("form"))


@query("C38_word_counts", "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}\\p{Pc}]+')) AS words FROM documents WHERE text IS NOT NULL")
def c38(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}\p{M}\p{Pc}]+"), F.lit(0))).cast("bigint").alias("words"))


_START = "regexp_replace(paragraphs[1], '^[^a-zA-Z0-9]*', '')"


@query("C39_scorer_text", f"""WITH p AS (SELECT id, list_filter(string_split(CASE WHEN contains(text, '</think>') THEN {_STRIP("substr(text, strpos(text, '</think>') + 8)")} ELSE text END, chr(10)), lambda x: {_STRIP('x')} <> '') AS paragraphs, text FROM (SELECT id, CASE WHEN label = 1 THEN 'Certainly, here it is:' || chr(10) || text ELSE 'x</think> ' || text END AS text FROM examples WHERE text IS NOT NULL AND label IS NOT NULL))
  SELECT id, sha256(trim(regexp_replace(lower(array_to_string(CASE WHEN len(paragraphs) > 1 AND (starts_with({_START}, 'Certainly') OR starts_with({_START}, 'Title')) THEN paragraphs[2:] ELSE paragraphs END, chr(10))), '{_W}', ' ', 'g'))) AS form FROM p""")
def c39(spark, d):
    made = F.when(F.col("label") == 1, F.concat(F.lit("Certainly, here it is:\n"), "text")).otherwise(F.concat(F.lit("x</think> "), "text"))
    rows = _examples(spark, d).where("text is not null and label is not null").select("id", made.alias("text"))
    return rows.select("id", F.sha2(R.scorer_text(F.col("text"), ("Certainly", "Title")), 256).alias("form"))


_MECH = ("AI\\s+(tends?|rarely|never|often|usually|frequently|almost never|is trained|generates?|produces?)", "\\bgenerat(es?|ed|ion)\\b.{0,40}\\b(AI|model|LLM|automat)", "humans?\\s+(naturally|tends?|often|rarely|writes?|uses?|prefers?|avoids?)", "\\bbecause\\b.{5,}", "\\bunlike\\b.{10,}")
_REWORDED = f"(SELECT cid, CASE WHEN id % 4 = 0 THEN comment || ' because humans tend to write like this and models rarely do' WHEN id % 4 = 1 THEN comment || ' this is a clear sign, as AI often does it' ELSE comment END AS why FROM {_COMMENTS})"


@query("C40_needs_rewrite", f"SELECT cid, length(trim(why)) < 60 OR NOT ({' OR '.join(f'''regexp_matches(why, '(?i){m}')''' for m in (*_MECH, 'models?\\s+(tends?|rarely|often|are trained|generates?|produces?)'))}) OR regexp_matches(why, '(?i)is a\\s+(small |subtle |clear |strong |notable |definitive |tell-?tale )?(sign|tell\\b|indicator|marker|clue|hallmark|hint|evidence)') AS rewrite FROM {_REWORDED}")
def c40(spark, d):
    c = F.col("comment")
    why = F.when(F.col("id") % 4 == 0, F.concat(c, F.lit(" because humans tend to write like this and models rarely do"))).when(F.col("id") % 4 == 1, F.concat(c, F.lit(" this is a clear sign, as AI often does it"))).otherwise(c)
    return _comments(spark, d).select("cid", R.needs_rewrite(why).alias("rewrite"))


@query("C41_patched_explanation", f"SELECT cid, w1 || 'why=\"new\"' || substr(w, strpos(w, old) + length(old)) AS form FROM (SELECT cid, w, old, substr(w, 1, strpos(w, old) - 1) AS w1 FROM (SELECT cid, '<a why=\"' || comment || '\"/><b why=\"' || comment || '\"/>' AS w, 'why=\"' || comment || '\"' AS old FROM {_COMMENTS} WHERE NOT regexp_matches(comment, '[&<>\"'']')))")
def c41(spark, d):
    attr = lambda x: F.concat(F.lit('why="'), T.escape_document(x), F.lit('"'))
    rows = _comments(spark, d).where(~F.col("comment").rlike("[&<>\"']"))
    wire = F.concat(F.lit("<a "), attr(F.col("comment")), F.lit("/><b "), attr(F.col("comment")), F.lit("/>"))
    return rows.select("cid", R.replace_first(wire, attr(F.col("comment")), attr(F.lit("new"))).alias("form"))


@query("C42_inverted_index", f"SELECT cid, array_to_string({_WORDS('comment')}, ' ') AS form FROM {_COMMENTS}")
def c42(spark, d):
    """Text from word -> positions: the map is unfolded, ordered by position and joined, within the row."""
    words = T.white_words(F.col("comment"))
    places = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("w"), F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i) == w).alias("at")))
    rows = _comments(spark, d).where(F.size(words) > 0).select("cid", F.map_from_entries(F.transform(places, lambda p: F.struct(p["w"], p["at"]))).alias("index"))
    return rows.select("cid", R.from_inverted_index(F.col("index")).alias("form"))


_NUMS = "(SELECT doc_id, 'AUROC of ' || (doc_id % 130) || CASE WHEN doc_id % 3 = 0 THEN '.5%' ELSE '' END || ' and accuracy 0.' || (doc_id % 97) AS t FROM documents)"


@query("C43_first_pattern", f"SELECT doc_id, round(CASE WHEN n > 1 THEN n / 100 ELSE n END, 4) AS value FROM (SELECT doc_id, TRY_CAST(coalesce(nullif(regexp_extract(t, '(?i)auroc[^0-9]*([0-9]+\\.[0-9]+)', 1), ''), nullif(regexp_extract(t, '(?i)accuracy[^0-9]*([0-9]*\\.?[0-9]+)', 1), '')) AS DOUBLE) AS n FROM {_NUMS})")
def c43(spark, d):
    t = F.concat(F.lit("AUROC of "), (F.col("doc_id") % 130).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".5%").otherwise(""), F.lit(" and accuracy 0."), (F.col("doc_id") % 97).cast("string"))
    patterns = (r"(?i)auroc[^0-9]*([0-9]+\.[0-9]+)", r"(?i)accuracy[^0-9]*([0-9]*\.?[0-9]+)")
    return table(spark, d, "documents").select("doc_id", R.first_match(t, patterns).alias("value"))


_REPORTED = "(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'not reported' WHEN 1 THEN 'fell from 0.' || (doc_id % 90) || ' to 0.' || (doc_id % 70) || ' here' WHEN 2 THEN (doc_id % 101) || '.5%' WHEN 3 THEN 'about ' || (doc_id % 300) WHEN 4 THEN '' ELSE 'AUC 0.' || (doc_id % 99) END AS t FROM documents)"


@query("C44_reported_scores", f"SELECT doc_id, round(CASE WHEN n > 1 AND n <= 100 THEN n / 100 ELSE n END, 9) AS score FROM (SELECT doc_id, CASE WHEN t = '' OR contains(t, 'not reported') OR contains(t, 'n/a') THEN NULL WHEN contains(lower(t), ' from ') AND contains(lower(t), ' to ') THEN TRY_CAST(regexp_extract_all(t, '\\d+\\.\\d+|\\d+')[-1] AS DOUBLE) ELSE TRY_CAST(regexp_extract_all(t, '\\d+\\.\\d+|\\d+')[1] AS DOUBLE) END AS n FROM {_REPORTED})")
def c44(spark, d):
    i = F.col("doc_id")
    s = lambda m: (i % m).cast("string")
    t = F.when(i % 6 == 0, "not reported").when(i % 6 == 1, F.concat(F.lit("fell from 0."), s(90), F.lit(" to 0."), s(70), F.lit(" here"))).when(i % 6 == 2, F.concat(s(101), F.lit(".5%"))).when(i % 6 == 3, F.concat(F.lit("about "), s(300))).when(i % 6 == 4, "").otherwise(F.concat(F.lit("AUC 0."), s(99)))
    return table(spark, d, "documents").select("doc_id", F.round(T.reported_score(t), 9).alias("score"))


_ANSWER = "(SELECT id, CASE WHEN length(id) % 3 = 0 THEN 'I think 0.' || (length(id) % 10) || ' fits' WHEN length(id) % 3 = 1 THEN '{\"p_ai\": ' || (length(id) % 40) / 20.0::DOUBLE || '}' ELSE '{\"p_ai\": -1}' END AS a, length(id) AS n FROM examples)"


@query("C45_answered_probability", "SELECT id, CASE n % 3 WHEN 0 THEN (n % 10) / 10.0::DOUBLE WHEN 1 THEN least(1.0, (n % 40) / 20.0::DOUBLE) ELSE 0.0 END AS p FROM (SELECT id, length(id) AS n FROM examples)")
def c45(spark, d):
    n = F.length("id")
    a = F.when(n % 3 == 0, F.concat(F.lit("I think 0."), (n % 10).cast("string"), F.lit(" fits"))).when(n % 3 == 1, F.concat(F.lit('{"p_ai": '), ((n % 40) / 20.0).cast("string"), F.lit("}"))).otherwise('{"p_ai": -1}')
    return _examples(spark, d).select("id", R.probability(a).alias("p"))


@query("C46_judge_json", "SELECT doc_id, judge_id, item_id, judged_at, rank AS parsed_rank FROM judgments WHERE rank IS NOT NULL")
def c46(spark, d):
    """Answers in code fences with text around them: the object between the first and the last brace is parsed."""
    raw = F.concat(F.lit("Sure!\n```json\n"), F.to_json(F.struct("item_id", "rank")), F.lit("\n```\nDone."))
    rows = table(spark, d, "judgments").where("rank is not null").select("doc_id", "judge_id", "item_id", "judged_at", raw.alias("a"))
    return rows.select("doc_id", "judge_id", "item_id", "judged_at", R.json_object(F.col("a"), "item_id string, rank int")["rank"].alias("parsed_rank"))


@query("C47_rubric_json", "SELECT id, [0.25, 1.0, 0.0]::DOUBLE[] AS ann FROM examples WHERE length(id) % 2 = 0")
def c47(spark, d):
    """The last object that starts with ``{"ann":``, its numbers within 0..1, if it has as many as asked for."""
    even = F.length("id") % 2 == 0
    a = F.concat(F.lit('first {"ann": [9, 9]} then '), F.when(even, '{"ann": [0.25, 7, -1], "x": {"y": 1}} end').otherwise('{"ann": [0.5]} end'))
    return _examples(spark, d).select("id", R.rubric_scores(a, 3).alias("ann")).where("ann is not null")


_CUT = f"w AS (SELECT doc_id, {_WORDS(_CLEAN('text'))} AS w FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, w, w[1:128] AS h FROM w), k AS (SELECT doc_id, w, h, list_max(list_filter(range(greatest(1, len(h) - 24) + CASE WHEN len(h) <= 25 THEN 1 ELSE 0 END, len(h) + 1), lambda i: regexp_matches(h[i], '[.!?]$'))) AS b FROM h)"


@query("C48_truncated_documents", f"WITH {_CUT} SELECT doc_id, sha256(array_to_string(CASE WHEN len(w) <= 128 THEN w WHEN b IS NOT NULL THEN h[1:b] ELSE h END, ' ')) AS form FROM k")
def c48(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", T.white_words(T.clean_document_text(F.col("text"))).alias("w"))
    return rows.select("doc_id", F.sha2(F.array_join(R.truncate_words(F.col("w"), 128), " "), 256).alias("form"))
