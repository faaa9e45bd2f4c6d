"""Subject areas of documents by curated terms, found with a multi-pattern automaton.

A sentence's evidence for a subject is the weight of the subject's terms in it, times their rarity in the corpus, at most 1;
a document's score is its evidence per sentence.  Thresholds per subject come from the documents of known subjects.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import canonical_language, checkpoint, process_cache
from quern.llm.subject_terms import terms

_TAG = re.compile(r"<[^<>]*>")
_END = re.compile(r"[.!?…]+(?=\W|$)|\n\s*\n")
_GAP = re.compile(r"[^\w|]+|_+")
#: Stretches with fewer words are no sentences (speech tags, headings); a longer stretch counts once per SENTENCE_WORDS words.
LEAST_WORDS, SENTENCE_WORDS = 4, 16
DEFAULT_THRESHOLD = 0.3
#: Labelled documents a subject needs for a threshold of its own, and how many the documents of all subjects count for in it.
LEAST_POSITIVE, PRIOR_POSITIVE = 8, 20


def _automaton():
    cache = process_cache()
    if "subject automaton" not in cache:
        import ahocorasick

        by_term: dict[str, list[int]] = {}
        for k, (term, _, _) in enumerate(terms()):
            by_term.setdefault(term, []).append(k)
        a = ahocorasick.Automaton()
        for term, ks in by_term.items():  # with the distance from the first blank to the end of the match
            word = f" {term[:-1]}" if term.endswith("*") else f" {term} "
            a.add_word(word, (len(word) - 1, tuple(ks)))
        a.make_automaton()
        cache["subject automaton"] = a
    return cache["subject automaton"]


def profile(text: str | None) -> tuple[int, dict[tuple[int, ...], int]]:
    """Sentences of the whole text, and how many of them hold each combination of terms (indices into ``terms()``)."""
    if not text:
        return 0, {}
    low = text.lower()
    if "<" in low:
        low = _TAG.sub(" ", low)
    flat = " " + _GAP.sub(" ", _END.sub(" | ", low)) + " "
    stretches, at = [], 0
    ends = []
    for s in flat.split("|"):
        at += len(s) + 1
        ends.append(at)
        n = s.count(" ") - 1
        stretches.append(0 if n < LEAST_WORDS else max(1, round(n / SENTENCE_WORDS)))
    found: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}
    for end, (length, ks) in _automaton().iter(flat):
        begin = end - length
        k = bisect_right(ends, begin)
        if stretches[k] > 1:  # an unpunctuated stretch: take even parts of it for sentences
            first = ends[k - 1] if k else 0
            k = (k, (begin - first) * stretches[k] // (ends[k] - first))
        hits = found.setdefault(k, [])
        while hits and hits[-1][0] >= begin:  # a longer term that ends here or later holds the shorter ones
            hits.pop()
        if not hits or hits[-1][1] < end:
            hits.append((begin, end, ks))
    out: dict[tuple[int, ...], int] = {}
    for k, hits in found.items():
        if isinstance(k, tuple) or stretches[k]:
            combo = tuple(sorted({x for _, _, ks in hits for x in ks}))
            out[combo] = out.get(combo, 0) + 1
    return sum(stretches), out


def profiles(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``doc_id, lang, sentences, terms, combos``: the distinct terms of each document and its combinations, coded as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, lang, text in zip(b["doc_id"], b["lang"], b["text"], strict=True):
                n, combos = profile(text)
                distinct = sorted({x for c in combos for x in c})
                rows.append((i, lang, n, distinct, ";".join(f"{m}:{','.join(map(str, c))}" for c, m in combos.items())))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "sentences", "terms", "combos"])

    rows = docs.select(F.col(id_col).alias("doc_id"), canonical_language(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {id_type}, lang string, sentences int, terms array<int>, combos string")


def scored(profiled: DataFrame) -> DataFrame:
    """``doc_id, lang, sentences, subject, score`` for each subject a document has any evidence for."""
    total = profiled.count()
    frequency = {r["t"]: r["n"] for r in profiled.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per curated term
    known = terms()
    idf = np.array([np.log((total + 1) / (frequency.get(k, 0) + 1)) for k in range(len(known))])
    typical = np.median(idf[[k for k in range(len(known)) if k in frequency]]) if frequency else 1.0
    weight = [w * float(np.clip(idf[k] / max(typical, 1e-9), 0.5, 1.0)) for k, (_, _, w) in enumerate(known)]
    subject = [s for _, s, _ in known]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, lang, n, combos in zip(b["doc_id"], b["lang"], b["sentences"], b["combos"], strict=True):
                score: dict[str, float] = {}
                for part in combos.split(";") if combos else ():
                    times, _, ks = part.partition(":")
                    here: dict[str, float] = {}
                    for k in map(int, ks.split(",")):
                        here[subject[k]] = here.get(subject[k], 0.0) + weight[k]
                    for s, w in here.items():
                        score[s] = score.get(s, 0.0) + min(1.0, w) * int(times)
                rows += [(i, lang, n, s, x / max(n, 1)) for s, x in score.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "sentences", "subject", "score"])

    id_type = profiled.schema["doc_id"].dataType.simpleString()
    return profiled.mapInPandas(run, f"doc_id {id_type}, lang string, sentences int, subject string, score double")


def _best(positive: np.ndarray, negative: np.ndarray) -> float:
    """The bin from which F1 is best, in the middle of the best stretch."""
    tp, fp = positive[::-1].cumsum()[::-1], negative[::-1].cumsum()[::-1]
    f1 = 2 * tp / np.maximum(tp + fp + positive.sum(), 1e-9)
    return float(np.median(np.flatnonzero(f1[1:] >= f1[1:].max() - 1e-3) + 1))


def calibrated_thresholds(scores: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """The score from which each subject is assigned, and the one for subjects with fewer than LEAST_POSITIVE labelled documents.

    A subject's threshold has the best F1 over its labelled documents, with those of all subjects counting as PRIOR_POSITIVE more; the common
    one has the best F1 over all.  All of a labelled document's other subjects count as negatives.  Scores are counted in hundredths, so the
    driver gets at most 200 rows per subject.
    """
    marked = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where("doc_id is not null and subject is not null").distinct()
    of_labelled = scores.join(marked.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "subject", "score")
    joined = of_labelled.join(marked.withColumn("yes", F.lit(1)), ["doc_id", "subject"], "full")
    bins = joined.groupBy("subject", F.floor(F.coalesce("score", F.lit(0.0)) * 100).cast("int").alias("b"), F.coalesce("yes", F.lit(0)).alias("yes")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict[str, np.ndarray] = {}
    for r in bins:
        counts.setdefault(r["subject"], np.zeros((2, 202)))[r["yes"], min(max(r["b"], 0), 200)] += r["n"]
    every = sum(counts.values(), np.zeros((2, 202)))
    if not every[1].sum() or not every[0].sum():
        return {}, DEFAULT_THRESHOLD
    prior = every * (PRIOR_POSITIVE / every[1].sum())
    own = {s: _best(c[1] + prior[1], c[0] + prior[0]) / 100 for s, c in counts.items() if c[1].sum() >= LEAST_POSITIVE}
    return own, _best(every[1], every[0]) / 100


def assign_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``doc_id, subject, score`` for each subject assigned, and the make-up ``lang, subject, documents, share`` of the corpus.

    A document has none, one or several subjects.  Null and empty texts have none.  Thresholds are calibrated per subject on ``labels``, with a common one where a subject has few; without labels of both kinds it is DEFAULT_THRESHOLD.  ``subjects`` restricts the subjects to
    those listed.  The make-up has a row per language and subject and, with a null subject, one for documents without any; shares are of the language's documents.
    """
    profiled = checkpoint(profiles(docs, id_col, text_col, lang_col))
    scores = scored(profiled)
    if subjects is not None:
        listed = [r["subject"] for r in subjects.select(F.lower(F.trim("subject")).alias("subject")).distinct().collect()]
        scores = scores.where(F.col("subject").isin(listed))
    scores = checkpoint(scores)
    own, common = calibrated_thresholds(scores, labels)
    least = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), F.col("subject")), F.lit(common)) if own else F.lit(common)
    assigned = scores.where(F.col("score") >= least)
    per_lang = profiled.groupBy("lang").agg(F.count(F.lit(1)).alias("all"))
    with_any = assigned.groupBy("lang").agg(F.count_distinct("doc_id").alias("any"))
    none = per_lang.join(with_any, per_lang["lang"].eqNullSafe(with_any["lang"]), "left").select(per_lang["lang"], F.lit(None).cast("string").alias("subject"), (F.col("all") - F.coalesce("any", F.lit(0))).alias("documents"))
    counted = assigned.groupBy("lang", "subject").agg(F.count(F.lit(1)).alias("documents")).unionByName(none)
    per = per_lang.withColumnRenamed("lang", "l")
    makeup = counted.join(per, F.col("lang").eqNullSafe(F.col("l")), "left").select("lang", "subject", "documents", F.try_divide("documents", "all").alias("share"))
    return assigned.select("doc_id", "subject", "score"), makeup
