"""Scores of explanations, verdicts and document probes as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import content_tokens, distinct_ratio, jaccard, let, normalized_explanation, sigmoid, white_words

#: Terms that the offline scorer counts for either side, the weight of a hit, and the base of its logistic function.
AI_TERMS = ("ai", "generated", "formal", "therefore", "overall")
HUMAN_TERMS = ("typo", "lol", "i ", "cant", "human")
HIT_WEIGHT, LOGISTIC_BASE = 0.35, 2.718281828
#: Phrases of explanations that would fit any text.
GENERIC_PHRASES = (
    "too polished", "generic phrasing", "sounds generic", "ai-like", "lacks personality", "overly formal", "formulaic", "unnatural", "repetitive", "predictable structure",
    "typical of human writing", "typical of ai writing", "typical of ai-generated", "typical of machine-generated", "common in ai", "common in human",
)
KINDS = ("AI", "human")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def occurrences(text: Column, word: str) -> Column:
    """How often ``word`` occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def keyword_score(text: Column) -> Column:
    """Deterministic offline scorer: logistic of the weighted hits of the AI-side terms minus the human-side ones; 0.5 for a null text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    balance = sum((occurrences(low, w) for w in AI_TERMS), F.lit(0)) - sum((occurrences(low, w) for w in HUMAN_TERMS), F.lit(0))
    return 1 / (1 + F.exp(-HIT_WEIGHT * math.log(LOGISTIC_BASE) * balance.cast("double")))


def label_agreement(kind: Column, label: Column) -> Column:
    """1 if the type names the label's class, -1 if it names the other, 0 for any other type."""
    return F.when(kind == "AI", F.when(label == 1, 1).otherwise(-1)).when(kind == "human", F.when(label == 1, -1).otherwise(1)).otherwise(0)


def why_quality(why: Column, low: float = 10.0, high: float = 40.0, gram: int = 3) -> Column:
    """Length times variety of an explanation: a quadratic rise to ``low`` words, flat to ``high``, a quadratic fall to 0 at twice that; share of distinct runs of ``gram`` words."""

    def quality(t: Column) -> Column:
        n = F.size(t).cast("double")
        fall = (2 * high - n) / high
        length = F.when(n < low, (n / low) ** 2).when(n <= high, 1.0).when(n >= 2 * high, 0.0).otherwise(fall * fall)
        return F.when(n == 0, 0.0).otherwise(length * distinct_ratio(t, gram))

    return let(white_words(why), quality)


def explanation_reward(credibility: Column, why: Column) -> Column:
    return clamp(credibility) * why_quality(why)


def score_agreement(score: Column, credibility: Column) -> Column:
    return 1 - F.abs(clamp(score) - clamp(credibility))


def length_gate(why: Column, low: float = 50.0, high: float = 150.0, zero: float = 200.0, gram: int = 3) -> Column:
    """Gate of a verdict's explanation: quadratic rise to ``low`` words, flat to ``high``, quadratic fall to 0 at ``zero``, times the share of distinct runs of words."""

    def gate(t: Column) -> Column:
        n = F.size(t).cast("double")
        fall = (zero - n) / (zero - high)
        length = F.when(n < low, (n / low) ** 2).when(n <= high, 1.0).when(n >= zero, 0.0).otherwise(fall * fall)
        return F.when(n == 0, 0.0).otherwise(length * distinct_ratio(t, gram))

    return let(white_words(why), gate)


def plain_words(c: Column, stop: Sequence[str] = ()) -> Column:
    """Distinct words of three or more letters, stripped of everything but letters, digits and underscores, without ``stop``."""
    words = F.transform(white_words(F.lower(c)), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stop) if stop else F.length(w) >= 3)
    return F.array_distinct(kept)


def word_recall(explanations: Column, verdict: Column, stop: Sequence[str] = ()) -> Column:
    """Share of the distinct words of an array of explanations that the verdict's explanation has; 0 without words."""
    return let(plain_words(F.array_join(explanations, " "), stop), lambda a: F.when(F.size(a) > 0, F.size(F.array_intersect(a, plain_words(verdict, stop))) / F.size(a)).otherwise(0.0))


def quote_coverage(verdict: Column, spans: Column) -> Column:
    """Share of the verdict's quotations (three or more characters between typographic quotes) that lie in a span or hold one; 0 without quotations."""
    quotes = F.regexp_extract_all(F.coalesce(verdict, F.lit("")), F.lit("[“”‘’]([^“”‘’]{3,})[“”‘’]"), F.lit(1))

    def share(q: Column) -> Column:
        met = F.filter(q, lambda x: F.exists(spans, lambda s: (s != "") & (F.contains(s, F.trim(x)) | F.contains(F.trim(x), s))))
        return F.when(F.size(q) > 0, F.size(met) / F.size(q)).otherwise(0.0)

    return let(quotes, share)


def verdict_reward(verdict: Column, explanations: Column, spans: Column) -> Column:
    """Gate times the sum of recall and quotation coverage."""
    return length_gate(verdict) * (word_recall(explanations, verdict) + quote_coverage(verdict, spans))


def signed(kind: Column, strength: Column) -> Column:
    """A clamped strength, positive for AI and negative for human; null for other types and without a strength."""
    return F.when(kind == "AI", clamp(strength)).when(kind == "human", -clamp(strength))


def softmax_mean_of(values: Column, beta: float) -> Column:
    """Mean of an array's values weighted by exp(beta * |value|); plain for beta <= 0, 0 for an empty array.  Nulls are skipped."""
    kept = F.filter(values, lambda x: x.isNotNull())

    def mean(v: Column) -> Column:
        weight = (lambda x: F.exp(beta * F.abs(x))) if beta > 0 else (lambda x: F.lit(1.0))
        top = F.aggregate(v, F.lit(0.0), lambda a, x: a + weight(x) * x)
        return F.when(F.size(v) > 0, top / F.aggregate(v, F.lit(0.0), lambda a, x: a + weight(x))).otherwise(0.0)

    return let(kept, mean)


def signed_scores(tells: Column) -> Column:
    """Of an array of ``struct(type, score, ..)``: its signed scores, those without one left out."""
    return F.filter(F.transform(tells, lambda t: signed(t["type"], t["score"])), lambda x: x.isNotNull())


def aligned_strength(tells: Column, label: Column, beta: float) -> Column:
    """Softmax mean of the strengths of the tells that name the label's class."""
    right = F.filter(tells, lambda t: ((label == 1) & (t["type"] == "AI")) | ((label == 0) & (t["type"] == "human")))
    return softmax_mean_of(F.transform(right, lambda t: clamp(t["score"])), beta)


def verdict_score(tells: Column, label: Column, beta: float, scale: float, tau: float) -> Column:
    """0.5 moved towards the label by the squashed evidence, as far as tells of the label's own class are strong; 0.5 without scores."""

    def score(s: Column) -> Column:
        squashed = F.tanh(softmax_mean_of(s, beta) / tau)
        moved = scale * F.when(label == 0, -squashed).otherwise(squashed)
        return F.when(F.size(s) == 0, 0.5).otherwise(clamp(0.5 + moved * aligned_strength(tells, label, beta)))

    return let(signed_scores(tells), score)


def tell_probability(tells: Column, beta: float = 3.0, alpha: float = 4.0, center: float = 0.0) -> Column:
    """P(AI) from an array of ``struct(polarity, score, ..)``: logistic of the softmax-weighted signed strengths; 0.5 without tells."""
    top = F.aggregate(tells, F.lit(0.0), lambda a, t: a + F.exp(beta * t["score"]) * t["polarity"] * t["score"])
    mean = top / F.aggregate(tells, F.lit(0.0), lambda a, t: a + F.exp(beta * t["score"]))
    return F.when(F.size(tells) == 0, 0.5).otherwise(sigmoid(alpha * (mean - center)))


def tells_in_budget(tells: Column, length: Column, share: float) -> Column:
    """The tells with the highest scores whose spans fit into ``share`` of the text's characters, taken greedily; the shortest one if none fits.

    ``tells``: array of ``struct(ord, start, end, score, ..)``; equal scores go by ``ord``.
    """
    room = F.greatest(F.lit(1), F.floor(length * F.lit(share)).cast("int"))
    size = lambda t: t["end"] - t["start"]
    order = F.array_sort(tells, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["ord"] - b["ord"]))

    def pick(o: Column) -> Column:
        start = F.struct(F.lit(0).alias("used"), F.slice(o, 1, 0).alias("got"))

        def add(acc: Column, t: Column) -> Column:
            fits = (size(t) > 0) & (acc["used"] + size(t) <= room)
            return F.struct(F.when(fits, acc["used"] + size(t)).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["got"], F.array(t))).otherwise(acc["got"]).alias("got"))

        got = F.aggregate(o, start, add, lambda a: a["got"])
        shortest = F.slice(F.array_sort(o, lambda a, b: F.when(F.greatest(F.lit(1), size(a)) != F.greatest(F.lit(1), size(b)), F.greatest(F.lit(1), size(a)) - F.greatest(F.lit(1), size(b))).otherwise(a["ord"] - b["ord"])), 1, 1)
        return F.when(F.size(got) > 0, got).otherwise(shortest)

    return let(order, pick)


def explanation_overlap(explanation: Column, span: Column) -> Column:
    """Jaccard similarity of the content words of an explanation and of the span it explains; 0 if either has none."""
    return let(F.array(content_tokens(explanation), content_tokens(span)), lambda p: F.when((F.size(p[0]) == 0) | (F.size(p[1]) == 0), 0.0).otherwise(jaccard(p[0], p[1])))


def has_generic_phrase(explanation: Column) -> Column:
    form = normalized_explanation(explanation)
    out = F.lit(False)
    for phrase in GENERIC_PHRASES:
        out = out | F.contains(form, F.lit(phrase))
    return out
