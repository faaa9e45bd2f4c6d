"""Column functions for mining explanations: normal forms, words with stop lists, sets of character n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import char_ngrams, let, squeeze, strip

#: Words that say nothing in an explanation.
EXPLANATION_STOP_WORDS = (
    "a", "again", "also", "an", "and", "are", "as", "at", "be", "because", "but", "by", "for", "feel", "feels", "from", "has", "have", "i", "in", "is", "it", "like", "more", "not", "of", "often",
    "on", "or", "same", "so", "sound", "sounds", "that", "the", "think", "this", "to", "while", "with", "would", "writer",
)
LABEL_STOP_WORDS = (*EXPLANATION_STOP_WORDS, "ai", "human")
_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def unpunctuated(c: Column) -> Column:
    """Lower case, 'ai-written' and 'ai-like' as two words, ASCII punctuation as blanks, white space collapsed."""
    low = F.replace(F.replace(F.lower(c), F.lit("ai-written"), F.lit("ai written")), F.lit("ai-like"), F.lit("ai like"))
    return squeeze(F.regexp_replace(low, _PUNCTUATION, " "))


def fragment(c: Column) -> Column:
    """Entities resolved, lower case, ASCII punctuation as blanks, white space collapsed."""
    from quern.functions.text import unescape_document

    return squeeze(F.regexp_replace(F.lower(strip(unescape_document(c))), _PUNCTUATION, " "))


def punctuated_words(c: Column, stop: bool = False) -> Column:
    """Words of an explanation; with ``stop``, without stop words and single characters."""
    words = F.regexp_extract_all(unpunctuated(c), F.lit(r"[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*EXPLANATION_STOP_WORDS)) if stop else words


def label_words(c: Column) -> Column:
    """Words that can label a group of explanations: neither stop words nor the names of the classes."""
    return F.filter(punctuated_words(c), lambda w: (F.length(w) > 1) & ~w.isin(*LABEL_STOP_WORDS))


def phrase_in(words: Column, phrase: Column) -> Column:
    """Whether a phrase occurs as whole words."""
    blank = F.lit(" ")
    return F.contains(F.concat(blank, F.array_join(words, " "), blank), F.concat(blank, phrase, blank))


def char_gram_set(c: Column, shortest: int, longest: int) -> Column:
    """Distinct character n-grams of ``shortest`` to ``longest`` characters."""
    return let(c, lambda t: F.array_distinct(F.flatten(F.array(*[char_ngrams(t, n) for n in range(shortest, longest + 1)]))))
