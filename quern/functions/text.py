"""Column functions on text: cleaning, hashing, tokens, wire escapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of languages and the codes they stand for.
LANGUAGE_ALIASES = {"en": "en", "en-en": "en", "en-us": "en", "english": "en", "es": "es", "es-es": "es", "spanish": "es", "de": "de", "german": "de", "cs": "cs", "czech": "cs"}
#: Words that carry no content in explanations.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "it", "this", "that", "is", "are", "was", "were", "of", "to", "in", "for", "with", "as", "on", "by", "because", "suggests", "indicates", "text", "span",
    "phrase", "writing", "authorship", "human", "ai", "generated", "common", "typical",
)
WHITE = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.  Used in a lambda, an expression would else be computed again for every element."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """White space at both ends dropped, also no-break and other Unicode blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks and stripped, also no-break and other Unicode blanks."""
    return F.trim(F.regexp_replace(c, WHITE, " "))


def clean_document_text(c: Column) -> Column:
    """Null to empty, tags to blanks, white space collapsed; entities stay."""
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>\s][^>]*>", " "))


def normalize_for_hash(c: Column) -> Column:
    """Lower case, stripped, white space collapsed: the form in which texts count as the same."""
    return squeeze(F.lower(c))


def normalize_language(c: Column) -> Column:
    """Trimmed, lower-cased, ``_`` as ``-``; aliases, else a two-letter prefix, else the value; empty is null."""
    key = F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))
    alias = F.create_map(*[F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv])
    prefix = F.regexp_extract(key, r"^([a-z]{2})(-|$)", 1)
    return F.when(key == "", None).otherwise(F.coalesce(F.try_element_at(alias, key), F.when(prefix != "", prefix), key))


def key_of(*parts: Column | str, sep: str = "|") -> Column:
    """Parts joined by ``sep``, nulls as empty (``concat_ws`` would drop them)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def stable_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def hash_bucket(c: Column, buckets: int) -> Column:
    """First 32 bits of the SHA-256 of ``c`` modulo ``buckets``."""
    return F.pmod(F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def hash_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) fixed by the parts."""
    return F.conv(F.substring(F.sha2(key_of(*parts), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))


def white_words(c: Column) -> Column:
    """Words between white space, as an array; empty for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WHITE), lambda w: w != "")


def normalized_explanation(c: Column) -> Column:
    """Lower case, stripped, white space collapsed, then all but letters, digits, blanks and hyphens dropped."""
    return F.regexp_replace(squeeze(F.lower(c)), r"[^a-z0-9\s-]", "")


def word_ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, in order; none for shorter lists."""
    none = F.array().cast("array<string>")
    return let(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(none))


def ngrams_upto(tokens: Column, longest: int) -> Column:
    return let(tokens, lambda t: F.flatten(F.array(*[word_ngrams(t, n) for n in range(1, longest + 1)])))


def char_ngrams(c: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return let(c, lambda t: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n)))).otherwise(none))


def distinct_ratio(tokens: Column, n: int) -> Column:
    """Share of distinct n-grams; 1 where there is none."""
    return let(word_ngrams(tokens, n), lambda g: F.when(F.size(g) > 0, F.size(F.array_distinct(g)) / F.size(g)).otherwise(F.lit(1.0)))


def content_tokens(c: Column) -> Column:
    """Distinct words of more than two letters that carry content."""
    return F.array_distinct(F.filter(ascii_tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 1 for two empty ones."""
    return let(F.size(F.array_union(a, b)), lambda either: F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(1.0)))


def escape_document(c: Column) -> Column:
    """Control characters that XML forbids dropped; & < > " ' as entities."""
    out = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def unescape_document(c: Column) -> Column:
    out = c
    for entity, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(raw))
    return out


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


#: Phrases of a reported score that say there is none.
NO_SCORE = (
    "not reported", "not applicable", "n/a", "significant drop", "varies by", "considerable unreliability", "evaluated as", "evaluated across", "near-zero error", "trade-off possible",
    "reduced in real-world", "average improvement", "low reliability",
)


def reported_score(c: Column) -> Column:
    """A score from free text: the first number, or the last where the text says "from .. to ..", as a share (over 1 and up to 100: a percentage).

    Null for an empty text, one without a number and one that says there is no score.
    """
    low = F.lower(F.trim(c))
    none = low == ""
    for phrase in NO_SCORE:
        none = none | F.contains(low, F.lit(phrase))
    numbers = F.regexp_extract_all(low, F.lit(r"(\d+\.\d+|\d+)"), F.lit(1))
    span = F.contains(low, F.lit(" from ")) & F.contains(low, F.lit(" to "))
    n = F.when(~none & (F.size(numbers) > 0), F.when(span, F.element_at(numbers, -1)).otherwise(F.try_element_at(numbers, F.lit(1)))).try_cast("double")
    return F.when((n > 1) & (n <= 100), n / 100).otherwise(n)
