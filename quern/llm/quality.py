"""Statistics of a text that tell prose from lists, tables and junk, and trees trained on them.

Labelling rules of high precision mark clear prose, lists, tables and junk in a bounded sample; gradient-boosted trees learn
the classes from the statistics alone, and a temperature is set on a holdout that was written and checked by hand.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import hash_sample, process_cache

from quern.llm.trees import BoostedTrees

KINDS = ("prose", "list", "table", "junk")
#: Texts the trees are fitted on, at most: the first in the order of a hash of their id.
TRAINING_ROWS = 4000
LEAST_LENGTH = 40
MEMO_WORDS = 500_000

#: Frequent function words of the four languages.
COMMON = frozenset(
    """
    the a an of and to in that is was were be been for with on at by from as it this these those his her their its our my your no not one every some any
    which who whom what when where while if but or so because than then there here he she they we you i has had have do did does may might can could will would should near
    der die das den dem des ein eine einer und oder aber nicht ist sind war waren wurden wird in im zu zum zur von vom mit auf für bis seit am an ohne nach wegen laut als sich so wie dass denn obwohl während haben hat uns vor bei
    el la los las un una unos unas y o pero no en de del a al por para con sin que se es son fue fueron han ha su sus lo más muy como cuando donde porque aunque mientras desde hasta según cerca todo esto tras entre contra ya rara tan final muchos
    a i v ve na se si je jsou byl byla byly bylo být z ze s k ke o po do od pro při že jako ale nebo ani či protože ačkoli zatímco tak jak už bez podle nás mnohé kvůli obci tomu nedaleko než později hlavním všem
    """.split()
)
_TAG = re.compile(r"<[^<>]*>")
_TOKEN = re.compile(r"[^\s,;|│]+")
_MIXED = re.compile(r"[^\W\d_]+\d\w*|\d+[^\W\d_]\w*")
_MARK = re.compile(r"^[ \t]*(?:[-*•–—+·▪◦]|\[[ xX]?\]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|(?:[Nn]o|[Nn]r)\. ?\d{1,3}[:.)])[ \t]+", re.M)
_CELL = re.compile(r"\t|\||│|;|,|</t[dh]>|\s{2,}")
_SENTENCE = re.compile(r"[.!?…]+[\"”')\]]*(?=\s|$)")
_VOWEL = re.compile(r"[aeiouyáéíóúäöüàèìòùâêîôûåæøýěů]")
_SEPARATORS = (", ", "; ", " / ", " | ", " • ", " - ", " · ")
_MOJIBAKE = re.compile(r"[ÂÃ€™¤¿½³©»Ÿ�ï]")

FEATURES = (
    "log_chars", "words", "mean_word", "sd_word", "symbol_ratio", "digit_ratio", "upper_ratio", "space_ratio", "vowelless", "longest_word", "mixed_words",
    "common_ratio", "distinct_ratio", "top_word", "lines", "mean_line_words", "sd_line_words", "line_end_punct", "marked_lines", "short_lines",
    "sentence_ends", "words_per_sentence", "number_words", "cells_per_line", "cell_regularity", "cell_lines", "tag_ratio", "replacement",
    "item_words", "items_per_100", "item_short", "blank_cells", "lower_start", "word_like", "title_lines", "wide_gaps", "single_characters",
)


def _classes() -> np.ndarray:
    """Class of each character up to U+FFFF: 0 other, 1 lower-case or caseless letter, 2 upper-case letter, 3 digit, 4 white space."""
    cache = process_cache()
    if "character classes" not in cache:
        kinds = [3 if c.isdigit() else 4 if c.isspace() else (2 if c.isupper() else 1) if c.isalpha() else 0 for c in map(chr, range(0x10000))]
        cache["character classes"] = np.array(kinds, dtype=np.uint8)
    return cache["character classes"]


class Words(dict):
    """token -> its row in ``facts`` and ``form``, worked out once per process."""

    FACTS = 10  # token, length, its square, long word, long word with a vowel, word-like, single letter, common, mixed, number

    def __init__(self):
        super().__init__()
        self.facts, self.form, self.longest = np.zeros((4096, self.FACTS)), np.zeros(4096, dtype=np.int64), np.zeros(4096, dtype=np.int64)
        self.forms: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        k = len(self)
        if k == len(self.form):
            self.facts, self.form, self.longest = np.vstack([self.facts, np.zeros_like(self.facts)]), np.r_[self.form, np.zeros_like(self.form)], np.r_[self.longest, np.zeros_like(self.longest)]
        form = token.lower().strip(".:!?…\"“”'()[]{}»«")
        n, size, alpha = len(token), len(form), form.isalpha()
        voiced = alpha and _VOWEL.search(form) is not None
        self.facts[k] = (
            1, n, n * n, alpha and size > 2, voiced and size > 2, voiced and 2 <= size <= 14, alpha and size == 1, alpha and form in COMMON,
            not alpha and _MIXED.search(form) is not None, not alpha and form.replace(".", "").isdigit(),
        )
        self.form[k], self.longest[k] = self.forms.setdefault(form, len(self.forms)), n
        self[token] = k
        return k


def _spread(values: list[int]) -> tuple[float, float]:
    """Mean and standard deviation."""
    mean = sum(values) / len(values)
    return mean, max(sum(v * v for v in values) / len(values) - mean * mean, 0.0) ** 0.5


def statistics(text: str) -> list[float]:
    """The values of FEATURES for a whole text; all are finite, also for an empty one."""
    cache = process_cache()
    memo = cache.get("quality words")
    if memo is None or len(memo) > MEMO_WORDS:
        memo = cache["quality words"] = Words()
    raw = text.strip()
    tagged = "<" in raw
    rows = tagged and "</t" in raw.lower()
    body = re.sub(r"</t[dh]>\s*<t[dh][^<>]*>", " | ", raw, flags=re.I) if rows else raw
    body = re.sub(r"</(?:tr|li|p|div)>|<br\s*/?>", "\n", body, flags=re.I) if tagged else body
    plain = _TAG.sub(" ", body) if tagged else body
    chars = max(len(plain), 1)
    bare = _MARK.sub("", plain)  # what follows the marks of list items
    at = [memo[t] for t in _TOKEN.findall(bare)]
    total, length_sum, square_sum, long_words, voiced_long, word_like, singles, common, mixed, numbers = memo.facts[at].sum(axis=0).tolist() if at else [0.0] * Words.FACTS
    longest = int(memo.longest[at].max()) if at else 0
    repeats = Counter(memo.form[at].tolist()) if at else {}
    n = max(total, 1)
    mean_word = length_sum / n
    lines = [x for x in plain.split("\n") if x.strip()] or [""]
    per_line = [len(x.split()) for x in lines]
    line_mean, line_sd = _spread(per_line)
    codes = np.frombuffer(plain.encode("utf-32-le", "replace"), dtype=np.uint32)
    kinds = np.bincount(_classes()[np.minimum(codes, 0xFFFF)], minlength=5)
    letters, upper, digits, spaces = int(kinds[1] + kinds[2]), int(kinds[2]), int(kinds[3]), int(kinds[4])
    ends = len(_SENTENCE.findall(plain))
    marked = sum(1 for x in lines if _MARK.match(x))
    cells = [_CELL.split(x.strip().strip("|")) for x in lines]
    widths = Counter(map(len, cells))
    wide = {k: v for k, v in widths.items() if k > 1}
    same = max(wide.values(), default=0)
    all_cells = sum(k * v for k, v in widths.items())
    # A text in one or two lines may be a list divided by separators.
    items: list[str] = []
    item_sizes = [0]
    if len(lines) <= 3:
        best = max(_SEPARATORS, key=plain.count)
        if plain.count(best) >= 4:
            items = [x.strip() for x in max(lines, key=len).split(best)]
            item_sizes = [len(x.split()) for x in items]
    else:
        items, item_sizes = lines, per_line
    blank = sum(not c.strip() for row in cells if len(row) > 1 for c in row)
    return [
        np.log1p(len(raw)), float(np.log1p(total)), mean_word, max(square_sum / n - mean_word * mean_word, 0.0) ** 0.5, 1 - (letters + digits + spaces) / chars, digits / chars, upper / max(letters, 1), spaces / chars,
        (long_words - voiced_long) / n, float(np.log1p(longest)),
        mixed / n,
        common / n, len(repeats) / n, max(repeats.values(), default=0) / n,
        float(np.log1p(len(lines))), min(line_mean, 60.0), min(line_sd, 60.0), sum(1 for x in lines if x.rstrip().rstrip("\"”'*_)").endswith((".", "!", "?", "…", ":"))) / len(lines),
        marked / len(lines), sum(1 for x in per_line if x <= 6) / len(lines),
        ends / n, min(n / max(ends, 1), 200.0), numbers / n,
        min(all_cells / len(lines), 20.0), same / len(lines), sum(wide.values()) / len(lines), 1 - len(plain.replace(" ", "")) / max(len(raw.replace(" ", "")), 1), len(_MOJIBAKE.findall(plain)) / chars,
        min(sum(item_sizes) / len(item_sizes), 60.0), min(len(items) * 100 / n, 100.0), sum(1 for x in item_sizes if x <= 4) / len(item_sizes), blank / max(all_cells, 1),
        sum(1 for x in lines if x.lstrip()[:1].islower()) / len(lines),
        word_like / n, sum(1 for x in lines if x.istitle()) / len(lines), len(re.findall(r"\S {3,}\S", plain)) / len(lines), singles / n,
    ]


_AT = {name: i for i, name in enumerate(FEATURES)}


def weak_label(s: list[float]) -> int | None:
    """Class of a text whose statistics leave no doubt, else None."""
    g = lambda name: s[_AT[name]]
    many = np.expm1(g("lines")) >= 3
    if g("vowelless") > 0.4 or g("symbol_ratio") > 0.5 or g("replacement") > 0.2 or g("mixed_words") > 0.35 or g("mean_word") > 30 or (g("single_characters") > 0.25 and g("marked_lines") < 0.5 and g("cell_regularity") < 0.75):
        return 3
    if g("top_word") > 0.2 and g("distinct_ratio") < 0.25 and g("common_ratio") < 0.1:
        return 3
    if g("common_ratio") < 0.02 and not many and g("sentence_ends") < 0.01 and g("items_per_100") < 5 and g("word_like") > 0.7:
        return 3
    if many and g("marked_lines") > 0.9:
        return 1
    if many and g("common_ratio") < 0.08:
        if g("cell_regularity") > 0.75 and g("cells_per_line") >= 2 and g("marked_lines") < 0.2:
            return 2
        if g("cells_per_line") < 1.5 and g("item_words") < 6:
            return 1
    if not many and g("items_per_100") > 18 and g("item_words") < 5.5 and g("common_ratio") < 0.06 and g("sentence_ends") < 0.03:
        return 1
    if g("common_ratio") > 0.25 and g("item_words") > 6 and g("marked_lines") < 0.3 and g("symbol_ratio") < 0.15:
        return 0
    if g("common_ratio") > 0.12 and g("sentence_ends") > 0.04 and g("words_per_sentence") < 40 and g("marked_lines") < 0.2 and g("mean_line_words") > 6:
        return 0
    return None


def _sample(examples: DataFrame, id_col: str, text_col: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and weak labels of at most ``rows`` texts, fixed by a hash of id and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(s, weak_label(s)) for s in map(statistics, b["text"])]
            yield pd.DataFrame([(k, s) for s, k in got if k is not None], columns=["k", "s"])

    texts = examples.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length(F.trim("text")) >= LEAST_LENGTH)
    picked = hash_sample(texts, F.xxhash64("id", "text"), rows).select("text")
    got = picked.mapInPandas(run, "k int, s array<double>").collect()  # at most `rows` rows
    return np.array([r["s"] for r in got], float).reshape(len(got), len(FEATURES)), np.array([r["k"] for r in got], int)


def fit_kinds(examples: DataFrame, id_col: str = "id", text_col: str = "text", rows: int = TRAINING_ROWS) -> BoostedTrees:
    """Trees over FEATURES, fitted on weak labels and the hand-written SEEDS, with a temperature calibrated on HOLDOUT, of which nothing trains."""
    from quern.llm.holdout import HOLDOUT, SEEDS

    x, y = _sample(examples, id_col, text_col, rows)
    order = np.lexsort((np.arange(len(y)), [xxhash.xxh32_intdigest(v.tobytes()) for v in x])) if len(y) else np.zeros(0, int)
    x, y = x[order], y[order]
    train, held = ([(statistics(t), KINDS.index(k)) for k, t in texts] for texts in (SEEDS, HOLDOUT))
    x = np.vstack([x, np.repeat(np.array([s for s, _ in train]), 3, axis=0)])
    y = np.concatenate([y, np.repeat([k for _, k in train], 3)])
    trees = BoostedTrees(len(KINDS)).fit(x, y)
    return trees.calibrate(np.array([s for s, _ in held]), np.array([k for _, k in held]))


def text_statistics(examples: DataFrame, id_col: str = "id", text_col: str = "text", rows: int = TRAINING_ROWS) -> DataFrame:
    """``id``, the statistics of FEATURES, ``kind`` and the four probabilities, one row per input row.

    Null and blank texts and texts under 40 characters (trimmed) have null statistics and a null kind.  Texts are taken whole.
    Repeated rows stay; other columns don't matter; an empty table gives no rows.
    """
    model = fit_kinds(examples, id_col, text_col, rows)  # some 100 kB
    columns = [*FEATURES, *(f"p_{k}" for k in KINDS)]
    rows_ = examples.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [i for i, t in enumerate(b["text"]) if t is not None and len(t.strip()) >= LEAST_LENGTH]
            x = np.array([statistics(b["text"].iloc[i]) for i in at]).reshape(len(at), len(FEATURES))
            p = model.probabilities(x)
            out = pd.DataFrame(np.nan, index=b.index, columns=columns)
            kind = np.full(len(b), None, dtype=object)
            if at:
                out.iloc[at] = np.hstack([x, p])
                kind[at] = [KINDS[k] for k in p.argmax(axis=1)]
            yield pd.concat([b[["id"]], pd.DataFrame({"kind": kind}, index=b.index), out], axis=1)

    schema = "id string, kind string, " + ", ".join(f"{c} double" for c in columns)
    scored = rows_.mapInPandas(run, schema)
    return scored.select("id", "kind", *[F.when(F.col("kind").isNotNull(), F.col(c)).alias(c) for c in columns])
