"""Classes, segments and masks of the tokens of an annotated completion; forward fills in numpy over Arrow batches, as a token's role depends on those before it."""

from __future__ import annotations

import numpy as np
import pandas as pd

from quern.markup import _vectorized

#: Structural tokens.
TEXT_OPEN, VERDICT_OPEN, TEXT_CLOSE, SPAN_OPEN, ANN_OPEN, WHY, SCORE, CLOSE = range(8)
#: Classes of tokens.
REASONING, STRUCTURAL, OPENER, VERDICT_TYPE, VERDICT_WHY, ANN_TYPE, ANN_WHY, COPY, ANN_SCORE, VERDICT_SCORE = range(10)


def _last(where: np.ndarray) -> np.ndarray:
    """Index of the last true element up to each place, -1 before the first."""
    return np.maximum.accumulate(np.where(where, np.arange(len(where)), -1)) if len(where) else np.zeros(0, int)


def _attributes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the open attribute block began (-1 outside), and whether it is the verdict's."""
    at = _last(np.isin(t, (ANN_OPEN, VERDICT_OPEN, CLOSE, TEXT_CLOSE)))
    by = np.where(at >= 0, t[at], CLOSE) if len(t) else t
    inside = np.isin(by, (ANN_OPEN, VERDICT_OPEN))
    return np.where(inside, at, -1), by == VERDICT_OPEN


def classes(tokens, reasoning: int) -> np.ndarray:
    t = np.asarray(tokens, dtype=int)
    head, t = min(max(reasoning, 0), len(t)), t[max(reasoning, 0) :]
    opened, verdict = _attributes(t)
    why, score, either = _last(t == WHY), _last(t == SCORE), _last(np.isin(t, (WHY, SCORE)))
    asked = either > opened
    in_verdict = np.where(asked, np.where(t[either] == SCORE, VERDICT_SCORE, VERDICT_WHY), VERDICT_TYPE) if len(t) else t
    in_tell = np.where(score > opened, ANN_SCORE, np.where(why > opened, ANN_WHY, ANN_TYPE))
    out = np.where(t == SPAN_OPEN, OPENER, np.where(t <= CLOSE, STRUCTURAL, np.where(opened < 0, COPY, np.where(verdict, in_verdict, in_tell))))
    return np.r_[np.full(head, REASONING), out].astype(int)


def segments(tokens, reasoning: int) -> np.ndarray:
    """Per response token: 0 text, 1 verdict (from its opening on), 2 + k the k-th span."""
    t = np.asarray(tokens, dtype=int)[max(reasoning, 0) :]
    spans = np.cumsum(t == SPAN_OPEN)
    return np.where(_last(t == VERDICT_OPEN) >= 0, 1, np.where(spans > 0, 1 + spans, 0))


def mask(tokens, reasoning: int) -> np.ndarray:
    """Per response token: 1 for structure and attributes, 0 for text (and for attribute marks outside attributes)."""
    t = np.asarray(tokens, dtype=int)[max(reasoning, 0) :]
    opened, _ = _attributes(t)
    return ((opened >= 0) | np.isin(t, (CLOSE, TEXT_CLOSE, SPAN_OPEN, TEXT_OPEN))).astype(int)


def _each(f):
    def run(tokens: pd.Series, reasoning: pd.Series) -> pd.Series:
        return pd.Series([f(t, int(r)) for t, r in zip(tokens, reasoning, strict=True)], dtype=object)

    return run


def _spans(tokens: pd.Series) -> pd.Series:
    out = []
    for t in tokens:
        n = np.array([len(x) for x in t], dtype=int)
        start = np.r_[0, np.cumsum(n + 1)[:-1]] if len(n) else n
        out.append([{"start": int(a), "end": int(a + b)} for a, b in zip(start, n, strict=True)])
    return pd.Series(out, dtype=object)


classes_udf = _vectorized(_each(classes), "array<int>")
segments_udf = _vectorized(_each(segments), "array<int>")
mask_udf = _vectorized(_each(mask), "array<int>")
token_spans_udf = _vectorized(_spans, "array<struct<start:int,end:int>>")
