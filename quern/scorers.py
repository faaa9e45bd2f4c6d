"""Scorers of texts as plug-ins: run over Arrow batches, with the error of a row kept to that row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import let

Scorer = Callable[[list[str]], list[float]]
REGISTRY: dict[str, Callable[..., Scorer]] = {}
OUT = "id string, detector string, score_ai double, error string, runtime_s double"


def scorer(name: str) -> Callable[[Callable[..., Scorer]], Callable[..., Scorer]]:
    """Register a factory of scorers under a name."""

    def register(factory: Callable[..., Scorer]) -> Callable[..., Scorer]:
        REGISTRY[name] = factory
        return factory

    return register


def make_scorer(name: str, **options) -> Scorer:
    if name not in REGISTRY:
        raise KeyError(f"no scorer {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**options)


@scorer("length")
def length_scorer(scale: float = 1000.0) -> Scorer:
    return lambda texts: [len(t) / (len(t) + scale) for t in texts]


@scorer("repetition")
def repetition_scorer() -> Scorer:
    def score(texts: list[str]) -> list[float]:
        out = []
        for t in texts:
            words = t.lower().split()
            if not words:
                raise ValueError("no words")
            out.append(1 - len(set(words)) / len(words))
        return out

    return score


def run_scorer(examples: DataFrame, name: str, id_col: str = "id", text_col: str = "text", batch: int = 64, **options) -> DataFrame:
    """``id, detector, score_ai, error, runtime_s`` for each row.

    Texts go to the scorer in batches; a batch that fails is scored text by text, so that only bad rows carry an error.
    If the scorer can't be made, every row carries that error.  A null text is an error of its row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            score, broken = make_scorer(name, **options), None
        except Exception as e:
            score, broken = None, f"{type(e).__name__}: {e}"
        for f in frames:
            values, errors, took = [], [], []
            for at in range(0, len(f), batch):
                texts = list(f["text"].iloc[at : at + batch])
                began = time.perf_counter()
                got, bad = [None] * len(texts), [broken] * len(texts)
                if score:
                    try:
                        got = [float(x) for x in score(texts)]
                    except Exception:
                        for i, t in enumerate(texts):
                            try:
                                got[i] = float(score([t])[0])
                            except Exception as e:
                                got[i], bad[i] = None, f"{type(e).__name__}: {e}"
                values += got
                errors += bad
                took += [(time.perf_counter() - began) / max(len(texts), 1)] * len(texts)
            yield pd.DataFrame({"id": f["id"], "detector": name, "score_ai": pd.Series(values, dtype="float64", index=f.index), "error": pd.Series(errors, dtype=object, index=f.index), "runtime_s": took})

    return examples.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, OUT)


def score_distinct(rows: DataFrame, text_col: str, name: str, **options) -> DataFrame:
    """``rows`` with ``score_ai``, each distinct text scored once."""
    keyed = rows.withColumn("_k", F.sha2(F.coalesce(text_col, F.lit("")), 256))
    once = keyed.groupBy("_k").agg(F.first(text_col).alias("_t"))
    scored = run_scorer(once, name, "_k", "_t", **options).select(F.col("id").alias("_k"), "score_ai")
    return keyed.join(scored, "_k").drop("_k")


def word_chunks(words: Column, size: int, stride: int) -> Column:
    """Overlapping slices of a list of words; the last one is the first that reaches the end."""
    def cut(w: Column) -> Column:
        last = F.ceil((F.size(w) - size) / stride).cast("int") * stride + 1
        starts = F.when(F.size(w) <= size, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), last, F.lit(stride)))
        return F.transform(starts, lambda s: F.slice(w, s, size))

    return let(words, cut)


def fit_feature_model(rows: DataFrame, features: list[str], label: str):
    """Standardized logistic regression over numeric features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, maxIter=50)]
    return Pipeline(stages=stages).fit(rows.where(F.col(label).isNotNull()))


def apply_feature_model(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("score_ai", vector_to_array("probability")[1]).drop("_raw", "features", "rawPrediction", "probability", "prediction")


@scorer("keywords")
def keyword_scorer() -> Scorer:
    """The offline scorer of ``functions.evidence`` for a list of texts."""
    from quern.functions.evidence import AI_TERMS, HIT_WEIGHT, HUMAN_TERMS, LOGISTIC_BASE

    def one(text: str) -> float:
        low = text.lower()
        balance = sum(map(low.count, AI_TERMS)) - sum(map(low.count, HUMAN_TERMS))
        return 1.0 / (1.0 + LOGISTIC_BASE ** (-HIT_WEIGHT * balance))

    return lambda texts: [one(t) for t in texts]


def softmax_of(logits: Column) -> Column:
    """Softmax of an array, without overflow."""
    e = let(F.array_max(logits), lambda m: F.transform(logits, lambda x: F.exp(x - m)))
    return let(e, lambda v: let(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(v, lambda x: x / s)))


def bucket_expectation(weights: Column) -> tuple[Column, Column]:
    """Expected bucket (from 0) over the number of buckets less one, and the likeliest bucket, of an array of unnormalized probabilities."""
    top = F.aggregate(F.transform(weights, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    mass = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return top / mass / F.greatest(F.size(weights) - 1, F.lit(1)), F.array_position(weights, F.array_max(weights)) - 1


def masked_starts(words: Column, seed: Column, share: float, span: int) -> Column:
    """Sorted starts (from 1) of the spans that are masked: as many as ``share`` of the words asks for, drawn by hashes without replacement; none for very short texts."""
    n = F.size(words)
    wanted = F.least(F.greatest(F.lit(1), F.bround(n * share / span)), n - span).cast("int")
    order = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(n - span, F.lit(1))), lambda i: F.struct(F.xxhash64(seed, i).alias("h"), i.alias("i"))))
    drawn = F.transform(F.slice(order, F.lit(1), F.greatest(wanted, F.lit(1))), lambda x: x["i"])
    return F.when(n < max(4, span + 2), F.array().cast("array<int>")).otherwise(F.array_sort(drawn))


def filled(words: Column, starts: Column, span: int) -> Column:
    """The text with its masked spans filled by the words that stood there, in one pass over the places: what a filler that knows the text gives."""
    places = F.sequence(F.lit(1), F.size(words))
    masked = lambda i: F.exists(starts, lambda s: (i >= s) & (i < s + span))
    kept = F.transform(places, lambda i: F.when(masked(i), F.lit(None).cast("string")).otherwise(F.element_at(words, i)))
    fills = F.transform(places, lambda i: F.when(masked(i), F.element_at(words, i)))
    return F.array_join(F.zip_with(kept, fills, lambda a, b: F.coalesce(a, b)), " ")
