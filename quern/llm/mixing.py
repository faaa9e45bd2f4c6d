"""A mixture of documents whose sources reach target shares of its tokens, by soft membership.

A naive Bayes table of hashed word counts, fitted on a bounded sample of documents of known source, gives every
document a posterior over the sources; a recorded source is evidence beside the text.  Projected gradient least squares then
finds a rate per document, between 0 and the uses allowed, such that expected tokens per source match the targets.
The rate depends on the posterior alone, so documents of equal posterior (in steps of 1 / GRID) take part as one row of sums.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import canonical, checkpoint, hash_sample, process_cache, words_of
from quern.llm.tokens import TOKENIZERS, VOCABULARY, counter

#: Labelled documents the classifier is fitted on, at most (in the order of a hash of their id).
LABELLED_SAMPLE = 4000
FEATURES = 1 << 12
#: Probability that a recorded source is the true one, before the text is read.
EVIDENCE = 0.999
#: Posteriors are kept in steps of 1 / GRID.
GRID = 256
#: Steps after which rates that still move are an error, and the share of the mixture by which they may.
STEPS, SETTLED = 1000, 1e-6
#: A source counts as reached if it comes this close to its share.
TOLERANCE = 1e-5
OTHER = "(other)"
MEMO_WORDS = 1_000_000


class Slots(dict):
    def __missing__(self, word: str) -> int:
        n = xxhash.xxh32_intdigest(word) & (FEATURES - 1)
        if len(word) <= 40:
            self[word] = n
        return n


def sparse_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words of the whole text, and their counts damped by the logarithm."""
    memo = process_cache().setdefault("mixing slots", Slots())
    if len(memo) > MEMO_WORDS:
        memo.clear()
    words = words_of(text)
    slots, counts = np.unique(np.fromiter(map(memo.__getitem__, words), dtype=np.int32, count=len(words)), return_counts=True)
    return slots, np.log1p(counts).astype(np.float32)


def word_counts(text: str) -> np.ndarray:
    """The same as a dense vector."""
    out = np.zeros(FEATURES, np.float32)
    slots, counts = sparse_counts(text)
    out[slots] = counts
    return out


def fit_naive_bayes(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-likelihood table, log-priors and the temperature that fits held-out rows best."""
    fit = np.arange(len(y)) % 4 != 3

    def tables(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = np.eye(classes, dtype=np.float32)[y[rows]]
        sums = one.T @ x[rows] + 0.1
        return np.log(sums / sums.sum(axis=1, keepdims=True)), np.log((one.sum(axis=0) + 1) / (len(rows) + classes))

    if not len(y):
        return np.zeros((classes, FEATURES), np.float32), np.full(classes, -np.log(classes)), 1.0
    table, prior = tables(np.flatnonzero(fit) if fit.any() else np.arange(len(y)))
    held, best = np.flatnonzero(~fit), (np.inf, 1.0)
    for t in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0) if len(held) else ():
        p = posterior(x[held], table, prior, t)
        best = min(best, (-np.log(np.maximum(p[np.arange(len(held)), y[held]], 1e-12)).mean(), t))
    table, prior = tables(np.arange(len(y)))
    return table, prior, best[1]


def posterior(x: np.ndarray, table: np.ndarray, prior: np.ndarray, temperature: float) -> np.ndarray:
    z = (x @ table.T) / temperature + prior
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def on_grid(p: np.ndarray) -> np.ndarray:
    """Rows of probabilities in steps of 1 / GRID, as integers that sum to GRID; the likeliest source takes what rounding leaves."""
    q = np.round(p * GRID).astype(np.int32)
    q[np.arange(len(q)), p.argmax(axis=1)] += GRID - q.sum(axis=1)
    return q.astype(np.uint16)


def descend(residuals: list[np.ndarray], scale: np.ndarray, members: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Rates after one projected step per residual, from 0; ``members``: documents x sources."""
    rate = np.zeros(len(members))
    for r in residuals:
        rate = np.clip(rate - members @ (r / scale), 0.0, most)
    return rate


def mix_sources(
    docs: DataFrame, targets: DataFrame, size_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    tokenizers: str = TOKENIZERS, sample: int = LABELLED_SAMPLE,
) -> tuple[DataFrame, DataFrame]:
    """The mixture (``doc_id, source, n_tokens, rate, uses``) and its report by source.

    The report has a row per target: ``source, target_share, max_uses, available_tokens, reachable_share, expected_share,
    actual_share, feasible``.  Shares are of a mixture of ``size_share`` times all tokens of ``docs``.
    Sources are compared trimmed, lower-cased, with blanks and hyphens as underscores; a source repeated in ``targets``
    counts once, with its largest share.  Every document gets a posterior from its text and, where it has one, its recorded source; those
    with a null or empty text have no tokens and are never used.  Documents of other sources are a class of their own, without a target.
    ``source`` is the recorded one, else the likeliest.  ``uses`` is the rate rounded up or down by a hash of the id, so that its
    expectation is the rate; it never exceeds ``max_uses`` of that source.  Rates that don't settle are an error.
    Empty ``docs`` make every target infeasible; empty ``targets`` an empty report.
    """
    spark = docs.sparkSession
    goal = (
        targets.select(canonical(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_uses").cast("int").alias("uses"))
        .where("source is not null").groupBy("source").agg(F.max("share").alias("share"), F.max("uses").alias("uses")).orderBy("source").collect()
    )  # the report has a row for each: a configuration, not data
    names = [r["source"] for r in goal]
    k = len(names) + 1  # the last class: all other sources
    share = np.array([r["share"] or 0.0 for r in goal] + [0.0])
    uses = np.array([r["uses"] or 0 for r in goal] + [0], dtype=float)
    index = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]) if names else None
    source = canonical(F.col(source_col))
    known = F.lit(k - 1) if index is None else F.coalesce(F.try_element_at(index, source), F.lit(k - 1))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.when(source.isNotNull(), known).otherwise(F.lit(-1)).cast("int").alias("known"))

    labelled = hash_sample(rows.where("known >= 0 and text is not null"), F.xxhash64("doc_id"), sample)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [sparse_counts(t) for t in b["text"]]
            yield pd.DataFrame({"known": b["known"], "slots": [i.tobytes() for i, _ in got], "counts": [c.tobytes() for _, c in got]})

    fitted = labelled.select("known", "text").mapInPandas(features, "known int, slots binary, counts binary").collect()  # at most `sample` rows
    x = np.zeros((len(fitted), FEATURES), np.float32)
    for i, r in enumerate(fitted):
        x[i, np.frombuffer(r["slots"], np.int32)] = np.frombuffer(r["counts"], np.float32)
    table, prior, temperature = fit_naive_bayes(x, np.array([r["known"] for r in fitted], dtype=int), k)
    model = spark.sparkContext.broadcast((np.ascontiguousarray(table.T / temperature), prior))
    path = os.path.join(tokenizers, VOCABULARY)
    doubt = np.full((k + 1, k), np.log((1 - EVIDENCE) / max(k - 1, 1)))  # by recorded source; the last row: none
    doubt[np.arange(k), np.arange(k)] = np.log(EVIDENCE)
    doubt[k] = 0.0

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        weights, prior = model.value
        for b in batches:
            n = np.array([count(t) for t in b["text"]], dtype=np.int64)
            z = np.zeros((len(b), k))
            for i, t in enumerate(b["text"]):
                if n[i]:
                    slots, counts = sparse_counts(t)
                    z[i] = counts @ weights[slots]
            z += prior + doubt[np.where(b["known"] < 0, k, b["known"])]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            q = on_grid(p / p.sum(axis=1, keepdims=True))
            yield pd.DataFrame({"doc_id": b["doc_id"], "known": b["known"], "n_tokens": n, "p": [r.tobytes() for r in q]})

    id_type = rows.schema["doc_id"].dataType.simpleString()
    sized = checkpoint(rows.mapInPandas(measure, f"doc_id {id_type}, known int, n_tokens bigint, p binary"))
    alike = checkpoint(sized.where("n_tokens > 0").groupBy("p").agg(F.sum("n_tokens").alias("n")))

    def memberships(p: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(p), np.uint16).reshape(len(p), k) / GRID

    def sums(of) -> np.ndarray:
        """Tokens per source, with each document weighted by ``of(members)``."""

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(k)
            for b in batches:
                if len(b):
                    members = memberships(b["p"])
                    total += (of(members) * b["n"].to_numpy()) @ members
            yield pd.DataFrame({"i": np.arange(k, dtype=np.int32), "n": total})

        out = np.zeros(k)
        for r in alike.mapInPandas(add, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():  # k rows
            out[r["i"]] = r["n"]
        return out

    tokens = sums(lambda members: np.ones(len(members)))
    size = size_share * tokens.sum()
    reachable = sums(lambda members: members @ uses)
    scale = np.maximum(tokens / max(size, 1e-9), 1e-9)  # at least the Hessian, so a step never overshoots
    residuals: list[np.ndarray] = []
    at = np.zeros(k)
    while True:
        residual = at / max(size, 1e-9) - share
        residual[-1] = 0.0  # what is of other sources has no target
        residuals.append(residual)
        moved = sums(lambda members, past=list(residuals): descend(past, scale, members, members @ uses))
        change, at = np.abs(moved - at).max(), moved
        if change <= SETTLED * max(size, 1.0):
            break
        if len(residuals) >= STEPS:
            raise RuntimeError(f"rates still move by {change / size:.3g} of the mixture after {STEPS} steps")

    past = list(residuals)
    all_names = [*names, None]

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            members = memberships(b["p"])
            known_ = b["known"].to_numpy()
            label = np.where(known_ >= 0, known_, members.argmax(axis=1))
            rate = np.where(b["n_tokens"] > 0, descend(past, scale, members, members @ uses), 0.0)
            draw = np.array([xxhash.xxh64_intdigest(f"mix|{i}") for i in b["doc_id"]], dtype=np.uint64) / 2.0**64
            count = np.minimum(np.floor(rate + draw), uses[label]).astype(np.int32)
            source_ = [all_names[i] if c >= 0 or n > 0 else None for i, c, n in zip(label, known_, b["n_tokens"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": source_, "n_tokens": b["n_tokens"], "rate": rate, "uses": count})

    mixture = sized.mapInPandas(rates, f"doc_id {id_type}, source string, n_tokens bigint, rate double, uses int")
    used = mixture.where("uses > 0").groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("used_tokens"))
    facts = [
        (n, float(share[i]), int(uses[i]), float(tokens[i]), float(reachable[i] / size if size else 0.0), float(at[i] / size if size else 0.0),
         bool(size > 0 and at[i] / size >= share[i] - TOLERANCE and reachable[i] > 0 or share[i] <= 0))
        for i, n in enumerate(names)
    ]
    report = spark.createDataFrame(facts, "source string, target_share double, max_uses int, available_tokens double, reachable_share double, expected_share double, feasible boolean")
    report = report.join(used, "source", "left").select(
        "source", "target_share", "max_uses", "available_tokens", "reachable_share", "expected_share",
        (F.coalesce(F.col("used_tokens"), F.lit(0)) / F.lit(float(size or 1))).alias("actual_share"), "feasible",
    )
    return mixture, report
