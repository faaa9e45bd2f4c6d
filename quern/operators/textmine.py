"""Counts and weights of word and character n-grams, similarity of texts."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import ascii_tokens, char_ngrams, ngrams_upto


def document_frequency(rows: DataFrame, id_col: str, grams: Column, splits: dict[str, Column] | None = None) -> DataFrame:
    """``gram, df`` and, for each of ``splits``, the documents that fulfil it."""
    each = rows.select(F.explode(F.array_distinct(grams)).alias("gram"), *[c.alias(k) for k, c in (splits or {}).items()])
    return each.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), *[F.count_if(F.col(k)).alias(k) for k in splits or {}])


def tfidf(rows: DataFrame, id_col: str, tokens: Column, longest: int = 1, min_df: int = 2) -> DataFrame:
    """``id, term, tf, df, weight``: smooth idf ln((1 + N) / (1 + df)) + 1, rows of unit length.

    Terms are counted per document before the shuffle by term; N is one row.
    """
    docs = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (tokens if longest == 1 else ngrams_upto(tokens, longest)).alias("_g"))
    n = docs.agg(F.count(F.lit(1)).alias("_n"))
    tf = docs.select("id", F.explode("_g").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    raw = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("_w", F.col("tf") * (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", "tf", "df", (F.col("_w") / norm).alias("weight"))


def pair_cosine(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, a, b, cosine`` for the pairs of documents of a group that share a term; ``groups``: ``id, grp`` with few documents each (a document's explanations)."""
    w = weights.select("id", "term", "weight").join(groups, "id")
    x, y = w.alias("x"), w.alias("y")
    pairs = x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.term") == F.col("y.term")) & (F.col("x.id") < F.col("y.id")))
    return pairs.groupBy(F.col("x.grp").alias("grp"), F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.sum(F.col("x.weight") * F.col("y.weight")).alias("cosine"))


def substring_frequency(rows: DataFrame, text: str, lengths: tuple[int, ...]) -> DataFrame:
    """``length, gram, count``: in how many texts a substring of a given length occurs that holds a blank and has none at its ends."""
    inner = lambda g: F.filter(g, lambda x: F.contains(x, F.lit(" ")) & ~x.startswith(" ") & ~x.endswith(" "))
    sets = F.array(*[F.struct(F.lit(n).alias("length"), F.array_distinct(inner(char_ngrams(F.col(text), n))).alias("g")) for n in lengths])
    each = rows.select(F.explode(sets).alias("s")).select("s.length", F.explode("s.g").alias("gram"))
    return each.groupBy("length", "gram").agg(F.count(F.lit(1)).alias("count"))


def idf_table(rows: DataFrame, id_col: str, grams: Column) -> DataFrame:
    """``phrase, n, count, doc_count, idf``: uses, documents and ln((N + 1) / (df + 1)) + 1 of each n-gram."""
    per = rows.select(F.col(id_col).alias("id"), F.explode(grams).alias("phrase")).groupBy("id", "phrase").agg(F.count(F.lit(1)).alias("k"))
    g = per.groupBy("phrase").agg(F.sum("k").alias("count"), F.count(F.lit(1)).alias("doc_count"))
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    idf = F.ln((F.col("_n") + 1) / (F.col("doc_count") + 1)) + 1
    return g.crossJoin(F.broadcast(total)).select("phrase", F.size(F.split("phrase", " ")).cast("bigint").alias("n"), "count", "doc_count", F.round(idf, 6).alias("idf"))  # one row


def variety(rows: DataFrame, groups: list[str], words: str) -> DataFrame:
    """Per group: explanations, vocabulary, tokens, type-token ratio, and mean, median and 95th percentile (discrete) of their lengths in words."""
    from quern.operators.ranks import positions

    each = rows.select(*groups, F.explode(words).alias("_t")).groupBy(*groups, "_t").agg(F.count(F.lit(1)).alias("_n"))
    g = each.groupBy(*groups).agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("_n").alias("tokens"))
    placed = positions(rows.select(*groups, F.size(words).cast("bigint").alias("_l")), ["_l"], groups)
    n = F.col("group_rows")
    at = lambda p: F.max(F.when(F.col("position") == p, F.col("_l")))
    lengths = placed.groupBy(*groups).agg(F.count(F.lit(1)).alias("explanations"), at(F.floor(n / 2)).alias("median_words"), at(F.least(n - 1, F.floor(0.95 * n))).alias("p95_words"))
    out = g.join(lengths, groups)
    return out.select(*groups, "explanations", "vocabulary", "tokens", F.round(F.col("vocabulary") / F.col("tokens"), 4).alias("ttr"), F.round(F.col("tokens") / F.col("explanations"), 1).alias("mean_words"), "median_words", "p95_words")


def intra_similarity(rows: DataFrame, group: str, id_col: str, words: str) -> DataFrame:
    """``group, similarity``: mean cosine of the pairs of a group's texts, weighed by sublinear TF-IDF over words and pairs of words within the group; groups of one text have no row.

    The sum over all pairs is (|sum of the unit vectors|^2 - n) / 2, so no pairs are formed.
    """
    texts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    tf = rows.select(group, id_col, F.explode(ngrams_upto(F.col(words), 2)).alias("term")).groupBy(group, id_col, "term").agg((1 + F.ln(F.count(F.lit(1)))).alias("_tf"))
    df = tf.groupBy(group, "term").agg(F.count(F.lit(1)).alias("_df"))
    w = tf.join(df, [group, "term"]).join(texts, group).withColumn("_w", F.col("_tf") * (F.ln((1 + F.col("_k")) / (1 + F.col("_df"))) + 1))
    norms = w.groupBy(group, id_col).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    unit = w.join(norms, [group, id_col]).groupBy(group, "term").agg(F.sum(F.col("_w") / F.col("_norm")).alias("_x"))
    sums = unit.groupBy(group).agg(F.sum(F.col("_x") * F.col("_x")).alias("_s")).join(norms.groupBy(group).agg(F.count(F.lit(1)).alias("_m")), group)
    pairs = F.col("_k") * (F.col("_k") - 1) / 2
    return texts.join(sums, group, "left").select(group, (F.coalesce((F.col("_s") - F.col("_m")) / 2, F.lit(0.0)) / pairs).alias("similarity"))


#: Characters of text whose n-grams a task holds at once.
CHUNK_CHARS = 500_000


def gram_model(rows: DataFrame, row_col: str, id_col: str, text: str, shortest: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Document frequency of character n-grams over rows (``g, df``; a row's texts count together) and ``id, row, mean_idf``: mean ln((1 + N) / (1 + df)) over a text's distinct n-grams, 0 without any.

    Texts come together in chunks of whole rows.  A chunk counts its n-grams, and it gets the frequencies of its distinct ones back, so no n-gram of a single text is shuffled.
    """
    from quern.session import checkpoint

    texts = checkpoint(rows.select(F.col(row_col).cast("string").alias("_row"), F.col(id_col).cast("string").alias("_id"), F.col(text).alias("_text")))
    n, chars = texts.agg(F.count_distinct("_row"), F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()
    texts = texts.withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.lit(max(1, -(-chars // CHUNK_CHARS)))))
    kinds = dict(rows.dtypes)

    def sets(keys: list, values: pd.Series) -> dict:
        out: dict = {}
        for k, t in zip(keys, values, strict=True):
            out.setdefault(k, set()).update(t[i : i + size] for size in range(shortest, longest + 1) for i in range(len(t) - size + 1))
        return out

    def count(group: pd.DataFrame) -> pd.DataFrame:
        found: Counter = Counter()
        for grams in sets([r if isinstance(r, str) else None for r in group["_row"]], group["_text"]).values():
            found.update(grams)
        return pd.DataFrame({"_chunk": group["_chunk"].iloc[0], "g": list(found), "_n": list(found.values())})

    def score(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        idf = {g: math.log((1 + n) / (1 + df)) for g, df in zip(known["g"], known["df"], strict=True)}
        keys = [(r if isinstance(r, str) else None, i if isinstance(i, str) else None) for r, i in zip(group["_row"], group["_id"], strict=True)]
        out = [(*k, math.fsum(idf[g] for g in grams) / len(grams) if grams else 0.0) for k, grams in sets(keys, group["_text"]).items()]
        return pd.DataFrame(out, columns=["_row", "_id", "mean_idf"])

    counts = checkpoint(texts.groupBy("_chunk").applyInPandas(count, "_chunk bigint, g string, _n bigint"))
    df = counts.groupBy("g").agg(F.sum("_n").alias("df"))
    known = counts.select("_chunk", "g").join(df, "g")
    scored = texts.groupBy("_chunk").cogroup(known.groupBy("_chunk")).applyInPandas(score, "_row string, _id string, mean_idf double")
    return df, scored.select(F.col("_id").cast(kinds[id_col]).alias(id_col), F.col("_row").cast(kinds[row_col]).alias(row_col), "mean_idf")


def word_sets(spans: DataFrame, span: str, tokenizer=None) -> DataFrame:
    """``spans`` with ``words``: the distinct words of each span; ``tokenizer`` maps a column to an array of words."""
    words = tokenizer(F.col(span)) if tokenizer else F.regexp_extract_all(F.lower(span), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return spans.withColumn("words", F.array_distinct(words))


#: Sets of a bucket up to which a join compares them; sets whose nearest a task looks for, and the most tasks for a bucket.
JOINED_SETS, TASK_SETS, BUCKET_TASKS = 64, 16_384, 16


def nearest_jaccard(sets: list[np.ndarray], asked: np.ndarray) -> np.ndarray:
    """Largest Jaccard similarity of each of the ``asked`` sets (by place) with another one.

    A set's words are followed from the rarest; one of s words that first meets another at its word p shares at most s - p with it (p from 0), so the
    common words are left as soon as none can come closer than what was found.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, word, df = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(sets)), size)
    order = np.lexsort((word, df[word], of))  # within each set, rarest first
    word, at = word[order], np.append(0, np.cumsum(size))
    by_word = np.lexsort((size[of], word))
    posting, start = of[by_word], np.append(0, np.cumsum(df))
    inside, out = np.zeros(len(flat), dtype=bool), np.zeros(len(asked))
    for k, i in enumerate(asked):
        mine = word[at[i] : at[i + 1]]
        s, best = len(mine), 0.0
        inside[mine] = True
        for p, w in enumerate(mine):
            if best >= (s - p) / s:
                break
            others = posting[start[w] : start[w + 1]]  # by size
            low = np.searchsorted(size[others], best * s, "left")  # a shared part of all its words, at most
            others = others[low : np.searchsorted(size[others], (s - p) / best - p, "right") if best else None]
            others = others[others != i]
            if len(others):
                lengths = size[others]
                ends = np.cumsum(lengths)
                shared = np.add.reduceat(inside[word[np.repeat(at[others] - ends + lengths, lengths) + np.arange(ends[-1])]].astype(np.int64), ends - lengths)
                best = max(best, float((shared / (s + lengths - shared)).max()))
        inside[mine] = False
        out[k] = best
    return out


def span_genericity(tells: DataFrame, ids: list[str], bucket: str, span: str, weight: float, least: int) -> DataFrame:
    """``tells`` without their spans, with ``n`` (tells of the bucket) and ``g = ln(1 + max(n, least)) * clamp(1 - weight * J)``, J the largest word Jaccard of the span with another span of the bucket.

    Equal word sets meet as one: a set that occurs twice has J = 1 without a comparison, so only distinct sets of a bucket are compared: those of a small bucket
    joined on a shared word (sets that share none have J = 0), those of a large one by ``nearest_jaccard``, in parts that each look for the nearest of some sets.
    """
    from quern.functions.text import jaccard
    from quern.session import checkpoint

    hashed = F.array_sort(F.transform("words", lambda w: F.xxhash64(w)))
    t = checkpoint(word_sets(tells, span).withColumn("_set", hashed).drop("words", span))
    sets = checkpoint(t.groupBy(bucket, "_set").agg(F.count(F.lit(1)).alias("_copies")).withColumn("_sid", F.monotonically_increasing_id()))
    sizes = sets.groupBy(bucket).agg(F.sum("_copies").alias("n"))
    held = sets.join(sets.groupBy(bucket).agg(F.count(F.lit(1)).alias("_sets")).where("_sets > 1"), bucket)
    small = held.where(F.col("_sets") <= JOINED_SETS)
    words = small.select(bucket, F.col("_sid").alias("_oid"), F.col("_set").alias("_other"), F.explode("_set").alias("_w"))
    mine = small.where("_copies = 1").select(bucket, "_sid", "_set", F.explode("_set").alias("_w"))
    met = mine.join(words, [bucket, "_w"]).where("_sid != _oid").groupBy("_sid", "_oid").agg(F.first("_set").alias("_set"), F.first("_other").alias("_other"))
    joined = met.groupBy("_sid").agg(F.max(jaccard(F.col("_set"), F.col("_other"))).alias("_j"))

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        asked = np.flatnonzero(group["_own"].to_numpy(bool))
        return pd.DataFrame({"_sid": group["_sid"].to_numpy(np.int64)[asked], "_j": nearest_jaccard(list(group["_words"]), asked)})

    parts = F.least(F.lit(BUCKET_TASKS), F.ceil(F.col("_sets") / TASK_SETS)).cast("bigint")
    large = held.where(F.col("_sets") > JOINED_SETS).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    large = large.select(bucket, "_part", "_sid", ((F.col("_copies") == 1) & (F.pmod(F.xxhash64("_sid"), parts) == F.col("_part"))).alias("_own"), F.col("_set").alias("_words"))
    large = large.repartition(4 * tells.sparkSession.sparkContext.defaultParallelism, bucket, "_part")  # work grows with more than bytes
    best = joined.unionByName(large.groupBy(bucket, "_part").applyInPandas(nearest, "_sid bigint, _j double"))
    scored = sets.join(best, "_sid", "left").select(bucket, "_set", F.when(F.col("_copies") > 1, 1.0).otherwise(F.coalesce("_j", F.lit(0.0))).alias("_j"))
    out = t.join(scored.join(sizes, bucket), [bucket, "_set"])
    diversity = F.when(F.col("n") < 2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - weight * F.col("_j"))))
    return out.withColumn("g", F.ln(1 + F.greatest("n", F.lit(least))) * diversity).drop("_set", "_j")


def drop_probabilities(tells: DataFrame, g: str, score: str, strength: float, cap: float, score_weight: float, quantile: float) -> DataFrame:
    """``tells`` with the drop probabilities of three styles: by genericity over its median (``scaled``; before the score counts, ``mass``), above a quantile of it, and above the median; each times ``keep`` = max(0, 1 - weight * score)."""
    from quern.operators.aggregates import linear_quantile
    from quern.session import checkpoint

    tells = checkpoint(tells)  # read by the quantiles and by what follows
    refs = linear_quantile(tells, [], g, {"_med": 0.5, "_ref": quantile})
    rows = tells.crossJoin(F.broadcast(refs)).withColumn("keep", F.greatest(F.lit(0.0), 1 - score_weight * F.col(score)))  # one row
    over = F.greatest(F.lit(1e-6), F.col("_med"))
    p = lambda excess: F.least(F.lit(cap), strength * excess / over)
    above = lambda ref: F.greatest(F.lit(0.0), F.col(g) - F.col(ref))
    rows = rows.withColumn("mass", p(F.col(g)))
    return rows.withColumns({"scaled": F.col("mass") * F.col("keep"), "above_quantile": p(above("_ref")) * F.col("keep"), "above_median": p(above("_med")) * F.col("keep")}).drop("_med", "_ref")


def content_key(p: Column, why: Column, substance: str, style: str) -> Column:
    """Order in which tells are kept: explanations of substance come 0.6 earlier, those of mere style 0.4 later."""
    return F.when(why.rlike(substance), F.greatest(F.lit(0.0), p - 0.6)).when(why.rlike(style), F.least(F.lit(1.0), p + 0.4)).otherwise(p)


def keep_most_specific(tells: DataFrame, doc: str, order: str, p: str, key: str, cap: float, least: int, most: int, seed: int) -> DataFrame:
    """``tells`` with ``kept``: a document keeps between ``least`` and ``most`` tells (as far as it has them), fewer the more generic they are on average; the fraction is rounded by a hash."""
    from pyspark.sql.window import Window

    from quern.functions.text import hash_uniform

    of = Window.partitionBy(doc)
    n = F.count(F.lit(1)).over(of)
    rows = tells.withColumns({"_low": F.least(F.lit(least), n), "_high": F.greatest(F.least(F.lit(least), n), F.least(F.lit(most), n)), "_gen": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg(p).over(of) / cap))})
    want = F.col("_low") + (F.col("_high") - F.col("_low")) * (1 - F.col("_gen"))
    k = F.greatest("_low", F.least("_high", F.floor(want) + (hash_uniform(F.lit(str(seed)), doc) < want - F.floor(want)).cast("int")))
    place = F.row_number().over(of.orderBy(F.round(key, 9), order))
    return rows.withColumns({"_k": k, "_place": place}).withColumn("kept", F.col("_place") <= F.col("_k")).drop("_low", "_high", "_gen", "_k", "_place")


def overlap_ratio(target: DataFrame, other: DataFrame, id_col: str, tokens: Column, n: int) -> DataFrame:
    """``id, ratio``: share of the target's n-grams (with their counts) that the other text of the same id also has."""
    from quern.functions.text import word_ngrams

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), F.explode(word_ngrams(tokens, n)).alias("g")).groupBy("id", "g").agg(F.count(F.lit(1)).alias(name))

    both = counts(target, "a").join(counts(other, "b"), ["id", "g"], "left")
    return both.groupBy("id").agg((F.sum(F.least("a", F.coalesce("b", F.lit(0)))) / F.sum("a")).alias("ratio"))


def words(c: Column | str) -> Column:
    return ascii_tokens(F.col(c) if isinstance(c, str) else c)
