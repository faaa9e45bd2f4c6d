"""Helpers shared by the training-data operators: checkpoints, words, hashes, canonical spellings."""

from __future__ import annotations

import re
import sys
import tempfile
import types

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVAL_SPLITS = ("val", "validation", "dev", "test", "test_shift")
TRAIN_SPLITS = ("train",)
LANGUAGE_NAMES = {"english": "en", "german": "de", "spanish": "es", "czech": "cs", "deutsch": "de"}

_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W_]+")


def process_cache() -> dict:
    """A dict that lives as long as the (Python worker) process; functions shipped by value can't keep globals."""
    return sys.modules.setdefault("_quern_process_cache", types.ModuleType("_quern_process_cache")).__dict__


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the session names.

    Where none is set, a local session gets a folder of its own; on a cluster that is an error, as executors don't share local disks.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return df.checkpoint(eager=True)


class Bitmap:
    """Which hashes may occur in a column: a bit for each value of the top bits of a 64-bit hash.

    It has sixteen bits or more for each of the ``expected`` hashes, but never more than 2 ** MOST_BITS (8 MB), so it can be broadcast whatever the data; bits
    are set and packed in the executors.  A hash of the column is always in it; others are in it by the share of bits that are set.
    """

    CHUNK, MOST_BITS = 1024, 26  # words of 64 bits in a row that the driver gets

    def __init__(self, hashes: DataFrame, column: str, expected: int):
        bits = min(self.MOST_BITS, max(16, max(expected, 1).bit_length() + 4))
        slot, chunk = f"shiftrightunsigned(`{column}`, {64 - bits})", self.CHUNK
        words = hashes.where(F.col(column).isNotNull()).groupBy(F.expr(f"shiftright({slot}, 6)").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")).alias("b"))

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(chunk, dtype=np.int64)
            out[group["w"].to_numpy() % chunk] = group["b"]
            return pd.DataFrame({"k": [int(group["w"].iloc[0] // chunk)], "x": [out.tobytes()]})

        set_ = np.zeros(1 << (bits - 6), dtype=np.uint64)
        for r in words.groupBy((F.col("w") / chunk).cast("bigint").alias("k")).applyInPandas(pack, "k bigint, x binary").collect():  # a row per chunk
            set_[r["k"] * chunk : (r["k"] + 1) * chunk] = np.frombuffer(r["x"], np.uint64)
        self._words, self._shift = hashes.sparkSession.sparkContext.broadcast(set_), np.uint64(64 - bits)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        slot = h.view(np.uint64) >> self._shift
        return (self._words.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def words_of(text: str) -> list[str]:
    """Runs of letters or digits of the lower-cased text, tags in angle brackets left out; each letter is lowered by itself, whatever stands beside it, as SQL does."""
    if not text.isascii():
        text = text.replace("İ", "i").replace("Σ", "σ")  # lower() adds a dot, which ends a word, and has a sigma of its own for ends of words
    text = text.lower()
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text)


def canonical(c: Column) -> Column:
    """Trimmed, lower-cased, blanks and hyphens read as underscores; blank becomes null."""
    out = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    return F.when(out != "", out)


def canonical_language(c: Column) -> Column:
    """Two-letter code behind the spellings of a language (``en-US``, ``English``, ``EN``); others stay as they are."""
    low = F.lower(F.trim(c))
    base = F.regexp_extract(low, r"^([a-z]{2})(?:[-_].*)?$", 1)
    named = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    out = F.coalesce(F.when(base != "", base), F.try_element_at(named, low), low)
    return F.when(out != "", out)


def canonical_class(c: Column) -> Column:
    """1 for the spellings of the AI class, 0 for those of the human class, null for all else."""
    low = F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", " ")
    return F.when(low.rlike("^(ai|machine)( generated| written)?$"), 1).when(low.rlike("^human( written)?$"), 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, h: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the lowest ``h`` (a bigint hash).

    A count of the rows sets a bound on the hash under which some three times as many fall, so that the final ordering moves
    a multiple of the sample and not a sample from each partition.
    """
    total = df.count()
    marked = df.withColumn("_h", h)
    if total > 3 * rows:
        marked = marked.where(F.pmod("_h", F.lit(1 << 30)) < int((1 << 30) * (3 * rows / total)))
    return marked.orderBy(F.pmod("_h", F.lit(1 << 30)), "_h").limit(rows).drop("_h")
