"""Values worked out by hand from the definitions."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import evidence as E
from quern.functions import wiretext as R
from quern.operators import tells as D

TELL = "array<struct<ord:int,start:int,end:int,type:string,score:double,why:string,span:string,polarity:int>>"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def docs(spark, text, y, tells):
    return spark.createDataFrame([(1, text, y, tells)], f"id int, text string, y int, tells {TELL}")


def test_keyword_score(spark):
    # "ai" twice (also in "plain"), "overall" once; "i " once, "human" once: (3 - 2) * 0.35
    assert one(spark, E.keyword_score(F.col("t")), t="AI overall: plain human said i say") == pytest.approx(1 / (1 + 2.718281828**-0.35))
    assert one(spark, E.keyword_score(F.col("t")), t=None) == 0.5


def test_length_scores(spark):
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    for n, want in ((0, 0), (5, 0.25), (10, 1), (40, 1), (60, 0.25), (80, 0), (90, 0)):
        assert one(spark, E.why_quality(F.col("t")), t=words(n)) == pytest.approx(want), n
    for n, want in ((0, 0), (25, 0.25), (50, 1), (150, 1), (175, 0.25), (200, 0)):
        assert one(spark, E.length_gate(F.col("t")), t=words(n)) == pytest.approx(want), n
    assert one(spark, E.why_quality(F.col("t")), t="a b c a b c a b c a b c") == pytest.approx(3 / 10)


def test_verdict_scores(spark):
    tells = [(1, 0, 1, "AI", 0.8, "", "", 1), (2, 0, 1, "human", 0.4, "", "", -1), (3, 0, 1, "unsure", 0.9, "", "", 0)]
    w1, w2 = math.exp(3 * 0.8), math.exp(3 * 0.4)
    agg = (w1 * 0.8 - w2 * 0.4) / (w1 + w2)
    row = docs(spark, "x", 1, tells).select(E.verdict_score(F.col("tells"), F.lit(1), 3.0, 0.45, 0.5).alias("ai"), E.verdict_score(F.col("tells"), F.lit(0), 3.0, 0.45, 0.5).alias("human"), E.tell_probability(F.col("tells")).alias("p")).first()
    assert row["ai"] == pytest.approx(0.5 + 0.45 * math.tanh(agg / 0.5) * 0.8) and row["human"] == pytest.approx(0.5 - 0.45 * math.tanh(agg / 0.5) * 0.4)
    w3 = math.exp(3 * 0.9)
    assert row["p"] == pytest.approx(1 / (1 + math.exp(-4 * (w1 * 0.8 - w2 * 0.4) / (w1 + w2 + w3))))


def test_recall_and_quotes(spark):
    df = spark.createDataFrame([(["The odd rhythm.", "of it"], "An odd thing, “odd thing” and ‘no’ and “elsewhere”", ["an odd thing here", ""])], "w array<string>, v string, s array<string>")
    got = df.select(E.word_recall(F.col("w"), F.col("v")).alias("r"), E.quote_coverage(F.col("v"), F.col("s")).alias("q")).first()
    assert got["r"] == pytest.approx(1 / 3)  # of the, odd, rhythm the verdict has odd
    assert got["q"] == pytest.approx(1 / 2)  # "no" is too short for a quotation


def test_overlap_and_genericity(spark):
    tells = [(k, 0, 5, "AI", 0.9, "Sounds generic because of it", "alpha beta", 1) for k in range(1, 3)] + [(3, 0, 5, "human", 0.5, "The alpha, it is", "alpha", -1), (4, 0, 5, "AI", 0.2, "overly formal", "x", 1)]
    g = D.genericity(docs(spark, "alpha beta", 0, tells)).first()
    assert g["rate"] == pytest.approx(2 / 3) and g["weighted"] == pytest.approx(1.8 / 2.3) and g["tells"] == 3
    c = D.contradiction(docs(spark, "alpha beta", 0, tells)).first()
    assert c["rate_all"] == pytest.approx(3 / 4) and c["weighted_high"] == pytest.approx(1.8 / 2.3) and c["high_tells"] == 3
    assert one(spark, E.explanation_overlap(F.col("a"), F.col("b")), a="the of", b="alpha") == 0


def test_budget_is_greedy(spark):
    tells = [(1, 0, 60, "AI", 0.9, "", "", 1), (2, 60, 70, "AI", 0.8, "", "", 1), (3, 70, 75, "AI", 0.1, "", "", 1)]
    got = {r["budget"]: (r["tells"], r["chars"]) for r in D.budget_texts(docs(spark, "x" * 100, 1, tells)).collect()}
    assert got[0.5] == (2, 15) and got[0.1] == (1, 10) and got[0.02] == (1, 5)


def test_wire_texts(spark):
    assert one(spark, R.curly_quotes(F.col("t")), t="\"It's {'so'} (\"he\") said\"") == "“It’s {‘so’} (“he”) said”"
    assert one(spark, R.unquoted_words(F.col("t")), t='one "two three" four “five” six') == 3
    assert one(spark, R.needs_rewrite(F.col("t")), t="too short") is True
    long = "The second paragraph repeats the first, which people rarely do when they write"
    assert one(spark, R.needs_rewrite(F.col("t")), t=long) is False
    assert one(spark, R.needs_rewrite(F.col("t")), t=long + ", so it is a clear sign") is True
    assert one(spark, R.needs_rewrite(F.col("t")), t="The second paragraph repeats the first one and then repeats it once again") is True
    assert one(spark, R.is_standalone(F.col("t")), t="Stiff, COMPARED WITH the rest") is False
    block = "<|channel|>analysis<|message|>thinking<|end|><|channel|>final<|message|> done <|return|>"
    assert one(spark, R.response_text(F.col("t")), t=block) == "done"
    assert one(spark, R.response_text(F.col("t")), t="<|channel|>a<|message|>x<|end|><|channel|>b<|message|>y") == "y"
    assert one(spark, R.response_text(F.col("t")), t=" ``plain`` ") == "plain"
