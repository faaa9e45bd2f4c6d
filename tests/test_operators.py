import pytest
from pyspark.sql import functions as F

from quern import scorers as S
from quern.functions import evidence as E
from quern.functions import text as T
from quern.operators import allocate as A
from quern.operators import duels as D
from quern.operators import intervals as V
from quern.operators import normalize as N
from quern.operators.ranks import positions


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.clean_document_text(F.col("t")), t=" <p>a  b</p>\n&amp; c < d") == "a b &amp; c < d"
    assert one(spark, T.clean_document_text(F.col("t")), t=None) == ""
    for raw, want in (("EN", "en"), ("en_US", "en"), ("German", "de"), ("", None), ("klingon", "klingon"), (None, None)):
        assert one(spark, T.normalize_language(F.col("t")), t=raw) == want
    text = "a <b> & \"c\" 'd'"
    assert one(spark, T.unescape_document(T.escape_document(F.col("t"))), t=text) == text
    assert one(spark, T.word_ngrams(T.ascii_tokens(F.col("t")), 3), t="one two") == []
    assert one(spark, T.ngrams_upto(T.ascii_tokens(F.col("t")), 2), t="One two") == ["one", "two", "one two"]
    for raw, want in (("about 87.5% of it", 0.875), ("fell from 0.9 to 0.7 in it", 0.7), ("not reported, 0.9", None), ("1250 items", 1250.0), ("", None), (None, None)):
        assert one(spark, T.reported_score(F.col("t")), t=raw) == want
    assert one(spark, E.keyword_score(F.col("t")), t=None) == 0.5


def test_intervals(spark):
    df = spark.createDataFrame([([(1, 5), (5, 8), (10, 11), (-3, 0), (9, 9), (2, 3)], "0123456789abc"), ([], "xyz")], f"iv {V.INTERVALS}, t string")
    rows = df.select(V.merged(F.col("iv")).alias("m"), "t").select("m", V.kept_spans(F.col("t"), F.col("m")).alias("k"), V.without_spans(F.col("t"), F.col("m"), "#").alias("d"), V.covered(F.col("m")).alias("c")).collect()
    assert [tuple(x) for x in rows[0]["m"]] == [(1, 8), (10, 11)] and rows[0]["k"] == "1234567 [...] a" and rows[0]["d"] == "0#89#bc" and rows[0]["c"] == 8
    assert rows[1]["m"] == [] and rows[1]["k"] == " " and rows[1]["d"] == "xyz"


def test_positions_split_long_prefixes_and_groups(spark):
    rows = [(f"same-prefix-{k:05}", k % 3 if k % 7 else None, float(k % 50)) for k in range(400)]
    df = spark.createDataFrame(rows, "id string, g int, v double").repartition(5)
    got = {r["id"]: (r["position"], r["group_rows"]) for r in positions(df, ["id"], ["g"], largest=20).collect()}
    for g in (0, 1, 2, None):
        mine = sorted(i for i, x, _ in rows if x == g)
        assert [got[i] for i in mine] == [(k, len(mine)) for k in range(len(mine))]
    by_value = {r["id"]: r["position"] for r in positions(df, ["v", "id"]).collect()}
    assert [by_value[i] for i, _, _ in sorted(rows, key=lambda r: (r[2], r[0]))] == list(range(400))
    assert positions(df.limit(0), ["id"]).count() == positions(df.limit(0), ["v"]).count() == 0


def test_allocation():
    strata = [{"key": k, "n0": a, "n1": b} for k, a, b in (("x", 50, 80), ("y", 20, 9), ("z", 2, 100))]
    plan = A.balanced_allocation(strata, 60, 5, 1, 1000, 1)
    assert sum(plan.values()) == 30 and set(plan) == {"x", "y"} and plan["y"] <= 9
    with pytest.raises(ValueError):
        A.balanced_allocation(strata, 600, 5, 1, 1000, 1)
    with pytest.raises(ValueError):
        A.balanced_allocation(strata, 10, 500, 1, 1000, 1)


def test_balanced_sample_is_balanced(spark):
    rows = [(f"i{k}", f"s{k % 3}", k % 2 if k % 11 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "id string, s string, label int")
    got = A.balanced_sample(df, F.col("s"), "label", "id", 40, 3).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 20, 1: 20}


def test_unified_record_keeps_counts(spark, small):
    from quern.plans.records_q import _unified

    u = _unified(spark, small)
    assert tuple(u.columns) == N.UNIFIED and u.count() == spark.read.parquet(f"{small}/examples.parquet").count()


def test_win_rates_count_ties_half(spark):
    rows = [("d", "j", "model", 1), ("d", "j", "human", 1), ("d", "j", "human", 2), ("d", "j", "model", 3), ("e", "j", "model", 1)]
    got = D.win_rates(spark.createDataFrame(rows, "doc_id string, judge_id string, true_kind string, rank int")).collect()
    assert [(r["doc_id"], r["wins"], r["duels"]) for r in got] == [("d", 1.5, 4)]


def test_scorers_keep_errors_to_their_rows(spark):
    df = spark.createDataFrame([("a", "x y x"), ("b", ""), ("c", None), ("d", "p q")], "id string, text string")
    got = {r["id"]: r for r in S.run_scorer(df, "repetition").collect()}
    assert got["a"]["score_ai"] == pytest.approx(1 / 3) and got["d"]["score_ai"] == 0 and "ValueError" in got["b"]["error"] and got["c"]["error"]
    broken = S.run_scorer(df, "nobody").collect()
    assert all("KeyError" in r["error"] and r["score_ai"] is None for r in broken)
    chunks = spark.createDataFrame([(list("abcdefg"),), (["a"],)], "w array<string>").select(S.word_chunks(F.col("w"), 4, 2).alias("c")).collect()
    assert ["".join(x) for x in chunks[0]["c"]] == ["abcd", "cdef", "efg"] and chunks[1]["c"] == [["a"]]


def _comment_tables(spark, folder, articles):
    """``expert_articles`` with comments of few words; two articles share an id."""
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
    slots = lambda: [(f"w{k}", rng.choice(["AI-generated", "human"]), 3, " ".join(rng.choice(words) for _ in range(20)) if rng.random() > 0.2 else None) for k in range(5)]
    text = lambda: " ".join(rng.choice(words) for _ in range(80))
    rows = [(min(i, articles - 2), "t", text(), "AI", "human", *slots()) for i in range(articles)]
    slot = "struct<annotator_id: string, guess: string, confidence: int, comment: string>"
    kinds = "id bigint, title string, article string, ground_truth string, expert_majority_vote string, " + ", ".join(f"annotator_{k} {slot}" for k in range(1, 6))
    spark.createDataFrame(rows, kinds).coalesce(2).write.parquet(f"{folder}/expert_articles.parquet")


def test_gram_model_ships_no_gram_of_a_text_and_equals_sql(spark, tmp_path):
    import duckdb

    from quern.plans import ORACLE, QUERIES

    _comment_tables(spark, tmp_path, 300)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW expert_articles AS SELECT * FROM '{tmp_path}/expert_articles.parquet/*.parquet'")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    for name in ("P03_char_idf", "P04_fitted_model"):
        before = written()
        df = QUERIES[name](spark, str(tmp_path))
        got = sorted(map(tuple, df.collect()))
        assert written() - before < 1_000_000
        want = con.sql(ORACLE[name])
        assert df.columns == want.columns and got == sorted(want.fetchall())


def test_nearest_sets_of_a_large_bucket(spark, monkeypatch):
    import math
    import random

    from quern.operators import textmine as X

    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    spans = [" ".join(rng.choice(words[: rng.choice([20, 60])]) for _ in range(rng.choice([0, 1, 3, 7, 9, 12]))) for _ in range(1500)]
    rows = [(i, "large" if i % 5 else "small" if i % 25 else f"b{i}", s) for i, s in enumerate(spans)]
    monkeypatch.setattr(X, "TASK_SETS", 1000, raising=False)
    df = X.span_genericity(spark.createDataFrame(rows, "id int, k string, span string"), ["id"], "k", "span", 0.5, 2)
    assert "FlatMapGroupsInPandas" in df._jdf.queryExecution().toString()  # a large bucket's sets aren't joined with each other
    got = {r["id"]: (r["n"], r["g"]) for r in df.collect()}
    sets = {i: (k, set(s.split())) for i, k, s in rows}
    for i, (k, x) in list(sets.items())[::4]:
        others = [y for j, (q, y) in sets.items() if q == k and j != i]
        best = max((1 if not x | y else len(x & y) / len(x | y) for y in others), default=0)
        n = len(others) + 1
        assert got[i][0] == n and abs(got[i][1] - math.log(1 + max(n, 2)) * (1 if n < 2 else 1 - 0.5 * best)) < 1e-12
