import base64
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.llm import packing, tokens

PATH = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


COUNT = tokens.counter(PATH)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(max_size=80))
def test_counts_equal_the_public_tokenizer(encoding, text):
    assert COUNT(text) == len(encoding.encode_ordinary(text))


def test_counts_on_documents(spark, small, encoding, clash):
    docs = clash(spark.read.parquet(f"{small}/documents.parquet"))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.with_token_counts(docs.select("doc_id", "text", "n"), "text").collect()}
    want = {r["doc_id"]: len(encoding.encode_ordinary(r["text"])) if r["text"] else 0 for r in docs.select("doc_id", "text").collect()}
    assert got == want


def test_long_pieces(encoding):
    for text in ("a" * 30_000, "ab" * 5_000, " " * 4_000, "é☃" * 3_000):
        assert COUNT(text) == len(encoding.encode_ordinary(text))


def test_budget_adds_up_and_takes_an_empty_table(spark, small, clash):
    e = clash(spark.read.parquet(f"{small}/examples.parquet"))
    rows = tokens.token_budget(e).collect()
    per = {s: sum(r["tokens"] for r in rows if r["slice"] == s) for s in {r["slice"] for r in rows}}
    assert len(per) == 5 and len(set(per.values())) == 1 and per["all"] > 0
    assert sum(r["documents"] for r in rows if r["slice"] == "dataset") == e.count()
    twice = {r["slice"]: r["tokens"] for r in tokens.token_budget(e.union(e)).where("slice = 'all'").collect()}
    assert twice["all"] == 2 * per["all"]
    assert tokens.token_budget(e.limit(0)).count() == 0


def brute_best(counts, capacity):
    first = max(counts)
    sums = {first}
    items = [n for n, c in counts.items() for _ in range(c - (n == first))]
    for n in items:
        sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6))
def test_fullest_window_is_optimal(counts):
    chosen = packing.fullest(counts, 40)
    assert all(chosen[n] <= counts[n] for n in chosen) and max(counts) in chosen
    assert sum(n * c for n, c in chosen.items()) == brute_best(counts, 40)


def test_plan_uses_everything_once():
    rng = random.Random(3)
    counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, 4097), 300)}
    plan = packing.plan_containers(counts, 4096)
    used = {}
    for times, chosen in plan:
        assert sum(n * c for n, c in chosen.items()) <= 4096
        for n, c in chosen.items():
            used[n] = used.get(n, 0) + times * c
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    alone = sum(c for n, c in counts.items() if n > 2048)  # no two of these share a container
    assert sum(t for t, _ in plan) <= max(-(-total // 4096), alone) * 1.02 + 1


def test_plan_of_short_texts_leaves_no_room():
    rng = random.Random(4)
    counts = {n: rng.randint(1, 500) for n in rng.sample(range(20, 1500), 1200)}
    plan = packing.plan_containers(counts, 4096)
    assert sum(t for t, _ in plan) == -(-sum(n * c for n, c in counts.items()) // 4096)


def test_packing_is_exact_partition(spark, clash):
    rng = random.Random(5)
    rows = [(i, " ".join(["word"] * rng.choice([1, 3, 7, 20, 33, 64, 65, 130]))) for i in range(300)] + [(1000, None), (1001, ""), (1002, " ".join(["word"] * 64)), (1003, "one two")] + [(7, "one two")]
    df = clash(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(5)
    out = packing.pack_documents(df, "doc_id", "text", capacity=64).collect()
    assert {r["doc_id"] for r in out} == {i for i, _ in rows}
    by = {}
    for r in out:
        if r["container"] is None:
            assert r["n_tokens"] == 0
        else:
            by.setdefault(r["container"], []).append((r["start"], r["end"]))
    assert sorted(by) == list(range(len(by)))
    for spans in by.values():
        at = 0
        for a, b in sorted(spans):
            assert a >= at and b <= 64
            at = b
    want = tokens.with_token_counts(df.select("doc_id", "text"), "text").groupBy("doc_id").sum("n_tokens").collect()
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == {r[0]: r[1] for r in want}
    parts = [r for r in out if r["doc_id"] in {i for i, t in rows if t and len(t.split()) == 130}]
    assert all(r["parts"] == 3 for r in parts)
    fill = packing.container_fill(packing.pack_documents(df, "doc_id", "text", capacity=64), 64).collect()
    assert sum(r["containers"] for r in fill) == len(by)


def test_packing_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(df, "doc_id", "text").count() == 0
