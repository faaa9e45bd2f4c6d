import random
import re

import pytest

from quern.llm import neardup, overlap
from quern.llm.shingles import shingles

TAG, WORD = re.compile(r"<[^<>]*>"), re.compile(r"[^\W_]+")


def sets(text, n=3):
    w = WORD.findall(TAG.sub(" ", text.lower())) if text else []
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= 20 else None


def variants(seed, groups=12):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([22, 40, 90, 400]))]
        rows.append((f"g{g}-0", " ".join(base)))
        for k in range(1, 5):
            words = list(base)
            for _ in range(int(len(words) * rng.choice([0.0, 0.02, 0.05, 0.12]))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((f"g{g}-{k}", (" " if k % 2 else "  ").join(words).upper() if k == 3 else " ".join(words)))
    rows += [("null", None), ("empty", ""), ("short", "a few words only"), ("tags", "<p>" + rows[0][1] + "</p>"), ("long", " ".join(rng.choice(vocab) for _ in range(20_000))), ("copy", rows[0][1]), ("copy2", rows[0][1])]
    return rows


def brute(rows, threshold):
    s = [(i, x) for i, t in rows if (x := sets(t))]
    return {(min(a, b), max(a, b)) for k, (a, x) in enumerate(s) for b, y in s[:k] if len(x & y) / len(x | y) >= threshold and a != b}


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_near_duplicates_match_brute_force(spark, clash, threshold):
    rows = variants(1)
    pool = clash(spark.createDataFrame(rows, "id string, text string")).repartition(3)
    got = neardup.expand_pairs(*neardup.near_duplicates(pool, threshold)).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == brute(rows, threshold) and len(got) == len(brute(rows, threshold))


def test_near_duplicates_on_tables(spark, small):
    pool = neardup.text_pool(spark.read.parquet(f"{small}/examples.parquet"), spark.read.parquet(f"{small}/pair_docs.parquet"))
    rows = [(r["id"], r["text"]) for r in pool.collect()]
    got = {(r["id_a"], r["id_b"]) for r in neardup.expand_pairs(*neardup.near_duplicates(pool)).collect()}
    assert got == brute(rows, 0.5)


def test_groups_are_components(spark):
    rows = variants(2)
    pool = spark.createDataFrame(rows, "id string, text string")
    links, members = neardup.near_duplicates(pool)
    out = {r["id"]: r["group_id"] for r in neardup.groups(links, members).collect()}
    pairs = brute(rows, 0.5)
    parent = {i: i for i, t in rows if sets(t)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    assert set(out) == set(parent)
    for a in parent:
        for b in parent:
            assert (out[a] == out[b]) == (find(a) == find(b))


def test_hot_block_is_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART_ROWS", 8)
    monkeypatch.setattr(neardup, "SAMPLE", 1)
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    rows = []
    for k in range(60):  # all near copies of one text, each with an edit of its own
        words = list(base)
        words[rng.randrange(120)] = f"x{k}"
        rows.append((f"d{k:02}", " ".join(words)))
    pool = spark.createDataFrame(rows, "id string, text string")
    got = {(r["id_a"], r["id_b"]) for r in neardup.expand_pairs(*neardup.near_duplicates(pool)).collect()}
    assert got == brute(rows, 0.5) and len(got) == 60 * 59 // 2


def test_large_block_uses_tiles(monkeypatch):
    import numpy as np

    monkeypatch.setattr(neardup, "TILE", 16)
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**63, (100, 4), dtype=np.uint64)
    fps[50:] = fps[:50] ^ np.uint64(1)
    n = np.sort(rng.integers(50, 60, 100))
    found = {(int(a), int(b)) for i, j in neardup.compare_block(np.arange(100), n, fps, None, 0.5, 20) for a, b in zip(i, j, strict=True)}
    want = {(i, j) for i in range(100) for j in range(i + 1, 100) if sum(int(x).bit_count() for x in fps[i] ^ fps[j]) <= 20}
    assert found == want


def test_empty_pool(spark):
    pool = spark.createDataFrame([], "id string, text string")
    links, members = neardup.near_duplicates(pool)
    assert links.count() == members.count() == neardup.groups(links, members).count() == 0


def examples(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, split string, dataset string")


def test_overlap_matches_brute_force(spark, clash):
    rng = random.Random(9)
    texts = variants(3)
    rows = []
    for i, t in texts:
        rows.append((i, t, rng.choice(["train", " Train ", "test", "VAL", "test_shift", None, "other", "train"]), rng.choice(["d1", "D1 ", None])))
    long_train = " ".join(t for _, t in texts[:3]) + " and more words"
    rows.append(("contains", long_train, "train", "d2"))
    rows.append(("contained", texts[0][1], "dev", "d2"))
    rows.append((None, texts[0][1], "dev", "d2"))
    side = lambda s: None if s is None else "train" if s.strip().lower() == "train" else "eval" if s.strip().lower() in overlap.EVAL_SPLITS else None
    s = [(i, side(sp), sets(t)) for i, t, sp, _ in rows if sets(t) and i]
    want = {(e, t) for e, se, x in s for t, st_, y in s if se == "eval" and st_ == "train" and e != t and len(x & y) / len(x) >= 0.6}
    df = clash(examples(spark, rows)).repartition(3)
    got = overlap.id_pairs(*overlap.contaminated_pairs(df.drop("split_"))).collect()
    assert {(r["eval_id"], r["train_id"]) for r in got} == want and ("contained", "contains") in want
    report = overlap.overlap_report(df).collect()
    assert sum(r["pairs"] for r in report) == len(want)
    assert sum(r["exact"] + r["near"] for r in report) <= sum(r["records"] for r in report)


def test_overlap_empty(spark):
    df = examples(spark, [])
    links, members = overlap.contaminated_pairs(df)
    assert overlap.id_pairs(links, members).count() == 0 and overlap.overlap_report(df).count() == 0


def test_shingles_are_case_and_markup_blind():
    a = shingles("The quick <b>brown</b> fox " * 6)
    b = shingles("the QUICK brown, fox! " * 6)
    assert (a == b).all() and shingles("too short") is None and shingles(None) is None


def test_block_longer_than_an_arrow_batch(spark):
    fp = lambda k: bytes(31) + bytes([k % 2])
    sigs = spark.createDataFrame([(k, 30, fp(k), [7]) for k in range(1, 61)], "cls bigint, n int, fp binary, keys array<bigint>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {tuple(r) for r in neardup.candidate_pairs(sigs, 0.5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(a, b) for b in range(1, 61) for a in range(1, b)}


def template_rows(seed, count=1500):
    """Texts of a few sentence patterns, so that most sequences of three words are common; some evaluation texts are edited training texts."""
    rng = random.Random(seed)
    words = [[f"{k}{i}" for i in range(12)] for k in ("noun", "verb", "adj")]
    sentence = lambda: ["the", rng.choice(words[2]), rng.choice(words[0]), rng.choice(words[1]), "the", rng.choice(words[0])]
    rows = []
    for i in range(count):
        text = [w for _ in range(rng.choice([4, 12, 25])) for w in sentence()]
        rows.append((f"t{i}", " ".join(text), "train", "d"))
        if i % 4 == 0:
            rows.append((f"e{i}", " ".join(w if rng.random() > 0.08 else rng.choice(words[0]) for w in text) if i % 8 else " ".join(w for _ in range(12) for w in sentence()), "test", "d"))
    return rows


@pytest.fixture(scope="module")
def template(spark):
    rows = template_rows(5)
    s = [(i, sp, sets(t)) for i, t, sp, _ in rows]
    return rows, {(e, t) for e, se, x in s for t, st_, y in s if se == "test" and st_ == "train" and len(x & y) / len(x) >= 0.6}


def test_overlap_ships_no_more_than_its_input(spark, template):
    rows, want = template
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    df = examples(spark, rows).repartition(2)
    before = written()
    got = {(r["eval_id"], r["train_id"]) for r in overlap.id_pairs(*overlap.contaminated_pairs(df)).collect()}
    assert got == want and len(want) > 100
    assert written() - before < 2 * sum(len(t) for _, t, _, _ in rows)


def test_overlap_in_blocks(spark, template, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(overlap, "HITS", 50)
    rows, want = template
    got = overlap.id_pairs(*overlap.contaminated_pairs(examples(spark, rows).repartition(3))).collect()
    assert {(r["eval_id"], r["train_id"]) for r in got} == want


def test_overlap_finds_what_sql_finds(spark, tmp_path):
    import duckdb

    from quern.llm.oracle import ORACLE
    from quern.llm.queries import p4_found

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for name, a, b in (("dotted", "İz{}", "iz{}"), ("sigma", "ΛΟΓΟΣ {}Σ", "λογοσ {}σ"), ("split", "{}", "{}"), ("same", "{}", "{}"), ("final", "ΛΟΓΟΣ{}", "λογος{}")):
        text = [word() for _ in range(30)]
        rows.append((name if name == "same" else f"{name}-e", " ".join(map(a.format, text)), " Test " if name == "split" else "test", "d"))
        rows.append((name if name == "same" else f"{name}-t", " ".join(map(b.format, text)), "train", "d"))
    examples(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/examples.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW examples AS SELECT * FROM '{tmp_path}/examples.parquet/*.parquet'")
    want = set(con.sql(ORACLE["p4_found"]).fetchall())
    assert {("dotted-e", "dotted-t"), ("sigma-e", "sigma-t"), ("split-e", "split-t"), ("same", "same")} <= want
    assert {tuple(r) for r in p4_found(spark, str(tmp_path)).collect()} == want
