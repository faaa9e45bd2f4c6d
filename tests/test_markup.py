import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern import markup as W

VERDICT = {"type": "AI", "why": "reads like a list & more", "score": 0.75}


def tell(start, end, kind="AI", why="because \"so\" <it> is", score=0.5):
    return {"start": start, "end": end, "type": kind, "explanation": why, "score": score}


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(blacklist_categories=["Cs"]), max_size=60), st.integers(0, 2**30))
def test_round_trip(text, seed):
    text = W._FORBIDDEN.sub("", text).replace("\r", "")
    rng = random.Random(seed)
    spans = [tell(*sorted((rng.randint(0, len(text)), rng.randint(0, len(text)))), kind=rng.choice(W.KINDS)) for _ in range(3)]
    wire = W.render(text, spans, VERDICT)
    p = W.parse(wire)
    assert p["ok"] and p["plain"] == text and W.diagnose(wire, text)["ok"]
    assert {(t["start"], t["end"]) for t in p["tells"]} <= {(t["start"], t["end"]) for t in spans}
    assert p["verdict"] == VERDICT
    assert W.repair(wire, text) == wire


def test_nested_and_offsets():
    text = "abc def ghi jkl"
    p = W.parse(W.render(text, [tell(0, 11), tell(4, 7, "human")], VERDICT))
    assert [(t["span_text"], t["nested"], t["type"]) for t in p["tells"]] == [("abc def ghi", False, "AI"), ("def", True, "human")]


@pytest.mark.parametrize(
    ("wire", "reason"),
    [
        ("", "empty_final"),
        (None, "empty_final"),
        ("plain text", "missing_outer_annotation"),
        ('<text>a<span>b</span><verdict type="AI" why="w" score="0.5" /></text>', "annotation_parse_failed"),
        ('<text>ab<annotation type="AI" why="w" score="0.5" /><verdict type="AI" why="w" score="0.5" /></text>', "annotation_parse_failed"),
        ('<text>a<span>b<annotation type="robot" why="w" score="0.5" /></span><verdict type="AI" why="w" score="0.5" /></text>', "invalid_type"),
        ('<text>abc<verdict type="AI" why="w" score="0.5" /></text>', "text_mismatch"),
        ("<text>a'b<verdict type=\"AI\" why=\"w\" score=\"0.5\" /></text>", "bad_xml_escaping"),
        ('<text>ab<verdict type="AI" why="w" score="1.5" /></text>', "annotation_parse_failed"),
    ],
)
def test_reasons(wire, reason):
    doc = "a'b" if reason == "bad_xml_escaping" else "ab"
    assert W.diagnose(wire, doc)["reason"] == reason


def test_end_mark_is_ignored():
    wire = W.render("ab", [], VERDICT) + W.END_MARK
    assert W.diagnose(wire, "ab")["ok"]


def test_repair_keeps_tells_and_invents_none():
    text = "The quick brown fox jumps over the lazy dog and runs away from it."
    good = W.render(text, [tell(4, 9), tell(20, 25, "human", "odd")], VERDICT)
    for broken in (
        good.replace('type="AI"', 'type=" ai "', 1), good.replace('score="0.75"', 'score="7"'), good.replace("lazy", "lasy"), good.replace("</span>", "</span></span>", 1),
        good + "trailing", good.replace("<span>", "<span><span>", 1), good.replace("&quot;", "&amp;quot;"),
    ):
        fixed = W.repair(broken, text)
        assert fixed and W.diagnose(fixed, text)["ok"]
        tells = W.parse(fixed)["tells"]
        assert len(tells) <= 2 and all((t["start"], t["end"]) in {(4, 9), (20, 25)} for t in tells)
    assert W.repair("nothing like it", text) is None
    assert W.repair(W.render("something else entirely, at some length", [], VERDICT), text) is None


def test_locate():
    assert W.locate("ab ab ab", ["ab", "ab", "x", "ab", "ab"]) == [(0, 2), (3, 5), None, (6, 8), None]
    assert W.difference("abcd", "abxd") == 2 and W.difference("", "abc") == 3


def test_columns(spark):
    text = "one two three"
    wire = W.render(text, [tell(4, 7)], VERDICT)
    df = spark.createDataFrame([(wire, text), (None, text), ("bad", None)], "wire string, text string")
    rows = df.select(W.parse_udf("wire").alias("p"), W.diagnose_udf("wire", "text").alias("r"), W.repair_udf("wire", "text").alias("f"), W.annotation_rows(df["wire"]).alias("a"), W.strip_scores(df["wire"]).alias("s")).collect()
    assert rows[0]["p"]["ok"] and rows[0]["p"]["tells"][0]["span_text"] == "two" and rows[0]["f"] == wire
    assert rows[0]["a"][0]["type"] == "AI" and 'score="0.5"' not in rows[0]["s"]
    assert [r["r"]["reason"] for r in rows] == ["ok", "empty_final", "missing_outer_annotation"] and rows[1]["f"] is None


def test_wires_of_every_document(spark, tmp_path):
    from quern.plans import QUERIES
    from quern.plans.wires_q import _wires

    texts = {k: f"R&D {k} <b>&amp;</b>" + ("\x01\x0b" if k % 2 else "") + " said \"no\" & left, & came 'back' again" * 4 for k in range(20)}
    spark.createDataFrame(list(texts.items()), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = _wires(spark, str(tmp_path)).select("doc_id", "wire", W.parse_udf("wire").alias("p"), W.diagnose_udf("wire", "text").alias("r")).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        text = texts[r["doc_id"]].replace("\x01", "").replace("\x0b", "")
        assert r["r"]["reason"] == "ok" and r["p"]["plain"] == text and r["p"]["tells"]
        assert all(t["span_text"] == text[t["start"] : t["end"]] for t in r["p"]["tells"])
    import hashlib

    repaired = {r["doc_id"]: r for r in QUERIES["J21_repaired_wires"](spark, str(tmp_path)).collect()}
    for r in rows:
        assert repaired[r["doc_id"]]["plain"] == hashlib.sha256(r["p"]["plain"].encode()).hexdigest() and repaired[r["doc_id"]]["tells"] == len(r["p"]["tells"])


def test_fuzzy_places_match_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 50)))
        span = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14)))
        best = None
        for n in range(max(1, len(span) - 2), len(span) + 4):
            for i in range(len(text) - n + 1):
                off = W.difference(text[i : i + n], span)
                if off <= max(5, (len(span) + n) // 6) and (best is None or (off, i) < best[:2]):
                    best = (off, i, n)
        got = W.fuzzy_place(text, span)
        assert (got is None) == (best is None)
        assert best is None or (W.difference(text[got[0] : sum(got)], span), got[0]) == best[:2]
    assert W.nearest("abcabcab", "ab", 1, 5) == 6 and W.nearest("abc", "x", 0, 0) is None and W.nearest("", "", 0, 0) is None


def test_token_classes_by_hand():
    from quern.operators import tokenclasses as K

    # reasoning, text, span, its text, attributes: type, why, score; text; verdict: type, why, score; closing
    t = [50, 0, 60, 3, 61, 4, 62, 5, 63, 63, 6, 64, 7, 65, 1, 66, 5, 67, 6, 68, 2]
    assert list(K.classes(t, 1)) == [0, 1, 7, 2, 7, 1, 5, 1, 6, 6, 1, 8, 1, 7, 1, 3, 1, 4, 1, 9, 1]
    assert list(K.segments(t, 1)) == [0, 0, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1]
    assert list(K.mask(t, 1)) == [1, 0, 1, 0, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 1]
    assert list(K.classes([], 3)) == list(K.segments([], 0)) == list(K.mask([5], 4)) == [] and list(K.classes([9], 4)) == [0]
