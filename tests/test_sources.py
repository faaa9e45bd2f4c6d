import json

import pytest
from pyspark.sql import functions as F

from quern.sources import readers as A
from quern.sources import writers as B


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a", "text": "ü", "label": 1, "meta": {"k": "v"}}\n\n{"id": "b", "text": null}\n')
    rows = A.read_jsonl(spark, str(p), A.EXAMPLE).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["a", "b"] and rows[0]["meta"] == {"k": "v"}
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n{"id": \n')
    with pytest.raises(Exception):  # noqa: B017
        A.read_jsonl(spark, str(tmp_path / "bad.jsonl"), A.EXAMPLE).collect()
    kept = A.read_jsonl(spark, str(tmp_path / "bad.jsonl"), A.EXAMPLE, strict=False)
    assert kept.where("id is null").count() == 1


def test_delimited(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿id,text,\n1,"two\nlines",\n2,"a ""quote""",\n', encoding="utf-8")
    rows = A.read_any(spark, str(tmp_path / "x.csv")).orderBy("id").collect()
    assert [r["text"] for r in rows] == ["two\nlines", 'a "quote"'] and rows[0].asDict().keys() == {"id", "text"}
    (tmp_path / "x.tsv").write_text("id\ttext\n1\thi\n")
    assert A.read_any(spark, str(tmp_path / "x.tsv")).first()["text"] == "hi"


def test_keyed_json_orders_by_number(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({str(k): {"v": k} for k in (10, 2, 0)}))
    assert [r["v"] for r in A.read_keyed_json(spark, str(tmp_path / "d.json"), "v:int").collect()] == [0, 2, 10]


def test_predictions_folder(spark, tmp_path):
    (tmp_path / "lr.predictions.jsonl").write_text('{"id": "a", "score_ai": 0.5}\n{"id": "b", "score_ai": null}\n{"id": "c", "score_ai": 0.3, "error": "x"}\n')
    rows = {r["id"]: (r["detector"], r["score_ai"], r["failed"]) for r in A.read_predictions_folder(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("lr", 0.5, False), "b": ("lr", 0.0, True), "c": ("lr", 0.3, True)}


def test_log_and_positions(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps({"step": s, "v": v}) for s, v in ((1, 1), (2, 2), (1, 3))))
    assert A.latest_log_entry(spark, str(tmp_path / "log.jsonl"), "step int, v int").first()["v"] == 3
    assert A.latest_log_entry(spark, str(tmp_path / "log.jsonl"), "step int, v int", 2).first()["v"] == 2
    left = A.with_positions(spark.createDataFrame([("b",), ("a",), ("c",)], "x string"), ["x"])
    right = spark.createDataFrame([(0, "first"), (1, "second")], "row_index bigint, y string")
    assert {r["x"]: r["y"] for r in A.align_by_position(left, right).collect()} == {"a": "first", "b": "second", "c": None}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, float("nan"), "x\ty"), ("a", None, 0.5, "é")], "z string, n int, d double, a string")
    B.write_jsonl(df, str(tmp_path / "j"))
    lines = sorted(x for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines())
    assert [list(json.loads(x)) for x in lines] == [["a", "d", "n", "z"]] * 2 and any("é" in x for x in lines)
    B.write_tsv(df.coalesce(1), str(tmp_path / "t"))
    text = next((tmp_path / "t").glob("part-*")).read_text().splitlines()
    assert text[0] == "z\tn\td\ta" and "b\t1\t\tx y" in text and "a\t\t0.5\té" in text


def test_splits_and_unified(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/examples.parquet").select("id", "text")
    assign = e.limit(30).select("id", F.lit("test").alias("split"))
    B.write_splits(e, assign, str(tmp_path / "s"), "id", shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == e.count() and back.where("split = 'test'").count() == 30
    from quern.plans.records_q import _unified

    counts = B.write_unified(_unified(spark, small), str(tmp_path / "u"))
    assert counts.where("gid = 7").agg(F.sum("rows")).first()[0] == e.count()
    assert spark.read.json(str(tmp_path / "u" / "jsonl")).count() == e.count()


def test_metric_log(spark):
    rows = [(1, 1, "a", 0.1), (1, 2, "a", 0.2), (1, 1, "b", 5.0), (2, 1, "a", 1.0)]
    got = {r["step"]: r["metrics"] for r in B.last_value_per_step(spark.createDataFrame(rows, "step int, seq int, key string, value double")).collect()}
    assert got == {1: {"a": 0.2, "b": 5.0}, 2: {"a": 1.0}}
