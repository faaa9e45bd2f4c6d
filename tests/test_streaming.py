import pytest
from pyspark.sql import functions as F

from quern.operators.ranks import ordered_ema
from quern.streaming import stateful as Q


@pytest.fixture(scope="module")
def parts(spark, small, tmp_path_factory):
    """The events in time order, in four files."""
    folder = tmp_path_factory.mktemp("events")
    e = spark.read.parquet(f"{small}/events.parquet").orderBy("ts", "event_id").toPandas()
    step = -(-len(e) // 4)
    import os
    import time

    for k in range(4):
        path = folder / f"{k}.parquet"
        e.iloc[k * step : (k + 1) * step].astype({"ts": "datetime64[us]"}).to_parquet(path)
        os.utime(path, (time.time() + k, time.time() + k))
    return str(folder), spark.read.parquet(str(folder)).schema


def run(stream, spark, name, tmp_path, mode="update"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_stream_state_equals_batch(spark, parts, tmp_path):
    folder, schema = parts
    stream = Q.ema_stream(Q.event_stream(spark, folder, schema), "event_type", ["ts", "event_id"], "value", 0.1, 0.5)
    rows = run(stream, spark, "ema", tmp_path)
    got = {r["event_type"]: r["m"]["ema"] for r in rows.groupBy("event_type").agg(F.max(F.struct("visits", "ema")).alias("m")).collect()}
    batch = ordered_ema(spark.read.parquet(folder).where("value is not null"), "event_type", ["ts", "event_id"], "value", 0.1, 0.5)
    assert got == pytest.approx({r["event_type"]: r["ema"] for r in batch.collect()}, rel=1e-9)


def test_windows_and_repeats(spark, parts, tmp_path):
    folder, schema = parts
    counts = run(Q.windowed_counts(Q.event_stream(spark, folder, schema), "ts", ["event_type"], "1 hour", "2 hours"), spark, "win", tmp_path)
    final = counts.groupBy("window", "event_type").agg(F.max("rows").alias("rows"))
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("window"), "event_type").agg(F.count(F.lit(1)).alias("rows"))
    assert final.join(batch, ["window", "event_type", "rows"], "left_semi").count() == final.count() == batch.count()
    once = run(Q.without_repeats(Q.event_stream(spark, folder, schema), "ts", ["event_id"], "10 days"), spark, "once", tmp_path, "append")
    assert once.count() == spark.read.parquet(folder).select("event_id").distinct().count()
    sessions = run(Q.session_counts(Q.event_stream(spark, folder, schema), "ts", ["user_id"], "30 minutes", "1 hour"), spark, "ses", tmp_path, "append")
    assert sessions.count() > 0
