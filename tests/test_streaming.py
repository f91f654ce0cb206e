import random
import time

import pytest
from pyspark.sql import functions as F

from folioforge.streaming import rates


def test_sequential_limiter():
    limits = rates.Limits(per_minute=5, per_hour=8, burst=2, cooldown_seconds=100)
    got = rates.admit([0, 1, 2, 3, 4, 5, 6, 50, 105, 110], limits)
    # 0.8 of five is four: the fifth request starts a burst
    assert got == ["ok", "ok", "ok", "ok", "ok", "minute", "minute", "minute", "ok", "ok"]
    assert rates.admit([0, 0.1, 0.2, 0.3], rates.Limits(per_minute=1, burst=1)) == ["ok", "burst", "cooldown", "cooldown"]
    assert rates.admit([100 * k for k in range(5)], rates.Limits(per_hour=3)) == ["ok", "ok", "ok", "hour", "hour"]


def test_stream_replays_the_limiter(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), round(t, 1)) for t in sorted(rng.uniform(0, 400) for _ in range(120))]
    source = tmp_path / "in"
    source.mkdir()
    df = spark.createDataFrame(rows, "domain string, s double").select("domain", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))
    df.coalesce(1).write.parquet(str(source / "part"))
    limits = rates.Limits(per_minute=10, per_hour=40, burst=3, cooldown_seconds=60)
    stream = spark.readStream.schema(df.schema).parquet(str(source / "part"))
    query = rates.admissions(stream, "domain", limits).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).start()
    # a query with timeouts doesn't end by itself
    for _ in range(90):
        if spark.table("admitted").count() == len(rows):
            break
        time.sleep(0.5)
    query.stop()
    got = {}
    for r in spark.table("admitted").orderBy("domain", "at").collect():
        got.setdefault(r["domain"], []).append(r["decision"])
    for domain in "ab":
        times = sorted(t for d, t in rows if d == domain)
        assert got[domain] == rates.admit(times, limits)


def test_stream_windows(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    query = rates.sliding_hours(stream, "event_type", slide="15 minutes").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    total = spark.table("hours").agg(F.sum("n")).first()[0]
    assert total == 4 * spark.read.parquet(path).count()


def test_flags(spark):
    df = spark.createDataFrame([(1, "a", k) for k in range(5)], "id long, d string, s long").withColumn("ts", F.timestamp_seconds("s"))
    flagged = rates.limit_flags(rates.window_counts(df, "d"), rates.Limits(per_minute=3))
    assert [r["allowed"] for r in flagged.orderBy("s").collect()] == [True, True, True, False, False]


@pytest.mark.parametrize("gap", ["10 seconds"])
def test_sessions(spark, gap):
    df = spark.createDataFrame([("a", s) for s in (0, 5, 30, 35, 60)], "d string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r["n"] for r in rates.sessions(df, "d", gap).collect()) == [1, 2, 2]
