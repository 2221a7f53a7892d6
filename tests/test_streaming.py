"""Streams give what batches give."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from spanloom.operators import sequence as S
from spanloom.streaming import spans


def drained(df, mode="append"):
    name = "t" + uuid.uuid4().hex
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture
def source(spark, tmp_path):
    rng = random.Random(4)
    rows = [(v, i, rng.random()) for v in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "video_id bigint, i bigint, p double").withColumn("ts", F.timestamp_seconds(F.col("i") * 60))
    for k in range(3):
        df.filter((F.col("i") >= 20 * k) & (F.col("i") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return df, stream


def test_hysteresis(spark, source):
    df, stream = source
    got = {tuple(r) for r in drained(spans.hysteresis(stream, 0.7, 0.3)).collect()}
    want = {(r.video_id, r.st, r.en) for r in S.hysteresis(df, 0.7, 0.3).collect() if r.en < 60}
    assert {g for g in got if g[2] < 60} >= want and len(got) >= len(want)


def test_windows(spark, source):
    df, stream = source
    key = lambda d: {(r.video_id, r.window.start): (r.n, round(r.mean_p, 9)) for r in d.collect()}
    assert key(drained(spans.windowed_scores(stream), "complete")) == key(spans.windowed_scores(df))


def test_sessions(spark, source):
    df, stream = source
    some = lambda d: spans.sessions(d.filter("p > 0.5").withColumn("cls", F.lit("a")), "2 minutes")
    key = lambda d: {(r.video_id, r.start, r.end, r.n) for r in d.collect()}
    assert key(drained(some(stream), "complete")) == key(some(df))
