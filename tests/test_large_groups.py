"""Groups and sequences that are larger than a task: matching in rounds, exact quantiles by selection, sequences in blocks."""

import logging
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import aggregates, long_sequence, matching, sequence


def greedy(pairs):
    used, out = set(), set()
    for neg, p, g in sorted((-x, p, g) for p, g, x in pairs):
        if ("p", p) not in used and ("g", g) not in used:
            used |= {("p", p), ("g", g)}
            out.add((p, g, -neg))
    return out


def test_a_dense_island(spark, monkeypatch, caplog):
    """10,000 intervals of one class of one video, all of which overlap in a chain, ties included."""
    rng = random.Random(4)
    intervals = lambda: [(1, k, "x", float(rng.randrange(40_000)), 0.0) for k in range(5000)]
    length = lambda rows: [(v, k, c, st, st + rng.choice((200, 250, 300))) for v, k, c, st, _ in rows]
    pred = spark.createDataFrame(length(intervals()), "video_id int, pred_id int, class_name string, st double, en double")
    gt = spark.createDataFrame(length(intervals()), "video_id int, gt_id int, class_name string, st double, en double")
    pairs = matching.candidates(pred, gt, 0.5, bucket=300.0).cache()
    want = greedy([(r.pred_id, r.gt_id, r.iou) for r in pairs.collect()])
    caplog.set_level(logging.INFO, "spanloom.operators.matching")
    assert {(r.pred_id, r.gt_id, r.iou) for r in matching.greedy_match(pairs).collect()} == want
    assert len([r for r in caplog.records if r.message.startswith("round")]) > 1
    assert pairs.count() > 50 * matching.FOLDED


def test_rounds_and_folds_agree(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(v, "c", p, g, rng.choice((0.5, 0.6, 0.7, 1.0)), 0.0, 1.0) for v in range(20) for p in range(6) for g in range(6) if rng.random() < 0.5]
    pairs = spark.createDataFrame(rows, "video_id int, class_name string, pred_id int, gt_id int, iou double, lo double, hi double")
    want = {(v, *x) for v in range(20) for x in greedy([r[2:5] for r in rows if r[0] == v])}
    for most in (0, 9, 1000):
        monkeypatch.setattr(matching, "FOLDED", most)
        assert {(r.video_id, r.pred_id, r.gt_id, r.iou) for r in matching.greedy_match(pairs).collect()} == want
    assert matching.match_in_rounds(pairs.limit(0), ["video_id"]).isEmpty()


def test_quantiles(spark):
    """Ties, nulls, signs, zeros of both signs, far exponents, a group of nulls and one of a single value."""
    rng = random.Random(6)
    values = {
        "mixed": [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(501)], "ties": [rng.choice((1.5, 2.0)) for _ in range(100)], "one": [3.25], "none": [None, None], "some": [None, 1.0, 4.0],
        "zero": [0.0, -0.0, 0.0, -1.0], "near": [1.0 + k * 2**-52 for k in range(50)], None: [float(k) for k in range(11)],
    }
    rows = [(c, v) for c, vs in values.items() for v in vs]
    rng.shuffle(rows)
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p93": 0.93, "p100": 1.0}
    got = {r.c: r[1:] for r in aggregates.exact_quantiles(spark.createDataFrame(rows, "c string, v double"), ["c"], F.col("v"), probs).collect()}
    assert got.keys() == values.keys()
    for c, vs in values.items():
        known = sorted(v for v in vs if v is not None)
        for k, p in enumerate(probs.values()):
            if not known:
                assert got[c][k] is None
                continue
            at = (len(known) - 1) * p
            low, high = known[int(np.floor(at))], known[int(np.ceil(at))]
            assert got[c][k] == pytest.approx(low + (high - low) * (at - np.floor(at)) if at % 1 else low, rel=1e-12)


def curve(rng, spark, n_sequences=6):
    rows = [(v, k, rng.choice((0.1, 0.3, 0.5, 0.7, 0.9))) for v in [*range(n_sequences), None] for k in range(rng.randrange(1, 90))]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "video_id int, i bigint, p double").repartition(3).cache()


def rounded(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks(spark, block):
    rng = random.Random(block)
    c = curve(rng, spark)
    for win in (1, 4, 5, 23):
        assert rounded(long_sequence.smooth(c, win, block=block)) == rounded(sequence.smooth(c, win))
    for hi, lo in ((0.6, 0.35), (0.8, 0.05), (0.4, 0.4)):
        assert rounded(long_sequence.hysteresis(c, hi, lo, block=block)) == rounded(sequence.hysteresis(c, hi, lo))
    windows = [(v, st, st + 6, rng.choice("ab"), rng.random()) for v in range(5) for st in range(0, 80, 2) if rng.random() < 0.5]
    w = spark.createDataFrame(windows, "video_id int, st bigint, en bigint, cls string, score double").repartition(3)
    for stride in (0, 2, 9):
        for reclassify in (False, True):
            cols = ["video_id", "st", "en", "cls", "score"]
            assert rounded(long_sequence.merge_windows(w, stride, reclassify, block=block).select(cols)) == rounded(sequence.merge_windows(w, stride, reclassify).select(cols))


def test_one_sequence_fills_several_tasks(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("video_id"), F.col("id").alias("i"), (F.col("id") * 37 % 101 / 101).alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = long_sequence.smooth(rows, 9, block=500).groupBy(F.spark_partition_id().alias("part")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 20_000
