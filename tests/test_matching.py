"""Matching and scores against loops, known values and published floors."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.intervals import half_even, iou
from spanloom.operators import matching as M
from spanloom.plans import sweep as W


def loop(pred, gt, thr):
    def overlap(a, b):
        hull = max(a[1], b[1]) - min(a[0], b[0])
        return max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / hull if hull > 0 else 0.0

    out = set()
    for v, c in {x[:2] for x in pred}:
        pairs = sorted((-overlap(p[3:], g[3:]), p[2], g[2]) for p in pred for g in gt if p[:2] == (v, c) == g[:2])
        used_p, used_g = set(), set()
        for n, p, g in pairs:
            if -n >= thr and p not in used_p and g not in used_g:
                out.add((v, p, g))
                used_p.add(p)
                used_g.add(g)
    return out


@pytest.mark.parametrize("parts, bucket", [(1, 3.0), (7, 100.0)])
def test_greedy_match(spark, parts, bucket):
    rng = random.Random(1)
    make = lambda n: [(rng.randrange(6), rng.choice("ab"), k, (s := rng.random() * 20), s + rng.random() * 10) for k in range(n)]
    pred, gt = make(150), make(150)
    df = lambda x, k: spark.createDataFrame(x, f"video_id bigint, class_name string, {k} bigint, st double, en double").repartition(parts)
    got = {(r.video_id, r.pred_id, r.gt_id) for r in M.greedy_match(M.candidates(df(pred, "pred_id"), df(gt, "gt_id"), 0.3, bucket)).collect()}
    assert got == loop(pred, gt, 0.3)


def test_greedy_is_not_optimal(spark):
    pairs = spark.createDataFrame([(1, "a", 0, 0, 0.9), (1, "a", 0, 1, 0.8), (1, "a", 1, 0, 0.85)], "video_id bigint, class_name string, pred_id bigint, gt_id bigint, iou double")
    assert [(r.pred_id, r.gt_id) for r in M.greedy_match(pairs).collect()] == [(0, 0)]


def test_iou_identities(spark):
    df = spark.createDataFrame([(0.0, 10.0, 5.0, 15.0), (0.0, 1.0, 2.0, 3.0), (1.0, 1.0, 1.0, 1.0), (0.0, None, 0.0, 1.0), (0.0, 10.0, 2.5, 7.5)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(iou(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == pytest.approx([1 / 3, 0, 0, 0, 0.5])


def test_half_even(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, -0.5, 7.5)], "x double")
    assert [r[0] for r in df.select(half_even(F.col("x"))).collect()] == [0, 2, 2, 0, 8]


def components(spark, rows):
    return spark.createDataFrame(rows, "video_id bigint, level bigint, is_anomaly boolean, n_pred bigint, n_gt bigint, matched bigint, f1 double, mean_iou double")


def test_silent_floor(spark):
    """24 level 1 videos (4 normal), 6 level 2 (2 normal) and 4 level 3 (none), and no events: 15.8333."""
    rows = [(k, 2, k >= 2, 0, int(k >= 2), 0, 0.0, 0.0) for k in range(6)] + [(10 + k, 3, True, 0, 1, 0, 0.0, 0.0) for k in range(4)]
    videos = spark.createDataFrame([(k, k >= 4) for k in range(24)], "video_id bigint, is_anomaly boolean")
    pred = spark.createDataFrame([], "video_id bigint, pred_id bigint, class_name string, st double, en double, score double")
    gt = spark.createDataFrame([(k, k, "fire", 0.0, 1.0) for k in range(4, 24)], "video_id bigint, gt_id bigint, class_name string, st double, en double")
    level1 = M.level1_accuracy(videos, pred, gt)
    assert W.submission_total(components(spark, rows), level1).first()["total"] == pytest.approx(15.8333, abs=1e-4)


def test_alert_only_and_grid(spark):
    rows = [(1, 3, True, 1, 1, 0, 0.0, 0.0), (2, 2, False, 0, 0, 0, 0.0, 0.0)]
    level1 = spark.createDataFrame([(0.0,)], "score double")
    grid = W.sensitivity(components(spark, rows), level1).collect()
    assert len(grid) == 9
    assert {(r.w3, round(r.d3, 6)) for r in grid} == {(0, 8.0), (1, 8.0), (2, 12.0)}
    assert {round(r.d2, 6) for r in grid} == {35.0}


def test_checkpoint_falls_back_to_recall(spark):
    t = lambda rows: spark.createDataFrame(rows, "epoch bigint, recall double, emitted bigint, score double")
    assert W.select_checkpoint(t([(1, 0.3, 50, 0.5), (2, 0.3, 50, 0.5), (3, 0.1, 99, 0.9)]), 0.25, 40).first()[0] == 1
    assert W.select_checkpoint(t([(1, 0.1, 50, 0.5), (2, 0.2, 10, 0.1)]), 0.25, 40).first()[0] == 2
