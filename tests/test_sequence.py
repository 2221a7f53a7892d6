"""Sequence operators against plain loops on random data."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import sequence as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def curve(spark):
    rng = random.Random(3)
    data = [(v, i, rng.random(), rng.choice("ab")) for v in range(12) for i in range(rng.choice([1, 2, 5, 30]))]
    return data, spark.createDataFrame(data, "video_id bigint, i bigint, p double, cls string").cache()


def curves(data):
    out = {}
    for v, i, p, c in data:
        out.setdefault(v, []).append((i, p, c))
    return {v: sorted(x) for v, x in out.items()}


def test_windows_have_a_tail_and_short_sequences_one(spark):
    clips = spark.createDataFrame([(1, 11), (2, 4), (3, 6)], "video_id bigint, n bigint")
    assert rows(S.sliding_windows(clips, 6, 2), "video_id", "st", "en") == [(1, 0, 6), (1, 2, 8), (1, 4, 10), (1, 5, 11), (2, 0, 4), (3, 0, 6)]


@pytest.mark.parametrize("win", [1, 3, 4, 5])
def test_smooth(curve, win):
    data, df = curve
    got = {(r.video_id, r.i): r.smooth for r in S.smooth(df, win).collect()}
    for v, x in curves(data).items():
        p = [q for _, q, _ in x]
        left, right = win // 2, win - 1 - win // 2
        padded = [p[0]] * left + p + [p[-1]] * right
        for i in range(len(p)):
            assert got[v, i] == pytest.approx(sum(padded[i : i + win]) / win)


def test_hysteresis(curve):
    data, df = curve
    want = []
    for v, x in curves(data).items():
        at = None
        for i, p, _ in x:
            if at is None and p > 0.7:
                at = i
            elif at is not None and p <= 0.3:
                want.append((v, at, i))
                at = None
        if at is not None:
            want.append((v, at, len(x)))
    assert rows(S.hysteresis(df, 0.7, 0.3), "video_id", "st", "en") == sorted(want)


def test_hysteresis_does_not_extend_left(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate((0.4, 0.6, 0.4))], "video_id bigint, i bigint, p double")
    assert rows(S.hysteresis(df, 0.5, 0.35), "st", "en") == [(1, 3)]


def test_run_length(curve):
    data, df = curve
    want = []
    for v, x in curves(data).items():
        run = None
        for i, p, c in [*x, (len(x), 0.0, None)]:
            on = p > 0.5
            if run and (not on or c != run[1]):
                want.append((v, run[1], run[0], i))
                run = None
            if on and run is None:
                run = (i, c)
    assert rows(S.run_length(df, F.col("p") > 0.5, "cls", "p"), "video_id", "cls", "st", "en") == sorted(want)


def test_changepoints(spark):
    rng = random.Random(5)
    data = [(v, i, [rng.gauss(0, 1) for _ in range(4)]) for v in range(5) for i in range((2, 3, 20, 40, 1)[v])]
    df = spark.createDataFrame(data, "video_id bigint, i bigint, emb array<double>")
    want = []
    for v in range(5):
        e = [x for w, _, x in data if w == v]
        norm = [max(sum(a * a for a in x) ** 0.5, 1e-8) for x in e]
        d = [1 - sum(a * b for a, b in zip(e[k], e[k + 1])) / norm[k] / norm[k + 1] for k in range(len(e) - 1)]
        peaks = [k for k in range(1, len(d) - 1) if d[k] >= d[k - 1] and d[k] >= d[k + 1]]
        want += [(v, k) for k in sorted(peaks, key=lambda k: (-d[k - 1], -k))[:4]]
    assert rows(S.changepoints(S.adjacent_distance(df), 4), "video_id", "cp") == sorted(want)


@pytest.mark.parametrize("reclassify", [False, True])
def test_merge_windows(spark, reclassify):
    data = [(1, 0, 6, "a", 0.5), (1, 2, 8, "a", 0.7), (1, 4, 10, "b", 0.6), (1, 6, 12, "a", 0.4)]
    df = spark.createDataFrame(data, "video_id bigint, st bigint, en bigint, cls string, score double")
    want = [(0, 12, "a", 0.7)] if reclassify else [(0, 8, "a", 0.7), (4, 10, "b", 0.6), (6, 12, "a", 0.4)]
    assert rows(S.merge_windows(df, 2, reclassify), "st", "en", "cls", "score") == want


def test_desmear_expand(spark):
    df = spark.createDataFrame([(1, 10, 16, 40)], "video_id bigint, st bigint, en bigint, n bigint")
    cut = S.desmear(df, 6, 2)
    assert rows(cut, "st", "en") == [(12, 14)]
    assert rows(S.expand(cut, 1.25, 2), "st", "en") == [(11, 15)]


def test_snap_moves_no_edge_too_far_and_keeps_spans(spark):
    spans = spark.createDataFrame([(1, 10, 20), (2, 5, 6)], "video_id bigint, st bigint, en bigint")
    points = spark.createDataFrame([(1, 8), (1, 12), (1, 27), (2, 5), (2, 4)], "video_id bigint, cp bigint")
    # Equal distances go to the smaller point; 27 is out of reach; a span that would collapse stays.
    assert rows(S.snap(spans, points, 2, ["video_id"]), "video_id", "st", "en") == [(1, 8, 20), (2, 5, 6)]


def test_bridges(spark):
    spans = spark.createDataFrame([(1, "a", 0, 2), (1, "b", 2, 3), (1, "a", 4, 5), (1, "a", 9, 10)], "video_id bigint, cls string, st bigint, en bigint")
    frames = spark.createDataFrame([(1, i, i / 2) for i in range(12)], "video_id bigint, i bigint, ts double")
    assert rows(S.bridge_frames(spans, frames, 1.5), "cls", "st", "en") == [("a", 0, 5), ("a", 9, 10), ("b", 2, 3)]
    events = spark.createDataFrame([(1, "a", 0.0, 2.0, 0.1), (1, "b", 2.0, 3.0, 0.2), (1, "a", 3.5, 5.0, 0.3), (1, "a", 6.0, 7.0, 0.9)], "video_id bigint, cls string, start_s double, end_s double, score double")
    assert rows(S.bridge_seconds(events, 1.0), "cls", "start_s", "end_s", "score") == [("a", 0.0, 2.0, 0.1), ("a", 3.5, 7.0, 0.9), ("b", 2.0, 3.0, 0.2)]


def test_duration_prior(spark):
    spans = spark.createDataFrame([(1, "a", 10, 12, 100, 0.5), (2, "a", 10, 90, 100, 0.5), (3, "z", 1, 2, 100, 0.5)], "video_id bigint, cls string, st bigint, en bigint, n bigint, step double")
    priors = spark.createDataFrame([("a", 2.0, 5.0, 9.0)], "cls string, p10 double, p50 double, p90 double")
    assert rows(S.duration_prior(spans, priors), "video_id", "st", "en") == [(1, 6, 16), (2, 10, 90), (3, 1, 2)]


def test_running_offsets(spark):
    n = 3000
    df = spark.range(n).select(F.col("id").alias("video_id"), (F.col("id") % 7).alias("n"))
    got = dict(rows(S.running_offsets(df), "video_id", "offset"))
    at = 0
    for k in range(n):
        assert got[k] == at
        at += k % 7
