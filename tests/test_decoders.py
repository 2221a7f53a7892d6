"""The decoders in full, trials of them, and submissions in files, against loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import matching as M
from spanloom.operators import sequence as S
from spanloom.plans import decode, submission, sweep
from spanloom.sources import readers


def loop_events(curve, ts, win, hi, lo, points, within, gap, priors, expand, least_s):
    """One video's events by the written rules, one class after another."""
    steps = sorted(b - a for a, b in zip(ts, ts[1:], strict=False))
    step = (steps[(len(steps) - 1) // 2] + steps[len(steps) // 2]) / 2 if steps else 0.5
    out, n = [], len(ts)
    for cls, p in curve.items():
        left, right = win // 2, win - 1 - win // 2
        padded = [p[0]] * left + p + [p[-1]] * right
        smooth = [sum(padded[i : i + win]) / win for i in range(n)]
        spans, i = [], 0
        while i < n:
            if smooth[i] > hi:
                j = i
                while j < n and smooth[j] > lo:
                    j += 1
                spans.append([i, j])
                i = j
            i += 1
        for s in spans:
            near = [min((c for c in points if abs(c - x) <= within), key=lambda c: (abs(c - x), c), default=x) for x in s]  # noqa: B023
            if near[1] > near[0]:
                s[:] = near
        merged = []
        for s, e in sorted(map(tuple, spans)):
            if merged and ts[s] - ts[merged[-1][1] - 1] <= gap:
                merged[-1][1] = e
            else:
                merged.append([s, e])
        done = []
        for s, e in merged:
            if cls in priors and ts[e - 1] - ts[s] + step < priors[cls][0]:
                half, centre = max(1, round(priors[cls][1] / step / 2)), (s + e - 1) / 2
                s, e = max(0, math.floor(centre - half)), min(n, math.ceil(centre + half + 1))
            centre, half = (s + e - 1) / 2, (e - s) * expand / 2
            done.append((max(0, math.floor(centre - half)), min(n, math.ceil(centre + half + 1))))
        for s, e in done:
            start, end = ts[s], ts[e - 1] + step
            if end - start >= least_s:
                out.append((cls, round(start, 6), round(end, 6), round(sum(smooth[s:e]) / (e - s), 6)))
    return sorted(out)


def test_extract_events(spark):
    rng, rows, frames, points, want = random.Random(5), [], [], [], []
    priors = {1: (2.0, 3.0), 2: (0.1, 9.0)}
    for v in range(25):
        n = rng.choice((1, 2, 7, 30, 60))
        ts = [0.5 * i + (0.1 if rng.random() < 0.2 and i > 1 else 0.0) for i in range(n)]
        curve = {}
        for cls in range(3):
            p, level = [], 0.3
            for _ in range(n):
                level = min(1.0, max(0.0, level + rng.uniform(-0.25, 0.25)))
                p.append(level)
            curve[cls] = p
            rows += [(v, i, cls, x) for i, x in enumerate(p)]
        frames += [(v, i, t) for i, t in enumerate(ts)]
        own = sorted(rng.sample(range(n), min(n, 5)))
        points += [(v, c) for c in own]
        want += [(v, *e) for e in loop_events(curve, ts, 3, 0.5, 0.35, own, 3, 1.0, priors, 1.1, 1.0)]
    found = decode.extract_events(
        spark.createDataFrame(rows, "video_id bigint, i bigint, cls bigint, p double"), spark.createDataFrame(frames, "video_id bigint, i bigint, ts double"), win=3, hi=0.5, lo=0.35, gap=1.0, expand=1.1, least_s=1.0,
        points=spark.createDataFrame(points, "video_id bigint, cp bigint"), within=3, priors=spark.createDataFrame([(k, *x) for k, x in priors.items()], "cls bigint, p10 double, p50 double"),
    ).collect()
    assert sorted((r.video_id, r.cls, round(r.start_s, 6), round(r.end_s, 6), round(r.score, 6)) for r in found) == sorted(want) and len(want) > 20
    for v in {r.video_id for r in found}:
        own = sorted((r for r in found if r.video_id == v), key=lambda r: r.k)
        assert [r.k for r in own] == list(range(1, len(own) + 1)) and all(a.score >= b.score for a, b in zip(own, own[1:], strict=False))


def test_equal_events_stay(spark):
    """Two bumps whose spans come to the same interval are two events."""
    p = [0.9 if i in (4, 5, 12, 13) else 0.1 for i in range(20)]
    curve = spark.createDataFrame([(1, i, 0, x) for i, x in enumerate(p)], "video_id bigint, i bigint, cls bigint, p double")
    frames = spark.createDataFrame([(1, i, i / 2) for i in range(20)], "video_id bigint, i bigint, ts double")
    found = decode.extract_events(curve, frames, win=1, hi=0.5, lo=0.3, gap=0.5, expand=20.0, least_s=1.0).collect()
    assert sorted((r.start_s, r.end_s, r.k) for r in found) == [(0.0, 10.0, 1), (0.0, 10.0, 2)]
    assert len(loop_events({0: p}, [i / 2 for i in range(20)], 1, 0.5, 0.3, [], 3, 0.5, {}, 20.0, 1.0)) == 2


@pytest.fixture(scope="module")
def clips(spark):
    rng = random.Random(6)
    frames = [(v, i, i / 2, [rng.gauss(0, 1) for _ in range(4)]) for v in range(12) for i in range(rng.choice((1, 5, 30)))]
    head = [(c, [rng.gauss(0, 1) for _ in range(4)]) for c in range(4)]
    return spark.createDataFrame(frames, "video_id bigint, i bigint, ts double, emb array<double>").cache(), spark.createDataFrame(head, "class_idx bigint, w array<double>")


def test_trials_are_single_decoders(spark, clips):
    frames, head = clips
    points = S.changepoints(S.adjacent_distance(frames), 8)
    trials = [
        {"width": 4, "stride": 2, "threshold": 0.4, "expand": 1.0, "snap": False, "most_events": 2, "gap": 0.0}, {"width": 4, "stride": 2, "threshold": 0.3, "expand": 1.25, "snap": True, "most_events": 9, "gap": 3.0},
        {"width": 6, "stride": 1, "threshold": 0.3, "expand": 1.25, "snap": True, "most_events": 1, "gap": 0.0},
    ]
    show = lambda rows: sorted((r.video_id, r.cls, r.start_s, r.end_s, round(r.score, 9), r.k) for r in rows)
    events = decode.trial_events(frames, head, trials, normal=3, least=2, points=points, within=4, most_span=0.8).cache()
    for k, t in enumerate(trials):
        one = decode.window_events(frames, head, normal=3, threshold=t["threshold"], width=t["width"], stride=t["stride"], expand=t["expand"], least=2, points=points if t["snap"] else None, within=4, gap=t["gap"], most_events=t["most_events"], most_span=0.8)
        assert show(events.filter(f"trial = {k}").collect()) == show(one.collect()) != []
    videos = frames.select("video_id").distinct().selectExpr("video_id", "2 + video_id % 2 as level", "true as is_anomaly")
    gt = videos.selectExpr("video_id", "video_id as gt_id", "cast(video_id % 3 as string) as class_name", "1.0D as st", "8.0D as en")
    named = events.selectExpr("trial", "video_id", "k as pred_id", "cast(cls as string) as class_name", "start_s as st", "end_s as en", "score")
    got = {r.trial: (r.min_total, r.median_total) for r in sweep.trial_totals(named, videos, gt, 4).collect()}
    for k in range(4):
        grid = sweep.sensitivity(M.video_components(videos, named.filter(f"trial = {k}"), gt), M.level1_accuracy(videos.filter("level = 1"), named.filter(f"trial = {k}"), gt))
        r = sweep.summary(grid).first()
        assert got[k] == (pytest.approx(r.total_min), pytest.approx(r.total_median))
    best = sweep.best_trials(sweep.trial_totals(named, videos, gt, 4), 3).collect()
    assert [r.trial for r in sorted(best, key=lambda r: r.place)] == sorted(got, key=lambda k: (-got[k][0], -got[k][1], k))[:3]


def test_greedy_match_by_islands(spark):
    rng = random.Random(7)
    boxes = lambda n, name: [(v, k, "c", s, s + rng.randrange(2, 12)) for v in range(3) for k in range(n) for s in [float(rng.randrange(0, 150))]]  # noqa: E731, ARG005
    p = spark.createDataFrame(boxes(40, "p"), "video_id int, pred_id int, class_name string, st double, en double")
    g = spark.createDataFrame(boxes(40, "g"), "video_id int, gt_id int, class_name string, st double, en double")
    pairs = M.candidates(p, g, 0.3)
    plain, split = (sorted(map(tuple, M.greedy_match(x).collect())) for x in (pairs.drop("lo", "hi"), pairs))
    assert plain == split != []


def test_envelope_is_a_json_document(spark, tmp_path):
    rows = [(f"T{k:03d}", "c", float(k), k + 1.0, 0.5, 'say "x"') for k in range(40)]
    events = spark.createDataFrame(rows, "video_id string, class_name string, start_time_sec double, end_time_sec double, score double, explanation string").repartition(5)
    submission.write_envelope(events, f"file://{tmp_path}/out", "2.1")
    files = sorted((tmp_path / "out").glob("part-*"))
    doc = json.loads("".join(f.read_text() for f in files))
    assert doc["schema_version"] == "2.1" and [p["video_id"] for p in doc["predictions"]] == sorted(r[0] for r in rows)
    back = submission.read_envelope(spark.read.text(f"file://{tmp_path}/out"))
    assert sorted(tuple(r)[0:1] + tuple(r)[2:] for r in back.collect()) == sorted(rows)


def test_error_rows_heads_and_metrics(spark, tmp_path):
    (tmp_path / "v.csv").write_text("video_id,level\na,1\nb,x\nc,3\n")
    good, bad = readers.read_checked(spark, f"file://{tmp_path}/v.csv", "video_id string, level int")
    assert sorted(map(tuple, good.collect())) == [("a", 1), ("c", 3)]
    assert [(r.line, r.file.endswith("v.csv")) for r in bad.collect()] == [("b,x", True)]
    head = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "class_idx bigint, w array<double>")
    readers.write_head(head.withColumn("more", F.lit(1)), f"file://{tmp_path}/head")
    assert sorted(map(tuple, readers.read_head(spark, f"file://{tmp_path}/head").collect())) == sorted(map(tuple, head.collect()))
    metrics = spark.createDataFrame([(1, 0.5, None), (2, 0.75, 3)], "epoch int, f1 double, n int")
    readers.write_metrics(metrics, f"file://{tmp_path}/metrics")
    assert sorted(map(str, readers.read_metrics(spark, f"file://{tmp_path}/metrics", "epoch int, f1 double, n int").collect())) == sorted(map(str, metrics.collect()))


def test_a_parameter_set_without_spans_has_a_row(spark, tmp_path):
    """A video whose five classes have equal probability (0.2) and a normal one: spans under thresholds of 0.15 and 0.2, none under 0.25; and no frames at all."""
    import duckdb

    from spanloom.queries import CATALOGUE

    query, sql = CATALOGUE["sweep_decode_grid"]
    for n in (100, 0):
        own = F.col("id") < 50
        rows = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.when(own, 0.5).otherwise(-0.5).cast("float")] * 64).alias("embedding"), F.when(own, F.col("id") % 5).otherwise(9).cast("int").alias("label"))
        rows.write.parquet(str(tmp_path / f"{n}" / "embeddings.parquet"))
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/{n}/embeddings.parquet/*.parquet')")
        found = sorted(map(tuple, query(spark, str(tmp_path / f"{n}")).collect()))
        assert found == sorted(con.execute(sql).fetchall())
        assert [r[:2] for r in found] == [(0, n // 100), (1, n // 100), (2, 0)]
