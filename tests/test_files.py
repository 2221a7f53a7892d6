import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import decisions as D
from spanloom.operators import relations as R
from spanloom.operators import validation as K
from spanloom.plans import submission as B
from spanloom.sources import readers as I
from spanloom.sources.schemas import PREDICTION


@pytest.mark.parametrize("text", ['[{"video_id": "T1", "level": 2, "duration_sec": 3.5}]', '{"videos": [{"video_id": "T1", "level": 2, "duration_sec": 3.5}]}', '{"T1": {"level": 2, "duration_sec": 3.5}}', "video_id,level,duration_sec\nT1,2,3.5\n"])
def test_manifest_encodings(spark, tmp_path, text):
    path = tmp_path / ("m.csv" if text.startswith("video") else "m.json")
    path.write_text(text)
    assert [(r.video_id, r.level, r.duration_sec) for r in I.read_manifest(spark, str(path)).collect()] == [("T1", 2, 3.5)]


def test_manifest_of_levels(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"T1": 1, "T2": 3}')
    assert sorted((r.video_id, r.level) for r in I.read_manifest(spark, str(tmp_path / "m.json")).collect()) == [("T1", 1), ("T2", 3)]


def test_ground_truth_bools(spark, tmp_path):
    (tmp_path / "g.csv").write_text("video_id,level,is_anomaly,class_name,start_time_sec,end_time_sec\na,2,TRUE,fire,1,2\nb,1,maybe,,,\n")
    loose = {r.video_id: r.is_anomaly for r in I.read_ground_truth(spark, str(tmp_path / "g.csv"), strict=False).collect()}
    assert loose == {"a": True, "b": False}
    with pytest.raises(Exception, match="not a boolean"):
        I.read_ground_truth(spark, str(tmp_path / "g.csv")).collect()


def test_videos_by_folder(spark, tmp_path):
    (tmp_path / "fire").mkdir()
    (tmp_path / "fire/videos.csv").write_text("video_id,filename\nv1,a.mp4\n")
    assert [(r.video_id, r.class_name) for r in I.read_videos(spark, str(tmp_path)).collect()] == [("v1", "fire")]


def test_override():
    assert I.override({"a": {"b": 1}}, "a.b=2.5") == {"a": {"b": 2.5}}
    with pytest.raises(KeyError):
        I.override({"a": {"b": 1}}, "a.c=2")


def test_append_new_is_resumable(spark, tmp_path):
    frames = spark.createDataFrame([("a", 0, 0.0, [1.0]), ("b", 0, 0.0, [2.0])], "video_id string, frame_idx int, ts double, emb array<float>")
    path = str(tmp_path / "cache")
    I.append_new(frames.filter("video_id = 'a'"), path)
    I.append_new(frames, path)
    assert sorted(r.video_id for r in I.read_frames(spark, path).collect()) == ["a", "b"]


def test_one_to_one_join_fails_on_repeats(spark):
    a, b = spark.createDataFrame([(1, 1), (1, 2)], "k int, x int"), spark.createDataFrame([(1, 3)], "k int, y int")
    with pytest.raises(Exception, match="repeats"):
        R.join_one_to_one(a, b, "k").collect()


def test_events_serialised(spark):
    rows = [(1, "fire", None, None, 0.5, "short"), (2, "fire", 1.0, 2.0, 0.5, "x" * 20)]
    df = spark.createDataFrame(rows, "level int, class_name string, start_time_sec double, end_time_sec double, score double, explanation string")
    a, b = (json.loads(r[0]) for r in D.checked_events(df).select(D.event_json()).collect())
    assert a == {"class_name": "fire", "start_time_sec": None, "end_time_sec": None, "score": 0.5}
    assert b["explanation"] == "x" * 20
    for bad in ((1, "fire", 0.0, 1.0, 0.5, None), (2, "normal", 0.0, 1.0, 0.5, None), (2, "fire", 1.0, 1.0, 0.5, None)):
        with pytest.raises(Exception, match="bad event"):
            D.checked_events(spark.createDataFrame([bad], df.schema)).collect()


def test_latest_prediction_wins(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "video_id string, pos int, v string")
    assert [(r.video_id, r.v) for r in B.latest(df).collect()] == [("a", "y")]


def test_rules_pass_a_good_submission(spark):
    events = spark.createDataFrame([("a", 2, "fire", "1.0", "2.0", "y" * 30)], "video_id string, level int, class_name string, start_time_sec string, end_time_sec string, explanation string")
    dur = spark.createDataFrame([("a", 10.0)], "video_id string, dur double")
    for found in (K.check_class(events, ["fire"]), K.check_times(events), K.check_explanation(events), K.check_duration(events, dur)):
        assert found.isEmpty()
    bad = events.withColumn("end_time_sec", F.lit("11"))
    assert K.check_duration(bad, dur).count() == 1


@pytest.mark.parametrize("average, n", [(10.0, 0), (10.3, 1), (10.1, 0)])
def test_runtime_two_percent(spark, average, n):
    df = spark.createDataFrame([("a", 100.0, 10, average, 10)], "video_id string, total_time_ms double, call_count bigint, average_time_ms double, n_times bigint")
    assert K.check_runtime(df).count() == n


def test_missing_parts(spark):
    lines = spark.createDataFrame([(json.dumps({"video_id": "a", "events": []}),), (json.dumps({"video_id": "b", "runtime_metadata": {"frames_processed": 1}}),)], "value string")
    parsed = lines.select(F.from_json("value", PREDICTION).alias("p")).select("p.*").withColumn("hardware", F.lit(None).cast("string"))
    got = sorted((r.video_id, r.problem, r.severity) for r in K.check_present(parsed, ("hardware",)).collect())
    assert got == [("a", "missing hardware", "warn"), ("a", "missing runtime_metadata", "error"), ("b", "missing events", "error"), ("b", "missing hardware", "warn")]


def test_embedding_cache(spark, tmp_path):
    """A folder of .npz files: frames and clips come back; a clip's row needs no embeddings; a broken file is one error."""
    rng = np.random.default_rng(3)
    (tmp_path / "test").mkdir()
    want = {}
    for k, n in enumerate((0, 1, 7, 30)):
        emb, ts = rng.normal(size=(n, 4)).astype(np.float16), (np.arange(n) / 2).astype(np.float32)
        want[f"v{k}"] = (emb, ts)
        more = {} if k == 1 else {"extract_time_ms": 12.5}
        np.savez(tmp_path / ("test" if k % 2 else "") / f"v{k}.npz", emb=emb, ts=ts, dur=n / 2, fps=25.0, **more)
    np.savez(tmp_path / "odd.npz", emb=np.zeros((2, 4)), ts=np.zeros(3), dur=1.0, fps=25.0)
    np.savez(tmp_path / "short.npz", emb=np.zeros((2, 4)))
    (tmp_path / "broken.npz").write_bytes(b"no archive")
    (tmp_path / "other.txt").write_text("x")
    frames = I.read_cache_frames(spark, str(tmp_path)).collect()
    for video, (emb, ts) in want.items():
        own = sorted((r for r in frames if r.video_id == video), key=lambda r: r.i)
        assert [r.ts for r in own] == ts.tolist() and [list(r.emb) for r in own] == emb.astype(np.float32).tolist()
    assert {r.video_id for r in frames} == {"v1", "v2", "v3"}
    clips = {r.video_id: r for r in I.read_cache_clips(spark, str(tmp_path)).collect()}
    assert {v: (r.n, r.dur, r.fps, r.extract_time_ms) for v, r in clips.items() if not r.error} == {f"v{k}": (n, n / 2, 25.0, 0.0 if k == 1 else 12.5) for k, n in enumerate((0, 1, 7, 30))} | {"odd": (3, 1.0, 25.0, 0.0)}
    assert {v for v, r in clips.items() if r.error} == {"short", "broken"}


def test_embeddings_that_nobody_asks_for_stay_closed(spark, tmp_path):
    """A file whose embeddings are damaged still gives its times and its clip."""
    np.savez(tmp_path / "v.npz", emb=np.ones((50, 8)), ts=np.arange(50.0), dur=25.0, fps=2.0)
    whole = bytearray((tmp_path / "v.npz").read_bytes())
    at = whole.index(b"emb.npy") + 200
    whole[at : at + 50] = b"?" * 50
    (tmp_path / "v.npz").write_bytes(bytes(whole))
    assert I.read_cache_frames(spark, str(tmp_path)).count() == 0
    assert I.read_cache_frames(spark, str(tmp_path), emb=False).count() == 50
    assert I.read_cache_clips(spark, str(tmp_path)).first().n == 50
