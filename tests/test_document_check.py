"""Whole submissions against a reader that goes through them in order and stops where the rules say so."""

import json
import random
from collections import Counter

import pytest

from spanloom.plans.document_check import validate_documents
from spanloom.queries import CATALOGUE

CLASSES = ["fire", "smoke"]
MOST = 3000


def read(text, levels):
    """Findings of one document, in a reader's order."""
    out = []
    try:
        doc = json.loads(text)
    except (TypeError, ValueError):
        return [(None, "<file>", "<file>", "is no JSON document")]
    if not isinstance(doc, dict) or "predictions" not in doc:
        return [(None, "<file>", "predictions", "missing required top-level field")]
    if not isinstance(doc["predictions"], list):
        return [(None, "<file>", "predictions", "must be a list")]
    if len(text.encode()) > MOST:
        out.append((None, "<file>", "file_size", "too many bytes"))
    seen = []
    for pos, p in enumerate(doc["predictions"]):
        if not isinstance(p, dict):
            out.append((pos, f"<prediction {pos}>", "prediction", "must be an object"))
        elif "video_id" not in p:
            out.append((pos, f"<prediction {pos}>", "video_id", "missing required field"))
        else:
            video = p["video_id"]
            name = video if isinstance(video, str) else json.dumps(video, separators=(",", ":"))
            if json.dumps(video) in seen:
                out.append((pos, name, "video_id", "duplicate video_id"))
            seen.append(json.dumps(video))
            if not isinstance(video, str) or video not in levels:
                out.append((pos, name, "video_id", "not in manifest"))
            else:
                out += [(pos, video, *f) for f in answer(p, levels[video])]
    out += [(None, video, "video_id", "missing manifest video") for video in levels if json.dumps(video) not in seen]
    return out


def answer(p, level):
    for c in ("events", "runtime_metadata"):
        if c not in p:
            yield c, "missing required field"
    if not isinstance(p.get("events", []), list):
        yield "events", "must be a list"
        return
    for k, e in enumerate(p.get("events", [])):
        at = f"events[{k}]"
        if not isinstance(e, dict):
            yield at, "must be an object"
            continue
        if e.get("class_name") == "normal":
            yield f"{at}.class_name", "'normal' is forbidden; use events: []"
        elif e.get("class_name") not in CLASSES:
            yield f"{at}.class_name", "unknown class string"
        start, end, both = e.get("start_time_sec"), e.get("end_time_sec"), f"{at}.start_time_sec/end_time_sec"
        if level == 1:
            if start is not None or end is not None:
                yield both, "timestamps must both be null for level 1"
        elif start is None or end is None:
            yield both, "timestamps are required for level 2/3"
        else:
            try:
                start, end = float(start), float(end)
            except (TypeError, ValueError):
                yield both, "must be numeric"
            else:
                if start < 0:
                    yield f"{at}.start_time_sec", "must be >= 0"
                if end <= start:
                    yield f"{at}.end_time_sec", "must be greater than start_time_sec"
        if "explanation" in e and not (isinstance(e["explanation"], str) and 20 <= len(e["explanation"]) <= 500):
            yield f"{at}.explanation", "must be a 20-500 character string"
    metadata = p.get("runtime_metadata")
    if metadata is None:
        return
    if not isinstance(metadata, dict):
        yield "runtime_metadata", "must be an object"
        return
    runs = metadata.get("model_runtimes", [])
    if not isinstance(runs, list):
        yield "runtime_metadata.model_runtimes", "must be a list"
        return
    for k, r in enumerate(runs):
        at = f"runtime_metadata.model_runtimes[{k}]"
        if not isinstance(r, dict):
            yield at, "must be an object"
            continue
        if {"total_time_ms", "call_count", "average_time_ms"} <= r.keys():
            total, n, mean = (r[c] for c in ("total_time_ms", "call_count", "average_time_ms"))
            numbers = all(isinstance(x, (int, float)) for x in (total, n, mean))
            if not numbers or n <= 0 or mean == 0 or abs(mean - total / n) / abs(mean) > 0.02:
                yield f"{at}.average_time_ms", "must equal total_time_ms/call_count within 2%"
        if "call_times_ms" in r and "call_count" in r:
            times = r["call_times_ms"]
            if not isinstance(times, list) or len(times) != r["call_count"]:
                yield f"{at}.call_times_ms", "length must equal call_count"


def some(rng, *values):
    return rng.choice(values)


def event(rng):
    e = {"class_name": some(rng, "fire", "smoke", "fire", "normal", "alien", None, 5)}
    for c in ("start_time_sec", "end_time_sec"):
        e[c] = some(rng, 1, 2.5, 7, None, "3", "soon", -1, [1], {"a": 1}, True)
    if rng.random() < 0.5:
        e["explanation"] = some(rng, "x" * 30, "short", None, 4, ["x" * 30], "é" * 20)
    for c in rng.sample(sorted(e), rng.randrange(2)):
        del e[c]
    return some(rng, e, e, e, e, 4, None, [e])


def run(rng):
    n, mean = some(rng, 0, 2, 4, "4", -1, True), some(rng, 2.0, 0, 5, "2", 2.03)
    r = {"total_time_ms": some(rng, 8, 4.0, 10, "8"), "call_count": n, "average_time_ms": mean, "call_times_ms": some(rng, [1, 2], [1, 2, 3, 4], [], "ab")}
    for c in rng.sample(sorted(r), rng.randrange(3)):
        del r[c]
    return some(rng, r, r, r, 3)


def prediction(rng):
    p = {"video_id": some(rng, "a", "b", "c", "d", "z", 5, None, "5"), "events": some(rng, [], [event(rng) for _ in range(3)], [event(rng)], "none", None, {}), "runtime_metadata": some(rng, {}, None, 4, {"model_runtimes": [run(rng), run(rng)]}, {"model_runtimes": 3}, {"model_runtimes": []})}
    for c in rng.sample(sorted(p), rng.randrange(2)):
        del p[c]
    return some(rng, p, p, p, p, p, p, 7, None, [p])


def test_documents(spark):
    rng = random.Random(3)
    texts = [json.dumps({"schema_version": "1", "predictions": [prediction(rng) for _ in range(rng.randrange(12))]}) for _ in range(150)]
    texts += ['{"predictions": 4}', '{"predictions": null}', '{"events": []}', "[1]", "7", "{", "", None, '{"predictions": []}', json.dumps({"predictions": [], "pad": "é" * MOST})]
    levels = {"a": 1, "b": 2, "c": 3, "d": 2, "quiet": 1}
    docs = spark.createDataFrame([*enumerate(texts)], "doc int, value string").repartition(3)
    manifest = spark.createDataFrame([(k, v, n) for k in range(len(texts)) for v, n in levels.items()], "doc int, video_id string, level int")
    got = sorted((r.doc, -1 if r.pos is None else r.pos, r.video_id, r.field, r.problem) for r in validate_documents(docs, manifest, CLASSES, ["doc"], MOST).collect())
    want = sorted((k, -1 if pos is None else pos, *rest) for k, t in enumerate(texts) for pos, *rest in read(t, levels))
    assert got == want
    assert validate_documents(docs.limit(0), manifest, CLASSES, ["doc"]).isEmpty()


@pytest.fixture(scope="module")
def two_videos(spark, tmp_path_factory):
    """Events of video 10, which the manifest has, and of 11, which it hasn't; each with a class that isn't known."""
    path = tmp_path_factory.mktemp("two_videos")
    rows = [(17, 10, "view", 1.0), (34, 11, "view", 1.0), (35, 11, "click", 1.0)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").write.parquet(str(path / "events.parquet"))
    spark.createDataFrame([(10,), (11,)], "c_custkey bigint").write.parquet(str(path / "customer.parquet"))
    return str(path)


_PARTS = ("v_ids", "v_class", "v_times", "v_explanation", "v_runtime", "v_duration", "v_warn")


def test_validate_all_counts_events_outside_the_manifest(spark, two_videos):
    query = {name: CATALOGUE[name][0] for name in ("validate_all", *_PARTS)}
    found = {(r.field, r.problem, r.severity): r.n for r in query["validate_all"](spark, two_videos).collect()}
    assert found["class_name", "unknown class", "error"] == 2
    rows = [r for name in _PARTS for r in query[name](spark, two_videos).collect()]
    assert found == Counter((r.field, r.problem, r.severity) for r in rows)


def test_validation_passed_counts_events_outside_the_manifest(spark, two_videos):
    rows = [r for name in _PARTS for r in CATALOGUE[name][0](spark, two_videos).collect()]
    errors = sum(r.severity == "error" for r in rows)
    assert CATALOGUE["validation_passed"][0](spark, two_videos).collect() == [(False, errors, len(rows) - errors)]
