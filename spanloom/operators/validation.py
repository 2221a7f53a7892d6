"""Checks of a submission. Rules give rows (video_id, field, problem, severity); the rules about one table's rows go through it once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROBLEM = ["video_id", "field", "problem", "severity"]
#: Lengths of an explanation, share by which a stated mean may differ, most events and largest share of a video.
EXPLANATION_CHARS, MEAN_TOLERANCE, MANY_EVENTS, LONG_SHARE = (20, 500), 0.02, 8, 0.8


def _problem(rows: DataFrame, where: Column, field: str, problem: str, severity: str = "error") -> DataFrame:
    return rows.filter(where).select("video_id", F.lit(field).alias("field"), F.lit(problem).alias("problem"), F.lit(severity).alias("severity"))


def _problems(rows: DataFrame, *rules: tuple[Column, str, str]) -> DataFrame:
    """The errors (where, field, problem) of each row, in one pass."""
    found = F.array(*(F.when(where, F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem"), F.lit("error").alias("severity"))) for where, field, problem in rules))
    return rows.select("video_id", F.inline(F.array_compact(found)))


def check_shape(docs: DataFrame, most_bytes: int, col: str = "value") -> DataFrame:
    """Documents (JSON texts) whose parts aren't what they have to be: predictions missing or no list, a prediction or event that is no object, events that
    are no list, or more bytes than allowed. video_id is <file> where no prediction is concerned."""
    body = F.get_json_object(col, "$.predictions")
    is_list, is_object = (lambda c, ch=ch: F.coalesce(F.startswith(F.ltrim(c), F.lit(ch)), F.lit(False)) for ch in "[{")
    file = docs.withColumn("video_id", F.lit("<file>"))
    listed = docs.filter(is_list(body)).select(F.posexplode(F.from_json(body, "array<string>")).alias("pos", "p"))
    raw = F.get_json_object("p", "$.events")
    objects = listed.filter(is_object(F.col("p"))).select(F.get_json_object("p", "$.video_id").alias("video_id"), raw.alias("events"))
    events = objects.filter(is_list(F.col("events"))).select("video_id", F.posexplode(F.from_json("events", "array<string>")).alias("pos", "e"))
    prefix = lambda name: F.concat(F.lit(f"{name}["), F.col("pos").cast("string"), F.lit("]"))
    shaped = lambda rows, video, name: rows.select(video.alias("video_id"), prefix(name).alias("field"), F.lit("must be an object").alias("problem"), F.lit("error").alias("severity"))
    return reduce(DataFrame.unionAll, [
        _problems(file, (body.isNull(), "predictions", "missing required top-level field"), (body.isNotNull() & ~is_list(body), "predictions", "must be a list"), (F.octet_length(col) > most_bytes, "file_size", "too many bytes")),
        shaped(listed.filter(~is_object(F.col("p"))), F.lit("<file>"), "predictions"),
        _problems(objects, (F.col("events").isNotNull() & ~is_list(F.col("events")), "events", "must be a list")),
        shaped(events.filter(~is_object(F.col("e"))), F.col("video_id"), "events"),
    ])


def check_ids(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Repeats (each but the first by pos), ids outside the manifest, ids of it that are missing."""
    again = predictions.withColumn("_k", F.row_number().over(Window.partitionBy("video_id").orderBy("pos")))
    always = F.lit(True)
    return reduce(DataFrame.unionAll, [
        _problem(predictions, F.col("video_id").isNull(), "video_id", "missing video_id"),
        _problem(again, (F.col("_k") > 1) & F.col("video_id").isNotNull(), "video_id", "duplicate video_id"),
        _problem(predictions.join(manifest, "video_id", "left_anti").filter("video_id is not null"), always, "video_id", "not in manifest"),
        _problem(manifest.join(predictions, "video_id", "left_anti"), always, "video_id", "missing manifest video"),
    ])


def check_present(predictions: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    """Predictions without events or runtime metadata (null columns); optional ones give warnings."""
    errors = [_problem(predictions, F.col(c).isNull(), c, f"missing {c}") for c in ("events", "runtime_metadata")]
    return reduce(DataFrame.unionAll, errors + [_problem(predictions, F.col(c).isNull(), c, f"missing {c}", "warn") for c in optional])


def check_class(events: DataFrame, classes: list[str], normal: str = "normal") -> DataFrame:
    return _problems(events, *_class_rules(classes, normal))


def _class_rules(classes: list[str], normal: str = "normal") -> list[tuple[Column, str, str]]:
    c = F.col("class_name")
    return [(c == normal, "class_name", "normal is not an event"), (c.isNull() | ((c != normal) & ~c.isin(*classes)), "class_name", "unknown class")]


def check_times(events: DataFrame) -> DataFrame:
    """Level 1 has no times; other levels have both, as numbers, 0 <= start < end. Times come as strings."""
    return _problems(events, *_time_rules())


def _time_rules() -> list[tuple[Column, str, str]]:
    s, e, late = F.col("start_time_sec"), F.col("end_time_sec"), F.col("level") > 1
    a, b = s.try_cast("double"), e.try_cast("double")
    both = late & s.isNotNull() & e.isNotNull()
    return [
        ((F.col("level") == 1) & (s.isNotNull() | e.isNotNull()), "times", "level 1 must have null times"),
        (late & (s.isNull() | e.isNull()), "times", "both times are required"),
        (both & (a.isNull() | b.isNull()), "times", "times must be numbers"),
        (both & (a < 0), "start_time_sec", "start must not be negative"),
        (both & (b <= a), "end_time_sec", "end must be after start"),
    ]


def check_explanation(events: DataFrame) -> DataFrame:
    return _problems(events, *_explanation_rules())


def _explanation_rules() -> list[tuple[Column, str, str]]:
    return [(~F.length("explanation").between(*EXPLANATION_CHARS), "explanation", "wrong length")]


def check_events(events: DataFrame, classes: list[str]) -> DataFrame:
    """All rules about single events (check_class, check_times, check_explanation) in one pass."""
    return _problems(events, *_class_rules(classes), *_time_rules(), *_explanation_rules())


def check_runtime(runtimes: DataFrame) -> DataFrame:
    """Counts and means positive, the mean within tolerance of total / count, a time for each call.

    runtimes: video_id, total_time_ms, call_count, average_time_ms, n_times.
    """
    n, avg = F.col("call_count"), F.col("average_time_ms")
    ok = (n > 0) & (avg != 0)
    return _problems(
        runtimes, (~ok, "model_runtimes", "count and average must be positive"),
        (ok & (F.abs(avg - F.try_divide("total_time_ms", n)) > MEAN_TOLERANCE * F.abs(avg)), "model_runtimes", "average differs from total / count"),
        (F.col("n_times") != n, "model_runtimes", "a time for each call is required"),
    )


def check_duration(events: DataFrame, durations: DataFrame) -> DataFrame:
    """Ends (as seconds) within the video's dur."""
    return _problem(events.join(durations, "video_id"), F.col("end_time_sec").try_cast("double") > F.col("dur"), "end_time_sec", "end is outside the video")


def warn(events: DataFrame, durations: DataFrame, predictions: DataFrame) -> DataFrame:
    """Warnings: events over most of a video, many events, silence on a level 3 video."""
    length = F.col("end_time_sec").try_cast("double") - F.col("start_time_sec").try_cast("double")
    counts = events.groupBy("video_id").agg(F.count("*").alias("n"))
    silent = predictions.filter("level = 3").join(events, "video_id", "left_anti")
    return reduce(DataFrame.unionAll, [
        _problem(events.join(durations, "video_id"), length > LONG_SHARE * F.col("dur"), "times", "covers most of the video", "warn"),
        _problem(counts, F.col("n") > MANY_EVENTS, "events", "many events", "warn"),
        _problem(silent, F.lit(True), "events", "silent on level 3", "warn"),
    ])


def passed(problems: DataFrame) -> DataFrame:
    """One row: whether there's no error, and how many errors and warnings."""
    errors = F.count_if(F.col("severity") == "error")
    return problems.agg((errors == 0).alias("passed"), errors.alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
