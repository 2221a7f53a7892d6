"""Submissions: rows of events to JSON documents and back, and a given template filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.intervals import half_even
from spanloom.sources.schemas import PREDICTION

EVENT = ["class_name", "start_time_sec", "end_time_sec", "score", "explanation"]


def to_json(events: DataFrame) -> DataFrame:
    """video_id and prediction (JSON): one row a video, its events by start, end and class. Nulls are left out."""
    ordered = F.array_sort(F.collect_list(F.struct("start_time_sec", "end_time_sec", "class_name", "score", "explanation")))
    rows = events.groupBy("video_id").agg(F.transform(ordered, lambda e: F.struct(*(e[c].alias(c) for c in EVENT))).alias("events"))
    return rows.select("video_id", F.to_json(F.struct("video_id", "events")).alias("prediction"))


def read_submission(lines: DataFrame, col: str = "value") -> DataFrame:
    """Rows of events from JSON predictions, one a line. A video without events gives one row of nulls; of a video's
    repeated predictions all are given (see latest)."""
    parsed = lines.select(F.from_json(col, PREDICTION).alias("p"))
    return parsed.select("p.video_id", F.posexplode_outer("p.events").alias("event_idx", "e")).select("video_id", "event_idx", "e.*")


def latest(predictions: DataFrame, pos: str = "pos") -> DataFrame:
    """Of each video the last prediction."""
    cols = [c for c in predictions.columns if c != "video_id"]
    return predictions.groupBy("video_id").agg(F.max_by(F.struct(*cols), pos).alias("p")).select("video_id", "p.*")


def clamp_events(template: DataFrame, events: DataFrame, margin: float = 0.1) -> DataFrame:
    """Events (st, en) of the template's videos (video_id, dur), rounded to hundredths, ended margin before the video does;
    those left empty are dropped. The template's other videos have no rows."""
    rows = template.join(events, "video_id").withColumns({"st": F.round("st", 2), "en": F.round(F.least("en", F.col("dur") - margin), 2)})
    return rows.filter("en > st")


def write_submission(events: DataFrame, path: str) -> None:
    """One JSON prediction a line, in as many files as there are partitions."""
    to_json(events).select("prediction").write.mode("overwrite").text(path)


def envelope(events: DataFrame, version: str = "1.0") -> DataFrame:
    """Lines (section, video_id, value) that in this order are one JSON document: schema_version and predictions, a line a video.

    No row or task holds the whole document, whatever its length.
    """
    rows = to_json(events)
    first = rows.agg(F.min("video_id").alias("first"))
    comma = F.when(F.col("video_id") == F.col("first"), "").otherwise(",")
    body = rows.join(F.broadcast(first)).select(F.lit(1).alias("section"), "video_id", F.concat(comma, "prediction").alias("value"))
    ends = events.sparkSession.createDataFrame([(0, f'{{"schema_version": "{version}", "predictions": ['), (2, "]}")], "section int, value string")
    return body.unionByName(ends.withColumn("video_id", F.lit(None).cast(rows.schema["video_id"].dataType)))


def write_envelope(events: DataFrame, path: str, version: str = "1.0") -> None:
    """The document as text files: read one after another in the order of their names they are the JSON document."""
    envelope(events, version).orderBy("section", "video_id").select("value").write.mode("overwrite").text(path)


def read_envelope(lines: DataFrame, col: str = "value") -> DataFrame:
    """Rows of events from the lines of an envelope as write_envelope writes it."""
    return read_submission(lines.select(F.ltrim(F.col(col), F.lit(",")).alias(col)).filter(F.startswith(col, F.lit('{"video_id"'))), col)


def read_documents(docs: DataFrame, key: list[str], col: str = "value") -> DataFrame:
    """key, video_id and prediction (raw JSON) from whole documents: `predictions`, or the document itself, is a list of predictions or maps ids to
    them. Of a document's predictions of one video the last counts; what isn't an object isn't a prediction. Documents that others
    wrote are whole, a row each, so one has to fit in a task."""
    body = F.coalesce(F.get_json_object(col, "$.predictions"), F.col(col))
    listed = F.startswith(F.ltrim(body), F.lit("["))
    from_list = docs.filter(listed).select(*key, F.posexplode(F.from_json(body, "array<string>")).alias("pos", "prediction")).withColumn("video_id", F.get_json_object("prediction", "$.video_id"))
    from_map = docs.filter(~listed).select(*key, F.posexplode(F.map_entries(F.from_json(body, "map<string,string>"))).alias("pos", "e")).select(*key, "pos", F.col("e.value").alias("prediction"), F.col("e.key").alias("video_id"))
    rows = from_list.unionByName(from_map).filter(F.startswith(F.ltrim("prediction"), F.lit("{")))
    return rows.groupBy(*key, "video_id").agg(F.max_by("prediction", "pos").alias("prediction"))


def fill_template(template: DataFrame, predictions: DataFrame, margin: float = 0.1) -> DataFrame:
    """Every video of a template (video_id, level, dur) with its events and runtime metadata.

    predictions: video_id, events (array of class_name, start_time_sec, end_time_sec, explanation), frames_processed, chunks_processed, time_ms. Level 1 has no
    times. Times are rounded to hundredths and end margin before the video does; events left empty go. Counts of at least one chunk and whole
    milliseconds. A video without a prediction has no events and no metadata. Adds n_clamped and n_dropped.
    """
    rows = template.join(predictions, "video_id", "left")
    limit = F.round(F.col("dur") - margin, 2)
    late = F.col("level") > 1

    def timed(e: Column) -> Column:
        st, en = F.round(e["start_time_sec"], 2), F.round(e["end_time_sec"], 2)
        some = lambda c: F.when(late, c)
        return F.struct(e["class_name"].alias("class_name"), some(st).alias("start_time_sec"), some(F.least(en, limit)).alias("end_time_sec"), F.when(e["explanation"] != "", e["explanation"]).alias("explanation"), F.coalesce(late & (en > limit), F.lit(False)).alias("clamped"))

    rows = rows.withColumn("_all", F.transform("events", timed))
    rows = rows.withColumn("_kept", F.filter("_all", lambda e: ~late | (e.end_time_sec > e.start_time_sec)))
    events = F.transform("_kept", lambda e: F.struct(*(e[c].alias(c) for c in ("class_name", "start_time_sec", "end_time_sec", "explanation"))))
    metadata = F.when(F.col("events").isNotNull(), F.struct(F.coalesce("frames_processed", F.lit(0)).cast("bigint").alias("frames_processed"), F.greatest(F.lit(1), F.coalesce("chunks_processed", F.lit(1))).cast("bigint").alias("chunks_processed"), half_even(F.coalesce("time_ms", F.lit(0.0))).alias("end_to_end_internal_time_ms")))
    none = F.array().cast("array<struct<class_name: string, start_time_sec: double, end_time_sec: double, explanation: string>>")
    return rows.select(
        "video_id", "level", F.coalesce(events, none).alias("events"), metadata.alias("runtime_metadata"),
        F.coalesce(F.size(F.filter("_all", lambda e: e.clamped)), F.lit(0)).alias("n_clamped"), (F.coalesce(F.size("_all"), F.lit(0)) - F.coalesce(F.size("_kept"), F.lit(0))).alias("n_dropped"),
    )
