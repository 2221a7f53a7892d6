"""Projections, decisions and filters on frames, probabilities and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.intervals import half_even
from spanloom.functions.vectors import argmax

#: Length that an explanation must have to be given.
EXPLANATION_CHARS = (20, 500)


def sample_frames(frames: DataFrame, target_fps: float, fps: str = "fps", i: str = "i") -> DataFrame:
    """Every step-th frame, step = max(1, fps / target rounded half to even); a bad fps counts as 25."""
    good = F.when((F.col(fps) > 0) & ~F.isnan(fps), F.col(fps)).otherwise(25.0)
    return frames.withColumn("step", F.greatest(F.lit(1), half_even(good / target_fps))).filter(F.col(i) % F.col("step") == 0)


def class_table(spark: SparkSession, names: list[str], other: str = "normal") -> DataFrame:
    """class_idx, class_name; the class of nothing comes last."""
    return spark.createDataFrame(list(enumerate([*names, other])), "class_idx int, class_name string")


def encode_class(rows: DataFrame, classes: DataFrame, col: str, unknown: int | None = None) -> DataFrame:
    """Adds class_idx. Unknown names get `unknown`, or fail the job where it is None. The table has a row a class: it is broadcast."""
    found = rows.join(F.broadcast(classes), rows[col] == classes["class_name"], "left").drop("class_name")
    missing = F.lit(unknown) if unknown is not None else F.raise_error(F.concat(F.lit("unknown class: "), F.col(col))).cast("int")
    return found.withColumn("class_idx", F.when(F.col("class_idx").isNotNull(), F.col("class_idx")).otherwise(missing))


def decode_class(idx: str, names: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.col(idx))


def parse_bool(c: Column, strict: bool = False) -> Column:
    """true or false in any case; else null, or an error if strict."""
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean") if strict else F.lit(None).cast("boolean")
    return F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False).otherwise(bad)


def parse_bool_lenient(c: Column) -> Column:
    return F.lower(c).eqNullSafe("true")


def id_at_least(col: str, prefix: str, at: int, least: int) -> Column:
    """Ids that begin with prefix and whose number from position `at` is at least `least`."""
    return F.startswith(F.col(col), F.lit(prefix)) & (F.substring(col, at, 20).try_cast("int") >= least)


def level1_decision(rows: DataFrame, normal_below: float, probs: str = "probs") -> DataFrame:
    """Rows whose last class has less than normal_below, with cls and score of the likeliest other class."""
    real = F.slice(probs, 1, F.size(probs) - 1)
    return rows.filter(F.element_at(probs, -1) < normal_below).withColumns({"cls": argmax(real), "score": F.array_max(real)})


def active(rows: DataFrame, at_least: float, probs: str = "probs") -> DataFrame:
    """Rows whose likeliest class but the last has at_least and more than the last."""
    real = F.slice(probs, 1, F.size(probs) - 1)
    found = rows.withColumns({"cls": argmax(real), "score": F.array_max(real)})
    return found.filter((F.col("score") >= at_least) & (F.col("score") > F.element_at(probs, -1)))


def within_fraction(spans: DataFrame, most: float, n: str = "n") -> DataFrame:
    """Spans that aren't empty nor longer than the share `most` of their sequence."""
    return spans.filter((F.col("en") > F.col("st")) & ((F.col("en") - F.col("st")) / F.col(n) <= most))


def explanation(phrase: Column, start: Column, end: Column) -> Column:
    """Says what is seen, and when if start isn't null."""
    text = F.when(start.isNull(), F.concat(phrase, F.lit(" is visible throughout the clip."))).otherwise(F.concat(phrase, F.lit(" observed from "), F.format_string("%.1f", start), F.lit("s to "), F.format_string("%.1f", end), F.lit("s.")))
    return F.when(F.length(text) >= EXPLANATION_CHARS[0], text).otherwise(F.concat(text, F.lit(" This was detected locally.")))


def checked_events(rows: DataFrame, normal: str = "normal") -> DataFrame:
    """Fails the job on events (level, class_name, start_time_sec, end_time_sec) that break the result's rules."""
    s, e = F.col("start_time_sec"), F.col("end_time_sec")
    ok = (F.col("class_name") != normal) & F.when(F.col("level") == 1, s.isNull() & e.isNull()).otherwise(s.isNotNull() & e.isNotNull() & (e > s))
    return rows.filter(F.assert_true(ok, F.concat(F.lit("bad event of class "), F.coalesce("class_name", F.lit("null")))).isNull())


def event_json() -> Column:
    """An event as JSON: times stand as null where they are missing, an explanation of a wrong length is left out."""
    base = ["class_name", "start_time_sec", "end_time_sec", "score"]
    good = F.length("explanation").between(*EXPLANATION_CHARS)
    options = {"ignoreNullFields": "false"}
    return F.when(good, F.to_json(F.struct(*base, "explanation"), options)).otherwise(F.to_json(F.struct(*base), options))
