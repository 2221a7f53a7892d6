"""The driver's tables seen as frames, curves, intervals and videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, i, ts, emb, class_idx: 50 embeddings a video, two a second."""
    k = F.col("vec_id") % 50
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("video_id"), k.alias("i"), (k / 2.0).alias("ts"), F.col("embedding").cast("array<double>").alias("emb"), F.col("label").alias("class_idx"))


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").withColumn("us", micros)
    return rows.withColumn("sec", (F.col("us") - F.min("us").over(Window.partitionBy("user_id"))) / 1e6)


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, i, sec, class_name, p: each user's events in order, as a score curve."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1
    return _seconds(spark, sf_dir).select(F.col("user_id").alias("video_id"), i.cast("bigint").alias("i"), "sec", F.col("event_type").alias("class_name"), (F.col("value") / (F.col("value") + 35.0)).alias("p"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, level (1 to 3), is_anomaly: one row a user."""
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct()
    return ids.select("video_id", (1 + F.col("video_id") % 3).alias("level"), (F.col("video_id") % 6 != 0).alias("is_anomaly"))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, gt_id, class_name, st, en (seconds): intervals of the anomalous users."""
    length = (4 + F.col("event_id") % 9) * 3600.0
    return _seconds(spark, sf_dir).filter("user_id % 6 <> 0").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("gt_id"), F.col("event_type").alias("class_name"), F.col("sec").alias("st"), (F.col("sec") + length).alias("en"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, pred_id, class_name, st, en, score: shifted, scaled and partly misnamed copies of the users' intervals."""
    e = F.col("event_id")
    start = F.col("sec") + ((e * 37) % 13 - 6) * 900.0
    length = (4 + e % 9) * 3600.0 * (0.6 + 0.1 * (e % 9))
    rows = _seconds(spark, sf_dir).filter("event_id % 5 <> 0")
    return rows.select(F.col("user_id").alias("video_id"), e.alias("pred_id"), F.when(e % 11 == 0, "click").otherwise(F.col("event_type")).alias("class_name"), start.alias("st"), (start + length).alias("en"), (F.col("value") / (F.col("value") + 35.0)).alias("score"))


def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_idx, w: each label's mean embedding."""
    each = frames(spark, sf_dir).select("class_idx", F.posexplode("emb").alias("d", "x"))
    mean = each.groupBy("class_idx", "d").agg(F.avg("x").alias("m"))
    return mean.groupBy("class_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x.m).alias("w"))
