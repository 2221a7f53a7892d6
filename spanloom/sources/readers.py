"""Readers of the file formats that videos, ground truth, manifests and embeddings come in. All read through Spark."""

from __future__ import annotations

import io
import zipfile
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.decisions import parse_bool, parse_bool_lenient

from .schemas import FRAMES, GROUND_TRUTH, MANIFEST_ENTRY, VIDEOS


def override(config: dict[str, Any], *settings: str) -> dict[str, Any]:
    """A copy of nested settings with "a.b.c=value" applied; a path that doesn't exist is a KeyError."""
    import copy
    import json

    out = copy.deepcopy(config)
    for setting in settings:
        path, _, value = setting.partition("=")
        *parents, last = path.split(".")
        at = out
        for p in parents:
            at = at[p]
        if last not in at:
            raise KeyError(path)
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return out


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """videos.csv of every class folder under path, with class_name from the folder."""
    rows = spark.read.schema(VIDEOS).option("header", True).csv(f"{path}/*/videos.csv")
    return rows.withColumn("class_name", F.element_at(F.split("_metadata.file_path", "/"), -2))


def read_ground_truth(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Ground truth with is_anomaly as a boolean: anything but true or false fails the job, or counts as false if not strict."""
    rows = spark.read.schema(GROUND_TRUTH).option("header", True).option("enforceSchema", False).csv(path)
    flag = F.col("is_anomaly")
    return rows.withColumn("is_anomaly", parse_bool(flag, strict=True) if strict else parse_bool_lenient(flag))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """video_id, level, filename, duration_sec from CSV, or JSON as a list, as {"videos": [...]}, or by id to a level or an entry."""
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
        cols = {"video_id": "string", "level": "int", "filename": "string", "duration_sec": "double"}
        return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in cols.items()))
    text = spark.read.text(path, wholetext=True).withColumn("value", F.trim("value"))
    listed = F.when(F.startswith("value", F.lit("[")), F.col("value")).otherwise(F.get_json_object("value", "$.videos"))
    entries = F.from_json(listed, f"array<{MANIFEST_ENTRY}>")
    lists = text.filter(listed.isNotNull()).select(F.inline(entries))
    pairs = text.filter(listed.isNull()).select(F.explode(F.from_json("value", "map<string,string>")).alias("video_id", "v"))
    entry = F.from_json("v", MANIFEST_ENTRY)
    maps = pairs.select("video_id", entry.alias("e"), "v").select("video_id", F.coalesce("e.level", F.col("v").try_cast("int")).alias("level"), "e.filename", "e.duration_sec")
    return lists.unionByName(maps)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def append_new(frames: DataFrame, path: str, key: str = "video_id") -> None:
    """Append the sequences that path doesn't hold yet; the commit protocol makes the write atomic."""
    spark = frames.sparkSession
    try:
        known = spark.read.parquet(path).select(key).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    (frames if known is None else frames.join(known, key, "left_anti")).write.mode("append").parquet(path)


def read_checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of CSV files: what doesn't fit the schema becomes an error row (line, file), and the other rows are read all the same."""
    rows = spark.read.schema(f"{schema}, _line string").option("header", True).option("columnNameOfCorruptRecord", "_line").csv(path)
    # Spark checks only the columns that a query uses, so both sides use all.
    whole = F.to_json(F.struct(*(c for c in rows.columns if c != "_line")))
    errors = rows.filter("_line is not null").select(F.coalesce("_line", whole).alias("line"), F.col("_metadata.file_path").alias("file"))
    return rows.filter(F.col("_line").isNull() & whole.isNotNull()).drop("_line"), errors


def write_head(head: DataFrame, path: str) -> None:
    """A linear head's weights (class_idx, w), as a table."""
    head.select("class_idx", "w").write.mode("overwrite").parquet(path)


def read_head(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("class_idx bigint, w array<double>").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics (a row an epoch or trial) as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _members(content: bytes, names: list[str]) -> dict[str, np.ndarray]:
    """Some arrays of an .npz archive; the other members aren't opened."""
    with np.load(io.BytesIO(content), allow_pickle=False) as archive:
        return {name: archive[name] for name in names if name in archive.files}


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """video_id (the file's name without its ending) and content of the .npz files under path, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("video_id"), "content")


def read_cache_clips(spark: SparkSession, path: str) -> DataFrame:
    """video_id, n (frames), dur, fps, extract_time_ms (0 where a file has none) and error of the .npz files of an embedding cache. Embeddings aren't
    opened. A file that can't be read, or lacks ts, dur or fps, has an error and nothing else."""

    def run(batches):
        for pdf in batches:
            out = []
            for video, content in zip(pdf["video_id"], pdf["content"], strict=True):
                try:
                    m = _members(content, ["ts", "dur", "fps", "extract_time_ms"])
                    out.append((video, len(m["ts"]), float(m["dur"]), float(m["fps"]), float(m.get("extract_time_ms", 0.0)), None))
                except (KeyError, ValueError, OSError, zipfile.BadZipFile) as e:
                    out.append((video, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["video_id", "n", "dur", "fps", "extract_time_ms", "error"]).astype({"n": "Int64"})

    return _archives(spark, path).mapInPandas(run, "video_id string, n bigint, dur double, fps double, extract_time_ms double, error string")


def read_cache_frames(spark: SparkSession, path: str, emb: bool = True) -> DataFrame:
    """video_id, i, ts and, unless told not to, emb of all frames of an embedding cache: a row a frame, float16 as float. Files that can't be read have no frames here and an
    error in read_cache_clips; so have files with other numbers of embeddings than of times."""

    def run(batches):
        for pdf in batches:
            for video, content in zip(pdf["video_id"], pdf["content"], strict=True):
                try:
                    m = _members(content, ["ts", "emb"] if emb else ["ts"])
                    ts, own = m["ts"], m["emb"] if emb else None
                except (KeyError, ValueError, OSError, zipfile.BadZipFile):
                    continue
                if own is not None and len(own) != len(ts):
                    continue
                frames = pd.DataFrame({"video_id": video, "i": np.arange(len(ts)), "ts": ts.astype(float)})
                yield frames.assign(emb=pd.Series(list(own.astype(np.float32)), dtype=object)) if emb else frames

    return _archives(spark, path).mapInPandas(run, "video_id string, i bigint, ts double" + ", emb array<float>" * emb)
