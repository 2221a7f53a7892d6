"""Spans of a stream of scores, in Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_scores(stream: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """video_id, window, n, mean_p, max_p of rows (video_id, ts, p), on the wall clock; rows later than `late` are dropped."""
    return stream.withWatermark("ts", late).groupBy("video_id", F.window("ts", width, slide)).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.max("p").alias("max_p"))


def sessions(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of rows (video_id, ts, p) of a class no more than gap apart."""
    return stream.withWatermark("ts", late).groupBy("video_id", "cls", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.max("p").alias("score")).select("video_id", "cls", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "score")


def hysteresis(stream: DataFrame, hi: float, lo: float) -> DataFrame:
    """video_id, st, en of spans as they close: open above hi, closed at the first value at or below lo.

    stream: video_id bigint, i bigint, p double, each video's rows in order across batches. State is one open start a video.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, out = state.get[0] if state.exists else -1, []
        rows = pd.concat(list(frames)).sort_values("i")
        for i, p in zip(rows["i"].tolist(), rows["p"].tolist(), strict=True):
            if start < 0 and p > hi:
                start = i
            elif start >= 0 and p <= lo:
                out.append((key[0], start, i))
                start = -1
        state.update((start,))
        yield pd.DataFrame(out, columns=["video_id", "st", "en"])

    return stream.groupBy("video_id").applyInPandasWithState(step, "video_id bigint, st bigint, en bigint", "start bigint", "append", GroupStateTimeout.NoTimeout)
