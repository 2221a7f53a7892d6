"""Decoders: from frame embeddings or score curves to labelled intervals, each a single plan for all sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.vectors import dot
from spanloom.operators import aggregates as A
from spanloom.operators import sequence as S


def window_probabilities(frames: DataFrame, head: DataFrame, width: int, stride: int, scale: float = 1.0) -> DataFrame:
    """video_id, n, st, en, class_idx, p: softmax over classes of each window's mean score under a linear head.

    A head is linear, so a window's score is the mean of its frames' scores: embeddings are read once, and only one number
    a frame and class goes through the window join. The head has a row a class and is broadcast.
    """
    scores = frames.select("video_id", "i", "emb").join(F.broadcast(head)).select("video_id", "i", "class_idx", (F.lit(scale) * dot("emb", "w")).alias("x"))
    clips = frames.groupBy("video_id").agg(F.count("*").alias("n"))
    mean = S.window_frames(S.sliding_windows(clips, width, stride), scores).groupBy("video_id", "n", "st", "en", "class_idx").agg(F.avg("x").alias("x"))
    w = Window.partitionBy("video_id", "n", "st", "en")
    shifted = mean.withColumn("e", F.exp(F.col("x") - F.max("x").over(w)))
    return shifted.withColumn("p", F.col("e") / F.sum("e").over(w)).select("video_id", "n", "st", "en", "class_idx", "p")


def window_candidates(scores: DataFrame, normal: int, threshold: float) -> DataFrame:
    """Windows whose likeliest class isn't `normal`, with at least threshold."""
    best = F.max_by("class_idx", F.struct("p", -F.col("class_idx")))
    found = scores.groupBy("video_id", "n", "st", "en").agg(best.alias("cls"), F.max("p").alias("score"), F.max(F.when(F.col("class_idx") == normal, F.col("p"))).alias("normal_p"))
    return found.filter((F.col("cls") != normal) & (F.col("score") >= threshold) & (F.col("score") > F.coalesce("normal_p", F.lit(0.0)))).drop("normal_p")


def windows(
    scores: DataFrame, normal: int, threshold: float, width: int, stride: int, expand: float, least: int, points: DataFrame | None = None, within: int = 6, reclassify: bool = False, most: float = 1.0
) -> DataFrame:
    """The window decoder: candidates, islands, half a window off each end, expansion, snapping (if points are given), and no spans
    longer than the share `most`. Every step but the first keeps to the partitioning by video."""
    spans = S.merge_windows(window_candidates(scores, normal, threshold), stride, reclassify, part=["video_id", "n"])
    spans = S.expand(S.desmear(spans, width, least), expand, least)
    if points is not None:
        spans = S.snap(spans, points, within, ["video_id", "grp"])
    return spans.filter((F.col("en") > F.col("st")) & ((F.col("en") - F.col("st")) / F.col("n") <= most))


def reclassified(spans: DataFrame, frames: DataFrame, head: DataFrame, normal: int, scale: float = 1.0) -> DataFrame:
    """Spans (video_id, n, st, en, …) with the class and score of all their frames together; those that `normal` wins go.

    The head is linear, so a span's score is the mean of its frames' scores, as for windows.
    """
    key = ["video_id", "n", "st", "en"]
    scores = frames.select("video_id", "i", "emb").join(F.broadcast(head)).select("video_id", "i", "class_idx", (F.lit(scale) * dot("emb", "w")).alias("x"))
    mean = S.window_frames(spans.select(*key).distinct(), scores).groupBy(*key, "class_idx").agg(F.avg("x").alias("x"))
    w = Window.partitionBy(*key)
    probs = mean.withColumn("e", F.exp(F.col("x") - F.max("x").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    own = F.col("class_idx") != normal
    best = probs.groupBy(*key).agg(F.max_by("class_idx", F.when(own, F.struct("p", -F.col("class_idx")))).alias("cls"), F.max(F.when(own, F.col("p"))).alias("score"), F.max(F.when(~own, F.col("p"))).alias("normal_p"))
    return spans.drop("cls", "score").join(best.filter(F.col("score") > F.coalesce("normal_p", F.lit(0.0))).drop("normal_p"), key)


def to_seconds(spans: DataFrame, frames: DataFrame, fps: float = 2.0) -> DataFrame:
    """Adds start_s, the time of the first frame, and end_s, that of the last and one step. The step is the time between a video's first two
    frames, 1 / fps where there is only one."""
    at = lambda to, k: frames.select("video_id", (F.col("i") + k).alias(to), F.col("ts").alias(f"_{to}"))
    first = F.max(F.when(F.col("i") == 1, F.col("ts"))) - F.max(F.when(F.col("i") == 0, F.col("ts")))
    step = frames.filter("i < 2").groupBy("video_id").agg(F.coalesce(first, F.lit(1.0 / fps)).alias("_step"))
    timed = spans.join(at("st", 0), ["video_id", "st"]).join(at("en", 1), ["video_id", "en"]).join(step, "video_id")
    return timed.withColumns({"start_s": F.col("_st"), "end_s": F.col("_en") + F.col("_step")}).drop("_st", "_en", "_step")


def ranked(events: DataFrame, most: int | Column | None = None, part: list[str] | None = None) -> DataFrame:
    """Events by falling score, then time, with their place k; at most `most` of each video if that is given."""
    place = F.row_number().over(Window.partitionBy(*(part or ["video_id"])).orderBy(F.col("score").desc(), "start_s", "end_s"))
    rows = events.withColumn("k", place.cast("bigint"))
    return rows if most is None else rows.filter(F.col("k") <= most)


def window_events(
    frames: DataFrame, head: DataFrame, normal: int, threshold: float, width: int, stride: int, expand: float, least: int, scale: float = 1.0, points: DataFrame | None = None, within: int = 6,
    reclassify: bool = False, gap: float = 0.0, most_events: int | None = None, most_span: float = 1.0,
) -> DataFrame:
    """The production decoder: windows, then (if asked for) the class of each whole interval, seconds, bridging of equal neighbours and rank.

    Rows: video_id, cls, start_s, end_s, score, k.
    """
    spans = windows(window_probabilities(frames, head, width, stride, scale), normal, threshold, width, stride, expand, least, points, within, reclassify, most_span)
    if reclassify:
        spans = reclassified(spans, frames, head, normal, scale)
    timed = to_seconds(spans, frames).select("video_id", "cls", "start_s", "end_s", "score")
    return ranked(S.bridge_seconds(timed, gap), most_events)


def extract_events(
    curve: DataFrame, frames: DataFrame, win: int, hi: float, lo: float, gap: float, expand: float, least_s: float, points: DataFrame | None = None, within: int = 6, priors: DataFrame | None = None
) -> DataFrame:
    """The curve decoder in full: for each class smoothing, hysteresis, snapping, bridging, duration priors, expansion, a minimum in seconds, the mean over
    the expanded span, and rank.

    curve: video_id, i, cls, p (a row a frame and class); frames: video_id, i, ts; priors: cls, p10, p50 in seconds. Rows: video_id, cls, start_s,
    end_s, score, k.
    """
    by = ["video_id", "cls"]
    smooth = S.smooth(curve, win, part=by)
    spans = S.hysteresis(smooth, hi, lo, value="smooth", part=by).select(*by, "st", "en")
    if points is not None:
        spans = S.snap(spans, points, within, [*by, "st", "en"], part=["video_id"])
    step = frames.groupBy("video_id").agg(F.count("*").alias("n")).join(A.median_step(frames, "ts", ["video_id"], "i", 0.5), "video_id")
    # A span's edges before it is made wider tell it from another that comes to the same edges: both are events.
    spans = S.bridge_frames(spans.distinct(), frames, gap).withColumn("span", F.struct("st", "en")).join(step, "video_id")
    at = lambda to, k: frames.select("video_id", (F.col("i") + k).alias(to), F.col("ts").alias(f"_{to}"))
    timed = lambda rows: rows.join(at("st", 0), ["video_id", "st"]).join(at("en", 1), ["video_id", "en"])
    if priors is not None:
        spans = S.duration_prior(timed(spans).withColumn("length", F.col("_en") - F.col("_st") + F.col("step")).drop("_st", "_en"), priors, centred=True).drop("length")
    half = (F.col("en") - F.col("st")) * expand / 2.0
    centre = (F.col("st") + F.col("en") - 1) / 2.0
    wide = spans.withColumns({"_s": F.greatest(F.lit(0), F.floor(centre - half)).cast("bigint"), "en": F.least(F.col("n"), F.ceil(centre + half + 1)).cast("bigint")}).withColumn("st", F.col("_s")).drop("_s")
    long = timed(wide).withColumns({"start_s": F.col("_st"), "end_s": F.col("_en") + F.col("step")})
    long = long.filter(F.col("end_s") - F.col("start_s") >= least_s).select(*by, "span", "st", "en", "start_s", "end_s")
    scored = S.window_frames(long, smooth.select(*by, "i", "smooth"), by).groupBy(*long.columns).agg(F.avg("smooth").alias("score"))
    return ranked(scored).select(*by, "start_s", "end_s", "score", "k")


def trial_events(frames: DataFrame, head: DataFrame, trials: list[dict], normal: int, least: int, scale: float = 1.0, points: DataFrame | None = None, within: int = 6, most_span: float = 1.0) -> DataFrame:
    """Events of the production decoder under every trial in one plan: trial, video_id, cls, start_s, end_s, score, k.

    trials: dicts of width, stride, threshold, expand, snap, most_events and gap; a trial's number is its place. Window scores depend on width
    and stride only and are worked out once for each pair of these; everything else is a column of the trial.
    """
    spark, found = frames.sparkSession, []
    pairs = dict.fromkeys((t["width"], t["stride"]) for t in trials)
    for width, stride in pairs:
        own = [(k, float(t["threshold"]), float(t["expand"]), bool(t["snap"]), int(t["most_events"]), float(t["gap"])) for k, t in enumerate(trials) if (t["width"], t["stride"]) == (width, stride)]
        params = spark.createDataFrame(own, "trial bigint, threshold double, factor double, snap boolean, most_events int, gap double")
        by = [*params.columns, "video_id", "n"]
        rows = window_candidates(window_probabilities(frames, head, width, stride, scale), normal, 0.0).join(F.broadcast(params), F.col("score") >= F.col("threshold"))
        spans = S.expand(S.desmear(S.merge_windows(rows, stride, part=by), width, least), F.col("factor"), least)
        if points is not None:
            spans = S.snap(spans.filter("snap"), points, within, ["trial", "video_id", "grp"]).unionByName(spans.filter("not snap"))
        spans = spans.filter((F.col("en") > F.col("st")) & ((F.col("en") - F.col("st")) / F.col("n") <= most_span))
        found.append(S.bridge_seconds(to_seconds(spans, frames), F.col("gap"), ["trial", "most_events", "gap", "video_id"]))
    return ranked(reduce(DataFrame.unionByName, found), F.col("most_events"), ["trial", "video_id"]).drop("most_events", "gap")


def window_sweep(scores: DataFrame, params: DataFrame, normal: int, width: int, stride: int, least: int) -> DataFrame:
    """The window decoder under every row of params (param_id, threshold, factor) in one plan: adds param_id.

    Window scores don't depend on these parameters, so they are worked out once; candidates are taken up by each parameter set that lets
    them pass, and param_id is one more partition key from there. params is a small grid and is broadcast.
    """
    found = window_candidates(scores, normal, 0.0).join(F.broadcast(params), F.col("score") >= F.col("threshold"))
    spans = S.merge_windows(found, stride, part=["param_id", "factor", "video_id", "n"])
    return S.expand(S.desmear(spans, width, least), F.col("factor"), least).filter(F.col("en") > F.col("st"))


def per_class(curve: DataFrame, win: int, hi: float, lo: float, least: int, points: DataFrame | None = None, within: int = 6, part: tuple[str, ...] = ("video_id", "class_name")) -> DataFrame:
    """The curve decoder, with the class as one more partition key: smoothing, hysteresis, snapping (if points are given),
    and spans of at least `least` frames. Frames are counted within each class's own curve."""
    by = list(part)
    own = curve.withColumn("i", (F.row_number().over(Window.partitionBy(*by).orderBy("i")) - 1).cast("bigint"))
    spans = S.hysteresis(S.smooth(own, win, part=by), hi, lo, value="smooth", part=by).withColumnRenamed("mean_p", "score")
    if points is not None:
        spans = S.snap(spans, points, within, [*by, "st", "en"], part=["video_id"])
    return spans.filter(F.col("en") - F.col("st") >= least)


def top(spans: DataFrame, k: int) -> DataFrame:
    """At most k spans of each video by falling score, then position; adds k, their place."""
    place = F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("score").desc(), "st", "en"))
    return spans.withColumn("k", place).filter(F.col("k") <= k)
