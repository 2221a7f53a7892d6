"""Scores of a submission under many weightings or parameters, as one plan each.

Matching doesn't depend on the weights, so its components are worked out once a video and every weighting is an expression on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.intervals import iou
from spanloom.operators import matching as M
from spanloom.operators import sequence as S

#: Weights (alert, match, timing) of the levels' grids, the first of each the default; points of the levels.
GRID = {2: [(0.2, 0.5, 0.3), (0.3, 0.4, 0.3), (0.34, 0.33, 0.33)], 3: [(0.2, 0.4, 0.4), (0.2, 0.3, 0.5), (0.3, 0.3, 0.4)]}
POINTS = {1: 25.0, 2: 35.0, 3: 40.0}


def weights(spark: SparkSession) -> DataFrame:
    """level, w_id, w_alert, w_match, w_time: a few rows."""
    return spark.createDataFrame([(level, k, *w) for level, grid in GRID.items() for k, w in enumerate(grid)], "level bigint, w_id bigint, w_alert double, w_match double, w_time double")


def weight_grid(spark: SparkSession) -> DataFrame:
    """All pairs (w2, w3) of the two levels' weightings: nine rows."""
    of = lambda level, to: weights(spark).filter(F.col("level") == level).select(F.col("w_id").alias(to))
    return of(2, "w2").crossJoin(of(3, "w3"))


def level_scores(components: DataFrame) -> DataFrame:
    """level, w_id, score: mean over a level's videos under each of its weightings; 0 for a level without videos."""
    w = F.broadcast(weights(components.sparkSession))
    each = components.join(w, "level").groupBy("level", "w_id").agg(F.avg(M.video_score(F.col("w_alert"), F.col("w_match"), F.col("w_time"))).alias("score"))
    return w.select("level", "w_id").join(each, ["level", "w_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _all_scores(components: DataFrame, level1: DataFrame) -> DataFrame:
    """One row: scores (by 10 * level + w_id), answered (videos with a prediction) and d1. Components are gone through once."""
    each = components.join(F.broadcast(weights(components.sparkSession)), "level", "left").groupBy("level", "w_id").agg(
        F.avg(M.video_score(F.col("w_alert"), F.col("w_match"), F.col("w_time"))).alias("score"), F.count_if(F.col("n_pred") > 0).alias("n")
    )
    entry = F.when(F.col("w_id").isNotNull(), F.struct((10 * F.col("level") + F.col("w_id")).alias("k"), "score"))
    found = each.agg(F.map_from_entries(F.collect_list(entry)).alias("scores"), F.coalesce(F.sum(F.when(F.coalesce("w_id", F.lit(0)) == 0, F.col("n"))), F.lit(0)).alias("answered"))
    return found.crossJoin(level1.select((F.col("score") * POINTS[1]).alias("d1")))


def sensitivity(components: DataFrame, level1: DataFrame) -> DataFrame:
    """w2, w3, d1, d2, d3, total and answered for every weighting of levels 2 and 3; a level without videos scores 0."""
    pairs = F.array(*(F.struct(F.lit(a).cast("bigint").alias("w2"), F.lit(b).cast("bigint").alias("w3")) for a in range(len(GRID[2])) for b in range(len(GRID[3]))))
    rows = _all_scores(components, level1).select("scores", "answered", "d1", F.inline(pairs))
    of = lambda level, w: F.coalesce(F.try_element_at("scores", 10 * F.lit(level).cast("bigint") + F.col(w)), F.lit(0.0)) * POINTS[level]
    rows = rows.withColumns({"d2": of(2, "w2"), "d3": of(3, "w3")})
    return rows.withColumn("total", F.col("d1") + F.col("d2") + F.col("d3")).drop("scores")


def submission_total(components: DataFrame, level1: DataFrame) -> DataFrame:
    return sensitivity(components, level1).filter("w2 = 0 and w3 = 0")


def summary(grid: DataFrame) -> DataFrame:
    return grid.agg(F.min("total").alias("total_min"), F.median("total").alias("total_median"), F.max("total").alias("total_max"))


def transfer_gate(components: DataFrame) -> DataFrame:
    """One row: precision, recall, alarm rate on normal videos, and counts."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    quiet = ~F.col("is_anomaly")
    return components.agg(
        share(F.sum(F.when(~quiet, F.col("matched"))), F.sum("n_pred")).alias("precision"), share(F.sum("matched"), F.sum("n_gt")).alias("recall"),
        F.coalesce(F.avg(F.when(quiet, (F.col("n_pred") > 0).cast("double"))), F.lit(0.0)).alias("alarm_rate"), F.sum("n_pred").alias("emitted"), F.count_if(quiet).alias("normal_videos"),
    )


def threshold_sweep(videos: DataFrame, pred: DataFrame, gt: DataFrame, thresholds: list[float]) -> DataFrame:
    """min_score, level, mean_f1: the score of each level if predictions below a threshold were left out.

    Each threshold matches anew what it leaves: a prediction that goes may free its interval for another. The pairs are worked out
    once, and the threshold is one more key of the groups that are matched.
    """
    params = F.explode(F.array(*map(F.lit, thresholds))).alias("min_score")
    passing = pred.select("video_id", "pred_id", "score", params).filter("score >= min_score").drop("score")
    pairs = M.candidates(pred, gt).join(passing, ["video_id", "pred_id"])
    hits = M.greedy_match(pairs, ["min_score", "video_id", "class_name"]).groupBy("video_id", "min_score").agg(F.count("*").alias("matched"))
    counts = passing.groupBy("video_id", "min_score").agg(F.count("*").alias("n_pred")).join(hits, ["video_id", "min_score"], "left")
    n_gt = gt.groupBy("video_id").agg(F.count("*").alias("n_gt"))
    rows = videos.select("video_id", "level", params).join(n_gt, "video_id", "left").join(counts, ["video_id", "min_score"], "left").na.fill(0, ["n_gt", "n_pred", "matched"])
    f1 = F.when(F.col("n_gt") == 0, (F.col("n_pred") == 0).cast("double")).otherwise(2.0 * F.col("matched") / (F.col("n_pred") + F.col("n_gt")))
    return rows.groupBy("min_score", "level").agg(F.avg(f1).alias("mean_f1"))


def best_trial(trials: DataFrame, part: list[str], score: str, param: str) -> DataFrame:
    """Of each group the trial of the highest score, the smallest parameter of equals."""
    return trials.groupBy(*part).agg(F.max_by(param, F.struct(F.col(score), -F.col(param))).alias(param), F.max(score).alias(score))


def select_checkpoint(trials: DataFrame, least_recall: float, least_emitted: int) -> DataFrame:
    """epoch: of the trials that qualify the one of the best score, else the one of the best recall; the first of equals."""
    ok = (F.col("recall") >= least_recall) & (F.col("emitted") >= least_emitted)
    best = F.max_by("epoch", F.when(ok, F.struct("score", -F.col("epoch"))))
    return trials.agg(F.coalesce(best, F.max_by("epoch", F.struct("recall", -F.col("epoch")))).alias("epoch"))


def snap_ablation(spans: DataFrame, points: DataFrame, within: int, start: Column, end: Column) -> DataFrame:
    """snap, mean_iou with the true interval [start, end), with and without snapping."""
    both = spans.withColumn("snap", F.lit(False)).unionByName(S.snap(spans, points, within, ["video_id"]).withColumn("snap", F.lit(True)))
    return both.groupBy("snap").agg(F.avg(iou(F.col("st").cast("double"), F.col("en").cast("double"), start, end)).alias("mean_iou"))


def trial_totals(events: DataFrame, videos: DataFrame, gt: DataFrame, n_trials: int, d1: float = 0.0) -> DataFrame:
    """trial, min_total, median_total: over all weightings, for the events of each of n_trials trials, best first by both, then by number.

    events: trial, video_id, pred_id, class_name, st, en; videos: video_id, level, is_anomaly; gt: video_id, gt_id, class_name, st, en. A trial and video are one key of the matching.
    """
    trial = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_trials - 1).cast("bigint"))).alias("trial")
    key = lambda df: df.withColumn("video_id", F.struct("trial", "video_id"))
    components = M.video_components(key(videos.select("*", trial)), key(events), key(gt.select("*", trial)))
    w = F.broadcast(weights(events.sparkSession))
    each = components.join(w, "level").groupBy(F.col("video_id.trial").alias("trial"), "level", "w_id").agg(F.avg(M.video_score(F.col("w_alert"), F.col("w_match"), F.col("w_time"))).alias("score"))
    scores = each.groupBy("trial").agg(F.map_from_entries(F.collect_list(F.struct((10 * F.col("level") + F.col("w_id")).alias("k"), "score"))).alias("scores"))
    pairs = F.array(*(F.struct(F.lit(20 + a).cast("bigint").alias("k2"), F.lit(30 + b).cast("bigint").alias("k3")) for a in range(len(GRID[2])) for b in range(len(GRID[3]))))
    of = lambda k, level: F.coalesce(F.try_element_at("scores", F.col(k)), F.lit(0.0)) * POINTS[level]
    totals = scores.select("trial", "scores", F.inline(pairs)).withColumn("total", F.lit(d1) + of("k2", 2) + of("k3", 3))
    return totals.groupBy("trial").agg(F.min("total").alias("min_total"), F.median("total").alias("median_total"))


def best_trials(totals: DataFrame, k: int = 10) -> DataFrame:
    """The k best trials with their place: by min_total, median_total, then number."""
    found = totals.orderBy(F.col("min_total").desc(), F.col("median_total").desc(), "trial").limit(k)
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.col("min_total").desc(), F.col("median_total").desc(), "trial")).cast("bigint"))
