"""One-to-one matching of predicted and true intervals, and scores built on it."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.intervals import iou
from spanloom.sources.scratch import new_path, stored

_log = logging.getLogger(__name__)


def candidates(pred: DataFrame, gt: DataFrame, thr: float = 0.5, bucket: float = 43200.0) -> DataFrame:
    """Pairs of a video and class with IoU of at least thr > 0, and their hull (lo, hi).

    pred: video_id, pred_id, class_name, st, en; gt: the same with gt_id. Intervals go to each stretch of `bucket` seconds that
    they touch, and a pair counts in the stretch where its overlap begins: an equi-join on video, class and stretch, whose
    work stays near the result for a video with any number of events. bucket should be about the usual length or more.
    """
    touched = F.explode(F.sequence(F.floor(F.col("st") / bucket), F.floor(F.greatest("st", "en") / bucket)))
    p, g = pred.withColumn("_b", touched).alias("p"), gt.withColumn("_b", touched).alias("g")
    on = (F.col("p.video_id") == F.col("g.video_id")) & (F.col("p.class_name") == F.col("g.class_name")) & (F.col("p._b") == F.col("g._b")) & (F.col("p.st") < F.col("g.en")) & (F.col("g.st") < F.col("p.en"))
    first = F.floor(F.greatest("p.st", "g.st") / bucket) == F.col("p._b")
    pairs = p.join(g, on & first).select("p.video_id", "p.class_name", "p.pred_id", "g.gt_id", iou(F.col("p.st"), F.col("p.en"), F.col("g.st"), F.col("g.en")).alias("iou"), F.least("p.st", "g.st").alias("lo"), F.greatest("p.en", "g.en").alias("hi"))
    return pairs.filter(F.col("iou") >= thr)


#: Pairs of an island up to which it is matched by a fold in one row.
FOLDED = 1000


def _islands(pairs: DataFrame, part: list[str]) -> DataFrame:
    """_island: numbers the stretches of time that no pair's hull bridges. Equal class splits pairs, and so do gaps: pairs that share an interval overlap, so
    those of different islands can't compete."""
    if not {"lo", "hi"} <= set(pairs.columns):
        return pairs.withColumn("_island", F.lit(0))
    w = Window.partitionBy(*part).orderBy("lo", "hi")
    pairs = pairs.withColumn("_new", (F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    return pairs.withColumn("_island", F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def greedy_match(pairs: DataFrame, part: list[str] | None = None) -> DataFrame:
    """Take pairs by falling IoU (then pred_id, gt_id) while neither side is taken; rows video_id, class_name, pred_id, gt_id, iou.

    Islands of few pairs are folded each in a row, without a UDF; those of more than FOLDED pairs are matched in rounds (match_in_rounds), which gives the same. The
    pairs are written once, so that they needn't be found again to tell.
    """
    part = part or ["video_id", "class_name"]
    rows = _islands(pairs, part).select(*part, "_island", "pred_id", "gt_id", "iou")
    rows = stored(rows.withColumn("_dense", F.count("*").over(Window.partitionBy(*part, "_island")) > FOLDED), "pairs")
    taken = _folded(rows.filter("not _dense"), [*part, "_island"])
    dense = rows.filter("_dense")
    if not dense.isEmpty():
        taken = taken.unionByName(match_in_rounds(dense, [*part, "_island"]).drop("round"))
    return taken.select(*part, "pred_id", "gt_id", "iou")


def _folded(pairs: DataFrame, part: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("neg"), "pred_id", "gt_id")))
    empty = F.filter(F.col("pairs"), lambda x: F.lit(False))
    free = lambda acc, x: ~F.exists(acc, lambda y: (y.pred_id == x.pred_id) | (y.gt_id == x.gt_id))
    folded = F.aggregate("pairs", empty, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    taken = pairs.groupBy(*part).agg(ordered.alias("pairs")).select(*part, F.explode(folded).alias("x"))
    return taken.select(*part, "x.pred_id", "x.gt_id", (-F.col("x.neg")).alias("iou"))


def match_in_rounds(pairs: DataFrame, part: list[str]) -> DataFrame:
    """The greedy matching by rounds of mutually best pairs: part, pred_id, gt_id, iou and round.

    A pair that is the first of both its sides, by falling IoU, then ids, is in the greedy matching whatever else is; it is taken, all pairs of
    its two sides leave, and so on until none is left. The first of all pairs is always such a pair, so every round takes one at least, usually a fixed share. Firsts are
    combined in the tasks, so a group may be of any size and an interval may be in any number of pairs. A round is logged and its rest written.
    """
    live, path, k = pairs.select(*part, "pred_id", "gt_id", "iou"), new_path(pairs.sparkSession, "matched"), 0
    order = F.struct((-F.col("iou")).alias("neg"), "pred_id", "gt_id")
    schema = T.StructType([*live.schema.fields, T.StructField("round", T.IntegerType())])
    while True:
        k += 1
        firsts = [live.groupBy(*part, side).agg(F.min(order).alias("first")).select(*part, "first.*") for side in ("pred_id", "gt_id")]
        mutual = firsts[0].join(firsts[1], [*part, "neg", "pred_id", "gt_id"]).select(*part, "pred_id", "gt_id", (-F.col("neg")).alias("iou"), F.lit(k).alias("round"))
        mutual.write.parquet(f"{path}/part-{k}")
        mutual = pairs.sparkSession.read.schema(schema).parquet(f"{path}/part-{k}")
        n = mutual.count()
        if not n:
            return pairs.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
        live = stored(live.join(mutual.select(*part, "pred_id"), [*part, "pred_id"], "left_anti").join(mutual.select(*part, "gt_id"), [*part, "gt_id"], "left_anti"), "pairs")
        _log.info("round %d matched %d pairs", k, n)


def video_components(videos: DataFrame, pred: DataFrame, gt: DataFrame, thr: float = 0.5) -> DataFrame:
    """For each video n_pred, n_gt, matched, f1, mean_iou: all that any weighting of the score needs."""
    taken = greedy_match(candidates(pred, gt, thr)).groupBy("video_id").agg(F.count("*").alias("matched"), F.sum("iou").alias("iou_sum"))
    count = lambda df, to: df.groupBy("video_id").agg(F.count("*").alias(to))
    rows = videos.join(count(pred, "n_pred"), "video_id", "left").join(count(gt, "n_gt"), "video_id", "left").join(taken, "video_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_pred", "n_gt", "matched")})
    n = F.col("n_pred") + F.col("n_gt")
    return rows.withColumns({"f1": F.when(n > 0, 2.0 * F.col("matched") / n).otherwise(0.0), "mean_iou": F.when(F.col("matched") > 0, F.col("iou_sum") / F.col("matched")).otherwise(0.0)}).drop("iou_sum")


def video_score(alert: Column | float, match: Column | float, time: Column | float) -> Column:
    """Score of a video's components under the weights: silence is right where nothing happens, else alert, F1 and timing."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    scored = lit(alert) * (F.col("n_pred") > 0).cast("double") + lit(match) * F.col("f1") + lit(time) * F.col("mean_iou")
    return F.when(F.col("n_gt") == 0, (F.col("n_pred") == 0).cast("double")).otherwise(scored)


def best_event(pred: DataFrame) -> DataFrame:
    """Of each video the event of the highest score (missing counts as 0), the first of equals."""
    return pred.groupBy("video_id").agg(F.max_by("class_name", F.struct(F.coalesce("score", F.lit(0.0)), -F.col("pred_id"))).alias("pred_class"))


def level1_accuracy(videos: DataFrame, pred: DataFrame, gt: DataFrame, normal: str = "normal") -> DataFrame:
    """One row: binary_acc, class_acc and their mean score over videos (video_id, is_anomaly)."""
    first = gt.groupBy("video_id").agg(F.min_by("class_name", "gt_id").alias("gt_class"))
    rows = videos.join(best_event(pred), "video_id", "left").join(first, "video_id", "left")
    guess = F.coalesce("pred_class", F.lit(normal))
    truth = F.when(F.col("is_anomaly"), F.coalesce("gt_class", F.lit(normal))).otherwise(normal)
    mean = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    found = rows.agg(mean((guess != normal) == F.col("is_anomaly")).alias("binary_acc"), mean(guess == truth).alias("class_acc"))
    return found.withColumn("score", (F.col("binary_acc") + F.col("class_acc")) / 2)


def component_report(components: DataFrame) -> DataFrame:
    """By level: found, emitted, false alarms, precision and recall."""
    sums = components.groupBy("level").agg(F.sum("matched").alias("found"), F.sum("n_pred").alias("emitted"), F.sum("n_gt").alias("actual"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.withColumns({"false_alarms": F.col("emitted") - F.col("found"), "precision": share("found", "emitted"), "recall": share("found", "actual")})


def top_per_video(events: DataFrame, k: int, part: list[str] | None = None) -> DataFrame:
    """At most k events of each video by falling score, then pred_id, with their place."""
    place = F.row_number().over(Window.partitionBy(*(part or ["video_id"])).orderBy(F.col("score").desc(), "pred_id"))
    return events.withColumn("place", place.cast("bigint")).filter(F.col("place") <= k)
