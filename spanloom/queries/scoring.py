"""Queries of matching, scores, sensitivity and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import matching as M
from spanloom.plans import decode as D
from spanloom.plans import sweep as W
from spanloom.sources import views as V

from .basic import query, r6


def _components(spark: SparkSession, sf_dir: str, thr: float = 0.5) -> DataFrame:
    return M.video_components(V.videos(spark, sf_dir), V.predictions(spark, sf_dir), V.ground_truth(spark, sf_dir), thr)


def _level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.level1_accuracy(V.videos(spark, sf_dir).filter("level = 1"), V.predictions(spark, sf_dir), V.ground_truth(spark, sf_dir))


@query("select video_id, pred_id, gt_id, round(iou, 6) as iou from v_cand")
def iou_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.candidates(V.predictions(spark, sf_dir), V.ground_truth(spark, sf_dir)).select("video_id", "pred_id", "gt_id", r6("iou").alias("iou"))


@query("select video_id, class_name, pred_id, gt_id, round(iou, 6) as iou from v_match")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.greedy_match(M.candidates(V.predictions(spark, sf_dir), V.ground_truth(spark, sf_dir))).withColumn("iou", r6("iou"))


@query("select video_id, class_name, pred_id, gt_id, round(iou, 6) as iou from v_match")
def greedy_match_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in rounds of mutually best pairs, as for islands of any density."""
    pairs = M.candidates(V.predictions(spark, sf_dir), V.ground_truth(spark, sf_dir))
    return M.match_in_rounds(pairs, ["video_id", "class_name"]).drop("round").withColumn("iou", r6("iou"))


@query("select video_id, matched, round(mean_iou, 6) as mean_iou from v_comp")
def matched_mean_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir).select("video_id", "matched", r6("mean_iou").alias("mean_iou"))


@query("select video_id, arg_min(class_name, rk) as pred_class from (select *, row_number() over (partition by video_id order by score desc, pred_id) as rk from v_pred) group by 1")
def best_event_per_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_event(V.predictions(spark, sf_dir))


@query("select round(binary_acc, 6) as binary_acc, round(class_acc, 6) as class_acc, round((binary_acc + class_acc) / 2, 6) as score from v_l1")
def l1_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level1(spark, sf_dir).select(*(r6(c).alias(c) for c in ("binary_acc", "class_acc", "score")))


@query("select video_id, level, round(case when n_gt = 0 then (n_pred = 0)::int::double else 0.2::double * (n_pred > 0)::int + 0.5::double * f1 + 0.3::double * mean_iou end, 6) as score from v_comp")
def video_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir).select("video_id", "level", r6(M.video_score(0.2, 0.5, 0.3)).alias("score"))


@query("select round(d1, 6) as d1, round(d2, 6) as d2, round(d3, 6) as d3, round(d1 + d2 + d3, 6) as total, (select count(*) filter (where n_pred > 0) from v_comp) as answered from v_grid where w2 = 0 and w3 = 0")
def submission_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.submission_total(_components(spark, sf_dir), _level1(spark, sf_dir))
    return found.select(*(r6(c).alias(c) for c in ("d1", "d2", "d3", "total")), "answered")


@query("select w2::bigint as w2, w3::bigint as w3, round(d1 + d2 + d3, 6) as total from v_grid")
def sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sensitivity(_components(spark, sf_dir), _level1(spark, sf_dir)).select("w2", "w3", r6("total").alias("total"))


@query("select round(min(d1 + d2 + d3), 6) as total_min, round(median(d1 + d2 + d3), 6) as total_median, round(max(d1 + d2 + d3), 6) as total_max from v_grid")
def sensitivity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.summary(W.sensitivity(_components(spark, sf_dir), _level1(spark, sf_dir))).select(*(r6(c).alias(c) for c in ("total_min", "total_median", "total_max")))


@query("""select a.w_id::bigint as w2, b.w_id::bigint as w3, n2, n3 from (select * from v_weights where level_name = 'L2') a cross join (select * from v_weights where level_name = 'L3') b
  cross join (select count(*) filter (where level = 2) as n2, count(*) filter (where level = 3) as n3 from v_comp)""")
def weight_grid_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of a submission's weightings, with the videos of either level that each is an average over."""
    levels = _components(spark, sf_dir).agg(*(F.count_if(F.col("level") == k).alias(f"n{k}") for k in (2, 3)))
    return W.weight_grid(spark).crossJoin(levels).select("w2", "w3", "n2", "n3")


@query("select level, sum(matched)::bigint as found, sum(n_pred)::bigint as emitted, sum(n_pred - matched)::bigint as false_alarms, round(sum(matched) / sum(n_pred), 6) as precision, round(sum(matched) / sum(n_gt), 6) as recall from v_comp group by 1")
def component_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.component_report(_components(spark, sf_dir)).select("level", "found", "emitted", "false_alarms", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("select round(sum(matched) filter (where is_anomaly) / sum(n_pred), 6) as precision, round(sum(matched) / sum(n_gt), 6) as recall, round(avg((n_pred > 0)::int::double) filter (where not is_anomaly), 6) as alarm_rate, sum(n_pred)::bigint as emitted, count(*) filter (where not is_anomaly) as normal_videos from v_comp")
def transfer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.transfer_gate(_components(spark, sf_dir)).select(*(r6(c).alias(c) for c in ("precision", "recall", "alarm_rate")), "emitted", "normal_videos")


_SWEEP = """with recursive ranked as (
  select s, c.*, row_number() over (partition by s, c.video_id, c.class_name order by iou desc, c.pred_id, gt_id) as rn from (select unnest([0.2::double, 0.5::double, 0.8::double]) as s) t cross join v_cand c join v_pred p using (video_id, pred_id) where p.score >= s),
fold as (
  select s, video_id, class_name, pred_id, gt_id, rn, true as taken, [pred_id] as ps, [gt_id] as gs from ranked where rn = 1
  union all
  select c.s, c.video_id, c.class_name, c.pred_id, c.gt_id, c.rn, not list_contains(f.ps, c.pred_id) and not list_contains(f.gs, c.gt_id),
    case when not list_contains(f.ps, c.pred_id) and not list_contains(f.gs, c.gt_id) then list_append(f.ps, c.pred_id) else f.ps end,
    case when not list_contains(f.ps, c.pred_id) and not list_contains(f.gs, c.gt_id) then list_append(f.gs, c.gt_id) else f.gs end
  from fold f join ranked c on c.s = f.s and c.video_id = f.video_id and c.class_name = f.class_name and c.rn = f.rn + 1),
counts as (
  select s as min_score, v.video_id, v.level, (select count(*) from v_gt g where g.video_id = v.video_id) as n_gt, (select count(*) from v_pred p where p.video_id = v.video_id and p.score >= s) as n_pred,
    (select count(*) from fold f where f.s = t.s and f.video_id = v.video_id and f.taken) as matched
  from (select unnest([0.2::double, 0.5::double, 0.8::double]) as s) t cross join v_video v),
swept as (select min_score, level, round(avg(case when n_gt = 0 then (n_pred = 0)::int::double else 2.0::double * matched / (n_pred + n_gt) end), 6) as mean_f1 from counts group by 1, 2)
"""
_SWEPT = f"{_SWEEP}select * from swept"


@query(_SWEPT)
def sweep_grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.threshold_sweep(V.videos(spark, sf_dir), V.predictions(spark, sf_dir), V.ground_truth(spark, sf_dir), [0.2, 0.5, 0.8]).withColumn("mean_f1", r6("mean_f1"))


@query(f"{_SWEEP}select level, arg_min(min_score, k) as min_score, max(mean_f1) as mean_f1 from (select *, row_number() over (partition by level order by mean_f1 desc, min_score) as k from swept) group by 1")
def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.best_trial(sweep_grid_scores(spark, sf_dir), ["level"], "mean_f1", "min_score")


@query("select snap, round(avg(ov / hull), 6) as mean_iou from (select s.snap, (least(s.en, s.n - 10) - greatest(s.st, 8)) as ov, (greatest(s.en, s.n - 10) - least(s.st, 8)) as hull from (select false as snap, video_id, st, en, n from v_spans union all select true, video_id, case when e > b then b else st end, case when e > b then e else en end, n from (select *, coalesce((select arg_min(cp, abs(cp - s.st) * 1000 + cp) from v_cp c where c.video_id = s.video_id and abs(c.cp - s.st) <= 6), st) as b, coalesce((select arg_min(cp, abs(cp - s.en) * 1000 + cp) from v_cp c where c.video_id = s.video_id and abs(c.cp - s.en) <= 6), en) as e from v_spans s)) s) group by 1")
def snap_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sequences import _changepoints, _spans

    found = W.snap_ablation(_spans(spark, sf_dir), _changepoints(spark, sf_dir), 6, F.lit(8.0), F.col("n") - 10.0)
    return found.select("snap", r6("mean_iou").alias("mean_iou"))


_EPOCHS = "select event_id // 500 as epoch, round(avg((value > 30)::int::double), 6) as recall, count(*) filter (where event_type = 'click') as emitted, round(avg(value) / 100, 6) as score from events group by 1"


@query(f"select coalesce(arg_max(epoch, score - epoch * 1e-9) filter (where recall >= 0.25 and emitted >= 40), arg_max(epoch, recall - epoch * 1e-9)) as epoch from ({_EPOCHS})")
def checkpoint_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events").groupBy(F.expr("event_id div 500").alias("epoch"))
    trials = events.agg(r6(F.avg((F.col("value") > 30).cast("double"))).alias("recall"), F.count_if(F.col("event_type") == "click").alias("emitted"), r6(F.avg("value") / 100).alias("score"))
    return W.select_checkpoint(trials, 0.25, 40)




#: The sweep's trials: every combination.
TRIALS = [
    {"width": width, "stride": 2, "threshold": threshold, "expand": expand, "snap": snap, "most_events": most, "gap": gap}
    for width in (6, 10) for threshold in (0.15, 0.2) for expand in (1.0, 1.25) for snap in (False, True) for most in (1, 3) for gap in (0.0, 1.0)
]


def _trial_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events of all trials, videos and their true intervals, over the embeddings' videos."""
    from .sequences import _changepoints, _spans

    found = D.trial_events(V.frames(spark, sf_dir), V.head(spark, sf_dir), TRIALS, normal=9, least=2, scale=60.0, points=_changepoints(spark, sf_dir), most_span=0.6)
    events = found.select("trial", "video_id", F.col("k").alias("pred_id"), F.col("cls").cast("string").alias("class_name"), F.col("start_s").alias("st"), F.col("end_s").alias("en"), "score")
    v = F.col("video_id")
    spans = _spans(spark, sf_dir)
    videos = spans.select("video_id", (2 + v % 2).alias("level"), (v % 6 != 0).alias("is_anomaly"))
    gt = spans.filter("video_id % 6 <> 0").select("video_id", v.alias("gt_id"), (v % 9).cast("string").alias("class_name"), (F.col("st") / 2.0).alias("st"), (F.col("en") / 2.0).alias("en"))
    return events, videos, gt


@query()
def sweep_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all decoder settings by least and median total over the weightings; tests hold it against one trial at a time."""
    events, videos, gt = _trial_tables(spark, sf_dir)
    best = W.best_trials(W.trial_totals(events, videos, gt, len(TRIALS)))
    return best.select("place", "trial", r6("min_total").alias("min_total"), r6("median_total").alias("median_total"))
