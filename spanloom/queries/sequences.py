"""Queries of the sequence operators and the decoders made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.vectors import dot
from spanloom.operators import aggregates as A
from spanloom.operators import long_sequence as L
from spanloom.operators import sequence as S
from spanloom.plans import decode as P
from spanloom.sources import views as V

from .basic import big, query, r6


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.curve(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sliding_windows(_clips(spark, sf_dir), 6, 2)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with the class and value of their best frame."""
    framed = S.window_frames(_windows(spark, sf_dir), V.curve(spark, sf_dir).select("video_id", "i", "class_name", "p"))
    return framed.groupBy("video_id", "n", "st", "en").agg(F.max_by("class_name", F.struct("p", -F.col("i"))).alias("cls"), F.max("p").alias("score"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter("score >= 0.65D")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_windows(_candidates(spark, sf_dir), 2, part=["video_id", "n"])


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = V.frames(spark, sf_dir).select("video_id").distinct()
    return ids.select("video_id", (5 + F.col("video_id") % 7).alias("st"), (30 + F.col("video_id") % 11).alias("en"), F.lit(50).cast("bigint").alias("n"))


def _changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.changepoints(S.adjacent_distance(V.frames(spark, sf_dir)), 8)


@query("select video_id, st, en from v_windows")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("video_id", "st", "en")


@query("select video_id, st, en, round(avg(p), 6) as mean_p from v_windows join v_curve using (video_id) where i >= st and i < en group by all")
def window_mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.span_mean(_windows(spark, sf_dir).select("video_id", "st", "en"), V.curve(spark, sf_dir)).withColumn("mean_p", r6("mean_p"))


@query("""select video_id, i, round((sum(p) over (partition by video_id order by i rows between 2 preceding and 2 following) + greatest(2 - i, 0) * first_value(p) over w + greatest(i + 2 - (n - 1), 0) * last_value(p) over w) / 5, 6) as smooth
  from (select *, count(*) over (partition by video_id) as n from v_curve) window w as (partition by video_id order by i rows between unbounded preceding and unbounded following)""")
def smooth_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.smooth(V.curve(spark, sf_dir), 5).select("video_id", "i", r6("smooth").alias("smooth"))


@query("""select video_id, i, round((sum(p) over (partition by video_id order by i rows between 2 preceding and 2 following) + greatest(2 - i, 0) * first_value(p) over w + greatest(i + 2 - (n - 1), 0) * last_value(p) over w) / 5, 6) as smooth
  from (select *, count(*) over (partition by video_id) as n from v_curve) window w as (partition by video_id order by i rows between unbounded preceding and unbounded following)""")
def smooth_curve_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in blocks of 7 frames, as for sequences that are longer than a task."""
    return L.smooth(V.curve(spark, sf_dir), 5, block=7).select("video_id", "i", r6("smooth").alias("smooth"))


@query("""select video_id, min(i) as st, max(i) + 1 as en, round(avg(p), 6) as mean_p from (
  select *, sum(case when s is distinct from ps then 1 else 0 end) over (partition by video_id order by i) as run from (
    select *, lag(s) over (partition by video_id order by i) as ps from (
      select *, coalesce(last_value(t ignore nulls) over (partition by video_id order by i rows between unbounded preceding and current row), 0) as s from (
        select *, case when p > 0.6 then 1 when p <= 0.35 then 0 end as t from v_curve)))) where s = 1 group by video_id, run""")
def hysteresis_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hysteresis(V.curve(spark, sf_dir), 0.6, 0.35).select("video_id", "st", "en", r6("mean_p").alias("mean_p"))


@query("""select video_id, min(i) as st, max(i) + 1 as en, round(avg(p), 6) as mean_p from (
  select *, sum(case when s is distinct from ps then 1 else 0 end) over (partition by video_id order by i) as run from (
    select *, lag(s) over (partition by video_id order by i) as ps from (
      select *, coalesce(last_value(t ignore nulls) over (partition by video_id order by i rows between unbounded preceding and current row), 0) as s from (
        select *, case when p > 0.6 then 1 when p <= 0.35 then 0 end as t from v_curve)))) where s = 1 group by video_id, run""")
def hysteresis_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in blocks of 7 frames."""
    return L.hysteresis(V.curve(spark, sf_dir), 0.6, 0.35, block=7).select("video_id", "st", "en", r6("mean_p").alias("mean_p"))


@query("""select min(i) as st, max(i) + 1 as en, round(avg(p), 6) as mean_p from (
  select *, coalesce(max(case when t = 0 then i end) over (order by i), -1) as closed from (
    select *, coalesce(last_value(t ignore nulls) over (order by i rows between unbounded preceding and current row), 0) as s from (
      select *, case when p > 0.6 then 1 when p <= 0.35 then 0 end as t from (
        select i, (sum(p) over (order by i rows between 2 preceding and 2 following) + greatest(2 - i, 0) * first_value(p) over w + greatest(i + 2 - (n - 1), 0) * last_value(p) over w) / 5 as p
        from (select event_id as i, value / (value + 35.0::double) as p, count(*) over () as n from events) window w as (order by i rows between unbounded preceding and unbounded following))))) where s = 1 group by closed""")
def long_sequence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one sequence, smoothed and cut into spans in blocks that any number of tasks share."""
    curve = V.table(spark, sf_dir, "events").select(F.lit(0).alias("video_id"), F.col("event_id").alias("i"), (F.col("value") / (F.col("value") + 35.0)).alias("p"))
    smooth = L.smooth(curve, 5, block=1000).select("video_id", "i", F.col("smooth").alias("p"))
    return L.hysteresis(smooth, 0.6, 0.35, block=1000).select("st", "en", r6("mean_p").alias("mean_p"))


@query("select video_id, i, round(d, 6) as d from v_dist")
def adjacent_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.adjacent_distance(V.frames(spark, sf_dir)).filter("d is not null").select("video_id", "i", r6("d").alias("d"))


@query("select video_id, cp from v_cp")
def changepoints_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changepoints(spark, sf_dir)


@query("select video_id, i + 1 as cp from (select *, row_number() over (partition by video_id order by d desc, i desc) as k from v_peak) where k <= 8")
def changepoints_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.changepoints(S.adjacent_distance(V.frames(spark, sf_dir)), 8, rank_by="peak")


@query("select video_id, st, en, cls, round(score, 6) as score from v_merged")
def merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("video_id", "st", "en", "cls", r6("score").alias("score"))


@query("select video_id, st, en, cls, round(score, 6) as score from v_merged")
def merge_windows_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in blocks of 7 frames."""
    return L.merge_windows(_candidates(spark, sf_dir), 2, part=["video_id", "n"], block=7).select("video_id", "st", "en", "cls", r6("score").alias("score"))


@query("""select video_id, min(st) as st, max(en) as en, arg_min(cls, st) as cls, round(max(score), 6) as score from (
  select *, sum(nw) over (partition by video_id order by st, en) as grp from (select *, case when st <= lag(en) over w + 2 then 0 else 1 end as nw from v_wcand window w as (partition by video_id order by st, en))) group by video_id, grp""")
def merge_windows_reclassify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_windows(_candidates(spark, sf_dir), 2, reclassify=True).select("video_id", "st", "en", "cls", r6("score").alias("score"))


@query("select video_id, grp::bigint as grp, st, en from v_expand")
def desmear_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.expand(S.desmear(_merged(spark, sf_dir), 6, 2), 1.25, 2).select("video_id", "grp", "st", "en")


_NEAR = "(select arg_min(cp, abs(cp - {0}) * 1000 + cp) from v_cp c where c.video_id = s.video_id and abs(c.cp - {0}) <= 6)"


@query(f"select video_id, st, {_NEAR.format('s.st')} as cp from v_spans s")
def nearest_changepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest(_spans(spark, sf_dir), _changepoints(spark, sf_dir), ["video_id"], "st", 6, "cp").select("video_id", "st", "cp")


@query(f"select video_id, case when e > b then b else st end as st, case when e > b then e else en end as en from (select *, coalesce({_NEAR.format('s.st')}, st) as b, coalesce({_NEAR.format('s.en')}, en) as e from v_spans s)")
def snap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.snap(_spans(spark, sf_dir), _changepoints(spark, sf_dir), 6, ["video_id"]).select("video_id", "st", "en")


_RUNS = "select video_id, class_name as cls, min(i) as st, max(i) + 1 as en from (select *, i - row_number() over (partition by video_id, class_name, (p > 0.5) order by i) as g, p > 0.5 as a from v_curve) where a group by video_id, class_name, g"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_length(V.curve(spark, sf_dir), F.col("p") > 0.5, "class_name", "p").withColumnRenamed("class_name", "cls")


@query(f"select video_id, cls, st, en from ({_RUNS})")
def run_length_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("video_id", "cls", "st", "en")


@query(f"""select video_id, cls, min(st) as st, arg_max(en, st) as en from (select *, sum(nw) over (partition by video_id, cls order by st) as grp from (
  select r.*, case when a.sec - lag(b.sec) over (partition by r.video_id, r.cls order by r.st) <= 100000 then 0 else 1 end as nw
  from ({_RUNS}) r join v_curve a on a.video_id = r.video_id and a.i = r.st join v_curve b on b.video_id = r.video_id and b.i = r.en - 1)) group by video_id, cls, grp""")
def bridge_gaps_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.curve(spark, sf_dir).select("video_id", "i", F.col("sec").alias("ts"))
    return S.bridge_frames(_runs(spark, sf_dir), frames, 100000.0)


@query("""select video_id, arg_min(cls, st) as cls, round(min(st), 6) as start_s, round(max(en), 6) as end_s, round(max(score), 6) as score from (select *, sum(nw) over (partition by video_id order by st, en) as grp from (
  select *, class_name as cls, case when class_name = lag(class_name) over w and st - lag(en) over w <= 20000 then 0 else 1 end as nw from v_pred window w as (partition by video_id order by st, en))) group by video_id, grp""")
def bridge_gaps_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.predictions(spark, sf_dir).select("video_id", F.col("class_name").alias("cls"), F.col("st").alias("start_s"), F.col("en").alias("end_s"), "score")
    return S.bridge_seconds(rows, 20000.0).select("video_id", "cls", *(r6(c).alias(c) for c in ("start_s", "end_s", "score")))


@query("select video_id, i, d::bigint as d, round(case when d < 64 then emb[d + 1] else emb[d - 63] - coalesce(b[d - 63], emb[d - 63]) end, 6) + 0.0::double as x from (select *, unnest([0, 63, 64, 100]) as d from (select *, lag(emb) over (partition by video_id order by i) as b from v_frames))")
def frame_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.explode(F.array(*map(F.lit, (0, 63, 64, 100)))).alias("d")
    return S.frame_delta(V.frames(spark, sf_dir)).select("video_id", "i", "feature", at).select("video_id", "i", big("d").alias("d"), r6(F.get("feature", F.col("d"))).alias("x"))


_CLS = "case video_id % 3 when 0 then '1-URGENT' when 1 then '2-HIGH' else '5-LOW' end"
_PRIORS = "select o_orderpriority as cls, quantile_cont(o_totalprice, 0.1) / 20000 as p10, quantile_cont(o_totalprice, 0.5) / 20000 as p50 from orders group by 1"


@query(f"""select video_id, case when short then greatest(0, floor((st + en) / 2.0::double - k / 2.0::double))::bigint else st end as st, case when short then least(n, ceil((st + en) / 2.0::double + k / 2.0::double))::bigint else en end as en from (
  select s.*, coalesce((en - st) * 0.1::double < p10, false) as short, greatest(1, round_even(p50 / 0.1::double, 0)::bigint) as k from (select *, {_CLS} as cls from v_spans) s left join ({_PRIORS}) using (cls))""")
def duration_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    priors = A.duration_priors(V.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cls"), F.col("o_totalprice").alias("dur")), "cls", "dur").withColumns({p: F.col(p) / 20000 for p in ("p10", "p50", "p90")})
    cls = F.expr("case video_id % 3 when 0 then '1-URGENT' when 1 then '2-HIGH' else '5-LOW' end")
    return S.duration_prior(_spans(spark, sf_dir).withColumns({"cls": cls, "step": F.lit(0.1)}), priors).select("video_id", "st", "en")


@query(f"select r.video_id, r.st, r.en, round(avg(p), 6) as mean_p from ({_RUNS}) r join v_curve c on c.video_id = r.video_id and c.i >= r.st and c.i < r.en group by all")
def span_mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.span_mean(_runs(spark, sf_dir).select("video_id", "st", "en"), V.curve(spark, sf_dir)).withColumn("mean_p", r6("mean_p"))


@query("select video_id, i, round(0.25 * coalesce(lag(e) over w, 0) + e + 0.25 * coalesce(lead(e) over w, 0), 6) as boundary from (select *, (class_name = 'purchase')::int::double as e from v_curve) window w as (partition by video_id order by i)")
def boundary_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.curve(spark, sf_dir).withColumn("edge", (F.col("class_name") == "purchase").cast("double"))
    return S.boundary_kernel(rows).select("video_id", "i", r6("boundary").alias("boundary"))


@query("select video_id, n, (sum(n) over (order by video_id) - n)::bigint as offset from v_n")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.running_offsets(_clips(spark, sf_dir))


# --- decoders


@query("select video_id, class_name, min(i) as st, max(i) + 1 as en, round(avg(s), 6) as score from (select *, sum(case when o is distinct from po then 1 else 0 end) over (partition by video_id, class_name order by i) as run from (select *, lag(o) over (partition by video_id, class_name order by i) as po from (select *, coalesce(last_value(t ignore nulls) over (partition by video_id, class_name order by i rows between unbounded preceding and current row), 0) as o from (select *, case when s > 0.6 then 1 when s <= 0.45 then 0 end as t from (select *, (sum(p) over (partition by video_id, class_name order by i rows between 1 preceding and 1 following) + (i = 0)::int * first_value(p) over w + (i = n - 1)::int * last_value(p) over w) / 3 as s from (select *, count(*) over (partition by video_id, class_name) as n from (select video_id, class_name, p, row_number() over (partition by video_id, class_name order by i) - 1 as i from v_curve)) window w as (partition by video_id, class_name order by i rows between unbounded preceding and unbounded following)))))) where o = 1 group by video_id, class_name, run having max(i) + 1 - min(i) >= 2")
def decode_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.per_class(V.curve(spark, sf_dir), win=3, hi=0.6, lo=0.45, least=2)
    return found.select("video_id", "class_name", "st", "en", r6("score").alias("score"))


_LOGIT = "select f.video_id, f.i, h.class_idx, 60 * list_dot_product(f.emb, h.w) as x from v_frames f cross join v_head h"
_WPROB = f"""select video_id, st, en, class_idx, exp(x - max(x) over w) / sum(exp(x - m)) over w as p from (select *, max(x) over (partition by video_id, st) as m from (
  select w.video_id, w.st, least(w.n, w.st + 6) as en, l.class_idx, avg(l.x) as x from (select video_id, n, unnest(list_distinct(list_concat(range(0, greatest(0, n - 6) + 1, 2), [greatest(0, n - 6)]))) as st from (select video_id, count(*) as n from v_frames group by 1)) w join ({_LOGIT}) l on l.video_id = w.video_id and l.i >= w.st and l.i < w.st + 6 group by all)) window w as (partition by video_id, st)"""
_WCLS = f"select video_id, st, en, cls, p as score from (select *, class_idx::bigint as cls, row_number() over (partition by video_id, st order by p desc, class_idx) as k, max(case when class_idx = 9 then p end) over (partition by video_id, st) as normal from ({_WPROB}) where true) where k = 1 and cls <> 9 and p >= 0.2 and p > normal"


def _window_sql(same: str) -> str:
    return f"""select video_id, cls, st, en, round(score, 6) as score from (select video_id, cls, score, greatest(0, floor((s + e) / 2.0::double - greatest(1.0::double, (e - s) * 1.25::double / 2)))::bigint as st, least((select count(*) from v_frames f where f.video_id = z.video_id), ceil((s + e) / 2.0::double + greatest(1.0::double, (e - s) * 1.25::double / 2)))::bigint as en from (
    select video_id, cls, score, case when e - s < 2 then round_even((s + e) / 2.0::double - 1, 0)::bigint else s end as s, case when e - s < 2 then round_even((s + e) / 2.0::double + 1, 0)::bigint else e end as e from (
    select video_id, grp, arg_min(cls, st) as cls, max(score) as score, round_even(min(st) + 3.0::double, 0)::bigint as s, round_even(max(en) - 3.0::double, 0)::bigint as e from (select *, sum(nw) over (partition by video_id order by st) as grp from (
    select *, case when st <= lag(en) over w + 2 {same} then 0 else 1 end as nw from ({_WCLS}) window w as (partition by video_id order by st))) group by video_id, grp)) z)"""


def _decoded(spark: SparkSession, sf_dir: str, reclassify: bool) -> DataFrame:
    scores = P.window_probabilities(V.frames(spark, sf_dir), V.head(spark, sf_dir), width=6, stride=2, scale=60.0)
    return P.windows(scores, normal=9, threshold=0.2, width=6, stride=2, expand=1.25, least=2, reclassify=reclassify).select("video_id", big("cls").alias("cls"), "st", "en", r6("score").alias("score"))


@query(_window_sql("and cls = lag(cls) over w"))
def decode_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, False)


@query(_window_sql(""))
def decode_windows_reclassify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, True)


@query(f"select video_id, cls, st, en, score, k from (select *, row_number() over (partition by video_id order by score desc, st, en) as k from ({_window_sql('and cls = lag(cls) over w')})) where k <= 2")
def decode_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top(_decoded(spark, sf_dir, False), 2).select("video_id", "cls", "st", "en", "score", big("k").alias("k"))


@query("select class_idx, d::bigint as d, round(w[d + 1], 6) as x from (select *, unnest(range(0, 64)) as d from v_head)")
def centroid_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.head(spark, sf_dir).select("class_idx", F.posexplode("w").alias("d", "x")).select("class_idx", big("d").alias("d"), r6("x").alias("x"))


@query("select video_id, i, arg_max(class_idx, x) as guess, round(max(x), 6) as x from (select f.video_id, f.i, h.class_idx, list_dot_product(f.emb, h.w) as x from v_frames f cross join v_head h) group by 1, 2")
def frame_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.broadcast(V.head(spark, sf_dir))
    rows = V.frames(spark, sf_dir).select("video_id", "i", "emb").join(head).select("video_id", "i", "class_idx", dot("emb", "w").alias("x"))
    return rows.groupBy("video_id", "i").agg(F.max_by("class_idx", "x").alias("guess"), r6(F.max("x")).alias("x"))


_SNAPPED = _window_sql("and cls = lag(cls) over w")


@query(f"select video_id, cls, case when e > b then b else st end as st, case when e > b then e else en end as en, score from (select *, coalesce({_NEAR.format('s.st')}, st) as b, coalesce({_NEAR.format('s.en')}, en) as e from ({_SNAPPED}) s)")
def decode_windows_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = P.window_probabilities(V.frames(spark, sf_dir), V.head(spark, sf_dir), width=6, stride=2, scale=60.0)
    found = P.windows(scores, normal=9, threshold=0.2, width=6, stride=2, expand=1.25, least=2, points=_changepoints(spark, sf_dir))
    return found.select("video_id", big("cls").alias("cls"), "st", "en", r6("score").alias("score"))


def _sweep_sql(k: int, threshold: float, factor: float) -> str:
    sql = _SNAPPED.replace("p >= 0.2 and", f"p >= {threshold} and").replace("1.25::double", f"{factor}::double")
    return f"select {k}::bigint as param_id, count(*) as spans, sum(en - st)::bigint as frames, round(max(score), 6) as best from ({sql})"


_GRID = [(0, 0.15, 1.0), (1, 0.2, 1.25), (2, 0.25, 1.25)]


@query(" union all ".join(_sweep_sql(*g) for g in _GRID))
def sweep_decode_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = P.window_probabilities(V.frames(spark, sf_dir), V.head(spark, sf_dir), width=6, stride=2, scale=60.0)
    params = spark.createDataFrame(_GRID, "param_id bigint, threshold double, factor double")
    found = P.window_sweep(scores, params, normal=9, width=6, stride=2, least=2)
    each = found.groupBy("param_id").agg(F.count("*").alias("spans"), F.sum(F.col("en") - F.col("st")).alias("frames"), r6(F.max("score")).alias("best"))
    # Parameters under which no span is left count too.
    return params.select("param_id").join(each, "param_id", "left").withColumn("spans", F.coalesce("spans", big(F.lit(0))))


@query("select video_id, i, k::bigint as k, round(case when k % 2 = 0 then sin(i / pow(10000, 2 * (k // 2) / 8.0::double)) else cos(i / pow(10000, 2 * (k // 2) / 8.0::double)) end, 6) + 0.0::double as x from (select video_id, i, unnest(range(0, 8)) as k from v_frames)")
def positional_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.positional_encoding(V.frames(spark, sf_dir).select("video_id", "i"), 8)
    return found.select("video_id", "i", F.posexplode("position").alias("k", "x")).select("video_id", "i", big("k").alias("k"), (r6("x") + 0.0).alias("x"))


_SNAP = "select video_id, cls, case when e > b then b else st end as st, case when e > b then e else en end as en, score from (select *, coalesce({near_st}, st) as b, coalesce({near_en}, en) as e from ({spans}) s)"
_N = "(select count(*) from v_frames f where f.video_id = {0}.video_id)"


def _snapped_sql(spans: str) -> str:
    return _SNAP.format(near_st=_NEAR.format("s.st"), near_en=_NEAR.format("s.en"), spans=spans)


def _events_sql(spans: str) -> str:
    """Seconds, bridging of gaps up to a second, and the three best of each video."""
    timed = f"select video_id, cls, st * 0.5::double as a, (en - 1) * 0.5::double + 0.5::double as b, score from ({spans}) t"
    runs = f"select *, sum(nw) over (partition by video_id order by a, b, cls rows between unbounded preceding and current row) as grp from (select *, case when cls = lag(cls) over w and a - lag(b) over w <= 1.0::double then 0 else 1 end as nw from ({timed}) window w as (partition by video_id order by a, b, cls))"
    return f"select * from (select *, row_number() over (partition by video_id order by score desc, start_s, end_s) as k from (select video_id, arg_min(cls, a) as cls, min(a) as start_s, max(b) as end_s, max(score) as score from ({runs}) group by video_id, grp)) where k <= 3"


def _whole(spans: str) -> str:
    return f"select * from ({spans}) t where en > st and (en - st) / {_N.format('t')} <= 0.6::double"


_SPANS_RE = _whole(_snapped_sql(_window_sql("")))
_MEANS = f"select r.video_id, r.st, r.en, l.class_idx, avg(l.x) as x from (select distinct video_id, st, en from ({_SPANS_RE})) r join ({_LOGIT}) l on l.video_id = r.video_id and l.i >= r.st and l.i < r.en group by all"
_PROBS = f"select *, exp(x - m) / sum(exp(x - m)) over (partition by video_id, st, en) as p from (select *, max(x) over (partition by video_id, st, en) as m from ({_MEANS}))"
_OWN = f"select video_id, st, en, arg_max(class_idx, p) filter (where class_idx <> 9)::bigint as cls, round(max(p) filter (where class_idx <> 9), 6) as score, max(p) filter (where class_idx <> 9) > coalesce(max(p) filter (where class_idx = 9), 0) as ok from ({_PROBS}) group by 1, 2, 3"


def _window_events(spark: SparkSession, sf_dir: str, reclassify: bool) -> DataFrame:
    found = P.window_events(
        V.frames(spark, sf_dir), V.head(spark, sf_dir), normal=9, threshold=0.2, width=6, stride=2, expand=1.25, least=2, scale=60.0, points=_changepoints(spark, sf_dir), reclassify=reclassify, gap=1.0, most_events=3, most_span=0.6
    )
    return found.select("video_id", big("cls").alias("cls"), "start_s", "end_s", r6("score").alias("score"), "k")


@query(_events_sql(_whole(_snapped_sql(_window_sql("and cls = lag(cls) over w")))))
def decode_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production decoder from embeddings to ranked events in seconds."""
    return _window_events(spark, sf_dir, False)


@query(_events_sql(f"select r.video_id, o.cls, r.st, r.en, o.score from ({_SPANS_RE}) r join ({_OWN}) o using (video_id, st, en) where o.ok"))
def decode_reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the class of each whole interval, and rejection."""
    return _window_events(spark, sf_dir, True)


_EDGE = "coalesce((select arg_min(cp, abs(cp - {0}) * 1000 + cp) from v_cp c where c.video_id = s.video_id and abs(c.cp - {0}) <= 6), {0})"


@query(f"""with raw as (select video_id, i, h.class_idx as cls, 60 * list_dot_product(emb, w) as x from v_frames f, v_head h),
p as (select video_id, i, cls, exp(x) / sum(exp(x)) over (partition by video_id, i) as p from raw),
n as (select video_id, count(*) as n from v_frames group by 1),
smooth as (
  select video_id, cls, i, (sum(p) over (partition by video_id, cls order by i rows between 2 preceding and 2 following) + greatest(2 - i, 0) * first_value(p) over w + greatest(i + 2 - (n - 1), 0) * last_value(p) over w) / 5 as v
  from p join n using (video_id) window w as (partition by video_id, cls order by i rows between unbounded preceding and unbounded following)),
state as (select *, coalesce(last_value(case when v > 0.2 then 1 when v <= 0.12 then 0 end ignore nulls) over o, 0) as open, max(case when v <= 0.12 then i end) over o as closed from smooth window o as (partition by video_id, cls order by i rows between unbounded preceding and current row)),
span as (select video_id, cls, min(i) as st, max(i) + 1 as en from state where open = 1 group by video_id, cls, closed),
near as (select *, {_EDGE.format("s.st")} as s1, {_EDGE.format("s.en")} as e1 from span s),
snapped as (select distinct video_id, cls, case when e1 > s1 then s1 else st end as st, case when e1 > s1 then e1 else en end as en from near),
run as (select *, sum(fresh) over (partition by video_id, cls order by st, en) as grp from (select *, case when (st - (lag(en) over (partition by video_id, cls order by st, en) - 1)) / 2.0::double <= 1 then 0 else 1 end as fresh from snapped)),
bridged as (select video_id, cls, min(st) as st, arg_max(en, st * 1000 + en) as en from run group by video_id, cls, grp),
wide as (select video_id, cls, st as s0, greatest(0, floor((st + en - 1) / 2.0::double - (en - st) * 1.1::double / 2))::bigint as st, least(n, ceil((st + en - 1) / 2.0::double + (en - st) * 1.1::double / 2 + 1))::bigint as en from bridged join n using (video_id)),
scored as (select w.video_id, w.cls, w.s0, w.st / 2.0::double as start_s, (w.en - 1) / 2.0::double + 0.5::double as end_s, avg(v) as score from wide w join smooth s on s.video_id = w.video_id and s.cls = w.cls and s.i >= w.st and s.i < w.en where (w.en - w.st) / 2.0::double >= 1 group by all)
select video_id, cls::bigint as cls, start_s, end_s, round(score, 6) as score, row_number() over (partition by video_id order by score desc, start_s, end_s) as k from scored""")
def extract_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve decoder in full over every class's probability."""
    frames, head = V.frames(spark, sf_dir), F.broadcast(V.head(spark, sf_dir))
    scores = frames.select("video_id", "i", "emb").join(head).select("video_id", "i", big("class_idx").alias("cls"), (60.0 * dot("emb", "w")).alias("x"))
    mean = scores.groupBy("video_id", "i").agg(F.max("x").alias("m"), F.sum(F.exp("x")).alias("s"))
    curve = scores.join(mean, ["video_id", "i"]).select("video_id", "i", "cls", (F.exp("x") / F.col("s")).alias("p"))
    found = P.extract_events(curve, frames, win=5, hi=0.2, lo=0.12, gap=1.0, expand=1.1, least_s=1.0, points=_changepoints(spark, sf_dir))
    return found.withColumn("score", r6("score"))


@query("select 'T' || lpad(video_id::varchar, 6, '0') as video_id, n, (sum(n) over (order by video_id) - n)::bigint as offset from v_n")
def running_offsets_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets where ids are names."""
    return S.running_offsets(_clips(spark, sf_dir).withColumn("video_id", F.concat(F.lit("T"), F.lpad(F.col("video_id").cast("string"), 6, "0"))))
