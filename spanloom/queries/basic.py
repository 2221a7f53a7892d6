"""Queries of sources, projections, joins, aggregations, set operations and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.intervals import half_even
from spanloom.functions.vectors import argmax, dot, softmax
from spanloom.operators import aggregates as A
from spanloom.operators import decisions as D
from spanloom.operators import relations as R
from spanloom.sources import views as V
from spanloom.sources.views import table

from .duck import duck

CATALOGUE: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that checks it."""

    def put(f):
        CATALOGUE[f.__name__] = (f, duck(sql) if sql else None)
        return f

    return put


big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")
r6 = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- sources and projections


@query("select video_id, i, fps, step from (select *, greatest(1, round_even(fps / 2.0::double, 0)::bigint) as step from (select *, case video_id % 4 when 0 then 15.0::double when 1 then 25.0 when 2 then 30.0 else 1.88 end as fps from v_frames)) where i % step = 0")
def frame_sample_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = F.expr("case video_id % 4 when 0 then 15.0D when 1 then 25.0D when 2 then 30.0D else 1.88D end")
    return D.sample_frames(V.frames(spark, sf_dir).withColumn("fps", fps), 2.0).select("video_id", "i", "fps", "step")


@query("select event_id, class_idx from (select event_id, case event_type when 'view' then 0 when 'click' then 1 when 'cart' then 2 when 'purchase' then 3 else 4 end::bigint as class_idx from events)")
def class_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = D.class_table(spark, ["view", "click", "cart", "purchase"], other="normal")
    return D.encode_class(table(spark, sf_dir, "events"), classes, "event_type", unknown=4).select("event_id", big("class_idx").alias("class_idx"))


@query("select vec_id, case label when 0 then 'c0' when 1 then 'c1' when 2 then 'c2' when 9 then 'normal' else 'c' || label end as class_name from embeddings")
def class_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"c{k}" for k in range(9)] + ["normal"]
    return table(spark, sf_dir, "embeddings").select("vec_id", D.decode_class("label", names).alias("class_name"))


@query("select doc_id, strict, lenient from (select doc_id, case lower(b) when 'true' then true when 'false' then false end as strict, coalesce(lower(b) = 'true', false) as lenient from (select doc_id, case doc_id % 3 when 0 then 'True' when 1 then 'FALSE' else 'maybe' end as b from documents)) ")
def bool_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.expr("case doc_id % 3 when 0 then 'True' when 1 then 'FALSE' else 'maybe' end")
    return table(spark, sf_dir, "documents").select("doc_id", D.parse_bool(b).alias("strict"), D.parse_bool_lenient(b).alias("lenient"))


@query("select video_id, dur, dur > 30 as is_real_holdout from (select video_id, max(sec) / 3600.0::double / 20.0::double as dur from v_curve group by 1)")
def holdout_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.curve(spark, sf_dir).groupBy("video_id").agg((F.max("sec") / 3600.0 / 20.0).alias("dur")).withColumn("is_real_holdout", F.col("dur") > 30)


@query("select event_id, user_id from events where user_id in (select c_custkey from customer where c_nationkey = 3)")
def ids_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").join(ids, "user_id", "left_semi").select("event_id", "user_id")


@query("select c_custkey, c_name from customer where starts_with(c_name, 'Customer') and try_cast(substr(c_name, 10) as integer) >= 25")
def id_pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(D.id_at_least("c_name", "Customer", 10, 25)).select("c_custkey", "c_name")


_PROBS = "select vec_id, list_transform(e, lambda x: exp(x - list_max(e))) as e from (select vec_id, list_transform(embedding[1:12]::double[], lambda x: x * 8) as e from embeddings)"


def _probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 12), lambda x: x * 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", logits.alias("logits")).select("vec_id", softmax("logits").alias("probs"))


@query(f"select vec_id, k::bigint as k, round(e[k + 1] / list_sum(e), 6) as p from (select *, unnest(range(0, 12)) as k from ({_PROBS}))")
def softmax_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probs(spark, sf_dir).select("vec_id", F.posexplode("probs").alias("k", "p")).select("vec_id", big("k").alias("k"), r6("p").alias("p"))


_L1 = f"select vec_id, list_transform(e, lambda x: x / list_sum(e)) as p from ({_PROBS})"


@query(f"select vec_id, (list_position(p[1:11], list_max(p[1:11])) - 1)::bigint as cls, round(list_max(p[1:11]), 6) as score from ({_L1}) where p[12] < 0.4")
def l1_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.level1_decision(_probs(spark, sf_dir), 0.4).select("vec_id", big("cls").alias("cls"), r6("score").alias("score"))


@query(f"select vec_id, (list_position(p[1:11], list_max(p[1:11])) - 1)::bigint as cls, round(list_max(p[1:11]), 6) as score from ({_L1}) where list_max(p[1:11]) >= 0.2 and list_max(p[1:11]) > p[12]")
def active_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.active(_probs(spark, sf_dir), 0.2).select("vec_id", big("cls").alias("cls"), r6("score").alias("score"))


@query("select pred_id, round(en - st, 6) as dur from v_pred where en - st >= 20000")
def min_duration_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.predictions(spark, sf_dir).filter(F.col("en") - F.col("st") >= 20000).select("pred_id", r6(F.col("en") - F.col("st")).alias("dur"))


@query("select video_id, pred_id, round(st, 6) as st, round(en, 6) as en from v_pred join (select video_id, max(sec) as n from v_curve group by 1) using (video_id) where en > st and (en - st) / n <= 0.02")
def span_fraction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.curve(spark, sf_dir).groupBy("video_id").agg(F.max("sec").alias("n"))
    found = D.within_fraction(V.predictions(spark, sf_dir).join(n, "video_id"), 0.02)
    return found.select("video_id", "pred_id", r6("st").alias("st"), r6("en").alias("en"))


@query("select video_id, i, case when video_id % 3 = 0 then 'Thick smoke is visible throughout the clip.' else printf('Thick smoke observed from %.1fs to %.1fs.', ts, ts + 1.5) end as explanation from v_frames")
def explain_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = D.explanation(F.lit("Thick smoke"), F.when(F.col("video_id") % 3 != 0, F.col("ts")), F.col("ts") + 1.5)
    return V.frames(spark, sf_dir).select("video_id", "i", text.alias("explanation"))


@query("""select video_id, i, case when video_id % 3 = 0 then '{"class_name":"smoke","start_time_sec":null,"end_time_sec":null,"score":' || (i / 4.0::double)::varchar || '}'
  else '{"class_name":"smoke","start_time_sec":' || ts::varchar || ',"end_time_sec":' || (ts + 1.5::double)::varchar || ',"score":' || (i / 4.0::double)::varchar || ',"explanation":"Thick smoke in the picture."}' end as event from v_frames""")
def event_serialise_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("video_id") % 3 == 0, 1).otherwise(2)
    timed = level > 1
    rows = V.frames(spark, sf_dir).select("video_id", "i", level.alias("level"), F.lit("smoke").alias("class_name"), F.when(timed, F.col("ts")).alias("start_time_sec"), F.when(timed, F.col("ts") + 1.5).alias("end_time_sec"), (F.col("i") / 4.0).alias("score"), F.when(timed, "Thick smoke in the picture.").otherwise("short").alias("explanation"))
    return rows.select("video_id", "i", D.event_json().alias("event"))


# --- joins


@query("select d.doc_id, d.lang, l.quality from documents d join labels l using (doc_id)")
def docs_labels_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.join_one_to_one(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("select v.video_id, coalesce(p.n, 0) as n_pred from v_video v left join (select video_id, count(*) as n from v_pred group by 1) p using (video_id)")
def pred_left_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.predictions(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"))
    return V.videos(spark, sf_dir).join(n, "video_id", "left").select("video_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_pred"))


@query("select c_custkey as video_id from customer where c_custkey not in (select user_id from events)")
def manifest_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.missing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id")), V.videos(spark, sf_dir), "video_id")


@query("select video_id from v_video where video_id not in (select c_custkey from customer where c_nationkey < 20)")
def unknown_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.missing(V.videos(spark, sf_dir).select("video_id"), table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("video_id")), "video_id")


@query("select video_id, level, n_nations from v_video join (select n_regionkey + 1 as level, count(*) as n_nations from nation group by 1) using (level)")
def level_map_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "nation").groupBy((F.col("n_regionkey") + 1).cast("bigint").alias("level")).agg(F.count("*").alias("n_nations"))
    return V.videos(spark, sf_dir).select("video_id", "level").join(sizes, "level")


@query("""select v.video_id, coalesce(a.src, b.src) as src from v_video v left join (select distinct user_id as video_id, 'eval' as src from events where event_id % 50 = 0) a using (video_id)
  left join (select distinct user_id as video_id, 'test' as src from events where event_id % 20 = 0) b using (video_id)""")
def cache_fallback_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    cache = lambda k, name: events.filter(F.col("event_id") % k == 0).select(F.col("user_id").alias("video_id"), F.lit(name).alias("src")).distinct()
    return R.first_found(V.videos(spark, sf_dir).select("video_id"), [cache(50, "eval"), cache(20, "test")], "video_id", "src")


@query("select o_orderkey, case when n.k is not null then n.v else o_totalprice end as price from orders left join (select l_orderkey as k, round(sum(l_extendedprice), 6) as v from lineitem where l_orderkey % 4 = 0 group by 1) n on o_orderkey = n.k")
def overwrite_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "lineitem").filter("l_orderkey % 4 = 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(r6(F.sum("l_extendedprice")).alias("price"))
    return R.overwrite(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), new, "o_orderkey", ["price"])


# --- aggregations


@query("select user_id, arg_min(event_type, event_id) as first_type, arg_min(value, event_id) as first_value from events group by 1")
def group_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_by(table(spark, sf_dir, "events"), ["user_id"], "event_id", {"event_type": "first_type", "value": "first_value"})


@query("select o_orderpriority as class_name, round(quantile_cont(o_totalprice, 0.1), 6) as p10, round(quantile_cont(o_totalprice, 0.5), 6) as p50, round(quantile_cont(o_totalprice, 0.9), 6) as p90 from orders group by 1")
def duration_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.duration_priors(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("class_name"), F.col("o_totalprice").alias("dur")), "class_name", "dur")
    return found.select("class_name", *(r6(c).alias(c) for c in ("p10", "p50", "p90")))


@query("select c.k::bigint as class_idx, coalesce(n, 1) as n from (select unnest(range(0, 12)) as k) c left join (select label as k, count(*) as n from embeddings group by 1) using (k)")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.class_counts(table(spark, sf_dir, "embeddings").select(big("label").alias("class_idx")), 12)


@query("select k::bigint as class_idx, round(w / avg(w) over (), 6) as weight from (select k, 1 / sqrt(coalesce(n, 1)) as w from (select unnest(range(0, 12)) as k) left join (select label as k, count(*) as n from embeddings group by 1) using (k))")
def class_weights_inv_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.class_weights(A.class_counts(table(spark, sf_dir, "embeddings").select(big("label").alias("class_idx")), 12)).select("class_idx", r6("weight").alias("weight"))


_TRUE_PRED = "select quality as t, (doc_id % 3 = 0)::int as p from documents join labels using (doc_id)"


def _true_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(big("quality").alias("truth"), big((F.col("doc_id") % 3 == 0)).alias("guess"))


@query(f"select a.k::bigint as truth, b.k::bigint as guess, coalesce(n, 0) as n from (select unnest([0, 1]) as k) a cross join (select unnest([0, 1]) as k) b left join (select t, p, count(*) as n from ({_TRUE_PRED}) group by 1, 2) c on a.k = c.t and b.k = c.p")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion(_true_pred(spark, sf_dir), 2)


@query(f"select round(avg(r), 6) as balanced_accuracy from (select t, avg((t = p)::int::double) as r from ({_TRUE_PRED}) group by 1)")
def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.balanced_accuracy(_true_pred(spark, sf_dir)).select(r6("balanced_accuracy").alias("balanced_accuracy"))


@query("select video_id, round(coalesce(median(d), 0.5), 6) as step from (select video_id, sec - lag(sec) over (partition by video_id order by i) as d from v_curve) group by 1")
def median_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.median_step(V.curve(spark, sf_dir), "sec", ["video_id"], "i", 0.5).select("video_id", r6("step").alias("step"))


@query("select text, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicates(table(spark, sf_dir, "documents"), ["text"], first="doc_id").withColumnRenamed("first", "first_id")


@query("select video_id, d::bigint as d, round(sum(w * emb[d + 1]) / sum(w), 6) as v from (select video_id, emb, exp(emb[1] - max(emb[1]) over (partition by video_id)) as w, unnest(range(0, len(emb))) as d from v_frames) group by 1, 2")
def attention_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.frames(spark, sf_dir).withColumn("a", F.col("emb")[0])
    return A.attention_pool(frames, "a", "emb", ["video_id"]).select("video_id", big("d").alias("d"), r6("v").alias("v"))


@query("select bin::bigint as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as rate from (select p, (class_name = 'click')::int::double as y, least(floor(p * 10), 9) as bin from v_curve) group by 1")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.curve(spark, sf_dir).select("p", (F.col("class_name") == "click").cast("double").alias("y"))
    return A.reliability(rows, "p", "y", 10).select("bin", "n", r6("mean_p").alias("mean_p"), r6("rate").alias("rate"))


@query("select round(sum(n * abs(mean_p - rate)) / sum(n), 6) as ece from (select bin, count(*) as n, avg(p) as mean_p, avg(y) as rate from (select p, (class_name = 'click')::int::double as y, least(floor(p * 10), 9) as bin from v_curve) group by 1)")
def reliability_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.curve(spark, sf_dir).select("p", (F.col("class_name") == "click").cast("double").alias("y"))
    return A.calibration_error(A.reliability(rows, "p", "y", 10)).select(r6("ece").alias("ece"))


@query("select user_id, count(*) as frames, count(*) filter (where event_type = 'purchase') as chunks, round(sum(value), 6) as ms from events group by 1")
def runtime_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if(F.col("event_type") == "purchase").alias("chunks"), r6(F.sum("value")).alias("ms"))


@query("select count(*) as total, count(*) filter (where en > 2500000) as clamped, count(*) filter (where st < 0) as dropped, round(avg(en - st), 6) as mean_len from v_pred")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.predictions(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("en") > 2500000).alias("clamped"), F.count_if(F.col("st") < 0).alias("dropped"), r6(F.avg(F.col("en") - F.col("st"))).alias("mean_len"))


@query("select doc_id, strlen(text) as bytes, strlen(text) <= 5000 as fits from documents")
def document_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", big(F.octet_length("text")).alias("bytes"), (F.octet_length("text") <= 5000).alias("fits"))


# --- sorts and top-k


@query("select video_id, pred_id, row_number() over (partition by video_id order by score desc, pred_id) as place from v_pred")
def rank_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("score").desc(), "pred_id"))
    return V.predictions(spark, sf_dir).select("video_id", "pred_id", big(place).alias("place"))


@query("select video_id, pred_id, place from (select video_id, pred_id, row_number() over (partition by video_id order by score desc, pred_id) as place from v_pred) where place <= 5")
def topn_per_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.operators.matching import top_per_video

    return top_per_video(V.predictions(spark, sf_dir), 5).select("video_id", "pred_id", "place")


@query("select l_orderkey, round(sum(l_extendedprice), 2) as total, max(l_quantity) as most from lineitem group by 1 order by total desc, most desc, l_orderkey limit 10")
def top10_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.max("l_quantity").alias("most"))
    return trials.orderBy(F.desc("total"), F.desc("most"), "l_orderkey").limit(10)


# --- set operations


@query("select n_nationkey::bigint as k, n_name as name, null::varchar as region from nation union all by name select r_regionkey::bigint as k, null::varchar as name, r_name as region from region")
def union_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(big("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return a.unionByName(table(spark, sf_dir, "region").select(big("r_regionkey").alias("k"), F.col("r_name").alias("region")), allowMissingColumns=True)


@query("select c_custkey as user_id from customer except select user_id from events")
def set_difference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).subtract(table(spark, sf_dir, "events").select("user_id"))


@query("select event_id, list_has_all(json_keys(props), ['k']) as complete from events")
def subset_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", R.has_all(F.json_object_keys("props"), ["k"]).alias("complete"))


@query("select distinct level from v_video")
def distinct_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.videos(spark, sf_dir).select("level").distinct()


_MIRROR = "select coalesce(a.k, b.k) as k, case when a.k is null then 'only_remote' when b.k is null then 'only_local' when a.v is distinct from b.v then 'differs' else 'same' end as status from (select c_custkey as k, c_nationkey as v from customer where c_custkey % 5 <> 0) a full join (select c_custkey as k, case when c_custkey % 7 = 0 then -1 else c_nationkey end as v from customer where c_custkey % 3 <> 0) b on a.k = b.k"


@query(f"select status, count(*) as n from ({_MIRROR}) group by 1")
def mirror_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    remote = c.filter("k % 3 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, -1).otherwise(F.col("v")))
    return R.mirror_diff(c.filter("k % 5 <> 0"), remote, "k", "v").groupBy("status").agg(F.count("*").alias("n"))


@query("select k, case when b.k is null then 'added' when a.v is distinct from b.v then 'conflict' else 'known' end as status from (select o_orderkey as k, o_orderstatus as v from orders where o_orderkey % 2 = 0) a left join (select o_orderkey as k, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end as v from orders where o_orderkey % 3 = 0) b using (k)")
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    canonical = o.filter("k % 3 = 0").withColumn("v", F.when(F.col("k") % 10 == 0, "X").otherwise(F.col("v")))
    return R.merge_report(o.filter("k % 2 = 0"), canonical, "k", "v")


@query("select count(*) filter (where d.doc_id is not null and l.doc_id is not null) as present, count(*) filter (where l.doc_id is null) as missing, count(*) filter (where d.n_chars = 0) as empty_docs, count(*) filter (where d.doc_id is null) as orphans, sum(strlen(d.text))::bigint as bytes from documents d full join labels l using (doc_id)")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, y = table(spark, sf_dir, "documents").alias("d"), table(spark, sf_dir, "labels").alias("l")
    both = d.join(y, F.col("d.doc_id") == F.col("l.doc_id"), "full")
    return both.agg(
        F.count_if(F.col("d.doc_id").isNotNull() & F.col("l.doc_id").isNotNull()).alias("present"), F.count_if(F.col("l.doc_id").isNull()).alias("missing"), F.count_if(F.col("d.n_chars") == 0).alias("empty_docs"),
        F.count_if(F.col("d.doc_id").isNull()).alias("orphans"), F.sum(F.octet_length("d.text")).cast("bigint").alias("bytes"),
    )


@query("select video_id, i, round(list_dot_product(emb, emb), 6) as sq, (list_position(emb, list_max(emb)) - 1)::bigint as top from v_frames")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.frames(spark, sf_dir).select("video_id", "i", r6(dot("emb", "emb")).alias("sq"), big(argmax("emb")).alias("top"))


@query("select event_id, round_even(value / 5.0::double, 0)::bigint as r from events")
def half_even_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", half_even(F.col("value") / 5.0).alias("r"))

