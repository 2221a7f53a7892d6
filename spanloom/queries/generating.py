"""Queries of splits, augmentation and synthetic sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import synthesis as G
from spanloom.sources import views as V

from .basic import big, query, r6


def _u(*parts: str) -> str:
    """The hashed uniform number of synthesis, in DuckDB."""
    return "(('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::bigint / 4294967296.0::double)"


@query("""select doc_id, lang, case when n_chars > 10000 then 'holdout' when place <= round_even(total * 0.2::double, 0) then 'val' else 'fit' end as split from (
  select *, row_number() over (partition by lang, n_chars > 10000 order by md5(doc_id || '|7'), doc_id) as place, count(*) filter (where n_chars <= 10000) over (partition by lang) as total from documents)""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return G.stratified_split(docs, 0.2, 7, "lang", "doc_id", F.col("n_chars") > 10000).select("doc_id", "lang", "split")


@query(f"select video_id, n, st, st + keep as en from (select *, floor({_u('video_id', chr(39) + 'crop' + chr(39), chr(39) + '3' + chr(39))} * (n - keep + 1))::bigint as st from (select *, ceil(n * 0.5)::bigint as keep from v_n))")
def clip_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = V.curve(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"))
    return G.clip_crop(clips, 0.5, 3).select("video_id", "n", "st", "en")


@query(f"select video_id, i, z as zeroed, round(case when z then 0 else list_sum(emb) end, 6) as total from (select *, {_u('video_id', 'i', chr(39) + 'zero' + chr(39), chr(39) + '3' + chr(39))} < 0.1 as z from v_frames)")
def frame_zeroing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.zero_frames(V.frames(spark, sf_dir), 0.1, 3)
    return found.select("video_id", "i", "zeroed", r6(F.aggregate("emb", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"""select number, slot, donor, st::bigint as st, least(st + n, 200)::bigint as en from (select *, sum(n) over (partition by number order by slot) - n as st from (
  select number, slot, floor({_u('number', 'slot', chr(39) + 'tile' + chr(39), chr(39) + '5' + chr(39))} * (select count(*) from v_n))::bigint + 0 as donor from (select unnest(range(0, 40)) as number) cross join (select unnest(range(0, 20)) as slot)) join (select row_number() over (order by video_id) - 1 as donor, n from v_n) using (donor)) where st < 200""")
def synth_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    clips = V.curve(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"))
    donors = clips.select((F.row_number().over(Window.orderBy("video_id")) - 1).cast("bigint").alias("donor"), "n")
    found = G.tile_background(G.synthetic_ids(spark, 40), donors, 200, 20, 5)
    return found.select("number", "slot", "donor", big("st").alias("st"), big("en").alias("en"))


#: A synthetic video for each document, its length in frames by the document's.
_NUMBERED = "select doc_id as number, 200 + n_chars % 400 as frames from documents"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"), (200 + F.col("n_chars") % 400).alias("frames"))


_Q = chr(39)
_PLACES = f"list_transform(range(0, 32), lambda t: floor({_u('number', 'k', 't', _Q + 'place' + _Q, _Q + '9' + _Q)} * (frames - 40 + 1))::bigint)"


@query(f"""with recursive video as (select number, frames, case when {_u('number', _Q + 'quiet' + _Q, _Q + '9' + _Q)} < 0.2::double then 0 else 1 + floor({_u('number', _Q + 'count' + _Q, _Q + '9' + _Q)} * 6) end as c from ({_NUMBERED})),
fold as (
  select number, frames, c, 1 as k, null::bigint as st, []::bigint[] as taken from video where c > 0 union all
  select number, frames, c, k + 1, found, case when found is null then taken else list_append(taken, found) end
  from (select *, list_filter({_PLACES}, lambda s: len(list_filter(taken, lambda o: not (s + 50 <= o or s >= o + 50))) = 0)[1] as found from fold where k <= c))
select number, (k - 1)::int as k, floor({_u('number', 'k - 1', _Q + 'class' + _Q, _Q + '9' + _Q)} * 11)::bigint as cls, st, st + 40 as en from fold where st is not null""")
def synth_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of hashed candidates the first that is free: a fold over the events placed before."""
    return G.place_events(_numbered(spark, sf_dir), F.col("frames"), 40, 10, 6, 32, 9)


_COUNT = f"(1 + floor({_u('number', chr(39) + 'count' + chr(39), chr(39) + '4' + chr(39))} * 6))::bigint"
_REG = f"select number, k, floor(k * (frames // greatest(c + 1, 2)) - 20)::bigint as st from (select number, frames, c, unnest(range(1, c + 1)) as k from (select number, frames, {_COUNT} as c from ({_NUMBERED})))"


@query(f"select number, k::int as k, st, st + 40 as en from ({_REG})")
def synth_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.regular_events(_numbered(spark, sf_dir), F.col("frames"), 40, 6, 4)


@query(f"select number, 2 as level, st / 2.0::double as start_time_sec, (st + 40) / 2.0::double as end_time_sec, 'synth_' || lpad(number::varchar, greatest(5, length(number::varchar))::int, '0') as video_id from ({_REG})")
def synth_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.regular_events(_numbered(spark, sf_dir), F.col("frames"), 40, 6, 4)
    return rows.select("number", F.lit(2).alias("level"), (F.col("st") / 2.0).alias("start_time_sec"), (F.col("en") / 2.0).alias("end_time_sec"), F.format_string("synth_%05d", "number").alias("video_id"))


@query("""select f.video_id as number, f.i, case when f.i >= s.st and f.i < s.en then s.cls else 11 end as label, round(case when f.i >= s.st and f.i < s.en then coalesce(d.emb[1], f.emb[1]) else f.emb[1] end, 6) as x, (f.i = s.st or f.i = s.en - 1)::int::double as edge
  from v_frames f join (select *, video_id % 9 as cls from v_spans) s using (video_id) left join (select video_id as cls, i, emb from v_frames where video_id < 9) d on d.cls = s.cls and d.i = f.i - s.st""")
def synth_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sequences import _spans

    frames = V.frames(spark, sf_dir)
    spans = _spans(spark, sf_dir).select(F.col("video_id").alias("number"), (F.col("video_id") % 9).alias("cls"), "st", "en")
    donors = frames.filter("video_id < 9").select(F.col("video_id").alias("cls"), "i", "emb")
    found = G.overlay(frames.select(F.col("video_id").alias("number"), "i", "emb"), spans, donors)
    return found.select("number", "i", "label", r6(F.col("emb")[0]).alias("x"), "edge")


_E = "(select distinct video_id as number, 1 as k, video_id % 4 as cls, 3 + video_id % 20 as st, 50 as frames from v_frames)"
_D = "(select video_id as donor, video_id % 4 as cls, count(*) - video_id % 7 as n from v_frames group by video_id)"
_CROP = f"""select number, k, cls, st, donor, floor({_u('number', 'k', _Q + 'crop' + _Q, _Q + '6' + _Q)} * (n - least(n, 20) + 1))::bigint as left_at, least(st + least(n, 20), frames) as en, {_u('number', 'k', _Q + 'scene' + _Q, _Q + '6' + _Q)} < 0.25::double as same
  from (select e.*, floor({_u('number', 'k', _Q + 'donor' + _Q, _Q + '6' + _Q)} * m)::int as pick from {_E} e join (select cls, count(*) as m from {_D} group by 1) using (cls)) join (select *, row_number() over (partition by cls order by donor) - 1 as pick from {_D}) using (cls, pick)"""


@query(f"""select f.video_id as number, f.i, coalesce(s.cls, 11)::bigint as label, round(coalesce(case when not s.same then d.emb[1] end, f.emb[1]), 6) as x, coalesce(f.i = s.st or f.i = s.en - 1, false)::int::double as edge
  from v_frames f left join ({_CROP}) s on s.number = f.video_id and f.i >= s.st and f.i < s.en left join v_frames d on d.video_id = s.donor and d.i = s.left_at + f.i - s.st""")
def synth_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video with one event: a crop of another clip of its class, or the scene as it was."""
    frames = V.frames(spark, sf_dir)
    donors = frames.groupBy(F.col("video_id").alias("donor")).agg((F.count("*") - F.first("video_id") % 7).alias("n")).withColumn("cls", F.col("donor") % 4)
    v = F.col("video_id")
    events = frames.select(v.alias("number"), F.lit(1).alias("k"), (v % 4).alias("cls"), (3 + v % 20).alias("st"), F.lit(50).alias("frames")).distinct()
    crops = G.donor_crops(events, donors, 20, 6)
    found = G.splice(frames.select(v.alias("number"), "i", "emb"), crops, frames.select(v.alias("donor"), "i", "emb"))
    return found.select("number", "i", "label", r6(F.col("emb")[0]).alias("x"), "edge")


@query("select video_id, 2 as level, dur from (select video_id, max(sec) / 3600.0::double / 20.0::double as dur from v_curve group by 1) where dur > 30")
def real_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = V.curve(spark, sf_dir).groupBy("video_id").agg((F.max("sec") / 3600.0 / 20.0).alias("dur"))
    return clips.filter("dur > 30").select("video_id", F.lit(2).alias("level"), "dur")
