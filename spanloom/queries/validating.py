"""Queries of the validator. The driver's events are made into a submission with every kind of fault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import validation as K
from spanloom.plans import submission as B
from spanloom.plans.document_check import validate_documents
from spanloom.sources import views as V

from .basic import query

_CLASSES = ["view", "click", "cart", "purchase"]

_EV = """select user_id as video_id, 1 + user_id % 3 as level, case when event_id % 13 = 0 then 'normal' when event_id % 17 = 0 then 'alien' else event_type end as class_name,
  case when 1 + user_id % 3 = 1 and event_id % 9 > 0 or event_id % 19 = 0 then null when event_id % 23 = 0 then 'soon' when event_id % 29 = 0 then '-1.0' else (event_id % 100)::varchar end as start_time_sec,
  case when 1 + user_id % 3 = 1 and event_id % 9 > 0 then null else (event_id % 100 + event_id % 7)::varchar end as end_time_sec,
  case when event_id % 4 = 0 then repeat('x', (event_id % 40)::int) end as explanation from events"""
_PRED = "select user_id as video_id, event_id as pos, 1 + user_id % 3 as level from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as k from events) where k = 1 or event_id % 97 = 0"
_MAN = "select c_custkey as video_id from customer where c_custkey % 11 <> 0"
_DUR = "select c_custkey as video_id, (60 + c_custkey % 50)::double as dur from customer"
_RUN = "select event_id as video_id, value as total_time_ms, event_id % 5 as call_count, round(value / greatest(1, event_id % 5), (event_id % 3)::int) as average_time_ms, case when event_id % 31 = 0 then 0 else event_id % 5 end as n_times from events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, level = F.col("event_id"), 1 + F.col("user_id") % 3
    none = (level == 1) & (e % 9 > 0)
    return V.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), level.alias("level"), F.when(e % 13 == 0, "normal").when(e % 17 == 0, "alien").otherwise(F.col("event_type")).alias("class_name"),
        F.when(none | (e % 19 == 0), None).when(e % 23 == 0, "soon").when(e % 29 == 0, "-1.0").otherwise((e % 100).cast("string")).alias("start_time_sec"),
        F.when(~none, (e % 100 + e % 7).cast("string")).alias("end_time_sec"), F.when(e % 4 == 0, F.repeat(F.lit("x"), (e % 40).cast("int"))).alias("explanation"),
    )


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("pos"), (1 + F.col("user_id") % 3).alias("level"))
    first = e.groupBy("video_id").agg(F.min("pos").alias("first"))
    return e.join(first, "video_id").filter("pos = first or pos % 97 = 0").drop("first")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "customer").filter("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("video_id"))


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), (60 + F.col("c_custkey") % 50).cast("double").alias("dur"))


def _runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 5
    mean = F.expr("case event_id % 3 when 0 then round(value / greatest(1, event_id % 5), 0) when 1 then round(value / greatest(1, event_id % 5), 1) else round(value / greatest(1, event_id % 5), 2) end")
    return V.table(spark, sf_dir, "events").select(F.col("event_id").alias("video_id"), F.col("value").alias("total_time_ms"), n.alias("call_count"), mean.alias("average_time_ms"), F.when(F.col("event_id") % 31 == 0, 0).otherwise(n).alias("n_times"))


def _p(rows: str, where: str, field: str, problem: str, severity: str = "error") -> str:
    return f"select video_id, '{field}' as field, '{problem}' as problem, '{severity}' as severity from ({rows}) where {where}"


_IDS = " union all ".join([
    _p(f"select *, row_number() over (partition by video_id order by pos) as k from ({_PRED})", "k > 1", "video_id", "duplicate video_id"),
    _p(_PRED, f"video_id not in ({_MAN})", "video_id", "not in manifest"),
    _p(_MAN, f"video_id not in (select video_id from ({_PRED}))", "video_id", "missing manifest video"),
])
_CLASS = " union all ".join([_p(_EV, "class_name = 'normal'", "class_name", "normal is not an event"), _p(_EV, "class_name not in ('normal', 'view', 'click', 'cart', 'purchase')", "class_name", "unknown class")])
_BOTH = "level > 1 and start_time_sec is not null and end_time_sec is not null"
_NUM = "try_cast({0}_time_sec as double)"
_TIMES = " union all ".join([
    _p(_EV, "level = 1 and (start_time_sec is not null or end_time_sec is not null)", "times", "level 1 must have null times"),
    _p(_EV, "level > 1 and (start_time_sec is null or end_time_sec is null)", "times", "both times are required"),
    _p(_EV, f"{_BOTH} and ({_NUM.format('start')} is null or {_NUM.format('end')} is null)", "times", "times must be numbers"),
    _p(_EV, f"{_BOTH} and {_NUM.format('start')} < 0", "start_time_sec", "start must not be negative"),
    _p(_EV, f"{_BOTH} and {_NUM.format('end')} <= {_NUM.format('start')}", "end_time_sec", "end must be after start"),
])
_EXPL = _p(_EV, "length(explanation) not between 20 and 500", "explanation", "wrong length")
_RUNTIME = " union all ".join([
    _p(_RUN, "not (call_count > 0 and average_time_ms <> 0)", "model_runtimes", "count and average must be positive"),
    _p(_RUN, "call_count > 0 and average_time_ms <> 0 and abs(average_time_ms - total_time_ms / call_count) > 0.02::double * abs(average_time_ms)", "model_runtimes", "average differs from total / count"),
    _p(_RUN, "n_times <> call_count", "model_runtimes", "a time for each call is required"),
])
_DURATION = _p(f"select e.*, d.dur from ({_EV}) e join ({_DUR}) d using (video_id)", f"{_NUM.format('end')} > dur", "end_time_sec", "end is outside the video")
_WARN = " union all ".join([
    _p(f"select e.*, d.dur from ({_EV}) e join ({_DUR}) d using (video_id)", f"{_NUM.format('end')} - {_NUM.format('start')} > 0.8::double * dur", "times", "covers most of the video", "warn"),
    _p(f"select video_id, count(*) as n from ({_EV}) group by 1", "n > 8", "events", "many events", "warn"),
    _p(f"select * from ({_PRED}) where level = 3", f"video_id not in (select video_id from ({_EV}))", "events", "silent on level 3", "warn"),
])


@query(_IDS)
def v_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.check_ids(_predictions(spark, sf_dir), _manifest(spark, sf_dir))


@query(_CLASS)
def v_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.check_class(_events(spark, sf_dir), _CLASSES)


@query(_TIMES)
def v_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.check_times(_events(spark, sf_dir))


@query(_EXPL)
def v_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.check_explanation(_events(spark, sf_dir))


@query(_RUNTIME)
def v_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.check_runtime(_runtimes(spark, sf_dir))


@query(_DURATION)
def v_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.check_duration(_events(spark, sf_dir), _durations(spark, sf_dir))


@query(_WARN)
def v_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.warn(_events(spark, sf_dir), _durations(spark, sf_dir), _predictions(spark, sf_dir))


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionAll, [K.check_events(_events(spark, sf_dir), _CLASSES), *(f(spark, sf_dir) for f in (v_ids, v_runtime, v_duration, v_warn))])


_ALL = " union all ".join([_IDS, _CLASS, _TIMES, _EXPL, _RUNTIME, _DURATION, _WARN])


@query(f"select field, problem, severity, count(*) as n from ({_ALL}) group by 1, 2, 3")
def validate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).groupBy("field", "problem", "severity").agg(F.count("*").alias("n"))


@query(f"select count(*) filter (where severity = 'error') = 0 as passed, count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warn') as warnings from ({_ALL})")
def validation_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.passed(_all(spark, sf_dir))


#: Bytes that a document of `_documents` may have; a tenth of them have more.
_MOST_BYTES = 200_000
_DOC_EVENTS = "select *, user_id as doc, row_number() over (partition by user_id order by event_id) - 1 as pos, event_id % 23 as k, 'v' || event_id as own from events"
#: Predictions whose events are read: their video is asked for and the events are a list.
_READ = f"select doc, pos, case when k = 2 then 'v' else own end as video_id, event_id as e, case when k = 2 then 2 else 1 + event_id % 3 end as level, event_type from ({_DOC_EVENTS}) where k not in (0, 1, 3, 4, 5) and doc % 10 < 8"


def _told(rows: str, where: str, pos: str, video: str, field: str, problem: str) -> str:
    return f"select doc, {pos} as pos, {video} as video_id, '{field}' as field, '{problem}' as problem from ({rows}) where {where}"


_EVENT = f"select *, e % 13 = 0 as normal, e % 17 = 0 as alien, case when level = 1 and e % 9 > 0 or e % 19 = 0 then null when e % 29 = 0 then 'soon' when e % 31 = 0 then '-1' else (e % 100)::varchar end as st, case when level = 1 and e % 9 > 0 then null else (e % 100 + e % 7)::varchar end as en from ({_READ})"
_BOTH_AT = "events[0].start_time_sec/end_time_sec"
_DOC_FINDINGS = " union all ".join([
    "select distinct user_id as doc, null as pos, '<file>' as video_id, 'predictions' as field, case when user_id % 10 = 9 then 'missing required top-level field' else 'must be a list' end as problem from events where user_id % 10 >= 8",
    "select distinct user_id, null, '<file>', 'file_size', 'too many bytes' from events where user_id % 10 = 7",
    _told(_DOC_EVENTS, "doc % 10 < 8 and k = 0", "pos", "'<prediction ' || pos || '>'", "prediction", "must be an object"),
    _told(_DOC_EVENTS, "doc % 10 < 8 and k = 1", "pos", "'<prediction ' || pos || '>'", "video_id", "missing required field"),
    _told(f"select *, row_number() over (partition by doc order by pos) as nth from ({_DOC_EVENTS}) where k = 2", "doc % 10 < 8 and nth > 1", "pos", "'v'", "video_id", "duplicate video_id"),
    _told(_DOC_EVENTS, "doc % 10 < 8 and k = 3", "pos", "'x' || event_id", "video_id", "not in manifest"),
    _told(_DOC_EVENTS, "doc % 10 < 8 and k = 4", "pos", "own", "events", "missing required field"),
    _told(_DOC_EVENTS, "doc % 10 < 8 and k = 4", "pos", "own", "runtime_metadata", "missing required field"),
    _told(_DOC_EVENTS, "doc % 10 < 8 and k = 5", "pos", "own", "events", "must be a list"),
    _told(_DOC_EVENTS, "doc % 10 < 8 and k in (0, 1, 2, 3)", "null", "own", "video_id", "missing manifest video"),
    _told(f"select user_id as doc, count(*) filter (where event_id % 23 = 2) as n from events group by 1", "doc % 10 < 8 and n = 0", "null", "'v'", "video_id", "missing manifest video"),
    _told(_EVENT, "normal", "pos", "video_id", "events[0].class_name", "''normal'' is forbidden; use events: []"),
    _told(_EVENT, "not normal and (alien or event_type not in ('view', 'click', 'cart', 'purchase'))", "pos", "video_id", "events[0].class_name", "unknown class string"),
    _told(_EVENT, "level = 1 and (st is not null or en is not null)", "pos", "video_id", _BOTH_AT, "timestamps must both be null for level 1"),
    _told(_EVENT, "level > 1 and (st is null or en is null)", "pos", "video_id", _BOTH_AT, "timestamps are required for level 2/3"),
    _told(_EVENT, "level > 1 and st = 'soon'", "pos", "video_id", _BOTH_AT, "must be numeric"),
    _told(_EVENT, "level > 1 and st = '-1'", "pos", "video_id", "events[0].start_time_sec", "must be >= 0"),
    _told(_EVENT, "level > 1 and try_cast(en as double) <= try_cast(st as double)", "pos", "video_id", "events[0].end_time_sec", "must be greater than start_time_sec"),
    _told(_EVENT, "e % 4 = 0 and e % 40 not between 20 and 500", "pos", "video_id", "events[0].explanation", "must be a 20-500 character string"),
    _told(_EVENT, "e % 6 = 0", "pos", "video_id", "events[1]", "must be an object"),
    _told(_EVENT, "e % 12 = 1", "pos", "video_id", "runtime_metadata", "must be an object"),
    _told(_EVENT, "e % 12 = 2 and (e % 5 = 0 or abs(2 - 8.0::double / greatest(1, e % 5)) > 0.04::double)", "pos", "video_id", "runtime_metadata.model_runtimes[0].average_time_ms", "must equal total_time_ms/call_count within 2%"),
    _told(_EVENT, "e % 12 = 2 and e % 5 <> 2", "pos", "video_id", "runtime_metadata.model_runtimes[0].call_times_ms", "length must equal call_count"),
])


@query(f"select doc, pos::int as pos, video_id, field, problem from ({_DOC_FINDINGS})")
def validate_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for each user with every kind of fault, each event a prediction, against the whole chain of rules with its stops."""
    e, k = F.col("event_id"), F.col("event_id") % 23
    own = F.concat(F.lit("v"), e.cast("string"))
    video = F.when(k == 2, "v").when(k == 3, F.concat(F.lit("x"), e.cast("string"))).otherwise(own)
    level = F.when(k == 2, 2).otherwise((1 + e % 3).cast("int"))
    none = (level == 1) & (e % 9 > 0)
    start = F.when(none | (e % 19 == 0), "null").when(e % 29 == 0, '"soon"').when(e % 31 == 0, "-1").otherwise((e % 100).cast("string"))
    end = F.when(none, "null").otherwise((e % 100 + e % 7).cast("string"))
    name = F.when(e % 13 == 0, "normal").when(e % 17 == 0, "alien").otherwise(F.col("event_type"))
    said = F.when(e % 4 == 0, F.concat(F.lit(', "explanation": "'), F.repeat(F.lit("x"), (e % 40).cast("int")), F.lit('"'))).otherwise("")
    event = F.concat(F.lit('{"class_name": "'), name, F.lit('", "start_time_sec": '), start, F.lit(', "end_time_sec": '), end, said, F.lit("}"), F.when(e % 6 == 0, ", 7").otherwise(""))
    events = F.when(k == 4, "").when(k == 5, ', "events": "none"').otherwise(F.concat(F.lit(', "events": ['), event, F.lit("]")))
    run = F.concat(F.lit('{"model_runtimes": [{"total_time_ms": 8, "average_time_ms": 2, "call_times_ms": [1, 2], "call_count": '), (e % 5).cast("string"), F.lit("}]}"))
    metadata = F.when(k == 4, "").otherwise(F.concat(F.lit(', "runtime_metadata": '), F.when(e % 12 == 1, "[]").when(e % 12 == 2, run).otherwise("{}")))
    prediction = F.when(k == 0, "5").when(k == 1, '{"events": []}').otherwise(F.concat(F.lit('{"video_id": "'), video, F.lit('"'), events, metadata, F.lit("}")))
    rows = V.table(spark, sf_dir, "events")
    doc = F.col("user_id").alias("doc")
    listed = rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", prediction.alias("p")))), lambda x: x.p), ", ").alias("body"))
    kind = F.col("doc") % 10
    text = F.when(kind == 9, '{"schema_version": "1"}').when(kind == 8, '{"predictions": {"a": 1}}').otherwise(F.concat(F.lit('{"predictions": ['), "body", F.lit("]}"), F.when(kind == 7, F.repeat(F.lit(" "), _MOST_BYTES)).otherwise("")))
    manifest = rows.select(doc, own.alias("video_id"), (1 + e % 3).alias("level")).unionAll(rows.select(doc, F.lit("v"), F.lit(2)).distinct())
    return validate_documents(listed.select("doc", text.alias("value")), manifest, _CLASSES, ["doc"], _MOST_BYTES)


@query(f"select t.video_id, p.pred_id, round(p.st, 2) as st, round(least(p.en, dur - 0.1::double), 2) as en from (select c_custkey as video_id, 2000000.0::double + c_custkey as dur from customer) t join v_pred p using (video_id) where round(least(p.en, dur - 0.1::double), 2) > round(p.st, 2)")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), (2000000.0 + F.col("c_custkey")).alias("dur"))
    return B.clamp_events(template, V.predictions(spark, sf_dir)).select("video_id", "pred_id", "st", "en")


@query("select video_id, count(*) as n, min(st)::double as first_start from (select user_id as video_id, event_id as st from events) group by 1")
def submission_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to JSON documents and back."""
    rows = V.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_type").alias("class_name"), F.col("event_id").cast("double").alias("start_time_sec"), (F.col("event_id") + 1.0).alias("end_time_sec"), F.col("value").alias("score"), F.lit(None).cast("string").alias("explanation"))
    back = B.read_submission(B.to_json(rows).select("prediction"), "prediction")
    return back.groupBy(F.col("video_id").cast("bigint").alias("video_id")).agg(F.count("*").alias("n"), F.min("start_time_sec").alias("first_start"))




def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_type").alias("class_name"), F.col("event_id").cast("double").alias("start_time_sec"), (F.col("event_id") + 1.0).alias("end_time_sec"), F.col("value").alias("score"), F.lit(None).cast("string").alias("explanation"))


@query("select user_id as video_id, count(*) as n, min(event_id)::double as first_start, round(sum(value), 6) as score from events group by 1")
def submission_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to the lines of one JSON document and back."""
    back = B.read_envelope(B.envelope(_rows(spark, sf_dir)))
    return back.groupBy(F.col("video_id").cast("bigint").alias("video_id")).agg(F.count("*").alias("n"), F.min("start_time_sec").alias("first_start"), F.round(F.sum("score"), 6).alias("score"))


@query("""select event_id as doc, video_id, case when event_id % 4 = 1 and video_id = 'a' then event_id + 2 else event_id + (video_id = 'b')::int end as start from events cross join (select unnest(['a', 'b']) as video_id) where event_id % 4 < 3""")
def submission_map_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose predictions are a list, a list with a repeat, a map, or the wrong kind, to the prediction that counts for each video."""
    of = lambda video, n: F.concat(F.lit(f'{{"video_id": "{video}", "events": [{{"class_name": "x", "start_time_sec": '), F.col(n).cast("string"), F.lit("}]}"))
    rows = V.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") + 1).alias("n1"), (F.col("event_id") + 2).alias("n2"))
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(F.lit('{"schema_version": "1", "predictions": ['), of("a", "event_id"), F.lit(", "), of("b", "n1"), F.lit("]}")))
    text = text.when(kind == 1, F.concat(F.lit("["), of("a", "event_id"), F.lit(", 7, "), of("b", "n1"), F.lit(", "), of("a", "n2"), F.lit("]")))
    text = text.when(kind == 2, F.concat(F.lit('{"predictions": {"a": '), of("q", "event_id"), F.lit(', "b": '), of("q", "n1"), F.lit(', "c": 5}}'))).otherwise('{"predictions": 3}')
    found = B.read_documents(rows.select(F.col("event_id").alias("doc"), text.alias("value")), ["doc"])
    return found.select("doc", "video_id", F.get_json_object("prediction", "$.events[0].start_time_sec").cast("bigint").alias("start"))


@query("""select c_custkey as video_id, 1 + c_custkey % 3 as level, p.video_id is not null as answered, coalesce(kept, 0)::bigint as n_events, coalesce(clamped, 0)::bigint as n_clamped, coalesce(n - kept, 0)::bigint as n_dropped, ends, case when p.video_id is not null then greatest(1, chunks) end as chunks, ms from customer c left join (
  select video_id, count(*) as n, count(*) filter (where late and e > l) as clamped, count(*) filter (where not late or least(e, l) > s) as kept, round(sum(case when late and least(e, l) > s then least(e, l) end), 4) as ends, count(*) filter (where class_name = 'none') as chunks, round_even(sum(score), 0)::bigint as ms
  from (select p.*, 1 + video_id % 3 > 1 as late, round(st, 2) as s, round(en, 2) as e, round(1500000.0::double + video_id - 0.1::double, 2) as l from v_pred p) group by 1) p on p.video_id = c.c_custkey""")
def template_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every video of a template with its events, times, metadata and counts; those without a prediction too."""
    v = F.col("c_custkey")
    template = V.table(spark, sf_dir, "customer").select(v.alias("video_id"), (1 + v % 3).alias("level"), (1500000.0 + v).alias("dur"))
    event = F.struct("class_name", F.col("st").alias("start_time_sec"), F.col("en").alias("end_time_sec"), F.lit("").alias("explanation"))
    own = V.predictions(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(event)).alias("events"), F.count("*").alias("frames_processed"), F.count_if(F.col("class_name") == "none").alias("chunks_processed"), F.sum("score").alias("time_ms"))
    found = B.fill_template(template, own)
    ends = F.aggregate(F.filter("events", lambda e: e.end_time_sec.isNotNull()), F.lit(None).cast("double"), lambda s, e: F.coalesce(s, F.lit(0.0)) + e.end_time_sec)
    return found.select(
        "video_id", "level", F.col("runtime_metadata").isNotNull().alias("answered"), F.size("events").cast("bigint").alias("n_events"), F.col("n_clamped").cast("bigint").alias("n_clamped"), F.col("n_dropped").cast("bigint").alias("n_dropped"), F.round(ends, 4).alias("ends"),
        F.col("runtime_metadata.chunks_processed").alias("chunks"), F.col("runtime_metadata.end_to_end_internal_time_ms").alias("ms"),
    )


@query("""select 'v' || event_id as video_id, 'events' as field, 'must be a list' as problem, 'error' as severity from events where event_id % 7 = 2
union all select 'v' || event_id, 'events[0]', 'must be an object', 'error' from events where event_id % 7 = 3
union all select '<file>', case event_id % 7 when 0 then 'predictions' when 1 then 'predictions' when 4 then 'predictions[1]' else 'file_size' end, case event_id % 7 when 0 then 'missing required top-level field' when 1 then 'must be a list' when 4 then 'must be an object' else 'too many bytes' end, 'error' from events where event_id % 7 in (0, 1, 4, 5)""")
def v_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every fault of shape, and size."""
    kind, name = F.col("event_id") % 7, F.concat(F.lit('"v'), F.col("event_id").cast("string"), F.lit('"'))
    whole = lambda events: F.concat(F.lit('{"predictions": [{"video_id": '), name, F.lit(f', "events": {events}}}]}}'))
    text = F.when(kind == 0, '{"schema_version": "1"}').when(kind == 1, '{"predictions": {"a": 1}}').when(kind == 2, whole('"none"')).when(kind == 3, whole('[1, {"class_name": "x"}]'))
    text = text.when(kind == 4, F.lit('{"predictions": [{"video_id": "x"}, 5]}')).when(kind == 5, F.concat(whole("[]"), F.repeat(F.lit(" "), 100))).otherwise(whole('[{"class_name": "x"}]'))
    return K.check_shape(V.table(spark, sf_dir, "events").select(text.alias("value")), 120)
