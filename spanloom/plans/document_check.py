"""Whole submissions, as JSON documents, against the rules, with the stops of an ordered rule chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.validation import EXPLANATION_CHARS, MEAN_TOLERANCE


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _no(c: Column) -> Column:
    """Whether a variant is missing or a JSON null."""
    return c.isNull() | F.is_variant_null(c)


def _of_type(v: Column, *kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike("^(" + "|".join(kinds) + r")\b"), F.lit(False))


_NUMBER = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "BOOLEAN")


def _finding(where: Column, field: Column | str, problem: str) -> Column:
    named = F.lit(field) if isinstance(field, str) else field
    return F.when(where, F.struct(named.alias("field"), F.lit(problem).alias("problem")))


def _each(items: Column, use) -> Column:
    """The findings of all items of an array of variants; a null array has none."""
    return F.flatten(F.coalesce(F.transform(items, lambda x, k: F.array_compact(use(x, k))), F.array()))


def _event_findings(level: Column, classes: list[str]):
    def rules(e: Column, k: Column) -> Column:
        at = lambda field="": F.concat(F.lit("events["), k.cast("string"), F.lit("]" + field))
        name, start, end, said = (_get(e, f"$.{c}") for c in ("class_name", "start_time_sec", "end_time_sec", "explanation"))
        is_object = _of_type(e, "OBJECT")
        is_normal = _of_type(name, "STRING") & (_get(e, "$.class_name", "string") == "normal")
        known = _of_type(name, "STRING") & _get(e, "$.class_name", "string").isin(*classes)
        given, late = ~_no(start) & ~_no(end), level != 1
        a, b = _get(e, "$.start_time_sec", "double"), _get(e, "$.end_time_sec", "double")
        counted = is_object & late & given & a.isNotNull() & b.isNotNull()
        chars = F.length(_get(e, "$.explanation", "string"))
        both = at(".start_time_sec/end_time_sec")
        return F.array(
            _finding(~is_object, at(), "must be an object"),
            _finding(is_object & is_normal, at(".class_name"), "'normal' is forbidden; use events: []"),
            _finding(is_object & ~is_normal & ~known, at(".class_name"), "unknown class string"),
            _finding(is_object & ~late & (~_no(start) | ~_no(end)), both, "timestamps must both be null for level 1"),
            _finding(is_object & late & ~given, both, "timestamps are required for level 2/3"),
            _finding(is_object & late & given & (a.isNull() | b.isNull()), both, "must be numeric"),
            _finding(counted & (a < 0), at(".start_time_sec"), "must be >= 0"),
            _finding(counted & (b <= a) & ~F.isnan(a), at(".end_time_sec"), "must be greater than start_time_sec"),
            _finding(is_object & said.isNotNull() & ~(_of_type(said, "STRING") & F.coalesce(chars.between(*EXPLANATION_CHARS), F.lit(False))), at(".explanation"), "must be a 20-500 character string"),
        )

    return rules


def _runtime_findings(r: Column, k: Column) -> Column:
    at = lambda field="": F.concat(F.lit("runtime_metadata.model_runtimes["), k.cast("string"), F.lit("]" + field))
    total, n, mean, times = (_get(r, f"$.{c}") for c in ("total_time_ms", "call_count", "average_time_ms", "call_times_ms"))
    as_number = lambda c: F.when(_of_type(_get(r, f"$.{c}"), *_NUMBER), _get(r, f"$.{c}", "double"))
    t, c, m = as_number("total_time_ms"), as_number("call_count"), as_number("average_time_ms")
    right = (c > 0) & (m != 0) & (F.abs(m - F.try_divide(t, c)) <= MEAN_TOLERANCE * F.abs(m))
    is_object = _of_type(r, "OBJECT")
    return F.array(
        _finding(~is_object, at(), "must be an object"),
        _finding(is_object & total.isNotNull() & n.isNotNull() & mean.isNotNull() & ~F.coalesce(right, F.lit(False)), at(".average_time_ms"), "must equal total_time_ms/call_count within 2%"),
        _finding(is_object & times.isNotNull() & n.isNotNull() & ~F.coalesce(F.size(_get(r, "$.call_times_ms", "array<variant>")) == c, F.lit(False)), at(".call_times_ms"), "length must equal call_count"),
    )


def validate_documents(docs: DataFrame, manifest: DataFrame, classes: list[str], key: list[str], max_bytes: int = 5 << 20, col: str = "value") -> DataFrame:
    """Findings of whole submissions: the key columns, pos (the prediction's index; null for the document and for missing videos), video_id, field and problem.

    docs: key columns and a JSON text. manifest: key columns, video_id (string) and level, the videos that a document has to answer. Rules stop as a
    reader would: a document without a list of predictions has that finding alone; a prediction that is no object, has no video_id or isn't in the
    manifest is looked at no further, nor is one whose events are no list. An event's level is the manifest's. Where no id is known
    video_id is <file> or <prediction k>. A text that is no JSON has one finding, an empty table none; a null text is no JSON.

    A document is parsed as a variant and its predictions are spread over rows; documents have to fit in a task, their predictions needn't. Two
    shuffles: by id, for repeats and for the manifest.
    """
    named = lambda rows, pos, video, found: rows.select(*key, pos.alias("pos"), video.alias("video_id"), F.inline(F.array_compact(found)))
    nowhere = F.lit(None).cast("int")
    parsed = docs.select(*key, F.try_parse_json(F.col(col)).alias("v"), F.octet_length(col).alias("n_bytes"))
    whole, listed = _get(F.col("v"), "$.predictions"), _get(F.col("v"), "$.predictions", "array<variant>")
    is_object = _of_type(F.col("v"), "OBJECT")
    of_file = F.array(
        _finding(F.col("v").isNull(), "<file>", "is no JSON document"),
        _finding(F.col("v").isNotNull() & (~is_object | whole.isNull()), "predictions", "missing required top-level field"),
        _finding(is_object & whole.isNotNull() & listed.isNull(), "predictions", "must be a list"),
        _finding(listed.isNotNull() & (F.col("n_bytes") > max_bytes), "file_size", "too many bytes"),
    )
    predictions = parsed.filter(is_object).select(*key, F.posexplode(listed).alias("pos", "p"))
    video = _get(F.col("p"), "$.video_id")
    rows = predictions.select(*key, "pos", "p", _of_type(F.col("p"), "OBJECT").alias("is_object"), video.isNotNull().alias("has_id"), F.to_json(video).alias("id_json"), F.when(_of_type(video, "STRING"), _get(F.col("p"), "$.video_id", "string")).alias("id"))
    label = F.concat(F.lit("<prediction "), F.col("pos").cast("string"), F.lit(">"))
    unnamed = named(rows.filter("not (is_object and has_id)"), F.col("pos"), label, F.array(_finding(~F.col("is_object"), "prediction", "must be an object"), _finding(F.col("is_object"), "video_id", "missing required field")))

    order = Window.partitionBy(*key, "id_json").orderBy("pos")
    answers = rows.filter("is_object and has_id").withColumn("again", F.row_number().over(order) > 1)
    wanted = manifest.select(*(F.col(c).alias(f"_{c}") for c in key), F.col("video_id").cast("string").alias("asked"), "level")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key), F.col("id") == F.col("asked"))
    answers = answers.join(wanted, same, "left")
    asked, p = F.col("asked").isNotNull(), F.col("p")
    events, metadata = _get(p, "$.events"), _get(p, "$.runtime_metadata")
    event_list = _get(p, "$.events", "array<variant>")
    go_on = asked & (events.isNull() | event_list.isNotNull())
    runtimes = F.when(_of_type(metadata, "OBJECT"), _get(metadata, "$.model_runtimes"))
    missing = lambda c, name: _finding(asked & c.isNull(), name, "missing required field")
    chain = F.array(
        _finding(F.col("again"), "video_id", "duplicate video_id"), _finding(~asked, "video_id", "not in manifest"), missing(events, "events"), missing(metadata, "runtime_metadata"),
        _finding(asked & events.isNotNull() & event_list.isNull(), "events", "must be a list"), _finding(go_on & ~_no(metadata) & ~_of_type(metadata, "OBJECT"), "runtime_metadata", "must be an object"),
        _finding(go_on & runtimes.isNotNull() & _get(metadata, "$.model_runtimes", "array<variant>").isNull(), "runtime_metadata.model_runtimes", "must be a list"),
    )
    inside = F.concat(_each(F.when(go_on, event_list), _event_findings(F.col("level"), classes)), _each(F.when(go_on, _get(metadata, "$.model_runtimes", "array<variant>")), _runtime_findings))
    of_answers = named(answers, F.col("pos"), F.coalesce("id", "id_json"), F.concat(chain, inside))

    # Only documents whose predictions are a list are asked for the rest of the manifest.
    readable = parsed.filter(is_object & listed.isNotNull()).select(*(F.col(c).alias(f"_{c}") for c in key))
    on_key = reduce(lambda a, b: a & b, (wanted[f"_{c}"].eqNullSafe(readable[f"_{c}"]) for c in key))
    seen = rows.filter("is_object and has_id and id is not null").select(*key, "id").distinct()
    silent = wanted.join(readable, on_key, "left_semi").join(seen, same, "left_anti")
    of_silent = silent.select(*(F.col(f"_{c}").alias(c) for c in key), nowhere.alias("pos"), F.col("asked").alias("video_id"), F.lit("video_id").alias("field"), F.lit("missing manifest video").alias("problem"))
    return reduce(DataFrame.unionAll, [named(parsed, nowhere, F.lit("<file>"), of_file), unnamed, of_answers, of_silent])
