"""Operators over ordered sequences. All take and give DataFrames; `part` names the columns that tell sequences apart.

Frame indices start at 0; spans are half-open [st, en). Nothing is collected; windows are partitioned by sequence, so a
sequence's rows meet in one task and different sequences spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.intervals import half_even
from spanloom.functions.vectors import dot, norm

PART = ["video_id"]
#: Values that cut an ordered table into ranges.
RANGES = 200


def _over(part: list[str], *order: str | Column):
    return Window.partitionBy(*part).orderBy(*order)


def _rows(w, a: int, b: int):
    return w.rowsBetween(a, b)


def sliding_windows(clips: DataFrame, width: int, stride: int, n: str = "n") -> DataFrame:
    """Windows [st, en) of each row's n frames, with a last one at the end; one short window if n < width."""
    last = F.greatest(F.lit(0), F.col(n) - width).cast("bigint")
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), last, F.lit(stride).cast("bigint")), F.array(last)))
    return clips.withColumn("st", F.explode(starts)).withColumn("en", F.least(F.col(n), F.col("st") + width).cast("bigint"))


def window_frames(windows: DataFrame, frames: DataFrame, part: list[str] = PART, i: str = "i", bucket: int = 64) -> DataFrame:
    """Each window [st, en) with its frames.

    Frames lie in buckets of `bucket` indices and a window goes to each bucket that it touches, so this is an equi-join on sequence and
    bucket whose work follows the result, however long a sequence is.
    """
    b = F.lit(bucket)
    touched = F.sequence(F.floor(F.col("st") / b), F.floor((F.greatest(F.col("en"), F.col("st") + 1) - 1) / b))
    w = windows.withColumn("_b", F.explode(touched)).alias("w")
    f = frames.withColumn("_b", F.floor(F.col(i) / b)).alias("f")
    on = (F.col("w._b") == F.col("f._b")) & (F.col(f"f.{i}") >= F.col("w.st")) & (F.col(f"f.{i}") < F.col("w.en"))
    for p in part:
        on = on & (F.col(f"w.{p}") == F.col(f"f.{p}"))
    return w.join(f, on).select(*(F.col(f"w.{c}") for c in windows.columns), *(F.col(f"f.{c}") for c in frames.columns if c not in windows.columns))


def smooth(curve: DataFrame, win: int, value: str = "p", part: list[str] = PART, i: str = "i", to: str = "smooth") -> DataFrame:
    """Centred moving average; the first and last values stand in beyond the edges. win <= 1 changes nothing."""
    if win <= 1:
        return curve.withColumn(to, F.col(value))
    left, right = win // 2, win - 1 - win // 2
    w, whole = _over(part, i), _rows(_over(part, i), Window.unboundedPreceding, Window.unboundedFollowing)
    n, k = F.count(value).over(Window.partitionBy(*part)), F.row_number().over(w) - 1
    inner = F.sum(value).over(_rows(w, -left, right))
    before = F.greatest(F.lit(left) - k, F.lit(0)) * F.first(value).over(whole)
    after = F.greatest(k + right - (n - 1), F.lit(0)) * F.last(value).over(whole)
    return curve.withColumn(to, (inner + before + after) / F.lit(float(win)))


def islands(rows: DataFrame, new: Column, part: list[str], order: list[str | Column], to: str = "island") -> DataFrame:
    """Numbers runs of rows: a row where `new` is true or null begins one."""
    w = Window.partitionBy(*part).orderBy(*order)
    return rows.withColumn("_new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).withColumn(to, F.sum("_new").over(_rows(w, Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def hysteresis(curve: DataFrame, hi: float, lo: float, value: str = "p", part: list[str] = PART, i: str = "i") -> DataFrame:
    """Spans that open where the value is above hi and close at the first at or below lo; the last may close at the end."""
    w = _over(part, i)
    turn = F.when(F.col(value) > hi, 1).when(F.col(value) <= lo, 0)
    state = curve.withColumn("_on", F.coalesce(F.last(turn, ignorenulls=True).over(_rows(w, Window.unboundedPreceding, 0)), F.lit(0)))
    runs = islands(state, F.col("_on") != F.lag("_on").over(w), part, [i], "_run")
    return runs.filter("_on = 1").groupBy(*part, "_run").agg(F.min(i).alias("st"), (F.max(i) + 1).alias("en"), F.avg(value).alias("mean_p")).drop("_run")


def adjacent_distance(frames: DataFrame, emb: str = "emb", part: list[str] = PART, i: str = "i", eps: float = 1e-8) -> DataFrame:
    """d = 1 - cosine to the next frame; null for the last."""
    unit = frames.withColumn("_norm", F.greatest(norm(emb), F.lit(eps)))
    w = _over(part, i)
    after, after_norm = F.lead(emb).over(w), F.lead("_norm").over(w)
    pairs = unit.withColumns({"_next": after, "_next_norm": after_norm})
    return pairs.withColumn("d", F.when(F.col("_next").isNotNull(), 1 - dot(emb, "_next") / (F.col("_norm") * F.col("_next_norm")))).drop("_norm", "_next", "_next_norm")


def changepoints(distances: DataFrame, k: int, part: list[str] = PART, i: str = "i", rank_by: str = "neighbour") -> DataFrame:
    """At most k interior peaks of d for each sequence, as rows (part, cp).

    rank_by "neighbour" ranks a peak at p by d[p - 1], as the pipeline that this serves has always done; "peak" ranks by
    d[p] and gives the frame after the edge. Ties go to the later frame.
    """
    w = _over(part, i)
    near = distances.filter("d is not null").withColumns({"_before": F.lag("d").over(w), "_after": F.lead("d").over(w)})
    peaks = near.filter("d >= _before and d >= _after")
    by = F.col("_before") if rank_by == "neighbour" else F.col("d")
    place = F.row_number().over(Window.partitionBy(*part).orderBy(by.desc(), F.col(i).desc()))
    shift = 0 if rank_by == "neighbour" else 1
    return peaks.withColumn("_place", place).filter(F.col("_place") <= k).select(*part, (F.col(i) + shift).cast("bigint").alias("cp"))


def merge_windows(candidates: DataFrame, stride: int, reclassify: bool = False, part: list[str] = PART) -> DataFrame:
    """Merge candidate windows (st, en, cls, score) that begin at most stride after the one before ends, of equal class unless
    reclassify: their hull, the first class and the best score. Ends must rise with starts."""
    w = _over(part, "st", "en")
    joins = F.col("st") <= F.lag("en").over(w) + stride
    if not reclassify:
        joins = joins & (F.col("cls") == F.lag("cls").over(w))
    runs = islands(candidates, ~joins, part, ["st", "en"], "grp")
    return runs.groupBy(*part, "grp").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.min_by("cls", "st").alias("cls"), F.max("score").alias("score"))


def desmear(spans: DataFrame, width: int, least: int) -> DataFrame:
    """Take half a window off each end (ties to even); spans shorter than least become least frames about their centre."""
    half = F.lit(width / 2.0)
    cut = spans.withColumns({"_s": half_even(F.col("st") + half), "_e": half_even(F.col("en") - half)})
    centre = (F.col("_s") + F.col("_e")) / 2.0
    short = (F.col("_e") - F.col("_s")) < least
    return cut.withColumns({"st": F.when(short, half_even(centre - least / 2.0)).otherwise(F.col("_s")), "en": F.when(short, half_even(centre + least / 2.0)).otherwise(F.col("_e"))}).drop("_s", "_e")


def expand(spans: DataFrame, factor: float | Column, least: int, n: str = "n") -> DataFrame:
    """Scale about the centre, to at least least frames; outwards to whole frames, within [0, n]."""
    centre, half = (F.col("st") + F.col("en")) / 2.0, F.greatest(F.lit(least / 2.0), (F.col("en") - F.col("st")) * factor / 2.0)
    start, end = F.floor(centre - half), F.ceil(centre + half)
    return spans.withColumns({"_s": F.greatest(F.lit(0), start).cast("bigint"), "en": F.least(F.col(n), end).cast("bigint")}).withColumn("st", F.col("_s")).drop("_s")


def nearest(edges: DataFrame, points: DataFrame, key: list[str], edge: str, within: int, to: str, part: list[str] = PART) -> DataFrame:
    """For each row of edges (unique by key) the nearest point cp of its sequence at most within away, the smaller of
    equals; null if there is none. Points lie in buckets twice as wide as the reach, and an edge looks in at most two."""
    wide = F.lit(2 * within + 1)
    looked = F.array_distinct(F.array(F.floor((F.col(edge) - within) / wide), F.floor((F.col(edge) + within) / wide)))
    a = edges.select(*dict.fromkeys([*part, *key, edge])).withColumn("_b", F.explode(looked)).alias("e")
    c = points.select(*part, "cp").withColumn("_b", F.floor(F.col("cp") / wide)).alias("c")
    on = (F.col("e._b") == F.col("c._b")) & (F.abs(F.col("c.cp") - F.col(f"e.{edge}")) <= within)
    for p in part:
        on = on & (F.col(f"e.{p}") == F.col(f"c.{p}"))
    near = a.join(c, on).groupBy(*(F.col(f"e.{k}") for k in key)).agg(F.min_by("c.cp", F.struct(F.abs(F.col("c.cp") - F.col(f"e.{edge}")), "c.cp")).alias(to))
    return edges.join(near, key, "left")


def snap(spans: DataFrame, points: DataFrame, within: int, key: list[str], part: list[str] = PART) -> DataFrame:
    """Move both edges to the nearest changepoint within reach; a span that would collapse stays as it was."""
    both = nearest(nearest(spans, points, key, "st", within, "_s", part), points, key, "en", within, "_e", part)
    s, e = F.coalesce("_s", "st"), F.coalesce("_e", "en")
    return both.withColumns({"_ns": F.when(e > s, s).otherwise(F.col("st")), "_ne": F.when(e > s, e).otherwise(F.col("en"))}).withColumns({"st": F.col("_ns"), "en": F.col("_ne")}).drop("_s", "_e", "_ns", "_ne")


def bridge_frames(spans: DataFrame, frames: DataFrame, gap: float, part: list[str] = PART) -> DataFrame:
    """Merge spans (st, en, cls) of a class where the time from the last frame of one to the first of the next is at most gap.

    frames: part, i, ts. The merged span ends where its last one does.
    """
    at = lambda name, k: frames.select(*part, (F.col("i") + k).alias(name), F.col("ts").alias(f"_{name}"))
    timed = spans.join(at("st", 0), [*part, "st"]).join(at("en", 1), [*part, "en"])
    by = [*part, "cls"]
    new = F.col("_st") - F.lag("_en").over(_over(by, "st", "en")) > gap
    runs = islands(timed, new, by, ["st", "en"], "_run")
    return runs.groupBy(*by, "_run").agg(F.min("st").alias("st"), F.max_by("en", F.struct("st", "en")).alias("en")).drop("_run")


def bridge_seconds(events: DataFrame, gap: float | Column, part: list[str] = PART) -> DataFrame:
    """Merge each event (start_s, end_s, cls, score) with the one before it, of whatever class, if the classes are equal and the gap is at most gap."""
    w = _over(part, "start_s", "end_s", "cls")
    new = ~((F.col("cls") == F.lag("cls").over(w)) & (F.col("start_s") - F.lag("end_s").over(w) <= gap))
    runs = islands(events, new, part, ["start_s", "end_s", "cls"], "_run")
    return runs.groupBy(*part, "_run").agg(F.min("cls").alias("cls"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.max("score").alias("score")).drop("_run")


def run_length(frames: DataFrame, active: Column, label: str, value: str, part: list[str] = PART, i: str = "i") -> DataFrame:
    """Runs of neighbouring active frames of one label: st, en, label, mean value."""
    w = _over(part, i)
    marked = frames.withColumn("_on", active)
    runs = islands(marked, (F.col("_on") != F.lag("_on").over(w)) | (F.col(label) != F.lag(label).over(w)), part, [i], "_run")
    return runs.filter("_on").groupBy(*part, "_run", label).agg(F.min(i).alias("st"), (F.max(i) + 1).alias("en"), F.avg(value).alias("mean_p")).drop("_run")


def frame_delta(frames: DataFrame, emb: str = "emb", part: list[str] = PART, i: str = "i") -> DataFrame:
    """Adds feature: the embedding followed by its difference to the frame before (zeros for the first)."""
    before = F.lag(emb).over(_over(part, i))
    return frames.withColumn("_b", before).withColumn("feature", F.concat(F.col(emb), F.zip_with(emb, F.coalesce("_b", emb), lambda x, y: x - y))).drop("_b")


def boundary_kernel(frames: DataFrame, mark: str = "edge", part: list[str] = PART, i: str = "i") -> DataFrame:
    """Adds boundary: marks convolved with (1/4, 1, 1/4)."""
    w = _over(part, i)
    side = lambda c: F.coalesce(c.over(w), F.lit(0.0)) * 0.25
    return frames.withColumn("boundary", side(F.lag(mark)) + F.col(mark) + side(F.lead(mark)))


def duration_prior(spans: DataFrame, priors: DataFrame, step: str = "step", n: str = "n", centred: bool = False) -> DataFrame:
    """Spans (st, en, cls) shorter than their class's p10 seconds are centred anew with p50; others stay.

    priors: cls, p10, p50. step: seconds a frame. Spans without a prior stay. centred: the curve decoder's variant, which tells a
    span's seconds by a column `length`, and goes half of p50, in whole frames, to either side of the middle frame and one more.
    """
    found = spans.join(priors.select("cls", "p10", "p50"), "cls", "left")
    frames = F.greatest(F.lit(1), half_even(F.col("p50") / F.col(step)))
    centre = (F.col("st") + F.col("en")) / 2.0
    short = F.coalesce((F.col("en") - F.col("st")) * F.col(step) < F.col("p10"), F.lit(False))
    start, end = F.greatest(F.lit(0), F.floor(centre - frames / 2.0)), F.least(F.col(n), F.ceil(centre + frames / 2.0))
    if centred:
        half, centre = F.greatest(F.lit(1), half_even(F.col("p50") / F.col(step) / 2.0)), (F.col("st") + F.col("en") - 1) / 2.0
        short = F.coalesce(F.col("length") < F.col("p10"), F.lit(False))
        start, end = F.greatest(F.lit(0), F.floor(centre - half)), F.least(F.col(n), F.ceil(centre + half + 1))
    return found.withColumns({"_s": F.when(short, start).otherwise(F.col("st")).cast("bigint"), "_e": F.when(short, end).otherwise(F.col("en")).cast("bigint")}).withColumns({"st": F.col("_s"), "en": F.col("_e")}).drop("_s", "_e", "p10", "p50")


def running_offsets(clips: DataFrame, length: str = "n", order: str = "video_id") -> DataFrame:
    """Adds offset: the frames of all clips before, in order, as a contiguous store would lay them out.

    Lengths are summed for each range of clips first, so only one row a range meets in one task. Ranges lie between RANGES values of
    `order`, of any type: those of least hash, so a fair sample that is the same at each run.
    """
    bounds = sorted(r[0] for r in clips.select(order).filter(F.col(order).isNotNull()).distinct().orderBy(F.xxhash64(order)).limit(RANGES).collect())
    below = F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order)) if bounds else F.array()
    ranges = clips.withColumn("_range", F.size(below))
    sums = ranges.groupBy("_range").agg(F.sum(length).alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).drop("_sum")
    w = _rows(Window.partitionBy("_range").orderBy(order), Window.unboundedPreceding, 0)
    return ranges.join(before, "_range").withColumn("offset", (F.col("_before") + F.sum(length).over(w) - F.col(length)).cast("bigint")).drop("_range", "_before")


def span_mean(spans: DataFrame, curve: DataFrame, value: str = "p", part: list[str] = PART) -> DataFrame:
    """Adds mean_p: the curve's mean over each span."""
    keys = [c for c in spans.columns]
    return window_frames(spans, curve.select(*part, "i", value), part).groupBy(*keys).agg(F.avg(value).alias("mean_p"))


def positional_encoding(frames: DataFrame, size: int, base: float = 10000.0, i: str = "i") -> DataFrame:
    """Adds position: sines and cosines of the frame's index at falling frequencies, size values in turn."""
    angle = lambda k: F.col(i) / F.lit(base ** (2 * (k // 2) / size))
    return frames.withColumn("position", F.array(*(F.sin(angle(k)) if k % 2 == 0 else F.cos(angle(k)) for k in range(size))))
