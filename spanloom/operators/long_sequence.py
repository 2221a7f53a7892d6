"""Smoothing, hysteresis and merging for sequences that are longer than a task should hold.

A sequence is cut into blocks of frames. What a block needs to know of the others is a few numbers a block (last state, last closing, last
candidate), which a scan over the blocks passes on; so rows are windowed by sequence and block, and one sequence fills any number of tasks.
Results are those of the functions of the same name in `sequence`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import PART

#: Frames in a block.
BLOCK = 100_000


def _with(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of side, one row a key at most; null keys meet."""
    side = side.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), *(c for c in side.columns if c not in keys))
    on = F.lit(True)
    for n, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return rows.join(side, on, "left").drop(*(f"_k{n}" for n in range(len(keys))))


def _before(blocks: DataFrame, part: list[str], **values: str) -> DataFrame:
    """part, _b and each value's last one in the blocks before; a row a block."""
    w = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*part, "_b", *(F.last(c, ignorenulls=True).over(w).alias(to) for to, c in values.items()))


def _blocked(rows: DataFrame, i: str, block: int) -> DataFrame:
    return rows.withColumn("_b", F.floor(F.col(i) / block))


def smooth(curve: DataFrame, win: int, value: str = "p", part: list[str] = PART, i: str = "i", to: str = "smooth", block: int = BLOCK) -> DataFrame:
    """Centred moving average over frames i = 0, 1, ... of each sequence; the first and last values stand in beyond the edges. A block gets the frames that its
    own need from its neighbours."""
    if win <= 1:
        return curve.withColumn(to, F.col(value))
    left, right = win // 2, win - 1 - win // 2
    ends = curve.groupBy(*part).agg(F.count("*").alias("_n"), F.min_by(value, i).alias("_first"), F.max_by(value, i).alias("_last"))
    needed = F.sequence(F.greatest(F.lit(0), F.floor((F.col(i) - right) / block)), F.floor((F.col(i) + left) / block))
    copies = curve.withColumn("_b", F.explode(needed))
    w = Window.partitionBy(*part, "_b").orderBy(i).rowsBetween(-left, right)
    own = copies.withColumn("_inner", F.sum(value).over(w)).filter(F.col("_b") == F.floor(F.col(i) / block))
    before = F.greatest(F.lit(left) - F.col(i), F.lit(0)) * F.col("_first")
    after = F.greatest(F.col(i) + right - (F.col("_n") - 1), F.lit(0)) * F.col("_last")
    return _with(own, ends, part).withColumn(to, (F.col("_inner") + before + after) / F.lit(float(win))).select(*curve.columns, to)


def hysteresis(curve: DataFrame, hi: float, lo: float, value: str = "p", part: list[str] = PART, i: str = "i", block: int = BLOCK) -> DataFrame:
    """Spans that open where the value is above hi and close at the first at or below lo. Between two closings there's one span at most, so the last closing
    before a frame names its span in all blocks that it runs through."""
    turn = F.when(F.col(value) > hi, 1).when(F.col(value) <= lo, 0)
    rows = _blocked(curve, i, block).withColumns({"_turn": turn, "_off": F.when(turn == 0, F.col(i))})
    blocks = rows.groupBy(*part, "_b").agg(F.max_by("_turn", F.when(F.col("_turn").isNotNull(), F.col(i))).alias("turn"), F.max("_off").alias("off"))
    rows = _with(rows, _before(blocks, part, _state="turn", _closed="off"), [*part, "_b"])
    w = Window.partitionBy(*part, "_b").orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, carried: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(carried))
    rows = rows.withColumns({"_on": F.coalesce(last("_turn", "_state"), F.lit(0)), "_span": last("_off", "_closed")})
    return rows.filter("_on = 1").groupBy(*part, "_span").agg(F.min(i).alias("st"), (F.max(i) + 1).alias("en"), F.avg(value).alias("mean_p")).drop("_span")


def merge_windows(candidates: DataFrame, stride: int, reclassify: bool = False, part: list[str] = PART, block: int = BLOCK) -> DataFrame:
    """Merge candidate windows (st, en, cls, score) as sequence.merge_windows does; grp is the start of a group's first candidate. Two scans: the last candidate of the blocks before
    tells whether a block's first one goes on; then the last beginning of a group before it names its group."""
    rows = _blocked(candidates, "st", block)
    own = Window.partitionBy(*part, "_b").orderBy("st", "en")
    ends = rows.groupBy(*part, "_b").agg(F.max_by(F.struct("en", "cls"), F.struct("st", "en")).alias("tail"))
    rows = _with(rows, _before(ends, part, _tail="tail"), [*part, "_b"])
    ahead = F.coalesce(F.lag(F.struct("en", "cls")).over(own), F.col("_tail"))
    joins = F.col("st") <= ahead["en"] + stride
    if not reclassify:
        joins = joins & (F.col("cls") == ahead["cls"])
    rows = rows.withColumn("_new", F.when(~F.coalesce(joins, F.lit(False)), F.struct("st", "en")))
    begun = rows.groupBy(*part, "_b").agg(F.max("_new").alias("begun"))
    rows = _with(rows, _before(begun, part, _group="begun"), [*part, "_b"])
    group = F.coalesce(F.last("_new", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("_group"))
    groups = rows.withColumn("_id", group).groupBy(*part, "_id").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.min_by("cls", "st").alias("cls"), F.max("score").alias("score"))
    return groups.select(*part, F.col("_id.st").alias("grp"), "st", "en", "cls", "score")
