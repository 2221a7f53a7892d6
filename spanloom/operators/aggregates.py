"""Grouped statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.sources.scratch import stored


def first_by(rows: DataFrame, part: list[str], order: str, cols: dict[str, str]) -> DataFrame:
    """Values of each group's first row in order, renamed."""
    return rows.groupBy(*part).agg(*(F.min_by(c, order).alias(to) for c, to in cols.items()))


#: Bits that a round of exact_quantiles tells apart.
RADIX_BITS = 16


def _ordered_bits(v: Column) -> Column:
    """A double's 64 bits as a bigint in the same order; -0.0 counts as 0.0, NaN comes last."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(v, F.lit(0.0)) + F.lit(0.0)).cast("bigint")
    return F.when(v.isNull(), None).when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _from_bits(k: Column) -> Column:
    bits = F.when(k < 0, k.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(k)
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def exact_quantiles(rows: DataFrame, part: list[str], value: Column, probs: dict[str, float]) -> DataFrame:
    """part and the exact quantiles of each group, interpolated between neighbouring values; nulls don't count, a group of nothing else has nulls.

    Distributed selection: values are counted by their first RADIX_BITS order-preserving bits, the counts tell which of these hold the wanted ranks, and only values that begin
    so are counted by the next bits, until all 64 are known. A group is never gathered or sorted: counts are combined in the tasks, at most
    2**RADIX_BITS a group and wanted rank.
    """
    keyed = stored(rows.select(*part, _ordered_bits(value.cast("double")).alias("_key")), "keys")
    same = lambda a, b, more=(): reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*part, *more)))
    sizes = keyed.groupBy(*part).agg((F.count("_key") - 1).alias("_last"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("_q"), F.lit(float(p)).alias("_p")) for name, p in probs.items())))
    ranks = sizes.select(*part, "_last", asked.alias("_x")).select(*part, "_x.*", (F.col("_last") * F.col("_x._p")).alias("_place")).filter("_place >= 0")
    wanted = ranks.select(*part, "_q", "_place", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))).alias("_rank"))
    wanted = wanted.withColumns({"_left": F.col("_rank"), "_prefix": F.lit(0).cast("bigint")})
    for shift in range(64 - RADIX_BITS, -1, -RADIX_BITS):
        wanted = stored(wanted, "wanted")
        own = F.shiftright("_key", shift + RADIX_BITS) if shift + RADIX_BITS < 64 else F.lit(0).cast("bigint")
        seen = keyed.filter("_key is not null").select(*part, own.alias("_prefix"), F.shiftright("_key", shift).alias("_next")).alias("r")
        seen = seen.join(wanted.select(*part, "_prefix").distinct().alias("w"), same("r", "w", ("_prefix",)), "left_semi")
        counts = seen.groupBy(*part, "_prefix", "_next").agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*part, "_prefix").orderBy("_next"))
        counts = counts.withColumn("_upto", upto)
        inside = (F.col("w._left") < F.col("c._upto")) & (F.col("w._left") >= F.col("c._upto") - F.col("c._n"))
        found = wanted.alias("w").join(counts.alias("c"), same("w", "c", ("_prefix",)) & inside)
        wanted = found.select(*(F.col(f"w.{c}") for c in part), "w._q", "w._place", "w._rank", (F.col("w._left") - (F.col("c._upto") - F.col("c._n"))).alias("_left"), F.col("c._next").alias("_prefix"))
    values = wanted.select(*part, "_q", "_place", "_rank", _from_bits(F.col("_prefix")).alias("_v"))
    low, high, share = F.min_by("_v", "_rank"), F.max_by("_v", "_rank"), F.max("_place") - F.min("_rank")
    each = values.groupBy(*part, "_q").agg((low + F.when(share > 0, (high - low) * share).otherwise(0.0)).alias("_v"))
    wide = each.groupBy(*part).agg(*(F.max(F.when(F.col("_q") == name, F.col("_v"))).alias(name) for name in probs))
    return sizes.alias("s").join(wide.alias("v"), same("s", "v"), "left").select(*(F.col(f"s.{c}") for c in part), *(F.col(f"v.{name}") for name in probs))


def duration_priors(rows: DataFrame, cls: str, dur: str) -> DataFrame:
    """p10, p50 and p90 of each class's durations (at least 0), interpolated."""
    return exact_quantiles(rows, [cls], F.greatest(F.lit(0.0), F.col(dur)), {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def class_counts(rows: DataFrame, classes: int, col: str = "class_idx") -> DataFrame:
    """n of each of the classes; 1 for one without rows."""
    return rows.sparkSession.range(classes).select(F.col("id").alias(col)).join(rows.groupBy(col).agg(F.count("*").alias("n")), col, "left").select(col, F.coalesce("n", F.lit(1)).cast("bigint").alias("n"))


def class_weights(counts: DataFrame) -> DataFrame:
    """weight = 1 / sqrt(n), scaled to a mean of 1. One row a class."""
    w = 1 / F.sqrt("n")
    return counts.withColumn("weight", w / F.avg(w).over(Window.partitionBy()))


def confusion(rows: DataFrame, classes: int) -> DataFrame:
    """n for every pair of truth and guess among the classes, also those that don't occur."""
    ids = rows.sparkSession.range(classes)
    grid = ids.select(F.col("id").alias("truth")).withColumn("guess", F.explode(F.sequence(F.lit(0), F.lit(classes - 1)).cast("array<bigint>")))
    return grid.join(rows.groupBy("truth", "guess").agg(F.count("*").alias("n")), ["truth", "guess"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def balanced_accuracy(rows: DataFrame) -> DataFrame:
    """Mean recall over the classes that occur."""
    return rows.groupBy("truth").agg(F.avg((F.col("truth") == F.col("guess")).cast("double")).alias("r")).agg(F.avg("r").alias("balanced_accuracy"))


def median_step(rows: DataFrame, ts: str, part: list[str], order: str, default: float) -> DataFrame:
    """Median time between neighbours; default for a single row."""
    d = F.col(ts) - F.lag(ts).over(Window.partitionBy(*part).orderBy(order))
    return rows.withColumn("_d", d).groupBy(*part).agg(F.coalesce(F.median("_d"), F.lit(default)).alias("step"))


def duplicates(rows: DataFrame, key: list[str], first: str) -> DataFrame:
    """Keys that occur more than once, how often, and their least value of `first`."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(first).alias("first")).filter("n > 1")


def attention_pool(frames: DataFrame, logit: str, emb: str, part: list[str]) -> DataFrame:
    """part, d, v: each sequence's mean embedding under softmax weights of the logit.

    The maximum is a number a sequence, combined before its shuffle and joined back; sums are combined before theirs, so no
    sequence has to fit anywhere.
    """
    top = frames.groupBy(*part).agg(F.max(logit).alias("_top"))
    each = frames.join(top, part).select(*part, F.exp(F.col(logit) - F.col("_top")).alias("_w"), F.posexplode(emb).alias("d", "_x"))
    return each.groupBy(*part, "d").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("v"))


def reliability(rows: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """By bin of predicted probability: n, mean prediction, rate of truth."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("bigint")
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def losses(rows: DataFrame, weights: DataFrame, probs: str, truth: str, edge_p: str, edge: str, edge_weight: float = 0.3) -> DataFrame:
    """One row: class loss (cross-entropy weighted by class), boundary loss (binary cross-entropy) and their weighted sum.

    weights: class_idx, weight; a row a class, broadcast.
    """
    log = lambda p: F.log(F.greatest(p, F.lit(1e-12)))
    known = rows.join(F.broadcast(weights), rows[truth] == weights["class_idx"])
    ce = F.sum(-F.col("weight") * log(F.get(probs, F.col(truth)))) / F.sum("weight")
    bce = F.avg(-(F.col(edge) * log(F.col(edge_p)) + (1 - F.col(edge)) * log(1 - F.col(edge_p))))
    return known.agg(ce.alias("class_loss"), bce.alias("boundary_loss")).withColumn("loss", F.col("class_loss") + edge_weight * F.col("boundary_loss"))
