"""Models on pooled embeddings, with Spark's own learners; and the interface for models that run outside Spark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spanloom.functions.vectors import softmax
from spanloom.sources.scratch import stored


def linear_probe(rows: DataFrame, emb: str, label: str, weight: str | None = None, iterations: int = 20) -> DataFrame:
    """rows with probs (array) and guess of a multinomial logistic regression fitted on them."""
    data = rows.withColumns({"features": array_to_vector(F.col(emb)), "label": F.col(label).cast("double")})
    model = LogisticRegression(maxIter=iterations, regParam=1e-4, **({"weightCol": weight} if weight else {})).fit(data)
    found = model.transform(data)
    return found.select(*rows.columns, vector_to_array("probability").alias("probs"), F.col("prediction").cast("bigint").alias("guess"))


def isotonic(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """rows with `calibrated`: the isotonic fit of truth on score."""
    data = rows.withColumns({"features": F.col(score), "label": F.col(truth).cast("double")})
    return IsotonicRegression().fit(data).transform(data).select(*rows.columns, F.col("prediction").alias("calibrated"))


def temperature_grid(rows: DataFrame, logits: str, label: str, grid: list[float]) -> DataFrame:
    """t, nll: mean negative log-likelihood of the labels under each temperature."""
    tried = rows.select(logits, label, F.explode(F.array(*map(F.lit, grid))).alias("t"))
    p = F.get(softmax(F.transform(logits, lambda x: x / F.col("t"))), F.col(label))
    return tried.withColumn("p", p).groupBy("t").agg(F.avg(-F.log(F.greatest(F.col("p"), F.lit(1e-12)))).alias("nll"))


def _merged_stacks(blocks: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Blocks (lowest score, highest score, sum of truths, rows) by rising score, pooled until their means rise. Pooling stretches first and their results afterwards gives
    the same as pooling all at once."""
    out: list[tuple[float, float, float, float]] = []
    for block in blocks:
        out.append(block)
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            (low, _, y, n), (_, high, more, m) = out[-2:]
            out[-2:] = [(low, high, y + more, n + m)]
    return out


_STACK = "low double, high double, total double, n double"


def isotonic_blocks(rows: DataFrame, cls: str, score: str, truth: str) -> DataFrame:
    """cls, low, high, value: for each class the isotonic fit of truth on score, as blocks of scores with their mean. Null scores and truths don't count.

    Adjacent violators are pooled in two steps, all classes in one job: the scores, each with its rows summed, are sorted by ranges of (class, score), and every range is pooled to
    a stack of blocks by itself; then each class's stacks are merged in order. Only stacks meet in one task.
    """
    kind = rows.schema[cls].dataType.simpleString()
    sums = rows.filter(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(cls).alias("cls"), F.col(score).cast("double").alias("low")).agg(F.sum(F.col(truth).cast("double")).alias("total"), F.count("*").cast("double").alias("n"))

    def pooled(batches):
        for pdf in batches:
            out = []
            for own, group in pdf.groupby("cls", dropna=False, sort=False):
                stack = _merged_stacks(list(zip(group["low"], group["high"], group["total"], group["n"], strict=True)))
                out += [(None if pd.isna(own) else own, *block) for block in stack]
            yield pd.DataFrame(out, columns=["cls", "low", "high", "total", "n"])

    ranged = sums.select("cls", "low", F.col("low").alias("high"), "total", "n").repartitionByRange("cls", "low").sortWithinPartitions("cls", "low")
    stacks = stored(ranged.mapInPandas(pooled, f"cls {kind}, {_STACK}"), "stacks")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.sort_values("low")
        out = [(low, high, total / n) for low, high, total, n in _merged_stacks(list(zip(group["low"], group["high"], group["total"], group["n"], strict=True)))]
        return pd.DataFrame(out, columns=["low", "high", "value"]).assign(cls=pdf["cls"].iloc[0])

    return stacks.groupBy("cls").applyInPandas(merged, f"low double, high double, value double, cls {kind}").select(F.col("cls").alias(cls), "low", "high", "value")


def isotonic_by_class(rows: DataFrame, cls: str, score: str, truth: str) -> DataFrame:
    """rows with `calibrated`: the value of their class's isotonic fit at their score; null for a null score. A class's blocks, few beside its rows, go to its rows as one array."""
    step = F.struct("low", "value")
    fits = isotonic_blocks(rows, cls, score, truth).groupBy(F.col(cls).alias("_cls")).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    found = rows.join(fits, F.col(cls).eqNullSafe(F.col("_cls")), "left")
    below = F.filter("_steps", lambda s: s.low <= F.col(score))
    return found.select(*rows.columns, F.when(F.col(score).isNotNull(), F.element_at(below, -1).value).alias("calibrated"))


def observed_faults(name: str) -> Observation:
    """Counts of rows scored and failed, filled in by the first action on what external_scorer returns."""
    return Observation(name)


def external_scorer(frames: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], emb: str = "emb", faults: Observation | None = None) -> DataFrame:
    """Adds probs by a model that runs in Python, and error: load() is called once a task and gives a function from a matrix of
    embeddings to one of probabilities. Rows go through in Arrow batches.

    A row that fails, because it has no embedding or because the model raises on it, has null probs and the error's text; the others are scored. Rows
    on which the model raises are halved and tried again, down to the one. faults counts both kinds in the same pass.
    """

    def attempt(model, values: list) -> tuple[list, list]:
        try:
            return [list(map(float, row)) for row in model(np.stack(values))], [None] * len(values)
        except Exception as e:  # whatever a caller's model raises is that row's fault
            if len(values) == 1:
                return [None], [f"{type(e).__name__}: {e}"]
        halves = [attempt(model, v) for v in (values[: len(values) // 2], values[len(values) // 2 :])]
        return halves[0][0] + halves[1][0], halves[0][1] + halves[1][1]

    def run(batches):
        model = load()
        for pdf in batches:
            values = [None if v is None else np.asarray(v, float) for v in pdf[emb]]
            good = [k for k, v in enumerate(values) if v is not None]
            probs, errors = [None] * len(values), ["no embedding"] * len(values)
            if good:
                for k, p, e in zip(good, *attempt(model, [values[k] for k in good]), strict=True):
                    probs[k], errors[k] = p, e
            yield pdf.assign(probs=pd.Series(probs, index=pdf.index, dtype=object), error=pd.Series(errors, index=pdf.index, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    found = frames.mapInPandas(run, f"{schema}, probs array<double>, error string")
    if faults is None:
        return found
    return found.observe(faults, F.count_if(F.col("error").isNull()).alias("scored"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def split_faults(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that were scored, without error, and the others, for a dead-letter table."""
    return scored.filter("error is null").drop("error"), scored.filter("error is not null").drop("probs")
