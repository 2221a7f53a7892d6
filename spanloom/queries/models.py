"""Queries of models and calibration. Fits have no SQL; tests hold them against expected accuracy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.vectors import softmax
from spanloom.operators import aggregates as A
from spanloom.operators.aggregates import balanced_accuracy
from spanloom.plans import models as P
from spanloom.plans.clip_head import head_windows, initial_head, train_head
from spanloom.sources import views as V
from spanloom.sources.scratch import stored

from .basic import query, r6


@query()
def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.linear_probe(V.frames(spark, sf_dir).select("video_id", "i", "emb", "class_idx"), "emb", "class_idx")
    return found.select("video_id", "i", "class_idx", "guess", r6(F.array_max("probs")).alias("p"))


@query()
def linear_probe_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linear_probe(spark, sf_dir)
    return balanced_accuracy(found.select(F.col("class_idx").cast("bigint").alias("truth"), "guess"))


@query()
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.curve(spark, sf_dir).select("video_id", "i", "p", (F.col("class_name") == "click").cast("double").alias("y"))
    return P.isotonic(rows, "p", "y").select("video_id", "i", r6("calibrated").alias("calibrated"))


@query("""with d as (select class_name, p, sum((video_id % 2)::double) as y, count(*)::double as n from v_curve group by 1, 2),
c as (select *, row_number() over w as i, sum(y) over w as ys, sum(n) over w as ns from d window w as (partition by class_name order by p)),
pair as (select a.class_name, a.i as j, b.i as k, (b.ys - a.ys + a.y) / (b.ns - a.ns + a.n) as mean from c a join c b on a.class_name = b.class_name and a.i <= b.i),
least as (select class_name, j, k as i, min(mean) over (partition by class_name, j order by k desc) as m from pair),
fit as (select class_name, i, max(m) as value from least group by 1, 2)
select video_id, v.i, round(value, 6) as calibrated from v_curve v join c on c.class_name = v.class_name and c.p = v.p join fit f on f.class_name = c.class_name and f.i = c.i""")
def isotonic_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An isotonic fit for each class, against the greatest of the least means of all stretches about a score."""
    rows = V.curve(spark, sf_dir).withColumn("y", (F.col("video_id") % 2).cast("double"))
    return P.isotonic_by_class(rows, "class_name", "p", "y").select("video_id", "i", r6("calibrated").alias("calibrated"))


def _weights(d: int, hidden: int = 16, classes: int = 12, seed: int = 7) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed).normal
    return {"project": g(size=(d, hidden)), "project_bias": g(size=hidden), "attend": g(size=hidden), "attend_bias": np.float64(0.1), "classify": g(size=(hidden, classes)), "classify_bias": g(size=classes)}


@query()
def clip_head_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip head with seeded weights over all sliding windows; DuckDB has no error function, so tests hold it against a loop."""
    found = head_windows(V.frames(spark, sf_dir).select("video_id", "i", "emb"), _weights(64), 6, 2)
    top = F.array_max("probs")
    return found.select("video_id", "st", "en", (F.array_position("probs", top) - 1).alias("cls"), r6(top).alias("p"))


@query()
def clip_head_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and balanced accuracy of each epoch of the clip head, over clips of ten frames with the label of their first; tests hold training against a loop."""
    frames = V.frames(spark, sf_dir).withColumn("clip", F.floor(F.col("i") / 10))
    step = F.struct("i", "emb", "class_idx")
    clips = frames.groupBy("video_id", "clip").agg(F.array_sort(F.collect_list(step)).alias("s")).select(F.col("s.emb").alias("embs"), F.col("s.class_idx")[0].cast("bigint").alias("class_idx"))
    weights = A.class_weights(A.class_counts(clips, 12))
    rows = clips.join(F.broadcast(weights.select("class_idx", "weight")), "class_idx").select("embs", F.col("class_idx").cast("int").alias("label"), "weight")
    _, history = train_head(stored(rows, "clips"), initial_head(64, 16, 12, 3), 5)
    return spark.createDataFrame([(t, round(loss, 6), round(accuracy, 6)) for t, loss, accuracy in history], "epoch int, loss double, balanced_accuracy double")


@query("select vec_id // 50 as video_id, vec_id % 50 as i, case when vec_id % 17 = 0 then 'no embedding' when embedding[1] > 0.15::float then 'ValueError: out of range' end as error, round(case when vec_id % 17 > 0 and embedding[1] <= 0.15::float then embedding[1]::double - embedding[2]::double end, 6) as margin from embeddings")
def scored_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that raises on some embeddings: each fault stays with its row, all others are scored."""

    def load():
        def model(x):
            if (x[:, 0] > np.float32(0.15)).any():
                raise ValueError("out of range")
            return x[:, :2]

        return model

    frames = V.frames(spark, sf_dir).select("video_id", "i", F.when((50 * F.col("video_id") + F.col("i")) % 17 != 0, F.col("emb")).alias("emb"))
    found = P.external_scorer(frames, load)
    return found.select("video_id", "i", "error", r6(F.col("probs")[0] - F.col("probs")[1]).alias("margin"))


_NLL = "select t, round(avg(-ln(greatest(e[label + 1] / list_sum(e), 1e-12))), 6) as nll from (select label, t, list_transform(embedding[1:10]::double[], lambda x: exp((x - list_max(embedding[1:10]::double[])) / t)) as e from embeddings cross join (select unnest([0.05::double, 0.2, 1.0, 5.0]) as t)) group by 1"


@query(_NLL)
def temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "embeddings").select(F.slice(F.col("embedding").cast("array<double>"), 1, 10).alias("logits"), "label")
    return P.temperature_grid(rows, "logits", "label", [0.05, 0.2, 1.0, 5.0]).withColumn("nll", r6("nll"))


_LOSS = """with w as (select k, w / avg(w) over () as weight from (select k, 1 / sqrt(coalesce(n, 1)) as w from (select unnest(range(0, 12)) as k) left join (select label as k, count(*) as n from embeddings group by 1) using (k))),
p as (select label, embedding[1]::double as e0, vec_id, list_transform(list_transform(embedding[1:12]::double[], lambda x: exp(x * 8 - list_max(embedding[1:12]::double[]) * 8)), lambda y: y) as e from embeddings),
r as (select weight, e[label + 1] / list_sum(e) as py, 1 / (1 + exp(-e0)) as q, (vec_id % 10 = 0)::int::double as y from p join w on w.k = p.label)
select round(c, 6) as class_loss, round(b, 6) as boundary_loss, round(c + 0.3::double * b, 6) as loss from (select sum(-weight * ln(greatest(py, 1e-12))) / sum(weight) as c, avg(-(y * ln(greatest(q, 1e-12)) + (1 - y) * ln(greatest(1 - q, 1e-12)))) as b from r)"""


@query(_LOSS)
def training_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "embeddings")
    weights = A.class_weights(A.class_counts(rows.select(F.col("label").cast("bigint").alias("class_idx")), 12))
    logits = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 12), lambda x: x * 8)
    scored = rows.select(softmax(logits).alias("probs"), "label", (1 / (1 + F.exp(-F.col("embedding")[0].cast("double")))).alias("q"), (F.col("vec_id") % 10 == 0).cast("double").alias("y"))
    return A.losses(scored, weights, "probs", "label", "q", "y").select(*(r6(c).alias(c) for c in ("class_loss", "boundary_loss", "loss")))
