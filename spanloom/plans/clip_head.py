"""The clip head: projection, GELU, attention pooling over a window's frames, and class probabilities, for every window of every clip."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of a window's width that a task pools at a time.
BLOCKS = 64
#: Weights by name and how many indices they have: project (inputs, hidden), attend (hidden), classify (hidden, classes), and their offsets.
SHAPES = {"project": 2, "project_bias": 1, "attend": 1, "attend_bias": 0, "classify": 2, "classify_bias": 1}


def write_head(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """Weights as a table: name, row, values (a row of the matrix)."""
    rows = [(name, k, [float(x) for x in np.atleast_1d(row)]) for name in SHAPES for k, row in enumerate(np.atleast_2d(weights[name]))]
    spark.createDataFrame(rows, "name string, row int, values array<double>").write.mode("overwrite").parquet(path)


def read_head(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The weights of one head; its size doesn't grow with the data."""
    found: dict[str, list] = {}
    for r in sorted(spark.read.parquet(path).collect(), key=lambda r: (r.name, r.row)):
        found.setdefault(r.name, []).append(r["values"])
    shaped = {name: np.array(rows) for name, rows in found.items()}
    return {name: {0: lambda x: x[0, 0], 1: lambda x: x[0], 2: lambda x: x}[SHAPES[name]](x) for name, x in shaped.items()}


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function by its series of positive terms, to about 1e-15."""
    x = np.clip(x, -6.0, 6.0)
    term = total = x.copy()
    for n in range(1, 150):
        term = term * (2 * x * x / (2 * n + 1))
        total = total + term
    return 2 / np.sqrt(np.pi) * np.exp(-x * x) * total


def hidden(emb: np.ndarray, weights: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features after projection and GELU, and attention logits, a row a frame."""
    x = emb @ weights["project"] + weights["project_bias"]
    h = x * (1 + _erf(x / np.sqrt(2))) / 2
    return h, h @ weights["attend"] + weights["attend_bias"]


def _scan(logits: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running maxima of the logits along axis 1, and sums of exp(logit - maximum) and of that times the values so far. Scaled by the maximum at each step, so
    nothing overflows or is lost beside what's larger."""
    top = np.maximum.accumulate(logits, axis=1)
    mass, total = np.empty_like(logits), np.empty_like(values)
    for k in range(logits.shape[1]):
        e = np.exp(logits[:, k] - top[:, k])
        mass[:, k], total[:, k] = e, e[:, None] * values[:, k]
        if k:
            keep = np.exp(top[:, k - 1] - top[:, k])
            mass[:, k] += keep * mass[:, k - 1]
            total[:, k] += keep[:, None] * total[:, k - 1]
    return top, mass, total


def pooled(h: np.ndarray, a: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Attention-pooled features of the windows of `width` frames at starts.

    Frames are cut into blocks of the width, so a window is the end of one block and the beginning of the next; sums along each block from both sides, worked
    out once, give every window however many overlap.
    """
    blocks = -(-len(a) // width) + 1
    padded = blocks * width - len(a)
    logits = np.concatenate([a, np.full(padded, -np.inf)]).reshape(blocks, width)
    logits = np.where(np.isneginf(logits), -1e300, logits)
    values = np.concatenate([h, np.zeros((padded, h.shape[1]))]).reshape(blocks, width, -1)
    ahead = _scan(logits, values)
    behind = [x[:, ::-1] for x in _scan(logits[:, ::-1], values[:, ::-1])]
    b, off = starts // width, starts % width
    top, mass, total = (x[b, off] for x in behind)
    at = np.maximum(off - 1, 0)
    top2, mass2, total2 = (x[np.minimum(b + 1, blocks - 1), at] for x in ahead)
    top2 = np.where(off == 0, -np.inf, top2)
    most = np.maximum(top, top2)
    one, two = np.exp(top - most), np.exp(top2 - most)
    return (one[:, None] * total + two[:, None] * total2) / (one * mass + two * mass2)[:, None]


def class_probabilities(x: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    z = x @ weights["classify"] + weights["classify_bias"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def head_windows(frames: DataFrame, weights: dict[str, np.ndarray], width: int, stride: int, emb: str = "emb", part: list[str] | None = None, i: str = "i") -> DataFrame:
    """part, st, en, probs: the head's class probabilities for each sliding window of each clip (see sequence.sliding_windows: a last window at the end, one short window
    if the clip is shorter).

    frames: part, i = 0, 1, ... and emb. A clip is cut into stretches of BLOCKS blocks, and a task gets a stretch with the frames that its last windows reach into, so a
    clip of any length fills any number of tasks.
    """
    part, stretch = part or ["video_id"], width * BLOCKS
    n = frames.groupBy(*part).agg(F.count("*").alias("_n"))
    needed = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_i") - width) / stretch)), F.floor(F.col("_i") / stretch))
    rows = frames.select(*part, F.col(i).alias("_i"), F.col(emb).alias("_emb")).join(n, part).withColumn("_g", F.explode(needed))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        total, first, g = int(pdf["_n"].iloc[0]), int(pdf["_i"].iloc[0]), int(pdf["_g"].iloc[0])
        last = max(0, total - width)
        lo, hi = g * stretch, (g + 1) * stretch
        starts = np.union1d(np.arange(-(-lo // stride) * stride, min(hi - 1, last) + 1, stride), [last])
        starts = starts[(starts >= lo) & (starts < hi)].astype(np.int64)
        h, a = hidden(np.stack(pdf["_emb"].to_numpy()).astype(float), weights)
        w = min(width, total)
        probs = class_probabilities(pooled(h, a, starts - first, w), weights) if len(starts) else np.empty((0, 1))
        out = pd.DataFrame({p: [pdf[p].iloc[0]] * len(starts) for p in part})
        return out.assign(st=starts, en=starts + w, probs=pd.Series(list(map(list, probs)), dtype=object))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*part).schema)
    return rows.groupBy(*part, "_g").applyInPandas(run, f"{kinds}, st bigint, en bigint, probs array<double>")


#: AdamW: rates of the running means of gradients and their squares, and what keeps a division defined.
BETAS, EPSILON = (0.9, 0.999), 1e-8


def initial_head(inputs: int, hidden: int, classes: int, seed: int) -> dict[str, np.ndarray]:
    """Seeded weights, scaled by the inputs that each sums over; offsets of zero."""
    g = np.random.default_rng(seed).normal
    return {
        "project": g(size=(inputs, hidden)) / np.sqrt(inputs), "project_bias": np.zeros(hidden), "attend": g(size=hidden) / np.sqrt(hidden), "attend_bias": np.zeros(()),
        "classify": g(size=(hidden, classes)) / np.sqrt(hidden), "classify_bias": np.zeros(classes),
    }


def clip_gradient(emb: np.ndarray, label: int, weight: float, w: dict[str, np.ndarray]) -> tuple[float, int, dict[str, np.ndarray]]:
    """Weighted cross-entropy of one clip, its guess, and the gradient of the loss by every weight."""
    x = emb @ w["project"] + w["project_bias"]
    below = (1 + _erf(x / np.sqrt(2))) / 2
    h = x * below
    a = h @ w["attend"] + w["attend_bias"]
    s = np.exp(a - a.max())
    s /= s.sum()
    mean = s @ h
    p = class_probabilities(mean[None, :], w)[0]
    by_z = weight * (p - (np.arange(len(p)) == label))
    by_mean = w["classify"] @ by_z
    by_s = h @ by_mean
    by_a = s * (by_s - s @ by_s)
    by_x = (s[:, None] * by_mean + by_a[:, None] * w["attend"]) * (below + x * np.exp(-x * x / 2) / np.sqrt(2 * np.pi))
    slope = {"project": emb.T @ by_x, "project_bias": by_x.sum(axis=0), "attend": by_a @ h, "attend_bias": by_a.sum(), "classify": np.outer(mean, by_z), "classify_bias": by_z}
    return float(-weight * np.log(max(p[label], 1e-300))), int(p.argmax()), slope


def _epoch(clips: DataFrame, w: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], float, float]:
    """Gradient and loss, as weighted means over all clips, and balanced accuracy under the weights. Each task sums over its clips and sends a row for each row of the weights; Spark adds
    these, and what comes back has the size of the weights."""

    def run(batches):
        total: dict[str, np.ndarray] = {name: np.zeros_like(np.atleast_2d(x)) for name, x in w.items()}
        loss, mass, hits = 0.0, 0.0, {}
        for pdf in batches:
            for emb, label, weight in zip(pdf["embs"], pdf["label"], pdf["weight"], strict=True):
                value, guess, slope = clip_gradient(np.stack(emb).astype(float), label, weight, w)
                loss, mass = loss + value, mass + weight
                n, k = hits.get(label, (0, 0))
                hits[label] = (n + 1, k + (guess == label))
                for name, g in slope.items():
                    total[name] += np.atleast_2d(g)
        out = [(name, k, list(map(float, row))) for name, g in total.items() for k, row in enumerate(g)]
        out += [("loss", 0, [loss, mass])] + [("hits", int(label), [float(n), float(k)]) for label, (n, k) in hits.items()]
        yield pd.DataFrame(out, columns=["name", "row", "values"])

    parts = clips.select("embs", "label", "weight").mapInPandas(run, "name string, row int, values array<double>")
    sums = parts.select("name", "row", F.posexplode("values").alias("at", "x")).groupBy("name", "row", "at").agg(F.sum("x").alias("x"))
    found: dict[str, dict] = {}
    for r in sums.collect():
        found.setdefault(r.name, {})[r.row, r.at] = r.x
    mass = found["loss"][0, 1]
    slope = {name: np.array([[found[name][k, at] for at in range(np.atleast_2d(x).shape[1])] for k in range(np.atleast_2d(x).shape[0])]).reshape(np.shape(x)) / mass for name, x in w.items()}
    labels = {k for k, _ in found["hits"]}
    return slope, found["loss"][0, 0] / mass, float(np.mean([found["hits"][k, 1] / found["hits"][k, 0] for k in sorted(labels)]))


def train_head(clips: DataFrame, weights: dict[str, np.ndarray], epochs: int, rate: float = 1e-2, decay: float = 1e-2) -> tuple[dict[str, np.ndarray], list[tuple[int, float, float]]]:
    """The head of the best epoch, by balanced accuracy (the first of equals), and (epoch, loss, balanced accuracy) of each, as they were before its step.

    clips: embs (array of a clip's embeddings), label and weight (see aggregates.class_weights). All clips count in each step (AdamW on the full
    gradient), so the losses are the same at any partitioning but for rounding. The driver holds the weights and two running means of their size. At least one clip.
    """
    w = {name: np.array(x, float) for name, x in weights.items()}
    first, second = ({name: np.zeros_like(x) for name, x in w.items()} for _ in range(2))
    best, history = (-1.0, w), []
    for t in range(1, epochs + 1):
        slope, loss, accuracy = _epoch(clips, w)
        history.append((t, loss, accuracy))
        if accuracy > best[0]:
            best = (accuracy, w)
        stepped = {}
        for name, x in w.items():
            first[name] = BETAS[0] * first[name] + (1 - BETAS[0]) * slope[name]
            second[name] = BETAS[1] * second[name] + (1 - BETAS[1]) * slope[name] ** 2
            step = (first[name] / (1 - BETAS[0] ** t)) / (np.sqrt(second[name] / (1 - BETAS[1] ** t)) + EPSILON)
            stepped[name] = x - rate * (step + decay * x)
        w = stepped
    return best[1], history
