"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Fixed by the method: n-gram lengths and hash buckets. CHUNK bounds the characters that are held as n-grams at a time.
LENGTHS, BUCKETS, CHUNK = (1, 2, 3), 1 << 15, 1 << 17


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, index of the text) of every n-gram of the lower-cased texts, some at a time; none crosses two texts."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        text = " " + " ".join(text.lower().split()) + " "
        for at in range(0, len(text), CHUNK):  # a long text's pieces overlap by two characters
            piece = text[max(0, at - 2) : at + CHUNK]
            held.append((piece, k, min(at, 2)))
            size += len(piece)
            if size >= CHUNK:
                yield _hashed(held)
                held, size = [], 0
    if held:
        yield _hashed(held)


def _hashed(held: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces (text, its index, characters that an earlier piece has counted)."""
    chars = np.frombuffer("".join(p for p, _, _ in held).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(p) for p, _, _ in held])
    of = np.repeat(np.arange(len(held)), lengths)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    index, seen = np.array([k for _, k, _ in held])[of], np.array([s for _, _, s in held])[of]
    buckets, texts, value = [], [], np.zeros(len(chars), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        value = value * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([chars[n - 1 :], np.zeros(n - 1, np.uint64)]) + np.uint64(n)
        if n in LENGTHS:
            last = place + (n - 1)
            ok = (last < lengths[of]) & (last >= seen)
            mixed = value[ok] * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((mixed >> np.uint64(49)).astype(np.int64))
            texts.append(index[ok])
    return np.concatenate(buckets), np.concatenate(texts)


def train(docs: DataFrame, label_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(labels in order, log-probabilities [bucket, label], log-priors) learned from all rows with a label.

    n-gram counts are combined in each map task and summed by Spark; the model has BUCKETS x labels entries, whatever
    the corpus. Labels are languages: few. Null texts count as empty. With no labelled row there are no labels.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for label in set(labels):
                own = [t or "" for t, x in zip(texts, labels, strict=True) if x == label]
                total = sums.setdefault(label, np.zeros(BUCKETS + 1, np.int64))
                total[BUCKETS] += len(own)  # documents, for the priors
                for buckets, _ in _grams(own):
                    total[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
        for label, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["label", "bucket", "n"])

    rows = docs.filter(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string"), F.col(text_col).cast("string"))
    found = rows.mapInArrow(count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(found["label"].unique())
    counts = np.zeros((BUCKETS + 1, len(labels)))
    counts[found["bucket"].to_numpy(int), np.searchsorted(labels, found["label"].to_numpy(str)) if labels else []] = found["n"].to_numpy(float)
    seen, priors = counts[:BUCKETS] + 1.0, counts[BUCKETS]
    return labels, np.log(seen / seen.sum(axis=0)) if labels else seen, np.log(priors / priors.sum()) if labels else priors


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of id_col, lang_pred and score, one for each input row.

    lang_pred is the likeliest label and score its posterior probability; `und` and 0 if the text is null, has no
    letter, or the model has no label. Of equal posteriors the first label in order wins. Whole texts are scored, of
    any length; only the text decides. The log-probability matrix is broadcast. Map-only.
    """
    labels = model[0]
    shipped = docs.sparkSession.sparkContext.broadcast((model[1].astype(np.float64), model[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, priors = shipped.value
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            has = np.array([bool(labels) and t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            at, totals = np.flatnonzero(has), np.zeros((len(texts), len(labels)))
            for buckets, index in _grams([texts[k] for k in at]):
                for k in range(len(labels)):
                    totals[:, k] += np.bincount(at[index], table[:, k][buckets], len(texts))
            names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if len(at):
                total = totals[at] + priors
                best = total.argmax(axis=1)
                names[at] = np.array(labels, object)[best]
                score[at] = 1 / np.exp(total - total.max(axis=1)[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
