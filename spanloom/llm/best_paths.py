"""Best segmentations under a vocabulary with additive scores (a unigram model), by a max-plus parallel scan.

For models whose encoding is the best-scoring path. A giant text is cut into chunks at any place; each chunk yields a
matrix of best scores from each state at its start to each at its end, matrices combine associatively, and once the
states at all cuts are known every chunk is traced back by itself.

A state at a cut is the number of characters by which the piece that lies over it reaches beyond, 0 if a piece ends there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored

#: Characters in a chunk, and chunks whose matrices are combined in one task.
CHUNK, BLOCK = 2048, 64
#: By how much an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0

NEVER = -np.inf


class Lattice:
    """Pieces that begin at each place of a text. pieces: (id, score) by string."""

    def __init__(self, pieces: dict[str, tuple[int, float]], unknown: int):
        self.pieces, self.unknown = pieces, unknown
        self.longest = max(map(len, pieces), default=1)
        self.penalty = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY

    def at(self, text: str, i: int) -> Iterator[tuple[int, int, float]]:
        """(length, id, score) of the pieces that begin at i; an unknown character is a piece of its own."""
        single = False
        for n in range(1, min(self.longest, len(text) - i) + 1):
            found = self.pieces.get(text[i : i + n])
            if found:
                single |= n == 1
                yield n, *found
        if not single:
            yield 1, self.unknown, self.penalty

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Best scores [state in, state out] of a chunk: the first size characters of text, after which text goes on for a piece's length."""
        best = np.full((size + self.longest, self.longest), NEVER)
        for s in range(self.longest):
            best[s, s] = 0.0
        for i in range(size):
            if best[i].max() > NEVER:
                for n, _, score in self.at(text, i):
                    np.maximum(best[i + n], best[i] + score, out=best[i + n])
        return best[size : size + self.longest].T.copy()

    def trace(self, text: str, size: int, start: int, end: int) -> list[int]:
        """Ids of the best path through a chunk from state start to state end."""
        best, back = np.full(size + self.longest, NEVER), [(-1, 0)] * (size + self.longest)
        best[start] = 0.0
        for i in range(start, size):
            if best[i] > NEVER:
                for n, piece, score in self.at(text, i):
                    if best[i] + score > best[i + n]:
                        best[i + n], back[i + n] = best[i] + score, (i, piece)
        out, at = [], size + end
        while at > start:
            at, piece = back[at]
            out.append(piece)
        return out[::-1]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states(matrices: list[np.ndarray], start: int, end: int) -> list[int]:
    """States at all cuts, the first and last included, of the best path through the matrices."""
    forward = [np.where(np.arange(len(matrices[0])) == start, 0.0, NEVER)]
    for m in matrices:
        forward.append((forward[-1][:, None] + m).max(axis=0))
    out = [end]
    for v, m in zip(forward[-2::-1], matrices[::-1], strict=True):
        out.append(int((v + m[:, out[-1]]).argmax()))
    return out[::-1]


def cut_states(matrices: DataFrame, product: Callable[[list], np.ndarray], between: Callable[[list, int, int], list[int]]) -> DataFrame:
    """key, at, s and e: the states before and after each chunk on the best path, from state 0 to state 0, of each key's text.

    matrices: key, block, at and m, a chunk's transfer matrix as an array; product multiplies matrices in order, between gives the states at all cuts of some,
    the outer ones included. Blocks are multiplied apart from each other; then each text's products give the states
    between its blocks, and from there each block is settled by itself.
    """
    kind = matrices.schema["m"].dataType.simpleString()

    def combine(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": f["key"].iloc[:1], "block": f["block"].iloc[:1], "m": [product(list(f.sort_values("at")["m"]))]})

    def outer(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        found = between(list(f["m"]), 0, 0)
        return pd.DataFrame({"key": f["key"], "block": f["block"], "s": found[:-1], "e": found[1:]})

    def inner(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("at")
        found = between(list(f["m"]), int(f["s"].iloc[0]), int(f["e"].iloc[0]))
        return pd.DataFrame({"key": f["key"], "at": f["at"], "s": found[:-1], "e": found[1:]})

    products = matrices.groupBy("key", "block").applyInPandas(combine, f"key bigint, block bigint, m {kind}")
    blocks = products.groupBy("key").applyInPandas(outer, "key bigint, block bigint, s int, e int")
    return matrices.join(blocks, ["key", "block"]).groupBy("key", "block").applyInPandas(inner, "key bigint, at bigint, s int, e int")


def best_paths(docs: DataFrame, pieces: dict[str, tuple[int, float]], unknown: int = 0, chunk: int = CHUNK, block: int = BLOCK, text_col: str = "text") -> DataFrame:
    """The best-scoring segmentation of every text as it stands (put in marks for spaces before).

    Rows: one per input row, all its columns in the struct `row`, then ids (array of int). A null or empty text has no ids;
    characters that no piece covers get the id `unknown`, each. Of paths with equal scores one is given, always the same.
    Repeated rows repeat; an empty table gives none; docs' columns may have any names. The vocabulary goes to every task.
    """
    lattice = Lattice(pieces, unknown)
    shipped, width = docs.sparkSession.sparkContext.broadcast(lattice), lattice.longest
    rows = stored(docs.select(F.struct("*").alias("row")).withColumn("key", F.monotonically_increasing_id()), "texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(k, text[i : i + chunk + width], min(chunk, len(text) - i)) for k, i in enumerate(range(0, len(text or ""), chunk))]
                at, parts, sizes = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(at, pa.int64()), pa.array(parts, pa.string()), pa.array(sizes, pa.int32())], names=["key", "at", "part", "size"])

    parts = rows.select("key", F.col(f"row.{text_col}").cast("string").alias("text")).mapInArrow(cut, "key bigint, at bigint, part string, size int")
    parts = stored(parts.repartition("key", "at"), "parts")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "block": f["at"] // block, "at": f["at"], "m": [shipped.value.matrix(p, n).ravel() for p, n in zip(f["part"], f["size"], strict=True)]})

    matrices = stored(parts.mapInPandas(measure, "key bigint, block bigint, at bigint, m array<double>"), "matrices")
    square = lambda column: [np.array(m).reshape(width, width) for m in column]
    inner = cut_states(matrices, lambda ms: reduce(times, square(ms)).ravel(), lambda ms, start, end: states(square(ms), start, end))

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "at": f["at"], "ids": [shipped.value.trace(p, n, s, e) for p, n, s, e in zip(f["part"], f["size"], f["s"], f["e"], strict=True)]})

    traced = parts.join(inner, ["key", "at"]).mapInPandas(trace, "key bigint, at bigint, ids array<int>")
    together = traced.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    none = F.array().cast(T.ArrayType(T.IntegerType()))
    return rows.join(together, "key", "left").select("row", F.coalesce(F.flatten("parts.ids"), none).alias("ids"))
