"""Periodic runs of words: a harmonic grid of periods and positions, extended by prefix hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, slices

#: A run has at least this many words, and at least this many periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Prefix hashes are polynomials in BASES modulo these primes (below 2**31, so that products fit 64 bits).
PRIMES, BASES = (2**31 - 1, 2**31 - 19), (1_000_003, 998_244_353)
#: Grids of texts up to this many words are kept by a task; those of longer texts are made a piece at a time, of so many pairs at most.
KEPT_GRID, PIECE = 1 << 15, 1 << 21

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _grid(first: int, last: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All (period, position) with first <= period < last, position a multiple of the period and position + 2 * period < n."""
    periods = np.arange(first, last, dtype=np.int64)
    counts = np.maximum((n - 1) // periods - 1, 0)
    q = np.repeat(periods, counts)
    k = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
    return q, q * k


@lru_cache(maxsize=2)
def _kept_grid(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid of `size` words by where its triples end, so that a shorter text's grid is a prefix; and the prefix's length for each n."""
    q, j = _grid(1, size // 3 + 1, size)
    order = np.argsort(j + 2 * q, kind="stable")
    q, j = q[order], j[order]
    return q, j, np.searchsorted(j + 2 * q, np.arange(size + 1))


def _triples(w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points (period, position) whose word stands there and one and two periods on, in pieces of bounded size. A run of three periods
    or more holds three neighbouring multiples of its period, so it has such a point; other points can't lie so in a run."""
    n, q = len(w), 1
    while q <= n // 3:
        if n <= KEPT_GRID:
            periods, j, upto = _kept_grid(max(1024, 1 << (n - 1).bit_length()))
            periods, j, q = periods[: upto[n]], j[: upto[n]], n
        else:
            # A period q has about n / q points.
            until = min(n // 3 + 1, q + max(1, PIECE * q // n))
            (periods, j), q = _grid(q, until, n), until
        at = np.flatnonzero(w[j] == w[j + periods])
        at = at[w[j[at]] == w[j[at] + 2 * periods[at]]]
        if len(at):
            yield periods[at], j[at]


@lru_cache(maxsize=4)
def _powers(prime: int, base: int, size: int) -> np.ndarray:
    """base**0 .. base**(size - 1), by doubling."""
    out = np.ones(size, np.int64)
    have = 1
    while have < size:
        step = pow(base, have, prime)
        more = min(have, size - have)
        out[have : have + more] = out[:more] * step % prime
        have += more
    return out


class _Prefixes:
    """Hashes of all prefixes of w. Equal stretches always compare equal; unequal ones seldom do, and callers check."""

    def __init__(self, w: np.ndarray):
        size = 1 << max(10, len(w).bit_length())
        self.powers = [_powers(p, b, size) for p, b in zip(PRIMES, BASES, strict=True)]
        self.sums = [np.concatenate([[0], np.cumsum((w.astype(np.int64) + 1) * pw[: len(w)] % p) % p]) for p, pw in zip(PRIMES, self.powers, strict=True)]

    def equal(self, a: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of `length` words at a and at a + q look equal."""
        out = np.ones(len(a), bool)
        for p, pw, h in zip(PRIMES, self.powers, self.sums, strict=True):
            near, far = (h[a + length] - h[a]) % p, (h[a + q + length] - h[a + q]) % p
            out &= near * pw[q] % p == far
        return out

    def longest(self, most: np.ndarray, equal_at) -> np.ndarray:
        """For each pair the largest length up to `most` that looks equal; all pairs are halved together."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = equal_at(mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low


def _exact(w: np.ndarray, q: int, j: int) -> tuple[int, int]:
    """The stretch of period q about j, word by word: for the case that hashes of unequal stretches were equal."""
    differ = np.flatnonzero(w[:-q] != w[q:])
    k = np.searchsorted(differ, j)
    begin = int(differ[k - 1]) + 1 if k else 0
    end = int(differ[k]) + q if k < len(differ) else len(w)
    return begin, end - begin


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of a sequence of word numbers, by start and period.

    Every grid point of every period that can lie in a run is extended to both sides by binary search over prefix hashes, all at
    once; the stretches are then checked word by word, so that hashes decide nothing. A stretch found under multiples of its
    period counts under the smallest.
    """
    if len(w) < MIN_WORDS:
        return []
    hashed, found = None, {}
    for q, j in _triples(w):
        hashed = hashed or _Prefixes(w)
        ahead = hashed.longest(len(w) - j - q, lambda n: hashed.equal(j, q, n))  # noqa: B023  called at once
        behind = hashed.longest(j, lambda n: hashed.equal(j - n, q, n))  # noqa: B023
        start, length = j - behind, q + ahead + behind
        enough = length >= np.maximum(MIN_WORDS, MIN_PERIODS * q)
        rows = np.stack([start, length, q, j])[:, enough]
        _, first = np.unique(rows[:3], axis=1, return_index=True)
        for s, n, p, at in rows[:, first].T.tolist():
            if not np.array_equal(w[s : s + n - p], w[s + p : s + n]):
                s, n = _exact(w, p, at)
                if n < max(MIN_WORDS, MIN_PERIODS * p):
                    continue
            found[s, n] = min(p, found.get((s, n), p))
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def _collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    edges = np.zeros(n + 1, np.int64)
    for s, length, p in runs:
        edges[s + p] += 1
        edges[s + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of each text, flat, and where each text's begin (one offset more than texts). Nulls have none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = parts.flatten(), np.asarray(parts.offsets) - parts.offsets[0].as_py()
    real = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate([[0], np.cumsum(real)])
    return before[offsets], flat.filter(pa.array(real))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of words that repeat with a period, and each text with its runs cut down to one period.

    Rows: one per input row with id_col, n_words, runs (array of structs start, length, period in words, by start and period),
    strongest (the run with the largest length / period; of equals the first, then the one of smaller period; null without
    runs) and collapsed (the words kept, joined by single spaces). A run is a stretch with smallest period p of at least MIN_WORDS
    words and MIN_PERIODS periods that no neighbouring word extends; a word goes if it lies behind the first period of any run.
    A null text counts as empty: no words, no runs, collapsed empty. Repeated rows repeat, an empty table gives none, other columns are not
    looked at. Whole texts are read: one of n words takes about n log n grid points, in pieces of bounded size, so memory grows with
    the text alone. Map-only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            offsets, words = words_of(batch.column(1))
            numbers = np.asarray(words.dictionary_encode().indices) if len(words) else np.zeros(0, np.int32)
            runs = [runs_of(numbers[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            stay = np.concatenate([np.zeros(0, bool), *(_collapsed(b - a, r) for a, b, r in zip(offsets[:-1], offsets[1:], runs, strict=True))])
            left = np.concatenate([[0], np.cumsum(stay)])[offsets].astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(left), words.filter(pa.array(stay)))
            named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
            best = [max(rs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None) for rs in named]
            out = [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(named, pa.list_(RUN)), pa.array(best, RUN), pc.binary_join(kept, " ")]
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_words", "runs", "strongest", "collapsed"])

    kind, run_type = docs.schema[id_col].dataType.simpleString(), "struct<start:bigint,length:bigint,period:bigint>"
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, runs array<{run_type}>, strongest {run_type}, collapsed string")


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text, a tenth of the texts (by a hash of the id) made to repeat: from a word a on, the p words there come again and
    again to the end. A null id changes nothing; null texts stay null."""
    text = F.col(text_col).cast("string")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.expr("h div 10")

    def repeated(words: Column) -> Column:
        a, n = F.col("g") % F.size(words), F.size(words)
        p = F.floor((n - a) / (F.lit(3) + F.col("g") % 8)).cast("bigint") + 1
        return F.array_join(F.transform(words, lambda w, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(w)), " ")

    words = F.array_remove(F.split(text, SPACE), "")
    rows = docs.select(F.col(id_col), text.alias("text"), h.alias("h")).withColumn("g", g)
    return rows.select(id_col, F.when((F.col("h") % 10 == 0) & (F.size(words) > 0), F.transform(F.array(words), repeated)[0]).otherwise(F.col("text")).alias("text"))
