"""Encodings that merge by rank, as a max-plus scan: which pieces may follow each other is decided two at a time.

A sequence of pieces is a text's encoding if and only if each two neighbours are what their own joined text is encoded as. So it
is the one path through the lattice of pieces whose links all weigh 0, where other links weigh minus infinity. As with additive scores, a chunk of a text
yields a matrix from the states at its start to those at its end (here 0 or minus infinity, so only the zeros are kept),
matrices combine associatively, and every chunk is traced back by itself once the states at all cuts are known.

A state at a cut is the piece that ends there or lies over it: by how many characters it begins before, and ends beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

#: States and pairs of states as numbers.
AHEAD, PAIR = 1 << 10, 1 << 20
#: Entries that a task's memory of neighbours may hold before it starts afresh.
CACHE_PAIRS = 400_000


class Merges:
    """Pieces with scores; of neighbours that join to a piece those of the best score join first, the leftmost of equals."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.known: dict[tuple[str, str], bool] = {}

    @cached_property
    def prefixes(self) -> set[str]:
        return {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text. Characters without a piece stay by themselves."""
        parts = list(text)
        while True:
            best, at = max(((self.pieces[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.pieces), default=(0.0, 1))
            if at > 0:
                return parts
            parts[-at : 2 - at] = ["".join(parts[-at : 2 - at])]

    def follow(self, a: str, b: str) -> bool:
        """Whether b may come after a; with a empty, whether b is a piece that merging gives at all."""
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= CACHE_PAIRS:
                self.known.clear()
            found = self.known[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def ends(self, text: str, i: int) -> Iterator[int]:
        """Where the pieces that begin at i end; a character without a piece is one of its own."""
        yield i + 1
        for j in range(i + 2, min(i + self.longest, len(text)) + 1):
            part = text[i:j]
            if part in self.pieces:
                yield j
            elif part not in self.prefixes:
                break

    def over(self, text: str, cut: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that end at the cut or lie over it."""
        return [(i, j) for i in range(max(0, cut - self.longest), cut) for j in self.ends(text, i) if j >= cut and self.follow("", text[i:j])]

    def walk(self, text: str, start: tuple[int, int], stop: int, other: dict[int, int] | None = None) -> tuple[dict[int, int], int | None]:
        """By place the start of the piece that ends there, for all places up to a piece over `stop` that pieces after `start` reach: each
        is reached in one way. With other, an earlier walk, also the place from which both go on alike, where this one ends."""
        back, pending = {start[1]: start[0]}, {start[1]}
        while pending and (i := min(pending)) < stop:
            pending.discard(i)
            before = text[back[i] : i]
            for j in self.ends(text, i):
                if self.follow(before, text[i:j]):
                    back[j] = i
                    pending.add(j)
            if other is not None and pending and all(other.get(j) == back[j] for j in pending) and all(other.get(j, j) > i or j in pending for j in range(i + 1, i + self.longest + 1)):
                return back, i
        return back, None

    def matrix(self, text: str, start: int, stop: int) -> np.ndarray:
        """Pairs (state at start, state at stop) that a path joins, as numbers. text goes on for a piece's length on both sides
        unless it begins or ends there; the whole text's ends have the one state 0."""
        out: list[int] = []
        ref: dict[int, int] | None = None
        reached: list[int] = []
        for s, e in self.over(text, start) if start else [(0, 0)]:
            back, met = self.walk(text, (s, e), stop, ref)
            if e >= stop:  # a piece over the whole chunk
                ends = [self.state(s, e, stop, len(text))]
            elif met is None:
                ends = [self.state(i, j, stop, len(text)) for j, i in back.items() if e <= i < stop <= j]
                if ref is None and ends:
                    ref, reached = back, ends
            else:
                ends = reached
            own = self.state(s, e, start, -1) if start else 0
            out += [own * PAIR + x for x in ends]
        return np.array(sorted(out), np.int64)

    @staticmethod
    def state(i: int, j: int, cut: int, end: int) -> int:
        return 0 if j == cut == end else (cut - i) * AHEAD + j - cut

    def trace(self, text: str, start: int, stop: int, s: int, e: int) -> list[str]:
        """The pieces of a chunk from state s to state e: those that begin in it."""
        first = (start - s // AHEAD, start + s % AHEAD) if s else (0, 0)
        back, _ = self.walk(text, first, stop)
        i, j = (back[stop], stop) if e == 0 else (stop - e // AHEAD, stop + e % AHEAD)
        out = []
        while j > first[1]:
            out.append(text[i:j])
            j, i = i, back.get(i, -1)
        return out[::-1]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Max-plus product, in order, of matrices of 0 and minus infinity."""
    found = np.asarray(matrices[0], np.int64)
    for m in matrices[1:]:
        after: dict[int, list[int]] = {}
        for x in np.asarray(m).tolist():
            after.setdefault(x // PAIR, []).append(x % PAIR)
        found = np.unique(np.array([x // PAIR * PAIR + y for x in found.tolist() for y in after.get(x % PAIR, ())], np.int64))
    return found


def between(matrices: list[np.ndarray], start: int, end: int) -> list[int]:
    """States at all cuts, the first and last included, of the one path through the matrices."""
    forward = [{start: start}]
    for m in matrices:
        forward.append({x % PAIR: x // PAIR for x in np.asarray(m).tolist() if x // PAIR in forward[-1]})
    if end not in forward[-1]:
        raise ValueError("no encoding leads through these chunks")
    out = [end]
    for reached in forward[:0:-1]:
        out.append(reached[out[-1]])
    return out[::-1]
