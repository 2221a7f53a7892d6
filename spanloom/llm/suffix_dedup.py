"""Repeated byte strings by a logarithmic family of sparse suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, merged_spans, slices, stored, text_key

#: Bytes of a long match, and of the anchor by which its suffix is sampled.
LENGTH, ANCHOR = 400, 64
#: Window starts that are looked at together in a long text, and contexts that a task compares together.
SEGMENT, TOGETHER = 1 << 20, 8_000
#: Batches in which a whole table is added to an empty index.
BATCHES = 4

_M64 = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of all substrings of one length, for one base; powers are kept between texts."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, width: int) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(self.base, 2 * n + 1), _powers(pow(self.base, -1, 1 << 64), 2 * n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n])])
        return _mixed((sums[width:] - sums[:-width]) * self.down[: n - width + 1])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width values: prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


def suffixes(data: bytes, rolling: Rolling, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[int, int, int, int]]:
    """(anchor's hash, its position, first and last start of the windows it stands for), for each sampled suffix.

    Every window of length bytes is stood for by the suffix at its anchor-gram of least hash, the first of equals. That
    depends on the window's bytes alone, so equal windows have equal anchors at equal offsets.
    """
    text, width = np.frombuffer(data, np.uint8), length - anchor + 1
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        hashes = rolling(text[at : at + SEGMENT + length - 1], anchor)
        # The place in the low bits makes the first of equals the least.
        keyed = (hashes & ~np.uint64((1 << 21) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        place = (_sliding_least(keyed, width) & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        own = place[first]
        yield from zip(hashes[own].view(np.int64).tolist(), (own + at).tolist(), (first + at).tolist(), (last + at).tolist(), strict=True)


def suffix_array(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The sampled suffixes of texts (id, rid, text): key (the anchor), ctx (128-bit digest of the bytes of all windows that the
    suffix stands for, and of the anchor's place there), id, rid, starts (of equal contexts in the text), off (anchor's
    place in the context) and width. One row for each different context of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(_BASES[0])
        for batch in slices(batches):
            rows: list[tuple] = []
            for k, text in enumerate(batch.column(2).to_pylist()):
                data = (text or "").encode()
                if len(data) < length:
                    continue
                found: dict[tuple, list[int]] = {}
                for key, at, lo, hi in suffixes(data, rolling, length, anchor):
                    ctx = xxhash.xxh3_128_digest(data[lo : hi + length], at - lo)
                    found.setdefault((key, ctx, at - lo, hi - lo + length), []).append(lo)
                rows += [(k, *key, starts) for key, starts in found.items()]
            if rows:
                of, key, ctx, off, width, starts = zip(*rows, strict=True)
                of = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ctx, pa.binary()), batch.column(0).take(of), batch.column(1).take(of), pa.array(starts, pa.list_(pa.int32())), pa.array(off, pa.int32()), pa.array(width, pa.int32())], names=["key", "ctx", "id", "rid", "starts", "off", "width"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "rid", "text").mapInArrow(run, f"key bigint, ctx binary, id {kind}, rid bigint, starts array<int>, off int, width int")


class IndexFamily:
    """Levels of sparse suffix arrays, each a table in the shared folder in the order of its keys.

    A new batch gets a suffix array of its own and is merge-scanned against every level: an equi-join on the key, which
    both sides' order serves. Then it becomes a level, and while two levels have equal size (in batches) they are merged into one of
    twice the size, so that n batches leave about log2(n) levels and rewrite each suffix as often.
    """

    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR):
        self.length, self.anchor = length, anchor
        self.levels: list[tuple[int, DataFrame]] = []

    @staticmethod
    def _run(rows: DataFrame) -> DataFrame:
        """A sorted run, written. Ranges may end within a key, so a hot key's suffixes fill as many as they need."""
        order = ("key", "ctx", "rid")
        return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order), "suffixes")

    def add(self, docs: DataFrame) -> DataFrame:
        """Add texts (id, rid, text); return the keys (stored) that the batch shares with a level or has more than once."""
        return self.add_suffixes(stored(suffix_array(docs, self.length, self.anchor), "suffixes"))

    def add_suffixes(self, rows: DataFrame) -> DataFrame:
        """The same for a stored suffix array in any order. Keys are combined before they are shuffled."""
        batch = self._run(rows)
        own = batch.groupBy("key").agg(F.sum(F.size("starts")).alias("n"))
        repeated = own.filter("n > 1").select("key")
        met = [own.select("key").join(level.select("key").distinct(), "key", "left_semi") for _, level in self.levels]
        found = stored(reduce(DataFrame.unionAll, met, repeated).distinct(), "met")
        self.levels.append((1, batch))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            self.levels.append((a + b, self._run(x.unionAll(y))))
        return found

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionAll, [level for _, level in self.levels])


def equal_windows(keys: np.ndarray, offs: np.ndarray, parts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each context the starts of its windows, and two hashes of each that tell key, anchor's place and bytes."""
    rollings = [Rolling(b) for b in _BASES]
    for key, off, part in zip(keys, offs, parts, strict=True):
        data = np.frombuffer(part, np.uint8)
        starts = np.arange(len(data) - length + 1)
        place = (np.uint64(off) - starts.astype(np.uint64)) * np.uint64(0xA24BAED4963EE407) + np.uint64(int(key) & _M64)
        yield starts, np.stack([_mixed(r(data, length) + place) for r in rollings], axis=1)


def equal_bytes(hashes: np.ndarray, parts: list[bytes], windows: list[int], length: int) -> np.ndarray:
    """For each window of all parts the number of its class of windows with equal bytes. hashes: two for each; where those are equal, the
    bytes are compared, a run of windows that follow each other in two parts at a time."""
    _, least, which = np.unique(hashes.view([("a", np.uint64), ("b", np.uint64)]).ravel(), return_index=True, return_inverse=True)
    which = which.ravel()
    first, base = least[which], np.cumsum(windows) - windows
    of = np.repeat(np.arange(len(parts)), windows)
    own = np.flatnonzero(first != np.arange(len(first)))
    cut = np.flatnonzero((np.diff(own) > 1) | (np.diff(first[own]) != 1) | (np.diff(of[own]) > 0) | (np.diff(of[first[own]]) > 0)) + 1
    more = {}
    for run in np.split(own, cut) if len(own) else ():
        a, b = (parts[of[x]][x - base[of[x]] : x - base[of[x]] + length + len(run) - 1] for x in (run[0], first[run[0]]))
        if a != b:  # different bytes of equal hashes: classes of their own
            for x in run.tolist():
                data = parts[of[x]][x - base[of[x]] : x - base[of[x]] + length]
                y = first[x]
                if data != parts[of[y]][y - base[of[y]] : y - base[of[y]] + length]:
                    which[x] = more.setdefault((which[x], data), len(least) + len(more))
    return which


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return [(int(x[0]), int(x[-1]) + length) for x in np.split(starts, cut)] if len(starts) else []


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, batches: int = BATCHES, together: int = TOGETHER) -> DataFrame:
    """Spans of bytes that lie in a string of length bytes which also starts elsewhere, in any of the texts.

    docs: id, rid and text; rows with equal id and rid are copies of each other. Rows: id, rid, spans (array of structs s, e; disjoint,
    in order), one for each such text with at least one span.
    """
    family, batch = IndexFamily(length, anchor), F.pmod(F.col("rid"), F.lit(batches))
    sampled = stored(suffix_array(docs, length, anchor), "sampled")
    met = [family.add_suffixes(sampled.filter(batch == k)) for k in range(batches)]
    keys = stored(reduce(DataFrame.unionAll, met).distinct(), "met")
    rows = stored(family.rows().join(keys, "key", "left_semi"), "met-rows")

    # A context found more than once is repeated as a whole; others may share some of their windows with another context of their key.
    spot = F.struct("id", "rid", F.col("starts")[0].alias("lo"))
    contexts = stored(rows.groupBy("key", "ctx", "off", "width").agg(F.sum(F.size("starts")).alias("n"), F.min(spot).alias("spot")), "contexts")
    several = contexts.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    mixed = contexts.join(several, "key").select("key", "ctx", "off", "width", "n", "m", "spot")
    wanted = stored(mixed.groupBy("spot.id", "spot.rid").agg(F.collect_list(F.struct("key", "ctx", "off", "width", "n", "m", F.col("spot.lo").alias("lo"))).alias("wanted")).withColumnsRenamed({"id": "own", "rid": "own_rid"}), "wanted")
    texts = joined(docs, wanted, docs.id.eqNullSafe(wanted.own) & (docs.rid == wanted.own_rid), "inner", 64 + 80 * F.size("wanted")).select("text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                out += [(w["key"], w["ctx"], w["off"], w["n"], w["m"], data[w["lo"] : w["lo"] + w["width"]]) for w in asked]
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "ctx", "off", "n", "m", "part"])

    parts = stored(texts.mapInArrow(cut, "key bigint, ctx binary, off int, n bigint, m bigint, part binary").dropDuplicates(["key", "ctx"]), "parts")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; whole keys are compared, some thousand contexts at a time."""

        def settle(rows: pd.DataFrame) -> pd.DataFrame:
            found = list(equal_windows(rows["key"].to_numpy(), rows["off"].to_numpy(), rows["part"].tolist(), length))
            hashes = np.concatenate([h for _, h in found])
            which = equal_bytes(hashes, rows["part"].tolist(), [len(starts) for starts, _ in found], length)
            hit, at, out = np.bincount(which)[which] > 1, 0, []
            for starts, _ in found:
                out.append(_runs(starts[hit[at : at + len(starts)]], length))
                at += len(starts)
            rows = rows.assign(spans=[[{"s": s, "e": e} for s, e in x] for x in out])
            return rows.loc[[bool(x) and n == 1 for x, n in zip(out, rows["n"], strict=True)], ["key", "ctx", "spans"]]

        held = pd.DataFrame()
        for frame in frames:
            held = pd.concat([held, frame], ignore_index=True)
            while len(held) >= together:
                edges = np.flatnonzero(held["key"].to_numpy()[1:] != held["key"].to_numpy()[:-1]) + 1
                ready = edges[edges <= together]
                if not len(ready):
                    break
                yield settle(held.iloc[: ready[-1]])
                held = held.iloc[ready[-1] :].reset_index(drop=True)
        if len(held):
            yield settle(held)

    span = "spans array<struct<s: int, e: int>>"
    small = parts.filter(F.col("m") <= together).repartition("key").sortWithinPartitions("key").mapInPandas(compare, f"key bigint, ctx binary, {span}")

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 256):
                rows = frame.iloc[i : i + 256]
                for (starts, h), key, ctx, n in zip(equal_windows(rows["key"].to_numpy(), rows["off"].to_numpy(), rows["part"].tolist(), length), rows["key"], rows["ctx"], rows["n"], strict=True):
                    yield pd.DataFrame({"h1": h[:, 0].view(np.int64), "h2": h[:, 1].view(np.int64), "key": key, "ctx": ctx, "n": n, "at": starts})

    # A key with more contexts than a task should hold: its windows are rows, counted by Spark.
    each = parts.filter(F.col("m") > together).mapInPandas(windows, "h1 bigint, h2 bigint, key bigint, ctx binary, n bigint, at bigint")
    shared = each.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
    large = each.filter("n = 1").join(shared, ["h1", "h2"], "left_semi").groupBy("key", "ctx").agg(F.transform(F.collect_list("at"), lambda a: F.struct(a.cast("int").alias("s"), (a + length).cast("int").alias("e"))).alias("spans"))

    whole = contexts.filter("n > 1").select("key", "ctx", F.array(F.struct(F.lit(0).alias("s"), F.col("width").alias("e"))).alias("spans"))
    settled = stored(whole.unionAll(small).unionAll(large), "settled")
    placed = rows.join(settled, ["key", "ctx"]).select("id", "rid", F.explode("starts").alias("lo"), "spans").select("id", "rid", F.transform("spans", lambda x: F.struct((x.s + F.col("lo")).alias("s"), (x.e + F.col("lo")).alias("e"))).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[{"s": s, "e": e} for s, e in merged_spans((x["s"], x["e"]) for x in row)] for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], names=["id", "rid", "spans"])

    kind = docs.schema["id"].dataType.simpleString()
    return placed.groupBy("id", "rid").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(merge, f"id {kind}, rid bigint, {span}")


def drop_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, batches: int = BATCHES, together: int = TOGETHER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text without the bytes that a repeated string of length bytes covers.

    Rows: one per input row with id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the rest's
    bytes) and kept (those bytes: a cut may fall within a character). A byte goes if it lies in a string of length bytes that also starts
    anywhere else, in the same text or another, as the texts came in; matches don't cross texts. Null texts count as
    empty; texts shorter than length stay whole. Rows that repeat are elsewhere to each other, so both lose what they share;
    this holds for rows that repeat both id and text as well. An empty table gives none; other columns aren't looked at.

    The index is a family of sparse suffix arrays (IndexFamily); candidates are settled window by window and their bytes compared; only
    contexts with equal 128-bit digests, and windows of a key with more than `together` contexts (two 64-bit hashes beside the
    anchor's), count as equal by digest. Only contexts that differ under a common key leave their texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = stored(repeated_spans(rows, length, anchor, batches, together), "spans").withColumnsRenamed({"id": "own", "rid": "own_rid"})
    found = joined(rows, spans, rows.id.eqNullSafe(spans.own) & (rows.rid == spans.own_rid), "left", 64 + 32 * F.size("spans")).select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, at, kept = text.encode(), 0, []
                for x in spans or ():
                    kept.append(data[at : x["s"]])
                    at = x["e"]
                rest = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(rest), len(spans or ()), hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return found.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
