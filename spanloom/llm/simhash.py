"""SimHash near-duplicates by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined, new_path, scope, slices, staying, stored, text_key, written
from .components import connected_components

#: Blocks that fingerprints are dealt to, so that each goes to at most so many tasks; and most fingerprints in a block, beyond which there
#: are more blocks. A task compares two blocks, tile by tile.
BLOCKS, MOST, TILE = 32, 1 << 20, 512
#: Pairs of positions that a task holds before it works them in, and of which it compares the sketches at a time; results don't depend on them.
HELD, COMPARED = 1 << 17, 1 << 12
#: The same for blocks with codes, slots of a sketch, and names of the columns of its code. A fingerprint goes to as many tasks as there are blocks, so what it takes
#: along there is a code, an eighth of its sketch, and blocks are as large as a task holds.
CODE_BLOCKS, MOST_CODES, SLOTS = 8, 1 << 18, 256
CODE = [f"code{k}" for k in range(SLOTS // 32)]
#: Sketches may show a similarity lower by so much than asked for (four standard deviations at 0.8) and are compared exactly then;
#: nodes and bytes of shingles in a part of a group to compare, beyond which there are more parts.
SLACK, MOST_NODES, MOST_BYTES = 0.1, 512, 32 << 20
#: Orders by which large groups are sorted to find close copies.
ORDERS = 3


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's word shingles, repeats included; none for a wordless text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(joined, 42)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1))
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], "<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash, as a signed integer: a bit is set if it is in over half the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<i8")[0])


def sketch(hashes: np.ndarray) -> bytes:
    """One-permutation MinHash: of the hashes that fall in each of SLOTS the least, cut to 16 bits from 1 up; 0 if there's none."""
    order = np.unique(hashes)
    slot = (order % np.uint64(SLOTS)).astype(np.int64)
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, slot, order)
    value = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
    return np.where(least == np.iinfo(np.uint64).max, 0, value).astype("<u2").tobytes()


def codes(sketches: np.ndarray) -> np.ndarray:
    """Rows of sketches with each slot cut to two bits (1 to 3; 0 if empty), as 64-bit numbers: first the slots' higher bits, then the lower ones."""
    cut = np.where(sketches == 0, 0, sketches % 3 + 1).astype(np.uint8)
    return np.packbits(np.concatenate([cut >> 1, cut & 1], axis=1), axis=1).view("<i8")


def shingle_set(hashes: np.ndarray) -> bytes:
    """The different hashes in order."""
    return np.unique(hashes).astype("<u8").tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets, as sorted arrays; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def similar(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether rows i of a and j of b, matrices of sketches, show a Jaccard similarity of at least `least`; texts without words are alike."""
    out = np.empty(len(i), bool)
    for k in range(0, len(i), COMPARED):
        x, y = a[i[k : k + COMPARED]], b[j[k : k + COMPARED]]
        used = ((x != 0) | (y != 0)).sum(axis=1)
        out[k : k + COMPARED] = ((x == y) & (x != 0)).sum(axis=1) >= least * used
    return out


def may_be_similar(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """The same of matrices of codes: true of all pairs of which `similar` is, as equal slots have equal codes, and of few others."""
    out, half = np.empty(len(i), bool), a.shape[1] // 2
    for k in range(0, len(i), COMPARED):
        x, y = a[i[k : k + COMPARED]], b[j[k : k + COMPARED]]
        own, other = x[:, :half] | x[:, half:], x ^ y
        used = np.bitwise_count(own | y[:, :half] | y[:, half:]).sum(axis=1, dtype=np.int64)
        equal = np.bitwise_count(own & ~(other[:, :half] | other[:, half:])).sum(axis=1, dtype=np.int64)
        out[k : k + COMPARED] = equal >= least * used
    return out


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", sketches: bool = False) -> DataFrame:
    """Rows of id_col, fp (bigint) and, if asked for, the columns of the sketch's code and digest (of the set of shingles), one for each input row; null and wordless texts have fingerprint 0. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps, minima, digests = [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), width)
                fps.append(fingerprint(hashes) if len(hashes) else 0)
                if sketches:
                    minima.append(sketch(hashes))
                    digests.append(xxhash.xxh64_intdigest(shingle_set(hashes)))
            more = [*codes(np.frombuffer(b"".join(minima), "<u2").reshape(-1, SLOTS)).T, np.array(digests, np.uint64).view(np.int64)] if sketches else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *map(pa.array, more)], names=[id_col, "fp", *extra])

    extra = [*CODE, "digest"] if sketches else []
    schema = T.StructType([docs.schema[id_col], *(T.StructField(name, T.LongType()) for name in ["fp", *extra])])
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _quarters(fps: np.ndarray) -> np.ndarray:
    """Bits set in each 16-bit quarter of the fingerprints; their differences sum to the distance at most."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _tiles(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, smallest, largest quarter counts) of each tile, in order of the counts."""
    q = _quarters(fps)
    order = np.lexsort(q.T[::-1])
    return [(x, q[x].min(axis=0), q[x].max(axis=0)) for x in (order[i : i + TILE] for i in range(0, len(order), TILE))]


def links(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in a and in b of all fingerprints at most radius apart, about HELD pairs at a time. Tiles are skipped whose bit
    counts differ by more."""
    left, right = _tiles(a), _tiles(b)
    lo, hi = (np.array([t[k] for t in right], np.int16).reshape(-1, 4) for k in (1, 2))
    held, size = [], 0
    for x, low, high in left:
        apart = np.maximum(0, np.maximum(lo - high, low - hi)).sum(axis=1)
        for k in np.flatnonzero(apart <= radius):
            y = right[k][0]
            i, j = np.nonzero(np.bitwise_count(a[x][:, None] ^ b[y][None, :]) <= radius)
            if len(i):
                held.append((x[i], y[j]))
                size += len(i)
            if size >= HELD:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the links that isn't its component's root: no more rows than nodes."""
    nodes, ids = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j, root = ids[: len(u)], ids[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _folded(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """A forest of all the pairs (u, v), worked in as they come: a group of near copies never has all its pairs in memory."""
    u = v = np.empty(0, np.int64)
    for x, y in pairs:
        u, v = _forest(np.concatenate([u, x]), np.concatenate([v, y]))
    return pd.DataFrame({"u": u, "v": v})


def _pairs_of_blocks(rows: DataFrame, radius: int, most: int, blocks: int) -> DataFrame:
    """rows (with fp) once for each pair of blocks to compare: adds pair and side.

    Blocks hold fingerprints with like counts of bits in their quarters, by the exact histogram of those counts (17**4 keys at most,
    whatever the corpus). Pairs whose counts prove all fingerprints over radius apart are left out.
    """
    spark, names = rows.sparkSession, [f"q{k}" for k in range(4)]
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int").alias(f"q{k}") for k in range(4)]
    counts = rows.select(*quarter).groupBy(*names).count().orderBy(*names).collect()
    size = min(most, max(TILE, -(-sum(r["count"] for r in counts) // blocks)))
    keys, boxes, room = [], [], 0
    for r in counts:
        q = [r[n] for n in names]
        parts = -(-r["count"] // size)
        if r["count"] > room or parts > 1:
            boxes += [[q, q] for _ in range(parts)]
            room = size if parts == 1 else 0
        else:
            boxes[-1] = [[*map(min, boxes[-1][0], q)], [*map(max, boxes[-1][1], q)]]
        room -= r["count"]
        keys.append((*q, len(boxes) - parts, parts))
    of_key = spark.createDataFrame(keys, ", ".join(f"{n} int" for n in names) + ", block int, parts int")
    # A box a block, so few thousands at hundreds of terabytes; which of them can be near is a join of their bounds.
    bounds = [f"{end}{k}" for end in ("low", "high") for k in range(4)]
    box = spark.createDataFrame([(k, *low, *high) for k, (low, high) in enumerate(boxes)], ", ".join(f"{n} int" for n in ["block", *bounds]))
    apart = lambda k: F.greatest(F.lit(0), F.col(f"b.low{k}") - F.col(f"a.high{k}"), F.col(f"a.low{k}") - F.col(f"b.high{k}"))
    near = (F.col("a.block") <= F.col("b.block")) & (apart(0) + apart(1) + apart(2) + apart(3) <= radius)
    both = F.array(*(F.struct(F.col(f"{x}.block").alias("block"), F.lit(side).alias("side")) for side, x in enumerate("ab")))
    pairs = box.alias("a").join(box.alias("b"), near).select((F.col("a.block").cast("bigint") * len(boxes) + F.col("b.block")).alias("pair"), F.inline(both))
    dealt = rows.withColumns({n: q for n, q in zip(names, quarter, strict=True)}).join(F.broadcast(of_key), names)
    dealt = dealt.withColumn("block", F.col("block") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return joined(dealt, stored(pairs, "pairs"), ["block"], "inner", 24).select(*rows.columns, "pair", "side")


def _near(part: pd.DataFrame, radius: int, least: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different nodes of a pair of blocks within radius, and of a similarity that may be `least` by their codes if that is given."""
    a, b = part[part["side"] == 0], part[part["side"] == 1]
    left, right = a["node"].to_numpy(), b["node"].to_numpy()
    cut = [] if least is None else [np.ascontiguousarray(p[CODE].to_numpy()).view(np.uint64) for p in (a, b)]
    for i, j in links(a["fp"].to_numpy().view(np.uint64), b["fp"].to_numpy().view(np.uint64), radius):
        ok = left[i] != right[j]
        i, j = i[ok], j[ok]
        if cut:
            ok = may_be_similar(*cut, i, j, least)
            i, j = i[ok], j[ok]
        yield left[i], right[j]


def near_links(rows: DataFrame, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """Links (u, v) between nodes, enough of them to join all whose fingerprints are within radius of each other and, if a
    similarity is asked for, whose sketches show it (and a few more, whose codes do).

    rows: a stored table of node (bigint, without repeats), fp, and the columns CODE if similarity is given. Every pair of fingerprints is compared, or
    skipped because bit counts prove it too far apart. Pairs of blocks go to tasks of bounded size, and each returns a spanning
    forest of what it finds, not all pairs. The work is quadratic in the number of nodes.
    """

    def forest(part: pd.DataFrame) -> pd.DataFrame:
        return _folded(_near(part, radius, similarity))

    size = (MOST, BLOCKS) if similarity is None else (MOST_CODES, CODE_BLOCKS)
    return _pairs_of_blocks(rows.select("node", "fp", *CODE * (similarity is not None)), radius, *size).groupBy("pair").applyInPandas(forest, "u bigint, v bigint")


def _verified(part: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links (u, v) between nodes of one or two parts of a candidate group whose sets of shingles have the similarity; pairs that are linked
    already, by others here or because they are of one `known` component, aren't compared."""
    a, b = part[part["side"] == 0].drop_duplicates("node"), part[part["side"] == 1].drop_duplicates("node")
    own = not len(b)
    b = a if own else b
    left, right = a["node"].tolist(), b["node"].tolist()
    sets = [[np.frombuffer(x, "<u8") for x in p["shingles"]] for p in (a, b)]
    sketches = [np.frombuffer(b"".join(p["sketch"]), "<u2").reshape(-1, SLOTS) for p in (a, b)]
    root, out = {}, []
    for p in (a, b):
        for node, known in zip(p["node"].tolist(), p["known"].tolist(), strict=True):
            root[node] = root[known] = known

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(left)):
        j = np.arange(i + 1 if own else 0, len(right))
        for k in j[similar(sketches[0], sketches[1], np.full(len(j), i), j, similarity - SLACK)].tolist():
            u, v = find(left[i]), find(right[k])
            if u != v and jaccard(sets[0][i], sets[1][k]) >= similarity:
                root[u] = v
                out.append((left[i], right[k]))
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


_SET = "node bigint, root bigint, sketch binary, shingles binary"


def _adjacent(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of the similarity between nodes of a group that come next to each other when they are sorted by the least two values in
    parts of their sketches. Of close copies most share those, so a group of them comes out in few components; what is missed here is left to others.

    rows: node, root, sketch, shingles. One shuffle by ranges, of ORDERS copies a node; a group of any size spreads over the ranges.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            slots = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, SLOTS).astype(np.int64)
            # Slot and value of the least of each part, as one number; empty slots come last.
            least = [np.where(x == 0, SLOTS << 16, x * SLOTS + np.arange(x.shape[1])).min(axis=1) for x in np.array_split(slots, 2 * ORDERS, axis=1)]
            for k in range(ORDERS):
                place = (least[2 * k] << 32) | least[2 * k + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), k, np.int32)), pa.array(place), *batch.columns], names=["order", "place", *batch.schema.names])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in slices(batches, 200):
            found = []
            for order, root, node, shingles in zip(*(batch.column(k).to_pylist() for k in (0, 3, 2, 5)), strict=True):
                own = np.frombuffer(shingles, "<u8")
                if before and before[:2] == (order, root) and before[2] != node and jaccard(before[3], own) >= similarity:
                    found.append((before[2], node))
                before = (order, root, node, own)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    placed = rows.select("node", "root", "sketch", "shingles").mapInArrow(keyed, f"order int, place bigint, {_SET}")
    order = ["order", "root", "place", "node"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compared, "u bigint, v bigint")


def _dealt(sets: DataFrame, similarity: float) -> DataFrame:
    """sets (node, root, known, sketch, shingles) once for each pair of parts that a task has to compare: adds pair and side.

    Sets of the similarity can't differ more in size, so a group is parted by size first, in steps of that ratio, then at random to bounded parts; every two parts of one step
    and of neighbouring steps make a pair.
    """
    step = F.floor(F.log(F.greatest(F.length("shingles"), F.lit(8)) / 8.0) / F.lit(-np.log(similarity).item())).cast("int")
    rows = sets.withColumn("step", step)
    most = F.greatest(F.count("*") / MOST_NODES, F.sum(F.length("shingles")) / MOST_BYTES)
    sizes = stored(rows.groupBy("root", "step").agg(F.ceil(most).cast("int").alias("parts")), "parts")
    near = lambda shift, to: sizes.select("root", (F.col("step") + shift).alias("step"), F.col("parts").alias(to))
    around = stored(sizes.join(near(-1, "above"), ["root", "step"], "left").join(near(1, "below"), ["root", "step"], "left"), "parts")
    rows = joined(rows, around, ["root", "step"], "inner", 48).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    each = lambda n, use: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), use)
    # One key of all: rows that a join has dealt by root would else count as grouped, and a hot group's parts stay in one task.
    pair = lambda kind, at, low, high, side: F.struct(F.concat_ws("/", "root", F.lit(kind), at, low, high).alias("pair"), side.cast("int").alias("side"))
    own = each(F.col("parts"), lambda o: pair("own", F.col("step"), F.least("part", o), F.greatest("part", o), F.col("part") > o))
    up = each(F.coalesce("above", F.lit(0)), lambda o: pair("up", F.col("step"), F.col("part"), o, F.lit(0)))
    down = each(F.coalesce("below", F.lit(0)), lambda o: pair("up", F.col("step") - 1, o, F.col("part"), F.lit(1)))
    return rows.select("node", "known", "sketch", "shingles", F.inline(F.concat(own, up, down)))


def exact_links(keyed: DataFrame, nodes: DataFrame, candidates: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (u, v) that join all nodes whose sets of shingles have the similarity and that are in one group of candidates.

    keyed: id (of id and rid) and text of rows; nodes: node and least (a row that holds it); candidates: node and root. Only texts in
    groups are read again. A group that a task can hold is compared there. Larger ones are first linked along sorted sketches, which joins most close copies at a few copies
    of each set; only groups that are still in several components are dealt to pairs of bounded parts, in which nothing that is joined already is compared.
    """
    met = stored(nodes.join(candidates, "node").select("node", "root", F.col("least.id").alias("own"), F.col("least.rid").alias("own_rid")), "met")
    rows = joined(keyed.select(F.col("id.id").alias("id"), F.col("id.rid").alias("rid"), F.col("text").cast("string").alias("text")), met, F.col("id").eqNullSafe(F.col("own")) & (F.col("rid") == F.col("own_rid")), "inner", 64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            hashes = [shingle_hashes(t.as_py(), width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(map(f, hashes), pa.binary()) for f in (sketch, shingle_set))], names=["node", "root", "sketch", "shingles"])

    sets = stored(rows.select("node", "root", "text").mapInArrow(cut, _SET), "shingles")
    large = (F.count("*") > MOST_NODES) | (F.sum(F.length("shingles")) > MOST_BYTES)
    size = stored(sets.groupBy("root").agg(large.alias("large")), "sizes")
    sized = joined(sets, size, ["root"], "inner", 12)
    verify = lambda p: _verified(p[["node", "known", "sketch", "shingles", "side"]], similarity)
    small = sized.filter("not large").select(F.col("root").cast("string").alias("pair"), "node", F.col("node").alias("known"), "sketch", "shingles", F.lit(0).alias("side"))
    found = small.groupBy("pair").applyInPandas(verify, "u bigint, v bigint")
    if size.filter("large").isEmpty():
        return found
    big = sized.filter("large").select("node", "root", "sketch", "shingles")
    first = stored(_adjacent(big, similarity), "links")
    roots = stored(connected_components(first).select(F.col("node").alias("of"), F.col("root").alias("to")), "roots")
    known = stored(big.select("node", "root").join(roots, F.col("node") == F.col("of"), "left").select("node", "root", F.coalesce("to", "node").alias("known")), "known")
    apart = stored(known.groupBy("root").agg((F.min("known") != F.max("known")).alias("apart")).filter("apart").select("root"), "apart")
    rest = known.join(apart, "root", "left_semi").select(F.col("node").alias("of"), "known")
    rest = joined(big, stored(rest, "rest"), F.col("node") == F.col("of"), "inner", 32).drop("of")
    return found.unionAll(first).unionAll(_dealt(rest, similarity).groupBy("pair").applyInPandas(verify, "u bigint, v bigint"))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's SimHash and its near-duplicate group.

    Rows: one per input row with id_col, fp and component (the smallest id reachable over links; its own included). Two texts are
    linked if their fingerprints differ in at most radius bits and, where a similarity is given, the Jaccard similarity of their
    shingle sets is at least that; there fingerprints and one-permutation MinHashes of SLOTS slots only find the candidates. Words are lower-cased (A-Z) runs of
    anything but ASCII white space; a text of fewer than width words is one shingle; null and wordless texts have fingerprint 0,
    linked like any other. Rows that repeat an id or a text repeat in the result; a null id is never a component unless
    its group has no other. An empty table gives none; other columns are not looked at.
    """
    found = _grouped(docs, width, radius, similarity, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "fp", F.col("least.id").alias("component"))


def _grouped(docs: DataFrame, width: int, radius: int, similarity: float | None, id_col: str, text_col: str) -> DataFrame:
    """id, rid, fp and least (id and rid of the group's first row) of each row."""
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("rid")).alias("id"), F.col(text_col).alias("text"))
    spark, extra = docs.sparkSession, CODE * (similarity is not None)
    prints = fingerprints(keyed, width, "id", "text", similarity is not None).select("id.id", "id.rid", "fp", *extra, *["digest"] * (similarity is not None))
    prints = stored(prints.withColumn("node", F.col("fp") if similarity is None else F.xxhash64("fp", "digest")).drop("digest"), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    path = new_path(spark, "groups")
    with scope(spark, "links"):
        distinct = stored(prints.groupBy("node", "fp", *extra).agg(first.alias("least")), "distinct")
        links = near_links(distinct.drop("least"), radius, None if similarity is None else similarity - SLACK)
        if similarity is not None:
            links = exact_links(keyed, distinct, connected_components(links), width, similarity)
        roots = connected_components(links).withColumnRenamed("node", "of")
        group = written(distinct.select("node", "least").join(roots, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), path)
    least = group.groupBy("root").agg(F.min("least").alias("first"))
    of_node = group.join(least, "root").select("node", F.col("first").alias("least"))
    return prints.select("id", "rid", "fp", "node").join(of_node, "node").select("id", "rid", "fp", "least")


def near_dedup(docs: DataFrame, width: int = 5, radius: int = 18, similarity: float | None = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one for each near-duplicate group: the one with the group's smallest id.

    The similarity is decided on the sets of shingles; fingerprints more than radius bits apart are missed, at 0.8 about 2.3 in a
    thousand pairs of texts of one size by the binomial distribution, fewer above; see near_duplicates. Of rows that repeat
    that id, one stays; a row with a null id only if the group has no other.
    """
    stay = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("rid") == F.col("least.rid"))
    path = new_path(docs.sparkSession, "fates")
    with scope(docs.sparkSession, "groups"):
        fates = written(_grouped(docs, width, radius, similarity, id_col, text_col).select("id", "rid", stay.alias("stay")), path)
    return staying(docs, fates, id_col, text_col)
