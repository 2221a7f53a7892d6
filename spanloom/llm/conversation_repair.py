"""Repair of conversation structure: cheapest edits by Dijkstra on the lattice of turns and grammar states."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, stored

#: Grammar states: nothing yet, after the system turn, after a user's, after an assistant's. A conversation's role initials are (s?(ua)+)?.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (EMPTY, ASSISTANT)
#: From each state, the state after a user's or assistant's turn: only one of the two may follow.
AFTER = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows are searched so many at a time; longer conversations are put together from their blocks' cheapest ways.
BLOCK = 512
SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"


class Turn(NamedTuple):
    role: str
    text: str
    #: blank, duplicate, truncated, or nothing
    fault: str

    def kept_to(self, state: int) -> int | None:
        """The state after this turn as it is, or None where its role can't stand."""
        to = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(self.role[:1])
        return to if to == AFTER[state] or (to == SYSTEM and state == EMPTY) else None


#: Cost and audit (initials of the edits in order). Cheapest first, then least by ASCII.
Way = tuple[int, str]


def cheapest(turns: list[Turn], entry: int, enough: Callable[[int], bool] = lambda state: False) -> dict[int, Way]:
    """Cheapest ways from the state `entry` before the turns to states after them.

    Nodes are (turns done, state), made as they are met; the key (cost, audit) grows along every edge, so the first time that a node
    is popped its key is the least. Stops at the first end node that is `enough`, or finds all.
    """
    heap, done, ends = [(0, "", 0, entry)], set(), {}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns):
            ends[state] = (cost, audit)
            if enough(state):
                break
        heapq.heappush(heap, (cost + INSERT, audit + "I", at, AFTER[state]))
        if at < len(turns):
            turn = turns[at]
            heapq.heappush(heap, (cost + DELETE, audit + "D", at + 1, state))
            if turn.fault not in ("blank", "duplicate"):
                late = TRUNCATED if turn.fault == "truncated" else 0
                heapq.heappush(heap, (cost + REROLE + late, audit + "R", at + 1, AFTER[state]))
                if (to := turn.kept_to(state)) is not None:
                    heapq.heappush(heap, (cost + KEEP + late, audit + "K", at + 1, to))
    return ends


def chained(first: dict[int, dict[int, Way]], second: dict[int, dict[int, Way]]) -> dict[int, dict[int, Way]]:
    """Cheapest ways through both of two neighbouring stretches, from each state to each. Associative."""
    out: dict[int, dict[int, Way]] = {}
    for entry, ways in first.items():
        ends = out[entry] = {}
        for middle, (cost, audit) in ways.items():
            for end, (more, rest) in second[middle].items():
                way = (cost + more, audit + rest)
                if end not in ends or way < ends[end]:
                    ends[end] = way
    return out


def ways_through(turns: list[Turn]) -> dict[int, dict[int, Way]]:
    """Cheapest ways from each state to each; blocks are chained two and two, so that audits are copied a logarithm of times."""
    level = [{entry: cheapest(turns[k : k + BLOCK], entry) for entry in range(4)} for k in range(0, max(1, len(turns)), BLOCK)]
    while len(level) > 1:
        level = [chained(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def cheapest_whole(turns: list[Turn]) -> Way:
    """The cheapest way of a conversation that is here as a whole."""
    ends = cheapest(turns, EMPTY, ACCEPTING.__contains__) if len(turns) <= BLOCK else ways_through(turns)[EMPTY]
    return min(ends[s] for s in ACCEPTING if s in ends)


def edited(turns: Iterable[Turn], audit: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """The turns (role, text) that the edits leave, and the state after them."""
    out, rest = [], iter(turns)
    for edit in audit:
        turn = None if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit == "K":
            state = turn.kept_to(state)
            out.append((turn.role, turn.text))
        else:
            state = AFTER[state]
            out.append((ROLE[state], turn.text if turn else ""))
    return out, state


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ROLE_TEXT = pa.struct([("role", pa.string()), ("text", pa.string())])
_WAY = pa.struct([("entry", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])
_PART_SQL = "part bigint, cut boolean, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired array<struct<role:string,text:string>>"
_CUT_SQL = ", first_turn bigint, last_turn bigint, first_role string, last_role string, ways array<struct<entry:int,end:int,cost:bigint,audit:string>>, turns array<struct<role:string,text:string,fault:string>>"


def _gap(before: int | None, turn: int | None) -> int:
    return max(0, turn - before - 1) if before is not None and turn is not None else 0


def _illegal(before: str | None, role: str) -> int:
    return int(before is not None and before[:1] + role[:1] not in ("su", "ua", "au"))


class _Part:
    """What one task holds of one conversation: its turns in order, faults and counts."""

    def __init__(self, conv):
        self.conv, self.turns, self.counts = conv, [], dict.fromkeys(_COUNTS, 0)
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, turn: int | None, role: str, text: str, n: int, seen: bool) -> None:
        """A row that stands n times at one turn; seen: an equal role and text stand at an earlier one."""
        shown = text.strip(SPACES)
        for k in range(n):
            fault = "blank" if not shown else "duplicate" if seen or k else "truncated" if shown[-1] not in ENDS else ""
            if fault:
                self.counts[fault] += 1
            self.counts["illegal"] += _illegal(self.last_role, role)
            self.turns.append(Turn(role, text if fault in ("", "truncated") else "", fault))
            self.last_role = role
        self.counts["gaps"] += _gap(self.last_turn, turn)
        self.first_role = role if self.first_role is None else self.first_role
        self.first_turn = turn if self.first_turn is None else self.first_turn
        self.last_turn = turn if turn is not None else self.last_turn

    def row(self, part: int, cut: bool) -> dict:
        out = {"conv": self.conv, "part": part, "cut": cut} | self.counts
        if cut:
            ways = [{"entry": a, "end": b, "cost": c, "audit": s} for a, ends in ways_through(self.turns).items() for b, (c, s) in ends.items()]
            ends = {"first_turn": self.first_turn, "last_turn": self.last_turn, "first_role": self.first_role, "last_role": self.last_role}
            return out | ends | {"ways": ways, "turns": [t._asdict() for t in self.turns]}
        cost, audit = cheapest_whole(self.turns)
        repaired, _ = edited(self.turns, audit, EMPTY)
        return out | {"cost": cost, "audit": audit, "repaired": [{"role": r, "text": t} for r, t in repaired]}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _part_schema(kind: pa.DataType, cut: bool) -> pa.Schema:
    fields = [("conv", kind), ("part", pa.int64()), ("cut", pa.bool_()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired", pa.list_(_ROLE_TEXT))]
    if cut:
        fields += [("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()), ("ways", pa.list_(_WAY)), ("turns", pa.list_(_TURN))]
    return pa.schema(fields)


def _found_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one range of sorted rows. The range's first and last may go on in the next ranges: they are given as cut."""
    task, now, first, schema, ready = TaskContext.get().partitionId(), None, True, None, []
    for batch in batches:
        schema = schema or _part_schema(batch.schema.field(0).type, True)
        for conv, turn, role, text, n, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    ready.append(now.row(2 * task, first))
                    first = False
                now = _Part(conv)
            now.add(turn, role, text, n, seen)
        if len(ready) > 200:
            yield _batch(ready, schema)
            ready = []
    if now is not None:
        yield _batch([*ready, now.row(2 * task + (not first), True)], schema)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cut conversation the cheapest way through its parts, which come in order: state before, audit, and
    what counts between a part and the ones before."""
    schema = pa.schema([("at", pa.int64()), ("entry", pa.int32()), ("edits", pa.string()), ("spent", pa.int64()), ("more_gaps", pa.int64()), ("more_illegal", pa.int64())])

    def settled(ways: dict, between: list[tuple[int, int, int]]) -> pa.RecordBatch:
        _, _, trail = min(w for s, w in ways.items() if s in ACCEPTING)
        steps = []
        while trail:
            trail, *step = trail
            steps.append(step)
        rows = [{"at": at, "entry": e, "edits": a, "spent": c, "more_gaps": g, "more_illegal": i} for (at, g, i), (e, a, c) in zip(between, reversed(steps), strict=True)]
        return _batch(rows, schema)

    nothing = object()
    conv, ways, between, turn, role = nothing, {}, [], None, None
    for row in _grouped(batches):
        if conv is nothing or row["conv"] != conv:
            if conv is not nothing:
                yield settled(ways, between)
            conv, ways, between, turn, role = row["conv"], {EMPTY: (0, "", ())}, [], None, None
        between.append((row["part"], _gap(turn, row["first_turn"]), _illegal(role, row["first_role"])))
        turn, role = row["last_turn"] if row["last_turn"] is not None else turn, row["last_role"]
        found: dict[int, tuple] = {}
        for w in row["ways"]:
            if w["entry"] in ways:
                cost, audit, trail = ways[w["entry"]]
                way = (cost + w["cost"], audit + w["audit"], (trail, w["entry"], w["audit"], w["cost"]))
                if w["end"] not in found or way[:2] < found[w["end"]][:2]:
                    found[w["end"]] = way
        ways = found
    if conv is not nothing:
        yield settled(ways, between)


def _edited_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = _part_schema(batch.schema.field(0).type, False)
        for row in batch.to_pylist():
            repaired, _ = edited([Turn(**t) for t in row["turns"]], row["edits"], row["entry"])
            row |= {"gaps": row["gaps"] + row["more_gaps"], "illegal": row["illegal"] + row["more_illegal"], "cost": row["spent"], "audit": row["edits"]}
            yield _batch([{f: row.get(f) for f in schema.names} | {"repaired": [{"role": r, "text": t} for r, t in repaired]}], schema)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with faults put in by a hash of conv_id and turn, and n: how often each stands at its turn (0: dropped).
    Null roles and texts become one space; in the hash null ids and turns count as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), what.alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    n = F.when(F.col("what") == 0, 0).when(F.col("what") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), n.alias("n"))


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The cheapest edits that give each conversation the role initials (s?(ua)+)?.

    turns: conv_id (any type that sorts), turn, role, text, and n, how often the row stands (0: not at all). Null roles and texts count as one space;
    repeated rows stand as often as they come; a null conv_id is a conversation; other columns are not looked at. Turns come by turn (null first), then
    role and text. Edits: keep (0), rerole to user or assistant (2), delete (3; the only one for blank and duplicate turns), insert an empty
    user or assistant turn (2); a truncated turn that isn't deleted costs 1 more. A role without a first letter has to go or change.

    Rows: conv_id, part, cut, and for the part gaps, blank, duplicate, truncated, illegal, cost, audit (initials of the edits, in order; of the
    cheapest ways the least) and repaired (array of role, text). A conversation is one row, or several in the order of `part` where it was cut
    between tasks: counts of parts add up, audits and turns follow each other. One without any turn has a row of zeros; no rows give none.

    Turns are range-sorted by conversation and turn, so that a long conversation fills several tasks. A task works on what lies
    in its range by Dijkstra; of the first and last conversation there, which may go on elsewhere, it gives the cheapest ways from
    each state to each, and these are chained in order afterwards (a row a part; 16 audits, a byte a turn each).
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), name("role").alias("role"), name("text").alias("text"), F.col("n").cast("bigint").alias("n"))
    ids = rows.groupBy("conv").agg(F.sum("n").alias("n")).filter("n = 0")
    rows = stored(rows.filter("n > 0").groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n")), "turns")

    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    what = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = rows.select("conv", what.alias("what"), place.alias("place")).groupBy("conv", "what").agg(F.min("place").alias("first"), F.count("*").alias("times")).filter("times > 1")
    first = stored(first.select(F.col("conv").alias("of"), F.col("what").alias("same"), "first"), "repeated")
    marked = joined(rows.withColumn("what", what), first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("what") == F.col("same")), "left", 256)
    marked = stored(marked.select("conv", "turn", "role", "text", "n", F.coalesce(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")), F.lit(False)).alias("seen")), "marked")

    ranged = marked.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    parts = stored(ranged.mapInArrow(_found_parts, f"conv {kind}, {_PART_SQL}{_CUT_SQL}"), "parts")
    cut, columns = parts.filter("cut"), ["conv", "part", "cut", *_COUNTS, "audit", "repaired"]
    ways = cut.select("conv", "part", "first_turn", "last_turn", "first_role", "last_role", "ways").repartition("conv").sortWithinPartitions("conv", "part")
    chosen = stored(ways.mapInArrow(_chosen, "at bigint, entry int, edits string, spent bigint, more_gaps bigint, more_illegal bigint"), "chosen")
    mended = cut.select("conv", "part", "cut", *_COUNTS, "turns").join(chosen, F.col("part") == F.col("at")).mapInArrow(_edited_parts, f"conv {kind}, {_PART_SQL}")
    none = ids.select("conv", F.lit(0).cast("bigint").alias("part"), F.lit(False).alias("cut"), *(F.lit(0).cast("bigint").alias(c) for c in _COUNTS), F.lit("").alias("audit"), F.array().cast("array<struct<role:string,text:string>>").alias("repaired"))
    return parts.filter("not cut").select(*columns).unionAll(mended.select(*columns)).unionAll(none).withColumnRenamed("conv", "conv_id")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its parts, which come in order; the digest is fed a turn at a time."""
    nothing = object()
    conv, counts, audits, digest, schema = nothing, {}, [], None, None
    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for row in batch.to_pylist():
            if conv is nothing or row["conv_id"] != conv:
                if conv is not nothing:
                    yield _batch([{"conv_id": conv, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()} | counts], schema)
                conv, counts, audits, digest, begun = row["conv_id"], dict.fromkeys(_COUNTS, 0), [], hashlib.sha256(), False
            for c in _COUNTS:
                counts[c] += row[c]
            audits.append(row["audit"])
            for t in row["repaired"]:
                digest.update(f"{chr(10) if begun else ''}{t['role']}:{t['text']}".encode())
                begun = True
    if conv is not nothing:
        yield _batch([{"conv_id": conv, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()} | counts], schema)


def summaries(parts: DataFrame) -> DataFrame:
    """One row for each conversation of repair_conversations: conv_id, its counts, audit, and the SHA-256 of the repaired turns (`role:text`, one a line). The
    digest of a conversation that was cut is a chain over its parts, so these few are read in order, a part at a time."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    shown = F.array_join(F.transform("repaired", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    whole = parts.filter("not cut").select("conv_id", *_COUNTS, "audit", F.sha2(shown, 256).alias("repaired_sha256"))
    ordered = parts.filter("cut").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.unionAll(ordered.mapInArrow(_digests, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"))
