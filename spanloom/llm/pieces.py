"""SentencePiece encoding and decoding of whole texts, giant ones in chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .best_paths import cut_states
from .common import slices, stored
from .merge_scan import Merges, between, product

#: The mark that stands for a space. A piece has it only at its start, so pieces never join what stands on both sides of one.
MARK = "▁"
#: Texts of more characters are cut into chunks of so many, each a row of its own; chunks whose matrices are combined in one task.
CHUNK, BLOCK = 1 << 16, 64
#: Entries that a task's memory of units may hold before it starts afresh.
CACHE_UNITS = 150_000


def model_table(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes that each piece stands for; control pieces stand for none."""
    table = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        table.append(b"" if model.is_control(k) or model.is_unused(k) else bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace(MARK, " ").encode())
    return table


def check_marks(model: sentencepiece.SentencePieceProcessor) -> None:
    """Raise unless cutting before a run of marks is safe: no piece may have a mark after another character."""
    bad = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if MARK in p.lstrip(MARK)]
    if bad:
        raise ValueError(f"pieces that reach across a space: {bad[:3]}")


def merge_table(model: sentencepiece.SentencePieceProcessor) -> tuple[dict[str, tuple[int, float]], list[int], int]:
    """(id and score by piece, ids of the 256 bytes, most characters of a piece) for merge_scan. Raises where the model does more than merge."""
    plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    odd = "a ﬁ①é\u0301  Ａ"
    if any(map(model.is_unused, plain)) or not all(map(model.is_byte, byte_ids)) or model.normalize(odd) != MARK + odd.replace(" ", MARK):
        raise ValueError("the model normalises texts, resegments pieces or has no bytes for unknown characters")
    table = {model.id_to_piece(k): (k, model.get_score(k)) for k in plain}
    return table, byte_ids, max(map(len, table))


class _Units(dict):
    """Ids, as bytes of int32, of a unit: a run of spaces, the first left out, and the characters up to the next space."""

    def __init__(self, model: bytes):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHE_UNITS:
            self.clear()
        # A lone space at a text's end is a mark by itself; the library would take it for an empty text.
        found = self.model.encode(unit) if unit else [self.model.piece_to_id(MARK)]
        ids = self[unit] = np.array(found, np.int32).tobytes()
        return ids


def units(text: str) -> list[str]:
    """Cut a text, before which a space is thought, before each run of spaces; each unit without its first space."""
    if text.startswith(" ") or text.endswith(" ") or "  " in text:
        return [u[1:] for u in re.findall(" +[^ ]*", " " + text)]
    return text.split(" ") if text else []


def _plain(text: str | None) -> str:
    return (text or "").replace(MARK, " ")


def encode(docs: DataFrame, model_file: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text as the library gives them, without begin and end.

    Rows: one per input row, all its columns in the struct `row`, then ids (array of int) and chunks (in how many it was encoded).
    A null or empty text has no ids. Repeated rows repeat; an empty table gives none; docs' columns may have any names.

    Ordinary texts are encoded where they are read, by the library, from a task's bounded memory of units. Giant ones are cut into chunks anywhere,
    within words too, for a max-plus parallel scan (see merge_scan; the model merges by rank, so a link between pieces weighs 0 or
    minus infinity): each chunk yields the matrix of its boundary states, matrices are combined associatively, and every chunk is traced back by
    itself. Models have to leave texts as they are but for spaces, and encode unknown characters as bytes.
    """
    with open(model_file, "rb") as f:
        source = f.read()
    check_marks(sentencepiece.SentencePieceProcessor(model_proto=source))
    pieces, byte_ids, around = merge_table(sentencepiece.SentencePieceProcessor(model_proto=source))
    shipped, merging = docs.sparkSession.sparkContext.broadcast(source), docs.sparkSession.sparkContext.broadcast((pieces, byte_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Units(shipped.value)
        for batch in slices(batches):
            texts = batch.column("row").field(text_col) if "row" in batch.schema.names else batch.column("text")
            parts = [b"".join(map(known.__getitem__, units(_plain(t)))) for t in texts.to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
            ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(parts), np.int32))).cast(pa.list_(pa.int32()))
            keep = [k for k, name in enumerate(batch.schema.names) if name != "text"]
            names = [batch.schema.names[k] for k in keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), ids], names=[*names, "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = MARK + _plain(text).replace(" ", MARK)
                found = [(k, text[max(0, at - around) : at + chunk + around], min(at, around), min(chunk, len(text) - at)) for k, at in enumerate(range(0, len(text), chunk))]
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True))], names=["key", "at", "part", "start", "size"])

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merges = Merges({p: score for p, (_, score) in merging.value[0].items()})
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "block": f["at"] // BLOCK, "at": f["at"], "m": [merges.matrix(p, s, s + n) for p, s, n in zip(f["part"], f["start"], f["size"], strict=True)]})

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bytes_of = merging.value
        merges = Merges({p: score for p, (_, score) in table.items()})
        for f in frames:
            ids = []
            for part, start, size, s, e in zip(f["part"], f["start"], f["size"], f["s"], f["e"], strict=True):
                found = merges.trace(part, start, start + size, s, e)
                ids.append([i for p in found for i in ([table[p][0]] if p in table else [bytes_of[b] for b in p.encode()])])
            yield pd.DataFrame({"key": f["key"], "at": f["at"], "ids": ids})

    rows, ids = docs.select(F.struct("*").alias("row")), T.StructField("ids", T.ArrayType(T.IntegerType()))
    giant = F.coalesce(F.length(F.col(f"row.{text_col}")) > chunk, F.lit(False))
    own = rows.filter(~giant).mapInArrow(run, T.StructType([rows.schema["row"], ids])).withColumn("chunks", F.lit(1))
    giants = stored(rows.filter(giant).withColumn("key", F.monotonically_increasing_id()), "giants")
    cuts = giants.select("key", F.col(f"row.{text_col}").cast("string").alias("text")).mapInArrow(cut, "key bigint, at bigint, part string, start int, size int")
    # Few bytes but much work: dealt to a stated number of tasks, which adaptive execution doesn't put together.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(cuts.repartition(tasks, "key", "at"), "parts")
    matrices = stored(parts.mapInPandas(measure, "key bigint, block bigint, at bigint, m array<bigint>"), "matrices")
    traced = parts.join(cut_states(matrices, product, between), ["key", "at"]).repartition(tasks, "key", "at").mapInPandas(trace, "key bigint, at bigint, ids array<int>")
    together = traced.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    put = giants.join(together, "key").select("row", F.flatten("parts.ids").alias("ids"), F.size("parts").alias("chunks"))
    return own.unionAll(put)


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for, without the space that encoding puts first. Null ids give null. Map-only."""
    table = model_table(sentencepiece.SentencePieceProcessor(model_file=model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if i is None else b"".join(map(table.__getitem__, i)).decode("utf-8", "replace").removeprefix(" ") for i in (x.as_py() if not x.is_valid else x.values.to_numpy(zero_copy_only=False).tolist() for x in batch.column(ids_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(to, T.StringType())]))
