"""Exact duplicates by distributed most-significant-byte radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, scope, staying, stored, text_key, written

#: Bytes that the first split looks at; each later one looks at STRIDE times as many.
FIRST_BYTES, STRIDE = 32, 8


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Groups of rows with byte-for-byte equal texts; of each the largest id stays.

    One row per input row: the columns `carry` of docs, or all, in the struct `row`, then text_sha256 (of the UTF-8 bytes), keep_id,
    group_size and kept. A null text counts as empty, so null and empty texts form one group. Rows that repeat both
    id and text are one document: each counts in group_size, and all of them are kept where their id is. A null id
    loses to any other; a group of null ids has keep_id null and is kept. An empty table gives an empty result. Columns
    of docs may have any names.

    Documents are split by successive bytes of their text, as in a most-significant-digit radix sort, a run of bytes at
    a time (32, then 256, 2048, ...): equality is decided by the bytes alone. A group leaves once it has a single member
    or its texts have ended, so later rounds see only what still shares a long prefix, and a text of n bytes takes
    about log8(n) rounds. Counting a group combines in the map tasks. Groups are written before rows are joined to them,
    so that both sides of the join are plain exchanges, whose hot keys adaptive execution splits.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_type, own = docs.schema[id_col].dataType, F.struct("*") if carry is None else F.struct(*carry)
    # A group is labelled by its largest id and that row's digest, which keeps labels apart where ids repeat.
    rows = docs.select(own.alias("row"), F.sha2(text, 256).alias("sha"), F.encode(text, "UTF-8").alias("rest"), F.struct(F.lit(None).cast(id_type).alias("id"), F.lit("").alias("sha")).alias("group"), F.col(id_col).alias("id"))
    keys, parts, width = ["group", "chunk", "ended"], [], FIRST_BYTES
    while True:
        rows = rows.withColumns({"chunk": F.substring("rest", 1, width), "ended": F.octet_length("rest") <= width})
        label = F.struct("id", "sha")
        groups = stored(rows.groupBy(*keys).agg(F.max(label).alias("largest"), F.count("*").alias("n")).filter("n > 1"), "groups")
        done = F.col("n").isNull() | F.col("ended")
        found = rows.join(groups, keys, "left").select(
            "row", "id", "sha", F.when(~done, F.expr(f"substring(rest, {width + 1})")).alias("rest"), F.coalesce("largest", label).alias("group"), F.coalesce("n", F.lit(1)).alias("n"), done.alias("done")
        )
        found = stored(found, "radix")
        parts.append(found.filter("done"))
        rows, width = found.filter("not done").select("row", "id", "sha", "rest", "group"), width * STRIDE
        if rows.isEmpty():
            break
    out = reduce(DataFrame.unionAll, parts)
    return out.select("row", F.col("sha").alias("text_sha256"), F.col("group.id").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("group.id")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one for each distinct text, with their columns as they were (see exact_groups)."""
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), text_key(id_col, text_col).alias("rid"))
    path = new_path(docs.sparkSession, "fates")
    with scope(docs.sparkSession, "radix"):
        fates = written(exact_groups(keyed, "id", "text", carry=["id", "rid"]).select("row.id", "row.rid", F.col("kept").alias("stay")), path)
    return staying(docs, fates, id_col, text_col)
