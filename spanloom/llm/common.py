"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return _own_dirs[app]


#: The folder below the application's that intermediate tables go to now; see scope.
_scopes: list[str] = []


def _own_folder(spark: SparkSession) -> str:
    return "/".join([shared_dir(spark), "spanloom", spark.sparkContext.applicationId, *_scopes])


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> bool:
    """Remove a folder in the shared store, with all in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_intermediates(spark: SparkSession) -> bool:
    """Remove this application's intermediate tables. Call it once results are written: a DataFrame that an operator returned reads them."""
    return delete(spark, _own_folder(spark))


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Intermediate tables written inside go when it ends, so what is to stay has to be written elsewhere before."""
    _scopes.append(f"{name}-{uuid.uuid4().hex}")
    folder = _own_folder(spark)
    try:
        yield
    finally:
        _scopes.pop()
        delete(spark, folder)


#: For tables that are stored. Bytes of a batch that a Python worker gets at a time, in place of Spark's 64 MB: texts lie in it several times, in the
#: executor's JVM and its workers. And a table's shuffle files go once it is written, not when the driver happens to collect its garbage.
_STORING = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def _storing(spark: SparkSession) -> Iterator[None]:
    """_STORING holds inside; the session's own settings are back afterwards."""
    before = {k: spark.conf.get(k) for k in _STORING}
    for k, v in _STORING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df to a path of new_path and read it back. The path may be made before a scope in which df's own tables lie, so that it stays."""
    with _storing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    return written(df, new_path(df.sparkSession, name))


def fits(df: DataFrame, row_bytes: int | Column, limit_mb: int = 48) -> bool:
    """Whether a stored table is small enough to broadcast. Rows of one size are only counted; where they hold arrays or texts,
    row_bytes is a column, which is summed."""
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return size <= limit_mb << 20


def joined(big: DataFrame, side: DataFrame, on: Column | list[str], how: str, row_bytes: int | Column) -> DataFrame:
    """Join; side is broadcast only after its size was checked, else both sides are shuffled."""
    return big.join(F.broadcast(side) if fits(side, row_bytes) else side, on, how)


def staying(docs: DataFrame, fates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stay, each once, with their columns as they were.

    fates: a stored table of id, rid (text_key of id and text) and stay, one row for each row of docs. Only what goes, and what would stay
    more than once, is looked up in the rows: both are few as a rule, so texts are shuffled only where they are many.
    """
    gone = stored(fates.filter("not stay").select("id", "rid").distinct(), "gone")
    twice = stored(fates.filter("stay").groupBy("id", "rid").agg(F.count("*").alias("n")).filter("n > 1").select("id", "rid"), "twice")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), text_key(id_col, text_col).alias("key"))

    def looked_up(side: DataFrame, how: str) -> DataFrame:
        return joined(rows, side, rows.own.eqNullSafe(side.id) & (rows.key == side.rid), how, 48)

    once = looked_up(gone.unionAll(twice), "left_anti")
    return once.unionAll(looked_up(twice, "left_semi").dropDuplicates(["own", "key"])).select("row.*")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(doc: str | Column = "doc_id", text: str | Column = "text") -> Column:
    """With doc_id, identifies a row by what it holds; rows equal in both count as copies of each other. Null counts as empty."""
    return F.xxhash64(doc, F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")))


def unsigned_hex(c: Column) -> Column:
    """A bigint's 64 bits as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def merged_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals as maximal disjoint ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        elif b > a:
            out.append((a, b))
    return out
