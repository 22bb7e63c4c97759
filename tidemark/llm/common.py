"""Helpers shared by the training-data operators.

``materialise`` cuts lineage with a Parquet table below ``spark.checkpoint.dir``,
the folder every executor can read.  The numpy helpers work on the UTF-8 buffer
of an Arrow column, so no Python code runs per document.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a task handles at once; one longer document is its own chunk.
CHUNK_BYTES = 1 << 18
#: Bytes of rows in an Arrow batch, counted by Spark; buffers of that size lie outside the executors' heap.
BATCH_BYTES = "2m"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWER, _INVERSE = np.uint64(0x100000001B3), np.uint64(pow(0x100000001B3, -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; where none is set, a temporary one in local mode only."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_BYTES, however long their texts are; a setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, with its own schema."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables below one folder of the shared folder, which go together once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over the batches of a task; what it freed goes back to the system at its end, as the worker process lives on."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a hint to broadcast it if it was counted to hold at most ``most`` rows."""
    return F.broadcast(df) if rows <= most else df


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of a task sorted by its first ``keys`` columns, as tables that cut no group of equal keys.

    A batch is joined to what is held only when its group ends, so a long group is copied once.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        if held and any(held[-1].column(c)[-1].as_py() != x[0] for c, x in enumerate(columns)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        last = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in columns]))
        if len(last):
            cut = int(last[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return offsets - offsets[0], body


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or one longer row."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), rows)
        yield at, end
        at = end


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES):
    """(batch slice, offsets from 0, bytes) over the batches of a task."""
    for batch in batches:
        offsets, body = utf8(batch.column(batch.schema.get_field_index(column)))
        for a, b in chunks(offsets, limit):
            yield batch.slice(a, b - a), offsets[a : b + 1] - offsets[a], body[offsets[a] : offsets[b]]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, which spread every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 text, and the offsets among them."""
    points = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return points, np.cumsum(np.r_[0, (body & 0xC0) != 0x80])[offsets]


_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, CHUNK_BYTES) + 1
        _tables[:] = [np.concatenate([[np.uint64(1)], np.full(size - 1, r, np.uint64)]).cumprod(dtype=np.uint64) for r in (_POWER, _INVERSE)]
    return _tables[0][:n], _tables[1][:n]


def word_spans(letters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-zero bytes, cut at document bounds."""
    inside = letters != 0
    n = len(letters)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hash(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span, mixed; equal spans hash alike anywhere."""
    power, inverse = _powers(len(letters) + 1)
    total = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters * power[:-1], out=total[1:])
    value = (total[ends] - total[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _ODD)


def gram_hash(words: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the run of ``n`` word hashes at each place, or at the places ``at``."""
    size = max(0, len(words) - n + 1) if at is None else len(at)
    out = np.full(size, n, np.uint64)
    for i in range(n):
        out = mix(out * _ODD + (words[i : i + size] if at is None else words[at + i]))
    return out
