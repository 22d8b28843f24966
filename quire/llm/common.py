"""Helpers shared by the training-data operators: shared folders, written tables, files."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.shared import Scratch, new_dir, shared_dir, written

__all__ = ["Scratch", "new_dir", "shared_dir", "written"]

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SLICE_ROWS, SLICE_BYTES = 256, 1 << 19


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a folder named by URI or plain path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit hash."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column of one Arrow batch, and its row offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets is not None else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def null_text_as_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


def sliced(batches: Iterator[pa.RecordBatch], column: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows whose texts in ``column`` have about ``size`` bytes in all, or of one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, end - at)
            at = end


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and what it has freed goes back to the system at the end of the task: workers wait for others with what they hold."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


NUMBER = "decimal(38,0)"


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a number that no two rows share and that stays the same however often they are read, and its name.

    Rows of a Parquet table are numbered by file (64 bits of a hash of its path) and place in it; other rows are written once with a number.
    """
    name = "_number"
    while name in docs.columns:
        name += "_"
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and all(f.endswith(".parquet") for f in docs.inputFiles()[:1]):
        at = F.xxhash64("_metadata.file_path").cast(NUMBER) * F.lit(10**12).cast("decimal(13,0)") + F.col("_metadata.row_index").cast("decimal(13,0)")
        return docs.withColumn(name, at.cast(NUMBER)), name
    return written(docs.withColumn(name, F.monotonically_increasing_id().cast(NUMBER)), "numbered"), name


_PART_BITS = 33  # monotonically_increasing_id: partition above, row below


def placed_in_groups(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``pos`` (from 0, by ``order``) in the group and ``count``, the group's rows. Ranges of (group, order) are numbered on their own and shifted by what is
    before them, so a group of any size is in many tasks. The order must tell rows apart, or rows that it does not meet in one range."""
    by = [group, *order]
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    ranged = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_id", _PART_BITS))
    sizes = ranged.groupBy(group, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(group)  # a row for each range that holds some of the group
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("count", F.sum("_size").over(whole)).drop("_size")
    placed = ranged.join(starts, [group, "_part"]).withColumn("pos", F.col("_start") + F.col("_id") - F.col("_first"))
    return placed.drop("_id", "_part", "_first", "_start")
