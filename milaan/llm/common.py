"""What several operators of this folder share: reading tables, checked broadcasts, Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milaan.sources.writers import scratch_path

# A table of one row per source, language, item and so on is sent to every executor up to this many rows.
SMALL_ROWS = 100_000
# Texts are worked on in slices of about this many bytes, so memory does not follow the Arrow batch.
SLICE_BYTES = 1 << 20
# Rows per Arrow batch: long texts must not add up to more than an executor holds.
BATCH_ROWS = 1000
HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the rows (and so the bytes) of the batches that Python workers get, and let them find this package."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if HOME not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, HOME) if x)


def small(frame: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcast a written table after counting its rows; beyond the limit the join shuffles, and AQE splits hot keys."""
    return F.broadcast(frame) if frame.count() <= limit else frame


class Scratch:
    """The tables a job writes to the shared folder on its way, each dropped by name once no later step reads it.

    A written table cuts lineage and outlives lost executors.  The shuffle files of its plan go when it is written, not when the
    driver happens to collect garbage; what is returned unwritten keeps its shuffle files.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def written(self, frame: DataFrame, name: str) -> DataFrame:
        path, before = scratch_path(self.spark, name), self.spark.conf.get(self.CLEANUP, "false")
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            frame.write.parquet(path)
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.held.pop(id(t))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def only(self, *tables: DataFrame) -> None:
        """Drop every table but these."""
        self.drop(*[t for t, _ in self.held.values() if not any(t is kept for kept in tables)])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, the row offsets, and which rows are null (they get no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    missing = np.asarray(column.is_null())
    if missing.any():
        column = column.fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at - at[0], missing


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def text_slices(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch in slices: its rows, their text bytes, the offsets, the null flags."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offsets, missing = text_bytes(batch.column(batch.schema.get_field_index(name)))
        for first, last in slices(offsets):
            at = offsets[first : last + 1]
            yield batch.slice(first, last - first), raw[at[0] : at[-1]], at - at[0], missing[first:last]
