"""What the text operators share: tables, the shared work folder, chunked Arrow input."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch, stored, work_dir  # noqa: F401  the operators take them from here

#: Java pattern of a word in the contracts: a run of bytes other than space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of text handled at once inside a task; bounds the numpy temporaries.
CHUNK = 1 << 20


#: Rows of text in an Arrow batch, unless the user sets another number than Spark's default.
BATCH_ROWS, _SETTING = "2000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by its folder. Texts are long, so Arrow batches get fewer rows than Spark's default of 10,000."""
    if spark.conf.get(_SETTING) == "10000":
        spark.conf.set(_SETTING, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(key: Column, n: int | Column, bound: int) -> Column:
    """True for about ``bound`` of ``n`` keys, chosen by a hash; for all if there are fewer.

    Only for fitting classifiers, where a documented bound is allowed.
    """
    place = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    return place * n < bound


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of ``column`` each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    block = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


@functools.cache
def _trim() -> Callable[[int], int]:
    """glibc's call that gives free pages of the heap back; elsewhere one that does nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a mapInArrow, whose worker gives back at a task's end what the task no longer uses.

    Spark keeps workers for later tasks; what they kept of their largest one would count beside the heap.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return task


def row_hash(df: DataFrame, row: str | None = None) -> Column:
    """A hash of all columns of ``df`` (or of those in its struct column ``row``); maps count by their JSON."""
    at = (lambda c: F.col(row)[c]) if row else (lambda c: F.col(f"`{c}`"))
    return F.xxhash64(*(F.to_json(F.struct(at(c).alias("x"))) if "map<" in kind else at(c) for c, kind in df.dtypes))
