"""What several corpus operators share: tables, folds, written intermediates, per-worker caches."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfence.session import shared_dir

#: A word, the same in Spark's, Python's and DuckDB's patterns.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id's text modulo ``parts``; an id of null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of a table, whatever signs their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer until no column is called so (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once into the shared folder and read back: later jobs neither recompute it nor depend on one executor's disk."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_worker(key: Any, make: Callable[[], Any]) -> Any:
    """One object per Python worker, kept over the tasks that the worker runs."""
    kept = sys.modules.setdefault("_skyfence_llm_kept", ModuleType("_skyfence_llm_kept")).__dict__.setdefault("objects", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def give_back() -> None:
    """Return freed memory to the system: idle workers share their executor's memory with the busy ones."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that gives memory back when its task's batches are done."""

    def wrapped(batches: Any):
        yield from run(batches)
        give_back()

    return wrapped


def slices(column: Any, rows: int = 256):
    """(offset, python values) of an Arrow column, a few rows at a time."""
    for start in range(0, len(column), rows):
        yield start, column.slice(start, rows).to_pylist()


def by_bytes(batch: Any, column: str, mb: float = 4.0):
    """Slices of an Arrow batch whose texts take about ``mb`` each; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + mb * 1e6, "right")))
        yield batch.slice(start, stop - start)
        start = stop
