"""Sends this package to the Python workers, so that functions unpickle on any executor."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from functools import cache, partial
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows that a worker makes before it hands them on.
BATCH_ROWS = 4096


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the context once; executors fetch it from the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="millrace-zip-")) / "millrace.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


@cache
def _trim():
    """glibc's ``malloc_trim``; where there is none, nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Returns to the system what Arrow's pool and C's heap hold unused."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def _lean(fn, batches):
    """``fn(batches)``; a worker waits for its next task, beside the JVM of its executor, without what this one took."""
    try:
        yield from fn(batches)
    finally:
        give_back()


def pieces(rows: Iterator, size: int = BATCH_ROWS) -> Iterator[list]:
    """``rows`` in lists of ``size`` at most, so that a worker never holds all that a task makes."""
    rows = iter(rows)
    while piece := list(islice(rows, size)):
        yield piece


def column_values(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of some columns of a batch; only one row at a time becomes Python objects."""
    columns = [batch.column(name) for name in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(partial(_lean, fn), schema)
