"""Bounds the memory of Python workers: batches by bytes, and freed memory given back to the system at the end of a task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch, which JVM and worker each hold several times; a longer row is a batch of its own.
BATCH = 2 << 20


@cache
def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim; elsewhere nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


#: Of modules that keep something between tasks, how to drop it.
KEEPERS: dict[str, Callable] = {}


def _drop_others(owner: str) -> None:
    for name, drop in KEEPERS.items():
        if name != owner:
            drop()
    _trim()(0)


def _frugal(run: Callable) -> Callable:
    """``run``, a function for mapInArrow: drops what other operators have kept in its worker, and gives freed memory back at the end of each task."""
    owner = run.__module__

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_others(owner)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return whole


def mapped(df: DataFrame, run: Callable, schema: object) -> DataFrame:
    """``df.mapInArrow`` with both bounds. The bound of batches is a setting of the session, read when the plan runs, and stays set."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df.mapInArrow(_frugal(run), schema)
