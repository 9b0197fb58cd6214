"""Python workers live on after a task; what it held goes back to the machine."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch where a row holds a whole text.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small: a session's batches get TEXT_ROWS rows at most from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run, forget=None):
    """A function of batches that, at a task's end, forgets what it has remembered and gives its memory back."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back()

    return task
