"""Files in a shared store, opened from tasks."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def writer(path: str):
    store, at = opened(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    return store.open_output_stream(at, compression=None)


def reader(path: str):
    store, at = opened(path)
    return store.open_input_file(at)


def reading_tasks(rows: DataFrame, size: str, each: int = 32_000_000) -> int:
    """Tasks for rows that each name ``size`` bytes to read.

    Spark sees only the few bytes of a name and would put all of them into one task.
    """
    total = rows.agg(F.sum(size)).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(total) // each))
