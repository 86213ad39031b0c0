"""Session defaults, lineage cutting and scratch tables."""

from __future__ import annotations

import atexit
import gc
import shutil
import uuid
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

# Let adaptive execution split a hot join key even where that costs one more shuffle.
SKEW = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}


def local_session(app: str = "codestrata", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks. A cluster brings its own settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=SKEW)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    A written table is computed once, survives lost executors and carries its
    size, so later joins are planned on real numbers.
    """
    return _written(df, f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}")


def merged(parts: list[DataFrame], most: int = 8) -> list[DataFrame]:
    """The tables of a loop's rounds, written together once they are many, so that a round reads few."""
    return parts if len(parts) <= most else [cut_lineage(reduce(DataFrame.unionByName, parts))]


def scratch_folder(spark: SparkSession) -> str:
    """The folder for written tables, the same on every master.

    It lies in ``spark.checkpoint.dir``, which all executors share. Where that
    is unset it lies beside the tables in the warehouse, which they share too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    application = f"codestrata-{spark.sparkContext.applicationId}"
    if named is not None:
        return f"{named.rstrip('/')}/{application}"
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{application}"
    _delete_at_exit(folder)
    return folder


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now.

    It does so when the driver collects its garbage, which may otherwise be
    long after a written table has made those files useless.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """The written tables of one run, deleted together when the run ends.

    ``keep`` writes a table that lives as long as the ``with`` block, or until
    ``drop`` where nothing reads it any more. What the run returns must come
    from ``result``, which outlives it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
        self.written: dict[DataFrame, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        delete_folder(self.spark, self.folder)

    def path(self, name: str = "") -> str:
        return f"{self.folder}/{name or uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        table = _written(df, path)
        self.written[table] = path
        release_shuffles(self.spark)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables of this run now, so that the disk holds only what is still read."""
        for table in tables:
            delete_folder(self.spark, self.written.pop(table))

    def result(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_leaving: set[str] = set()


def _delete_at_exit(folder: str) -> None:
    place = urlparse(folder)
    if folder not in _leaving and place.scheme in ("", "file"):
        _leaving.add(folder)
        atexit.register(shutil.rmtree, place.path, ignore_errors=True)
