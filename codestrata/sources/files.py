"""Source trees as relations."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders listed by one read task at least; a task then takes the folders below on its own.
_FOLDERS_AT_ONCE = 64


def in_ignored_folder(path: Column, ignored: Iterable[str]) -> Column:
    """True where any folder of a relative path has exactly an ignored name."""
    names = [n.strip() for n in ignored if n and n.strip()]
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names])) if names else F.lit(False)


def scan_python(spark: SparkSession, root: str, ignored: Iterable[str] = (), within: str = "") -> DataFrame:
    """``(path, source, error)`` for every ``.py`` file under ``root``, whatever its name starts with.

    Paths are relative to ``root``, with forward slashes, and start with
    ``within`` when one is given. A file that is not UTF-8 keeps its row with an
    error instead of failing the job. Ignored folders are not opened.
    """
    raw = _tree(spark, root, ignored, ".py", content=True)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    prefix = within.rstrip("/") + "/" if within else ""
    return raw.select(
        F.concat(F.lit(prefix), "path").alias("path"), F.regexp_replace(text, r"\r\n?", "\n").alias("source"),
        F.when(text.isNull(), "not utf-8").alias("error"),
    )


def scan_names(spark: SparkSession, root: str, ignored: Iterable[str] = ()) -> DataFrame:
    """``(path, is_folder)`` of every file and folder under ``root``, without reading any."""
    return _tree(spark, root, ignored, "", content=False).select("path", "is_folder")


def _tree(spark: SparkSession, root: str, ignored: Iterable[str], suffix: str, content: bool) -> DataFrame:
    spark.dataSource.register(SourceTree)
    names = "/".join(n.strip() for n in ignored if n and n.strip())
    return spark.read.format("source_tree").options(root=root, ignored=names, suffix=suffix, content=str(content).lower()).load()


class SourceTree(DataSource):
    """Files of a tree. Spark's own listing skips names that start with ``_`` or ``.``, which source trees need."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, is_folder boolean, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _Folders(InputPartition):
    """Relative folders, each read with all below it or only by itself."""

    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(None)
        self.folders = folders


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.suffix = options["root"], options["suffix"]
        self.ignored = set(options["ignored"].split("/")) - {""}
        self.content = options["content"] == "true"

    def partitions(self) -> Sequence[InputPartition]:
        """Folders near the root, a level at a time, until there are enough to share out."""
        store, base = self._store()
        alone, level = [], [""]
        while level and len(level) < _FOLDERS_AT_ONCE:
            alone += level
            level = [f for folder in level for f, is_folder, _ in self._entries(store, base, folder) if is_folder]
        return [_Folders([(f, False)]) for f in alone] + [_Folders([(f, True)]) for f in level]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        store, base = self._store()
        todo = list(partition.folders)
        while todo:
            folder, deep = todo.pop()
            for path, is_folder, place in self._entries(store, base, folder):
                if is_folder:
                    if not self.suffix:
                        yield path, True, None
                    if deep:
                        todo.append((path, True))
                elif path.endswith(self.suffix):
                    with store.open_input_stream(place) if self.content else _nothing() as file:
                        yield path, False, file.read() if file else None

    def _store(self):
        from pyarrow import fs

        if re.match(r"[a-z0-9+.-]+:/", self.root):
            return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.root))
        return fs.LocalFileSystem(), self.root

    def _entries(self, store, base: str, folder: str) -> Iterator[tuple[str, bool, str]]:
        from pyarrow import fs

        for info in store.get_file_info(fs.FileSelector(posixpath.join(base, folder) if folder else base)):
            is_folder = info.type == fs.FileType.Directory
            if not (is_folder and info.base_name in self.ignored):
                yield posixpath.join(folder, info.base_name), is_folder, info.path


def _nothing():
    import contextlib

    return contextlib.nullcontext()


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, slice, pos, text)`` of text reports, in line order.

    A split of a file is a slice, and lines keep their order inside it, so a
    large report is read by many tasks.
    """
    raw = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return raw.select(
        F.col("file_path").alias("file"), F.col("file_block_start").alias("slice"),
        F.struct("file_block_start", F.monotonically_increasing_id().alias("n")).alias("pos"), F.col("value").alias("text"),
    )
