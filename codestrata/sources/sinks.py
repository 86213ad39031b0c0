"""Text and JSON outputs of a project."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.sources.files import in_ignored_folder
from codestrata.sources.python_syntax import skeleton_text

# Folders and files that the outputs leave out.
SKELETON_SKIP = (
    ".git", ".venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".idea", ".vscode", ".grimp_cache",
    "alembic", "build", "dist",
)
TREE_SKIP = tuple(n for n in SKELETON_SKIP if n != "alembic")
TREE_SKIP_FILES = (".DS_Store",)
RULE = "=" * 60


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def _skeleton(sources: pd.Series) -> pd.DataFrame:
    found = []
    for source in sources:
        if source is None:
            found.append((None, "no readable text"))
            continue
        try:
            found.append((skeleton_text(source), None))
        except (SyntaxError, ValueError, RecursionError) as exc:
            found.append((None, str(exc)))
    return pd.DataFrame(found, columns=["text", "error"])


def skeletons(files: DataFrame, spread: bool = False) -> DataFrame:
    """``(path, text, error)``: each module without its function bodies."""
    kept = files.where(~in_ignored_folder(F.col("path"), SKELETON_SKIP)).select("path", "source")
    if spread:
        kept = kept.repartition(files.sparkSession.sparkContext.defaultParallelism * 2, "path")
    return kept.withColumn("s", _skeleton("source")).select("path", "s.text", "s.error")


def skeleton_blocks(skeleton: DataFrame) -> DataFrame:
    """One text block per file for a report in path order; broken files become a comment."""
    block = F.concat(F.lit(f"\n{RULE}\nFILE: "), "path", F.lit(f"\n{RULE}\n"), "text", F.lit("\n"))
    note = F.concat(F.lit("\n# Parsing error — "), "path", F.lit(": "), "error", F.lit("\n"))
    return skeleton.select("path", F.coalesce(block, note).alias("block"))


def tree_lines(files: DataFrame) -> DataFrame:
    """``(place, line)`` of an indented tree of ``files(path[, is_folder])``; ordering by ``place`` prints it.

    Folders come before files, names compare without case. An entry is the last
    of its folder when it equals the folder's largest sort key, so no folder's
    entries are ever collected.
    """
    folder = F.col("is_folder") if "is_folder" in files.columns else F.lit(False)
    kept = files.select("path", folder.alias("is_folder")).where(
        ~in_ignored_folder(F.col("path"), TREE_SKIP) & ~F.element_at(F.split("path", "/"), -1).isin(*TREE_SKIP_FILES)
    )
    parts = F.split("path", "/")
    size = F.size(parts)
    entry = F.transform(
        F.sequence(F.lit(1), size),
        lambda n: F.struct(
            F.array_join(F.slice(parts, F.lit(1), n - 1), "/").alias("folder"),
            F.transform(
                F.slice(parts, F.lit(1), n),
                lambda name, i: F.struct((((i + 1) == size) & ~F.col("is_folder")).cast("int").alias("is_file"), F.lower(name).alias("low"), name.alias("name")),
            ).alias("place"),
        ),
    )
    entries = kept.select(F.explode(entry).alias("e")).select("e.folder", "e.place").distinct()
    last = entries.groupBy("folder").agg(F.max("place").alias("last"))
    marked = entries.join(last, "folder").withColumn("is_last", F.col("place") == F.col("last"))
    # A line's indent depends on whether each folder above it was the last one.
    depth = F.size("place")
    above = marked.select(F.col("place").alias("up"), F.col("is_last").alias("up_last")).where(F.element_at("up", -1)["is_file"] == 0)
    steps = marked.select("place", "is_last", F.explode_outer(F.when(depth > 1, F.sequence(F.lit(1), depth - 1))).alias("n"))
    indented = (
        steps.withColumn("up", F.when(F.col("n").isNotNull(), F.slice("place", F.lit(1), F.col("n"))))
        .join(above, "up", "left")
        .groupBy("place", "is_last")
        .agg(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "up_last")))).alias("ups"))
    )
    prefix = F.array_join(F.transform("ups", lambda u: F.when(u["up_last"], "    ").otherwise("│   ")), "")
    connector = F.when(F.col("is_last"), "└── ").otherwise("├── ")
    return indented.select("place", F.concat(prefix, connector, F.element_at("place", -1)["name"]).alias("line"))


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON text with its null fields kept and sets in order."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """Write each report section as JSON lines under its own folder.

    Sections with one row per entity stay distributed; nothing is gathered.
    """
    for section, df in parts.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{section}")
