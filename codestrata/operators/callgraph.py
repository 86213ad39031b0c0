"""Call-graph text and edges: name collisions, confidence, dead and root nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.names import is_diagnostic, is_qualified_name
from codestrata.operators.ordered import fill_down


def parse_blocks(lines: DataFrame) -> DataFrame:
    """Call-graph text -> ``(file, block, start, used, seen, counted)``.

    ``lines(file, slice, pos, text)``: ``pos`` grows with the line number inside
    a file and ``slice`` with ``pos``. Two readings of the same text are kept:
    ``source`` is the header an edge belongs to, where a broken header leaves the
    previous one open; ``block`` is the header a collision belongs to, where a
    broken header closes the block.
    """
    text = F.trim(F.translate("text", "\t", " "))
    kept = lines.withColumn("_t", text).where(F.col("_t") != "")
    flush = ~F.startswith("text", F.lit(" "))
    valid = is_qualified_name(F.col("_t"))
    marked = kept.withColumn("_source", F.when(flush & ~is_diagnostic(F.col("_t")) & valid, F.col("_t"))).withColumn(
        "_open",
        F.when(flush, F.struct(F.col("pos").alias("start"), F.when(valid & ~is_diagnostic(F.col("_t")), F.col("_t")).alias("name"))),
    )
    used = F.when(~flush & F.startswith("_t", F.lit("[U]")), F.trim(F.regexp_replace("_t", r"^\[U\]", "")))
    read = marked.select("file", "slice", "pos", "_source", "_open", used.alias("used"))
    filled = fill_down(read, ["file"], "slice", ["pos"], {"source": "_source", "_block": "_open"})
    return filled.select(
        "file", "pos", F.col("_source").alias("header"), "source",
        F.col("_block.name").alias("block"), F.col("_block.start").alias("start"), "used",
    ).where(F.col("header").isNotNull() | is_qualified_name(F.col("used")))


def suspicious_blocks(parsed: DataFrame) -> DataFrame:
    """Names of blocks where a used name other than the block's own repeats."""
    return (
        parsed.where(F.col("used").isNotNull() & F.col("block").isNotNull() & (F.col("used") != F.col("block")))
        .groupBy("file", "start", "block", "used")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("block")
        .distinct()
    )


def raw_edges(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("used").isNotNull() & F.col("source").isNotNull() & (F.col("used") != F.col("source"))).select(
        "source", F.col("used").alias("target")
    )


def nodes(parsed: DataFrame) -> DataFrame:
    edges = raw_edges(parsed)
    return (
        parsed.where(F.col("header").isNotNull()).select(F.col("header").alias("name"))
        .union(edges.select("source")).union(edges.select("target")).distinct()
    )


def rate_edges(edges: DataFrame, suspicious: DataFrame, cascade: bool = True) -> DataFrame:
    """Distinct edges with a confidence.

    An edge from a suspicious block is low wherever it occurs, and low beats
    high among its copies. With ``cascade`` an edge into one is low as well.
    """
    bad = suspicious.select("block").distinct().withColumn("_bad", F.lit(True))
    unique = edges.select("source", "target").distinct()
    rated = unique.join(bad.withColumnsRenamed({"block": "source", "_bad": "_from"}), "source", "left")
    low = F.col("_from").isNotNull()
    if cascade:
        rated = rated.join(bad.withColumnsRenamed({"block": "target", "_bad": "_to"}), "target", "left")
        low = low | F.col("_to").isNotNull()
    return rated.select("source", "target", F.when(low, "low").otherwise("high").alias("confidence"))


def lower_copies(edges: DataFrame) -> DataFrame:
    """``edges(source, target, confidence)`` with copies folded: low beats high."""
    return edges.groupBy("source", "target").agg(
        F.when(F.max((F.col("confidence") == "low").cast("int")) == 1, "low").otherwise("high").alias("confidence")
    )


def classify_nodes(all_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node as ``root`` (only outgoing), ``dead`` (no edge) or ``used``; one grouping, no anti-joins."""
    marks = (
        all_nodes.select(F.col("name"), F.lit(0).alias("i"), F.lit(0).alias("o"))
        .union(edges.select(F.col("target"), F.lit(1), F.lit(0)))
        .union(edges.select(F.col("source"), F.lit(0), F.lit(1)))
    )
    flags = marks.groupBy("name").agg(F.max("i").alias("i"), F.max("o").alias("o"))
    kind = F.when(F.col("i") == 1, "used").when(F.col("o") == 1, "root").otherwise("dead")
    return flags.select("name", kind.alias("node_class"))


def collisions(all_nodes: DataFrame, suspicious: DataFrame) -> DataFrame:
    """One row: suspicious names, all names, and the exact share."""
    bad = suspicious.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = all_nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn("suspicious", bad)
    share = F.when(F.col("nodes") > 0, F.col("suspicious").cast("double") / F.col("nodes").cast("double")).otherwise(0.0)
    return counted.withColumn("rate", share)


def collision_rate(all_nodes: DataFrame, suspicious: DataFrame) -> float:
    """The share as a number, computed once so that no later expression repeats the counts behind it."""
    return collisions(all_nodes, suspicious).first()["rate"]


def collision_status(rate: Column, limit: float = 0.35, abort: bool = False) -> Column:
    """``ok``, ``high_collision``, or ``aborted``; the guard compares strictly and unrounded."""
    return F.when(rate > limit, "aborted" if abort else "high_collision").otherwise("ok")


def edge_totals(edges: DataFrame) -> DataFrame:
    return edges.agg(
        F.count(F.lit(1)).alias("edge_count"),
        F.count_if(F.col("confidence") == "high").alias("edge_count_high"),
        F.count_if(F.col("confidence") == "low").alias("edge_count_low"),
    )


def parse_warning(all_nodes: DataFrame, edges: DataFrame) -> Column:
    """True when names were read but not one edge, which points at an unknown text format."""
    total = all_nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    linked = edges.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (total > 0) & (linked == 0)
