"""Complexity, parameters and maintainability from source, by groupings over metric rows.

A function's complexity is one more than its branches; those of the functions inside it count
for it, those of a class inside it for that class's methods. The maintainability index is the published one: Halstead
volume from the multisets of operators and operands of the whole file, complexity of all its
blocks, statements, and the share of comment lines. Numbers are the library's own and need
not equal those of any particular tool to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.numbers import round_binary
from codestrata.session import cut_lineage


def complexity_blocks(rows: DataFrame) -> DataFrame:
    """One row per function and method, in the shape of a complexity report, with its parameters."""
    # Both sides of the join come from one reading of the sources.
    rows = cut_lineage(rows.where("kind = 'branch' or kind = 'block' and form in ('function', 'method')"))
    ways = rows.where("kind = 'branch'").groupBy("path", "owner").agg(F.sum("num").alias("ways"))
    blocks = rows.where("kind = 'block'")
    cc = (F.lit(1) + F.coalesce("ways", F.lit(0))).cast("long")
    return blocks.join(ways, ["path", "owner"], "left").select(
        F.col("path").alias("filepath"), "name", F.col("form").alias("type"), cc.alias("complexity"), complexity_rank(cc).alias("rank"),
        F.col("line").cast("long").alias("lineno"), F.col("num").cast("long").alias("parameter_count"), F.col("cls").alias("class_name"),
    )


def complexity_rank(cc: Column) -> Column:
    return F.when(cc <= 5, "A").when(cc <= 10, "B").when(cc <= 20, "C").when(cc <= 30, "D").when(cc <= 40, "E").otherwise("F")


def maintainability_files(rows: DataFrame) -> DataFrame:
    """``(filepath, mi, rank)`` of every file that parses; files without operators or statements are at 100."""
    kind = lambda name: F.col("kind") == name
    line = lambda name: F.sum(F.when(kind("lines") & (F.col("name") == name), F.col("num"))).alias(name)
    # Distinct operators and operands first, so that a name that fills a file is one row.
    merged = rows.where("kind <> 'error'").groupBy("path", "kind", F.when(F.col("kind").isin("operator", "operand", "lines"), F.col("name")).alias("name")).agg(
        F.sum(F.when(F.col("kind") != "block", F.col("num"))).alias("num"), F.count_if(F.col("form").isin("function", "method")).alias("functions")
    )
    files = merged.groupBy("path").agg(
        F.count_if(kind("operator") | kind("operand")).alias("words"), F.sum(F.when(kind("operator") | kind("operand"), F.col("num"))).alias("length"),
        (F.coalesce(F.sum(F.when(kind("branch"), F.col("num"))), F.lit(0)) + F.sum("functions")).alias("cc"), *map(line, ("code", "comment", "logical")),
    )
    volume = F.col("length") * F.log2(F.col("words").cast("double"))
    share = F.when(F.col("code") > 0, F.col("comment") / F.col("code") * 100).otherwise(0.0)
    index = 171 - 5.2 * F.log(volume) - 0.23 * F.col("cc") - 16.2 * F.log(F.col("logical").cast("double")) + 50 * F.sin(F.sqrt(2.46 * F.radians(share)))
    scaled = F.least(F.greatest(index * 100 / 171, F.lit(0.0)), F.lit(100.0))
    mi = F.when((F.coalesce("length", F.lit(0)) > 0) & (F.col("words") > 1) & (F.col("logical") > 0), scaled).otherwise(100.0)
    return files.select(F.col("path").alias("filepath"), round_binary(mi, 2).alias("mi")).withColumn("rank", F.when(F.col("mi") > 19, "A").when(F.col("mi") > 9, "B").otherwise("C"))
