"""Contract-checker text: broken imports per contract and the totals line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.ordered import fill_down

# Terminal colour codes; an indented import; the totals line.
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
IMPORT_LINE = r"^(?:\s+|\s*-\s+)(\S+)\s*->\s*(\S+)\s*(?:\(l\.\d+(?:,\s*l\.\d+)*\))?\s*$"
TOTALS = r"(?i)([0-9]+)\s+kept[^0-9]+([0-9]+)\s+broken"


def plain(lines: DataFrame) -> DataFrame:
    return lines.withColumn("text", F.regexp_replace("text", ANSI, ""))


def broken_contracts(lines: DataFrame) -> DataFrame:
    """``lines(file, slice, pos, text)`` -> broken contracts in text order."""
    text = F.rtrim(F.trim("text"))
    return plain(lines).where(text.endswith(" BROKEN")).select(
        "file", "pos", F.rtrim(F.regexp_replace(text, " BROKEN$", "")).alias("contract_name")
    )


def broken_imports(lines: DataFrame) -> DataFrame:
    """Each indented import under the contract that is open at its line.

    A contract stays open until the next broken one; a kept one in between does
    not close it. The plain form and the form with a bullet and line numbers
    are both read.
    """
    text = F.trim("text")
    ends = text.endswith(" BROKEN")
    named = F.rtrim(F.regexp_replace(text, " BROKEN$", ""))
    marked = plain(lines).withColumn("_open", F.when(ends, F.struct(F.when(named != "", named).alias("name"), F.col("pos").alias("start"))))
    kept = marked.where(ends | F.col("text").rlike(IMPORT_LINE)).select(
        "file", "slice", "pos", "_open", ends.alias("_ends"), *[F.regexp_extract("text", IMPORT_LINE, n).alias(c) for n, c in ((1, "importer"), (2, "imported"))]
    )
    filled = fill_down(kept, ["file"], "slice", ["pos"], {"_contract": "_open"})
    return filled.where(~F.col("_ends") & F.col("_contract.name").isNotNull()).select("file", "pos", F.col("_contract.name").alias("contract_name"), "importer", "imported")


def contract_totals(lines: DataFrame, status: DataFrame) -> DataFrame:
    """Kept and broken per file: the first totals line, else one contract by ``status(file, passed)``."""
    found = (
        plain(lines).where(F.col("text").rlike(TOTALS)).groupBy("file").agg(F.min_by("text", "pos").alias("t"))
    )
    joined = status.join(found, "file", "left")
    kept = F.when(F.col("t").isNotNull(), F.regexp_extract("t", TOTALS, 1).try_cast("long")).otherwise(F.col("passed").cast("long"))
    broken = F.when(F.col("t").isNotNull(), F.regexp_extract("t", TOTALS, 2).try_cast("long")).otherwise((~F.col("passed")).cast("long"))
    return joined.select("file", kept.alias("kept"), broken.alias("broken"))
