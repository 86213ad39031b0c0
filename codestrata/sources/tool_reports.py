"""JSON reports of complexity tools, as whole texts or as the entries of their root (``json_parts``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.numbers import round_binary

_BLOCK = "struct<name:string,type:string,complexity:bigint,rank:string,lineno:bigint>"


def complexity_blocks(reports: DataFrame, column: str = "json") -> DataFrame:
    """``{path: [block, ...] | error text}`` -> one row per function or method block.

    The values are read as variants, so one file's error text leaves the rest of
    its report intact.
    """
    files = reports.select(F.explode(F.from_json(column, "map<string,variant>")).alias("filepath", "found"))
    return _blocks(files.where(F.schema_of_variant("found").startswith("ARRAY")).select("filepath", F.to_json("found").alias("value")))


def complexity_entries(entries: DataFrame) -> DataFrame:
    """``complexity_blocks`` of ``(key, value)``; a value is parsed once, and one that is no list drops out."""
    return _blocks(entries.where("key is not null and startswith(value, '[')").select(F.col("key").alias("filepath"), "value"))


def _blocks(lists: DataFrame) -> DataFrame:
    blocks = lists.select("filepath", F.explode(F.from_json("value", f"array<{_BLOCK}>")).alias("b")).select("filepath", "b.*")
    return blocks.where(F.col("type").isin("function", "method")).select(
        "filepath", "name", "type", F.coalesce("complexity", F.lit(0)).alias("complexity"), F.coalesce("rank", F.lit("A")).alias("rank"),
        F.coalesce("lineno", F.lit(0)).alias("lineno"),
    )


def maintainability_files(reports: DataFrame, column: str = "json") -> DataFrame:
    """``{path: {mi, rank}}`` -> one row per file; values of any other shape drop out."""
    files = reports.select(F.explode(F.from_json(column, "map<string,variant>")).alias("filepath", "found"))
    return _indexes(files.where(F.schema_of_variant("found").startswith("OBJECT")))


def maintainability_entries(entries: DataFrame) -> DataFrame:
    """``maintainability_files`` of ``(key, value)``."""
    named = entries.where("key is not null and startswith(value, '{')")
    return _indexes(named.select(F.col("key").alias("filepath"), F.try_parse_json("value").alias("found")).where("found is not null"))


def _indexes(objects: DataFrame) -> DataFrame:
    mi = F.coalesce(F.try_variant_get("found", "$.mi", "double"), F.lit(0.0))
    rank = F.coalesce(F.try_variant_get("found", "$.rank", "string"), F.lit("A"))
    return objects.select("filepath", round_binary(mi, 2).alias("mi"), rank.alias("rank"))


def parameter_counts(reports: DataFrame, column: str = "json") -> DataFrame:
    """``{filename, function_list: [{start_line, parameter_count}]}`` -> one row per function, in list order."""
    shape = "struct<filename:string,function_list:array<struct<start_line:bigint,parameter_count:bigint>>>"
    rows = reports.select(F.from_json(column, shape).alias("r"))
    return rows.select(F.col("r.filename").alias("filepath"), F.posexplode("r.function_list").alias("seq", "f")).select(
        "filepath", F.col("f.start_line").alias("lineno"), F.col("f.parameter_count").alias("parameter_count"), "seq"
    )


def parameter_entries(entries: DataFrame) -> DataFrame:
    """``parameter_counts`` of reports that are such an object, or a list of them."""
    part = lambda name: F.max(F.when(F.col("key") == name, F.col("value")))
    single = entries.where("key in ('filename', 'function_list')").groupBy("file").agg(part("filename").alias("a"), part("function_list").alias("b"))
    whole = F.concat(F.lit('{"filename":'), F.coalesce("a", F.lit("null")), F.lit(',"function_list":'), F.coalesce("b", F.lit("null")), F.lit("}"))
    return parameter_counts(entries.where("key is null and startswith(value, '{')").select(F.col("value").alias("json")).unionByName(single.select(whole.alias("json"))))


def entries_error(entries: DataFrame, lists: bool = False) -> str | None:
    """Why a report's entries cannot be used: a document that is broken or has an ``error`` key; None if they can."""
    wrong = F.coalesce("problem", F.when(F.col("key") == "error", F.col("value")), F.when(F.col("key").isNull() & ~F.lit(lists), "not a JSON object"))
    found = entries.select("file", "place", wrong.alias("wrong")).where("wrong is not null").orderBy("file", "place").first()
    return found and found["wrong"].strip('"')


def source_status(results: DataFrame) -> DataFrame:
    """``(source, json)`` -> whether each source can be used.

    Only a result that is no object, or one with an ``error`` key, is broken. A
    result that merely reports failed checks is not.
    """
    value = F.try_parse_json("json")
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    error = F.try_variant_get(value, "$.error", "variant")
    ok = is_object & error.isNull()
    return results.select("source", F.coalesce(ok, F.lit(False)).alias("ok"), error.cast("string").alias("error"))
