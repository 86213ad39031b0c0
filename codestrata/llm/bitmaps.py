"""A filter of fixed size for rows that a join would drop anyway.

It has one bit per hash place, kept as at most ``BITS / 64`` rows of a word number and 64
bits, so its broadcast never grows with the data: two million bytes serve a join of any
size, and with very many keys it only lets more rows through. An exact join follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """``(_w, _b)``: the places of all keys, by one grouping with partial results per task."""
    places = keys.select(_place(F.col(key)).alias("p"))
    words = places.select(F.expr("p div 64").alias("_w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("_b"))
    return words.groupBy("_w").agg(F.bit_or("_b").alias("_b"))


def flagged(rows: DataFrame, key: str, held: DataFrame, flag: str) -> DataFrame:
    """The rows with a boolean that is false only for keys that are not in the bitmap."""
    place = _place(F.col(key))
    joined = rows.withColumn("_w", F.floor(place / 64)).join(F.broadcast(held), "_w", "left")
    bit = F.getbit(F.col("_b"), F.pmod(F.xxhash64(key), F.lit(64)).cast("int"))
    return joined.withColumn(flag, F.coalesce(bit, F.lit(0)) == 1).drop("_w", "_b")


def possible(rows: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """The rows whose keys may be in the bitmap."""
    return flagged(rows, key, held, "_held").where("_held").drop("_held")


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))
