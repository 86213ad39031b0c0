"""LCOM4: the number of connected components among a class's methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.graph import connected_components, with_least


def attribute_edges(uses: DataFrame) -> DataFrame:
    """Link each method to the lowest method using the same attribute of its class.

    One edge per use joins everything that sharing an attribute would join, so
    an attribute used by a third of all methods adds no pairs.
    """
    return with_least(uses, ["class_id", "attr"], "method_id", "v").select(F.col("method_id").alias("u"), "v")


def lcom4(methods: DataFrame, uses: DataFrame, calls: DataFrame | None = None, definitions: DataFrame | None = None) -> DataFrame:
    """``(class_id, methods_count, lcom4)``.

    ``methods(class_id, method_id)`` holds one row per vertex with ids unique
    over all classes; ``uses(class_id, method_id, attr)`` and ``calls(u, v)``
    link vertices. ``definitions(class_id)`` holds one row per definition where
    a name may be defined twice.
    """
    edges = attribute_edges(uses)
    if calls is not None:
        edges = edges.unionByName(calls.select("u", "v"))
    labels = connected_components(edges)
    # A component is counted at its root: a method that is its own label or has none.
    counted = (
        methods.join(labels.withColumnRenamed("node", "method_id"), "method_id", "left")
        .withColumn("_root", F.col("component").isNull() | (F.col("component") == F.col("method_id")))
        .groupBy("class_id")
        .agg(F.count(F.lit(1)).alias("methods_count"), F.count_if("_root").alias("lcom4"))
    )
    if definitions is None:
        return counted
    totals = definitions.groupBy("class_id").agg(F.count(F.lit(1)).alias("methods_count"))
    return totals.join(counted.drop("methods_count"), "class_id")
