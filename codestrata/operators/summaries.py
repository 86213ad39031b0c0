"""One-row and per-rank rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.numbers import mean_of
from codestrata.operators.relations import CC_LIMIT


def complexity_summary(functions: DataFrame) -> DataFrame:
    return functions.agg(
        F.count(F.lit(1)).alias("total_items"),
        mean_of(F.coalesce(F.sum("cc"), F.lit(0)), F.count("cc")).alias("mean_cc"),
        F.count_if(F.col("cc") > CC_LIMIT).alias("high_complexity_count"),
    )


def maintainability_summary(files: DataFrame) -> DataFrame:
    """The MI values carry two decimals, so a decimal sum does not depend on row order."""
    exact = F.col("mi").cast("decimal(20,2)")
    return files.where(F.col("mi").isNotNull()).agg(
        F.count(F.lit(1)).alias("total_files"),
        mean_of(F.coalesce(F.sum(exact), F.lit(0)), F.count("mi")).alias("mean_mi"),
        F.count_if(F.col("rank") == "C").alias("low_mi_count"),
    )


def rank_distribution(df: DataFrame, rank: str = "rank") -> DataFrame:
    return df.where(F.col(rank).isNotNull()).groupBy(F.col(rank).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


def _mean_when(condition: Column) -> Column:
    value = F.when(condition, F.col("lcom4"))
    return mean_of(F.coalesce(F.sum(value.cast("decimal(20,2)")), F.lit(0)), F.count(value))


def cohesion_summary(classes: DataFrame, limit: int = 1) -> DataFrame:
    """Rollup over normalised classes. Only classes that are not excluded enter the means."""
    counted = ~F.col("excluded") & F.col("lcom4").isNotNull()
    return classes.agg(
        F.count(F.lit(1)).alias("total_classes_analyzed"),
        F.count_if(~F.col("excluded")).alias("concrete_classes_count"),
        _mean_when(counted).alias("mean_lcom4_all"),
        _mean_when(counted & (F.col("methods_count") >= 2)).alias("mean_lcom4_multi_method"),
        F.count_if(counted & (F.col("methods_count") >= 2)).alias("analyzed_classes_count"),
        F.count_if(counted & (F.col("lcom4") > limit)).alias("low_cohesion_count"),
        F.count_if(F.col("excluded") & (F.col("lcom4") > limit)).alias("low_cohesion_excluded_count"),
        F.lit(limit).cast("long").alias("low_cohesion_threshold"),
    )


def excluded_offenders(classes: DataFrame, limit: int = 1) -> DataFrame:
    """Classes over the limit that the means leave out."""
    return classes.where(F.col("excluded") & (F.col("lcom4") > limit)).select(
        "class_name", "filepath", "lineno", "lcom4", "class_kind"
    )


def imports_summary(layers: DataFrame, contracts: DataFrame, cycles: DataFrame) -> DataFrame:
    """Violation totals over layers beside the contract and cycle counts; each input is aggregated first."""
    found = contracts.agg(
        F.coalesce(F.sum(F.col("kept") + F.col("broken")), F.lit(0)).alias("checked"),
        F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"),
    )
    return layers.agg(
        F.coalesce(F.sum("sdp_violations"), F.lit(0)).alias("sdp_violations"),
        F.coalesce(F.sum("slp_violations"), F.lit(0)).alias("slp_violations"),
    ).select(
        found.select("checked").scalar().alias("contracts_checked"),
        found.select("broken").scalar().alias("broken_contracts"),
        "sdp_violations",
        "slp_violations",
        cycles.agg(F.countDistinct("cycle_id").alias("n")).scalar().alias("import_cycles"),
    )


def dead_summary(dead: DataFrame, collision_rate: Column) -> DataFrame:
    return dead.agg(
        F.count(F.lit(1)).alias("dead_node_count"),
        F.count_if(F.col("confidence") == "high").alias("high_confidence_dead"),
    ).select("*", collision_rate.alias("collision_rate"))


def strength_counts(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("violations_total"),
        F.count_if(F.col("strength") == "strong").alias("strong_violations"),
        F.count_if(F.col("strength") != "strong").alias("weak_violations"),
    )
