"""Normalised fact relations and the metrics joined onto them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.names import dotted_size, joined_id, last_name, module_to_path, parent_name
from codestrata.functions.numbers import mean_of, round_binary
from codestrata.operators.ordered import as_of

CC_LIMIT = 10
CC_ERROR = 15
LCOM4_LIMIT = 1
LOW_MI_RANKS = ("B", "C")
DEAD_CONFIDENCE_CUTOFF = 0.35


def last_per_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Keep the row with the highest ``seq`` per key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def normal_functions(blocks: DataFrame) -> DataFrame:
    """Complexity blocks -> function rows with their key."""
    count = F.col("parameter_count") if "parameter_count" in blocks.columns else F.lit(None)
    return blocks.select(
        joined_id("filepath", F.coalesce("lineno", F.lit(0)), "name").alias("function_id"),
        F.coalesce("filepath", F.lit("")).alias("filepath"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("type", F.lit("function")).alias("type"),
        F.coalesce("lineno", F.lit(0)).cast("long").alias("lineno"),
        F.coalesce("complexity", F.lit(0)).cast("long").alias("cc"),
        F.coalesce("rank", F.lit("A")).alias("rank"),
        count.cast("long").alias("parameter_count"),
    )


def normal_classes(rows: DataFrame) -> DataFrame:
    """Cohesion rows -> class rows with their key."""
    return rows.select(
        joined_id("filepath", "name").alias("class_id"),
        F.coalesce("filepath", F.lit("")).alias("filepath"),
        F.coalesce("name", F.lit("")).alias("class_name"),
        F.coalesce("lineno", F.lit(0)).cast("long").alias("lineno"),
        F.coalesce("class_kind", F.lit("concrete")).alias("class_kind"),
        F.col("cohesion_score").cast("double").alias("lcom4"),
        F.col("cohesion_score_norm").cast("double").alias("lcom4_norm"),
        F.coalesce("methods_count", F.lit(0)).cast("long").alias("methods_count"),
        F.coalesce("excluded_from_aggregation", F.lit(False)).alias("excluded"),
    )


def normal_dead(dead_nodes: DataFrame, collision_rate: Column) -> DataFrame:
    """Dead call-graph nodes with the confidence the collision rate allows."""
    return dead_nodes.select(
        F.col("name").alias("qualified_name"),
        F.when(collision_rate >= DEAD_CONFIDENCE_CUTOFF, "low").otherwise("high").alias("confidence"),
    )


def lcom4_normalised(score: Column) -> Column:
    return F.when(score > 1.0, round_binary(F.lit(1.0) / score, 4)).otherwise(1.0)


def attach_parameter_counts(functions: DataFrame, counts: DataFrame) -> DataFrame:
    """Left join on (file, start line); the last row of a repeated line wins; line 0 never joins."""
    best = last_per_key(counts.where("lineno <> 0").select("filepath", "lineno", "parameter_count", "seq"), ["filepath", "lineno"], "seq")
    return functions.drop("parameter_count").join(best.drop("seq"), ["filepath", "lineno"], "left")


def file_index(functions: DataFrame, mi_files: DataFrame, classes: DataFrame) -> DataFrame:
    """Full outer merge of three sources on the path, in one shuffle.

    Each source is first folded to one partial row per path on the map side. Of several
    maintainability rows of a path the last by ``seq`` counts, with its own rank; without
    that column the one of the higher value.
    """
    order = F.col("seq").cast("long") if "seq" in mi_files.columns else F.lit(0).cast("long")
    rated = mi_files.select("filepath", F.struct(order.alias("seq"), "mi", F.col("rank").alias("mi_rank")).alias("rated"))
    parts = (
        functions.select("filepath", "cc")
        .unionByName(rated, allowMissingColumns=True)
        .unionByName(classes.select("filepath", F.lit(1).alias("is_class")), allowMissingColumns=True)
    )
    merged = parts.groupBy("filepath").agg(
        F.max("rated").alias("rated"),
        F.count("cc").alias("function_count"),
        mean_of(F.coalesce(F.sum("cc"), F.lit(0)), F.count("cc")).alias("mean_cc"),
        F.coalesce(F.max("cc"), F.lit(0)).alias("max_cc"),
        F.count_if(F.col("cc") > CC_LIMIT).alias("high_cc_count"),
        F.count("is_class").alias("class_count"),
    )
    return merged.select("filepath", "rated.mi", "rated.mi_rank", "function_count", "mean_cc", "max_cc", "high_cc_count", "class_count")


def bind_methods(functions: DataFrame, classes: DataFrame, width: int = 4096) -> DataFrame:
    """``(function_id, class_id)``: the class that starts last at or before each method."""
    methods = functions.where(F.col("type") == "method").select("function_id", "filepath", "lineno")
    starts = classes.select("filepath", "lineno", "class_id", *(["seq"] if "seq" in classes.columns else []))
    tie = ["seq"] if "seq" in classes.columns else []
    return as_of(methods, starts, ["filepath"], "lineno", ["class_id"], tie, width).select("function_id", "class_id")


def cross_functions(functions: DataFrame, bound: DataFrame, classes: DataFrame, files: DataFrame) -> DataFrame:
    """Functions with their file's MI and their class's LCOM4."""
    return (
        functions.join(bound, "function_id", "left")
        .join(files.select("filepath", F.col("mi").alias("file_mi")), "filepath", "left")
        .join(classes.select("class_id", F.col("lcom4").alias("class_lcom4")), "class_id", "left")
    )


def method_stats(functions: DataFrame, bound: DataFrame) -> DataFrame:
    """Per class, in one grouping: largest and mean CC, the methods over the limit and the first largest one."""
    order = F.struct("cc", -F.col("lineno"), "function_id")
    return (
        functions.select("function_id", "cc", "name", "lineno")
        .join(bound, "function_id")
        .groupBy("class_id")
        .agg(
            F.max("cc").alias("max_method_cc"),
            mean_of(F.sum("cc"), F.count("cc")).alias("mean_method_cc"),
            F.count_if(F.col("cc") > CC_LIMIT).alias("high_cc_methods"),
            F.max_by(F.struct("name", "lineno"), order).alias("top_method"),
        )
    )


def cross_classes(classes: DataFrame, stats: DataFrame, files: DataFrame) -> DataFrame:
    """Classes with their file's MI and the statistics of their methods."""
    return classes.join(files.select("filepath", F.col("mi").alias("file_mi")), "filepath", "left").join(stats, "class_id", "left")


def place_dead(dead: DataFrame, classes: DataFrame) -> DataFrame:
    """Add ``filepath`` and ``module`` to dead entries.

    With three or more parts the name is first read as module.Class.method, and
    kept so when that class is known. Otherwise the last part is the symbol.
    """
    probe = dead.withColumn(
        "_probe", F.when(
            dotted_size(F.col("qualified_name")) >= 3,
            joined_id(module_to_path(parent_name(F.col("qualified_name"), 2)), last_name(parent_name(F.col("qualified_name")))),
        )
    )
    known = classes.select(F.col("class_id").alias("_probe"), F.lit(True).alias("_known")).distinct()
    name = F.col("qualified_name")
    module = F.when(F.col("_known"), parent_name(name, 2)).otherwise(parent_name(name))
    return (
        probe.join(known, "_probe", "left")
        .withColumn("module", module)
        .withColumn("filepath", F.coalesce(module_to_path(F.col("module")), F.concat(name, F.lit(".py"))))
        .drop("_probe", "_known")
    )


def next_starts(classes: DataFrame, width: int = 4096) -> DataFrame:
    """Add the line where the next class of the same file starts; null for the last one.

    Inside a slice of lines the next start is a window; past its end it is the
    first start of the next slice that has one.
    """
    from pyspark.sql import Window

    sliced = classes.withColumn("_slice", F.floor(F.col("lineno") / width))
    inner = Window.partitionBy("filepath", "_slice").orderBy("lineno", "class_id")
    firsts = sliced.groupBy("filepath", "_slice").agg(F.min("lineno").alias("_first"))
    after = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy("filepath").orderBy("_slice"))).drop("_first")
    return (
        sliced.withColumn("_in", F.lead("lineno").over(inner))
        .join(after, ["filepath", "_slice"])
        .withColumn("next_start", F.coalesce("_in", "_after"))
        .drop("_slice", "_in", "_after")
    )
