"""Layer resolution, stability metrics and the two dependency rules.

Layers, prefixes, tiers and exceptions come from the configuration, so the
relations that hold them are as small as the configuration file. Nothing is
hinted: the planner broadcasts them while they are under its size limit and
shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.names import dotted_size, is_ignored_module, leading_parts
from codestrata.functions.numbers import ratio, round_binary
from codestrata.operators.graph import strong_components

SDP, SLP = "SDP-001", "SLP-001"


def resolve(df: DataFrame, module: str, prefixes: DataFrame, rule: str, name: str = "layer") -> DataFrame:
    """Add the layer of a dotted module name by one equi-join per prefix depth.

    ``prefixes(layer, prefix, ord)``; the depths are the part counts that occur in it.
    ``longest`` lets the deepest prefix win and, for a repeated prefix, the last
    entry; ``first`` lets the lowest ``ord`` win whatever its length.
    """
    last = rule == "longest"
    pick = F.max_by if last else F.min_by
    table = prefixes.groupBy("prefix").agg(
        pick("layer", "ord").alias("layer"), (F.max if last else F.min)("ord").alias("ord")
    )
    result = df
    depths = sorted(r[0] for r in prefixes.select(dotted_size(F.col("prefix"))).distinct().collect())
    if not depths:
        return result.withColumn(name, F.lit(None).cast("string"))
    for depth in depths:
        side = table.where(dotted_size(F.col("prefix")) == depth).select(
            F.col("prefix").alias("_key"), F.struct("ord", "layer").alias(f"_at{depth}")
        )
        # A name with fewer parts stays whole and cannot equal a prefix of this depth.
        result = result.withColumn("_key", leading_parts(F.col(module), depth)).join(side, "_key", "left").drop("_key")
    hits = [F.col(f"_at{d}") for d in sorted(depths, reverse=last)]
    best = F.coalesce(*hits) if last else F.array_min(F.array_compact(F.array(*hits)))
    return result.withColumn(name, best["layer"]).drop(*[f"_at{d}" for d in depths])


def layer_edges(
    imports: DataFrame, internal: DataFrame, external: DataFrame | None,
    package: str = "", ignored: tuple[str, ...] = (),
) -> DataFrame:
    """Distinct ``(source, target)`` layers over ``imports(importer, imported)``."""
    kept = imports.where(
        ~is_ignored_module(F.col("importer"), package, ignored) & ~is_ignored_module(F.col("imported"), package, ignored)
    )
    named = resolve(kept, "importer", internal, "first", "source").where(F.col("source").isNotNull())
    named = resolve(named, "imported", internal, "first", "_in")
    if external is None:
        named = named.withColumn("target", F.col("_in"))
    else:
        named = resolve(named, "imported", external, "first", "_out")
        named = named.withColumn("target", F.coalesce("_in", "_out"))
    return (
        named.where(F.col("target").isNotNull() & (F.col("source") != F.col("target"))).select("source", "target").distinct()
    )


def stability(layers: DataFrame, edges: DataFrame) -> DataFrame:
    """Afferent and efferent coupling and instability, layers without edges included."""
    out = edges.groupBy(F.col("source").alias("layer")).agg(F.countDistinct("target").alias("ce"))
    into = edges.groupBy(F.col("target").alias("layer")).agg(F.countDistinct("source").alias("ca"))
    joined = layers.select("layer").distinct().join(into, "layer", "left").join(out, "layer", "left").na.fill(0, ["ca", "ce"])
    return joined.select("layer", "ca", "ce", ratio(F.col("ce"), F.col("ca") + F.col("ce"), 2).alias("instability"))


def with_external_tier(tiers: DataFrame, external: DataFrame) -> DataFrame:
    """External layers without a tier sit one below the deepest one."""
    deepest = tiers.agg(F.max("tier").alias("t")).scalar()
    extra = external.select("layer").distinct().join(tiers.select("layer"), "layer", "left_anti")
    return tiers.select("layer", "tier").unionByName(extra.select("layer", (deepest + 1).cast("int").alias("tier")))


def _with_tiers(edges: DataFrame, tiers: DataFrame) -> DataFrame:
    side = tiers.select("layer", "tier")
    return edges.join(side.toDF("source", "tier"), "source").join(side.toDF("target", "dep_tier"), "target")


def sdp_violations(
    edges: DataFrame, stable: DataFrame, tiers: DataFrame, exceptions: DataFrame | None = None,
    tolerance: float = 0.0, textbook: bool = False,
) -> DataFrame:
    """Edges whose source is less stable than the rule allows.

    The default fires when the source's instability exceeds the target's, which
    is the established behaviour. ``textbook`` fires in the published direction.
    """
    values = stable.select("layer", "instability")
    placed = _with_tiers(edges, tiers).drop("tier", "dep_tier")
    if exceptions is not None:
        placed = placed.join(exceptions.select("source", "target").distinct(), ["source", "target"], "left_anti")
    rated = placed.join(values.toDF("source", "instability"), "source", "left").join(
        values.toDF("target", "dep_instability"), "target", "left"
    ).na.fill(0.0, ["instability", "dep_instability"])
    i, d = F.col("instability"), F.col("dep_instability")
    broken = (d > i + F.lit(tolerance)) if textbook else (i > d + F.lit(tolerance))
    return rated.where(broken).select(
        F.lit(SDP).alias("rule"), F.col("source").alias("layer"), F.col("target").alias("dependency"),
        F.lit("error").alias("severity"), "instability", "dep_instability",
        F.concat(
            F.lit("import from "), F.col("source"), F.lit(" to "), F.col("target"), F.lit(": instability "), i.cast("string"),
            F.lit(" meets "), d.cast("string"), F.lit(f"; the {'target' if textbook else 'source'} is the less stable side by "),
            round_binary(F.abs(i - d), 2).cast("string"), F.lit(f" where {float(tolerance)} is allowed"),
        ).alias("message"),
    )


def slp_violations(edges: DataFrame, tiers: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Edges that jump over at least one tier, with the severity ladder."""
    table = (
        tiers.select("layer", "tier")
        .join(interfaces.select("layer").distinct().withColumn("is_interface", F.lit(True)), "layer", "left")
        .na.fill(False, ["is_interface"])
    )
    everything = table.agg(
        F.array_sort(F.collect_list(F.struct("tier", "layer", "is_interface"))).alias("a")
    ).scalar()
    facing = table.where("is_interface").select(F.col("layer").alias("target"), F.lit(True).alias("_to_interface"))
    s, t = F.col("tier"), F.col("dep_tier")
    found = (
        _with_tiers(edges, tiers)
        .where(t - s - 1 >= 1)
        .join(facing, "target", "left")
        .withColumn("_all", everything)
        .withColumn("_skipped", F.filter("_all", lambda x: (x["tier"] > s) & (x["tier"] < t)))
    )
    severity = (
        F.when(F.col("_to_interface"), "warning")
        .when(F.exists("_skipped", lambda x: x["is_interface"]), "error")
        .when(t - s - 1 >= 2, "error")
        .otherwise("warning")
    )
    names = F.array_join(F.transform("_skipped", lambda x: F.concat(F.lit("'"), x["layer"], F.lit("'"))), ", ")
    return found.select(
        F.lit(SLP).alias("rule"), F.col("source").alias("layer"), F.col("target").alias("dependency"), severity.alias("severity"),
        s.cast("long").alias("tier"), t.cast("long").alias("dep_tier"), (t - s - 1).cast("long").alias("skip_distance"),
        F.sequence(s + 1, t - 1).alias("skipped_tiers"),
        F.concat(
            F.lit("import from "), F.col("source"), F.lit(" to "), F.col("target"), F.lit(" goes from tier "), s.cast("string"),
            F.lit(" to tier "), t.cast("string"), F.lit(" and leaves out "), names,
        ).alias("message"),
    )


def layer_cycles(edges: DataFrame) -> DataFrame:
    """One row per strongly connected set of two or more layers, named by its sorted members.

    The members come from the configuration's layer list, which bounds the name.
    """
    members = strong_components(edges)
    return members.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("members")).where(
        F.size("members") >= 2
    ).select(
        F.array_join("members", "__").alias("cycle_id"),
        F.col("members")[0].alias("from_layer"),
        F.element_at("members", -1).alias("to_layer"),
        F.size("members").cast("long").alias("cycle_size"),
        "members",
    )


def broken_pairs(broken_imports: DataFrame) -> DataFrame:
    """Resolved broken imports folded to one row per layer pair: their number and the first contract.

    Both the counters and the events need no more than this, and it is as small as the layer list squared.
    """
    return broken_imports.groupBy("from_layer", "to_layer").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("contract_name", "seq").alias("contract_name")
    )


def layer_counters(layers: DataFrame, violations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Layers with their SDP, SLP and broken-import counts; ``pairs`` are folded broken imports."""
    rules = violations.groupBy("layer").agg(
        F.count_if(F.col("rule") == SDP).alias("sdp_violations"), F.count_if(F.col("rule") == SLP).alias("slp_violations")
    )
    broken = pairs.groupBy(F.col("from_layer").alias("layer")).agg(F.sum("n").alias("broken_imports"))
    return layers.join(rules, "layer", "left").join(broken, "layer", "left").na.fill(
        0, ["sdp_violations", "slp_violations", "broken_imports"]
    )


def resolve_broken_imports(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Contract rows with both ends resolved; rows inside one layer or without a layer drop out."""
    named = resolve(resolve(rows, "importer", prefixes, "longest", "from_layer"), "imported", prefixes, "longest", "to_layer")
    return named.where(
        F.col("from_layer").isNotNull() & F.col("to_layer").isNotNull() & (F.col("from_layer") != F.col("to_layer"))
    )


def attach_tier(layers: DataFrame, tiers: DataFrame, utility: DataFrame) -> DataFrame:
    """Add ``tier`` and ``is_utility``; utility layers have no tier."""
    marked = layers.join(utility.select("layer").distinct().withColumn("is_utility", F.lit(True)), "layer", "left").na.fill(
        False, ["is_utility"]
    )
    return marked.join(tiers.select("layer", F.col("tier").alias("_t")), "layer", "left").withColumn(
        "tier", F.when(~F.col("is_utility"), F.col("_t"))
    ).drop("_t")
