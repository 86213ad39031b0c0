"""Violation events: fourteen emitters, the layer merge, the duplicate merge.

All emitters return one schema. ``details`` is JSON text; ``seq`` keeps the
emission order (stream number, then position) that the merge depends on.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.names import event_id, last_name, path_to_module
from codestrata.operators.layers import SDP, SLP, resolve
from codestrata.operators.relations import CC_ERROR, CC_LIMIT, LCOM4_LIMIT, LOW_MI_RANKS
from codestrata.session import cut_lineage

# Bits of the filter that leads to the events of a merge.
PLACES = 1 << 25

EVENT_SCHEMA = (
    "id string, type string, severity string, strength string, "
    "location struct<filepath:string,lineno:bigint,name:string,class_name:string,layer:string,from_layer:string,to_layer:string>, "
    "metrics struct<cc:bigint,rank:string,parameter_count:bigint,mi:double,lcom4:double,instability:double,"
    "dep_instability:double,skip_distance:bigint>, "
    "evidence array<struct<source:string,details:string>>, seq struct<stream:int,pos:bigint>"
)
_LOCATION = {
    "filepath": "string", "lineno": "bigint", "name": "string", "class_name": "string", "layer": "string",
    "from_layer": "string", "to_layer": "string",
}
_METRICS = {
    "cc": "bigint", "rank": "string", "parameter_count": "bigint", "mi": "double", "lcom4": "double",
    "instability": "double", "dep_instability": "double", "skip_distance": "bigint",
}
STREAMS = (
    "HIGH_CC_METHOD", "LOW_MI_FILE", "LOW_COHESION_CLASS", "DEAD_CODE_NODE", "IMPORT_CYCLE", "LAYER_VIOLATION",
    "OVERLOADED_CLASS", "DEAD_CODE_RISK", "DEAD_LAYER_NODE", "UNSTABLE_COHESION_LAYER", "LOW_MI_VIOLATING_LAYER",
    "LOW_COHESION_CONTRACT_LAYER",
)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 2).when(severity == "warning", 1).otherwise(0)


def _record(fields: dict[str, str], given: dict[str, Column | str]) -> Column:
    values = {k: (F.col(v) if isinstance(v, str) else v) for k, v in given.items()}
    return F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in fields.items()])


def evidence(source: str, keep_null: bool = True, **details: Column | str) -> Column:
    columns = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in details.items()]
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false" if keep_null else "true"})
    return F.struct(F.lit(source).alias("source"), body.alias("details"))


def _event(
    df: DataFrame, kind: str, parts: list[Column | str], severity: Column, strength: Column | str,
    location: dict, metrics: dict, found: Column, stream: str | None = None,
) -> DataFrame:
    position = F.col("seq").cast("long") if "seq" in df.columns else F.lit(0).cast("long")
    return df.select(
        event_id(kind, *parts).alias("id"),
        F.lit(kind).alias("type"),
        severity.alias("severity"),
        (F.lit(strength) if isinstance(strength, str) else strength).alias("strength"),
        _record(_LOCATION, location).alias("location"),
        _record(_METRICS, metrics).alias("metrics"),
        found.alias("evidence"),
        F.struct(F.lit(STREAMS.index(stream or kind)).alias("stream"), position.alias("pos")).alias("seq"),
    )


def _error_if(condition: Column) -> Column:
    return F.when(condition, "error").otherwise("warning")


def low_cohesion(classes: DataFrame, limit: int = LCOM4_LIMIT) -> DataFrame:
    return classes.where(~F.col("excluded") & (F.col("lcom4") > limit))


def _cohesion_evidence() -> Column:
    return evidence(
        "cohesion", cohesion_score="lcom4", cohesion_score_norm="lcom4_norm", methods_count="methods_count", class_kind="class_kind"
    )


def high_cc(functions: DataFrame) -> DataFrame:
    owner = F.element_at(F.split("class_id", "::"), -1) if "class_id" in functions.columns else F.lit(None)
    return _event(
        functions.where(F.col("cc") > CC_LIMIT), "HIGH_CC_METHOD", ["filepath", "lineno", "name"], _error_if(F.col("cc") > CC_ERROR), "weak",
        {"filepath": "filepath", "lineno": "lineno", "name": "name", "class_name": owner},
        {"cc": "cc", "rank": "rank", "parameter_count": "parameter_count"},
        F.array(evidence("radon", complexity="cc", rank="rank", type="type", lineno="lineno")),
    )


def low_mi(files: DataFrame) -> DataFrame:
    return _event(
        files.where(F.col("mi_rank").isin(*LOW_MI_RANKS)), "LOW_MI_FILE", ["filepath"], _error_if(F.col("mi_rank") == "C"), "weak",
        {"filepath": "filepath"}, {"mi": "mi", "rank": "mi_rank"},
        F.array(evidence("radon", mi="mi", rank="mi_rank", filepath="filepath")),
    )


def low_cohesion_events(classes: DataFrame, limit: int = LCOM4_LIMIT) -> DataFrame:
    return _event(
        low_cohesion(classes, limit), "LOW_COHESION_CLASS", ["filepath", "class_name"], _error_if(F.col("lcom4") >= 3), "weak",
        {"filepath": "filepath", "lineno": "lineno", "class_name": "class_name"}, {"lcom4": "lcom4"}, F.array(_cohesion_evidence()),
    )


def dead_code(dead: DataFrame) -> DataFrame:
    return _event(
        dead, "DEAD_CODE_NODE", ["qualified_name"], _error_if(F.col("confidence") == "high"), "weak",
        {"filepath": "filepath", "name": "qualified_name", "layer": "layer"}, {},
        F.array(evidence("pyan3", qualified_name="qualified_name", confidence="confidence")),
    )


def import_cycles(cycles: DataFrame) -> DataFrame:
    return _event(
        cycles, "IMPORT_CYCLE", ["cycle_id"], F.lit("error"), "weak", {"from_layer": "from_layer", "to_layer": "to_layer"}, {},
        F.array(evidence("import_graph", cycle_nodes="members", cycle_size="cycle_size")),
    )


def merge_layer_violations(violations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Join contract rows, SDP rows and SLP rows on the layer pair, then emit.

    ``violations`` carries both rules and a ``seq``; ``pairs`` are the folded broken
    imports. The event holds their number, so no event grows with the data; the
    imports themselves are a relation of their own.
    """
    pair = ["from_layer", "to_layer"]
    contract = pairs.select(*pair, F.struct("n", "contract_name").alias("linter"))
    rows = violations.where((F.col("layer") != "") & (F.col("dependency") != "")).withColumnsRenamed(
        {"layer": "from_layer", "dependency": "to_layer"}
    )
    details = F.struct("rule", "severity", "instability", "dep_instability", "skip_distance", "tier", "dep_tier")
    sdp = rows.where(F.col("rule") == SDP).groupBy(*pair).agg(F.max_by(details, F.col("seq")).alias("sdp"))
    worst = F.struct(F.coalesce("skip_distance", F.lit(0)), -F.col("seq"))
    slp = rows.where(F.col("rule") == SLP).groupBy(*pair).agg(F.max_by(details, worst).alias("slp"))
    merged = contract.join(sdp, pair, "full_outer").join(slp, pair, "full_outer")

    def graph(side: str) -> Column:
        names = ("rule", "severity", "instability", "dep_instability", "skip_distance", "tier", "dep_tier")
        return evidence("import_graph", False, **{n: F.col(f"{side}.{n}") for n in names})

    has, s, p = F.col("linter").isNotNull(), F.col("sdp").isNotNull(), F.col("slp").isNotNull()
    with_contract = merged.where(has)
    graph_severity = F.coalesce("sdp.severity", "slp.severity", F.lit("error"))
    contract_evidence = evidence("import_linter", contract_name="linter.contract_name", broken_imports_count="linter.n")
    strong = _event(
        with_contract, "LAYER_VIOLATION", pair, _error_if(severity_rank(graph_severity) >= 1), F.when(s | p, "strong").otherwise("weak"),
        {"from_layer": "from_layer", "to_layer": "to_layer"},
        {"instability": "sdp.instability", "dep_instability": "sdp.dep_instability", "skip_distance": "slp.skip_distance"},
        F.array_compact(F.array(contract_evidence, F.when(s, graph("sdp")), F.when(p, graph("slp")))),
    )
    alone = merged.where(~has)
    only_sdp = _event(
        alone.where(s), "SDP_VIOLATION", pair, F.col("sdp.severity"), "weak", {"from_layer": "from_layer", "to_layer": "to_layer"},
        {"instability": "sdp.instability", "dep_instability": "sdp.dep_instability"}, F.array(graph("sdp")), "LAYER_VIOLATION",
    )
    only_slp = _event(
        alone.where(p), "SLP_VIOLATION", pair, F.col("slp.severity"), "weak", {"from_layer": "from_layer", "to_layer": "to_layer"},
        {"skip_distance": "slp.skip_distance"}, F.array(graph("slp")), "LAYER_VIOLATION",
    )
    return strong.unionByName(only_sdp).unionByName(only_slp)


def overloaded(classes: DataFrame, limit: int = LCOM4_LIMIT) -> DataFrame:
    """Low-cohesion classes with a complex method; ``classes`` carry their method statistics."""
    found = low_cohesion(classes, limit).where(F.col("high_cc_methods") > 0)
    return _event(
        found, "OVERLOADED_CLASS", ["filepath", "class_name"], _error_if((F.col("lcom4") >= 3) & (F.col("max_method_cc") > CC_ERROR)), "strong",
        {"filepath": "filepath", "lineno": "lineno", "class_name": "class_name"}, {"lcom4": "lcom4", "cc": "max_method_cc"},
        F.array(
            _cohesion_evidence(),
            evidence(
                "radon", max_cc_method_name="top_method.name", max_complexity="max_method_cc", max_cc_method_lineno="top_method.lineno",
                mean_cc_in_class="mean_method_cc", high_cc_methods_count="high_cc_methods",
            ),
        ),
    )


def _dead_evidence() -> Column:
    return evidence("pyan3", qualified_name="qualified_name", confidence="confidence")


def dead_risk(dead: DataFrame, functions: DataFrame) -> DataFrame:
    """Dead entries that are complex functions.

    Of functions sharing file and name the one listed last counts. Complexity
    rows are listed from the highest value down, so that is the simplest one.
    """
    order = F.struct(-F.col("cc"), "lineno", "function_id")
    by_place = functions.groupBy("filepath", "name").agg(F.max_by(F.struct("function_id", "cc", "rank", "lineno"), order).alias("fn"))
    found = dead.withColumn("name", last_name(F.col("qualified_name"))).join(by_place, ["filepath", "name"]).where(F.col("fn.cc") > CC_LIMIT)
    return _event(
        found, "DEAD_CODE_RISK", ["qualified_name"], F.lit("error"), "strong",
        {"filepath": "filepath", "name": "qualified_name", "layer": "layer"}, {"cc": "fn.cc", "rank": "fn.rank"},
        F.array(_dead_evidence(), evidence("radon", function_id="fn.function_id", cc="fn.cc", rank="fn.rank", lineno="fn.lineno")),
    )


def dead_layer(dead: DataFrame, layers: DataFrame) -> DataFrame:
    troubled = layers.where("sdp_violations > 0 or slp_violations > 0 or broken_imports > 0")
    return _event(
        dead.join(troubled, "layer"), "DEAD_LAYER_NODE", ["qualified_name"], _error_if(F.col("confidence") == "high"), "strong",
        {"filepath": "filepath", "name": "qualified_name", "layer": "layer"}, {"instability": "instability"},
        F.array(
            _dead_evidence(),
            evidence(
                "import_graph", layer="layer", sdp_violation_count="sdp_violations", slp_violation_count="slp_violations",
                linter_broken_imports="broken_imports",
            ),
        ),
    )


def with_layer(df: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The layer of each row's file, by longest prefix of its module name."""
    return resolve(df.withColumn("_module", path_to_module(F.col("filepath"))), "_module", prefixes, "longest").drop("_module")


def unstable_layer(layers: DataFrame, classes: DataFrame, limit: int = LCOM4_LIMIT) -> DataFrame:
    """``classes`` carry their ``layer``."""
    worst = low_cohesion(classes, limit).where(F.col("layer").isNotNull()).groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("lcom4", "class_name", "filepath"), F.struct(-F.col("lcom4"), "filepath", "class_name")).alias("worst"),
    )
    found = layers.where("sdp_violations > 0").join(worst, "layer")
    return _event(
        found, "UNSTABLE_COHESION_LAYER", ["layer"], F.lit("error"), "strong", {"layer": "layer"},
        {"lcom4": "worst.lcom4", "instability": "instability"},
        F.array(
            evidence(
                "cohesion", low_cohesion_class_count="n", worst_class_name="worst.class_name", worst_class_lcom4="worst.lcom4",
                worst_class_filepath="worst.filepath",
            ),
            evidence("import_graph", layer="layer", sdp_violation_count="sdp_violations", instability="instability"),
        ),
    )


def _broken(layers: DataFrame) -> DataFrame:
    return layers.where("broken_imports > 0").select("layer", "broken_imports")


def low_mi_layer(files: DataFrame, layers: DataFrame) -> DataFrame:
    """``files`` carry their ``layer``."""
    found = files.where(F.col("mi_rank").isin(*LOW_MI_RANKS)).join(_broken(layers), "layer")
    return _event(
        found, "LOW_MI_VIOLATING_LAYER", ["filepath"], _error_if(F.col("mi_rank") == "C"), "strong",
        {"filepath": "filepath", "layer": "layer"}, {"mi": "mi", "rank": "mi_rank"},
        F.array(
            evidence("radon", filepath="filepath", mi="mi", rank="mi_rank"),
            evidence("import_linter", layer="layer", linter_broken_imports="broken_imports"),
        ),
    )


def low_cohesion_layer(classes: DataFrame, layers: DataFrame, limit: int = LCOM4_LIMIT) -> DataFrame:
    """``classes`` carry their ``layer``."""
    found = low_cohesion(classes, limit).join(_broken(layers), "layer")
    return _event(
        found, "LOW_COHESION_CONTRACT_LAYER", ["filepath", "class_name"], _error_if(F.col("lcom4") >= 3), "strong",
        {"filepath": "filepath", "lineno": "lineno", "class_name": "class_name", "layer": "layer"}, {"lcom4": "lcom4"},
        F.array(_cohesion_evidence(), evidence("import_linter", layer="layer", linter_broken_imports="broken_imports")),
    )


def concat_events(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _place(seq: Column) -> Column:
    """``seq`` as one number in the same order, nulls first: hash aggregates keep numbers, not structs."""
    stream = F.coalesce(seq["stream"], F.lit(-1)).cast("decimal(10,0)")
    pos = F.coalesce(seq["pos"].cast("decimal(20,0)") + F.lit(Decimal(2**63 + 1)), F.lit(Decimal(0)))
    return (stream * F.lit(Decimal(2**65)) + pos).cast("decimal(38,0)")


def _at_places(events: DataFrame, least: DataFrame) -> DataFrame:
    """The events at an id's ``place`` in ``least``, and a few more: a filter of at most ``PLACES`` bits, whatever the number of ids."""
    words = least.select(F.pmod(F.xxhash64("id", "place"), F.lit(PLACES)).alias("p"))
    bits = words.groupBy(F.floor(F.col("p") / 64).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_b"))
    at = F.pmod(F.xxhash64("id", _place(F.col("seq"))), F.lit(PLACES))
    held = events.withColumn("_p", at).withColumn("_w", F.floor(F.col("_p") / 64)).join(F.broadcast(bits), "_w")
    return held.where(F.getbit("_b", F.pmod("_p", F.lit(64)).cast("int")) == 1).select(*events.columns)


def merge_shared(events: DataFrame) -> DataFrame:
    """Merge events that share an id; an event whose id is its own stays as it is and meets no other.

    Ids are counted alone first. A filter of at most ``PLACES`` bits then leads the events whose id may be shared to the merge.
    """
    shared = cut_lineage(events.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    place = F.pmod(F.xxhash64("id"), F.lit(PLACES))
    bits = shared.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_b"))
    led = events.withColumn("_p", place).withColumn("_w", F.floor(F.col("_p") / 64)).join(F.broadcast(bits), "_w", "left")
    several = F.coalesce(F.getbit("_b", F.pmod("_p", F.lit(64)).cast("int")), F.lit(0)) == 1
    led = cut_lineage(led.select(*events.columns, several.alias("_several")))
    alone = led.where("not _several").drop("_several").withColumn("severity", _severity(severity_rank(F.col("severity"))))
    met = merge_duplicates(led.where("_several").drop("_several"))
    return alone.select(*met.columns).unionByName(met)


def _severity(rank: Column) -> Column:
    return F.when(rank == 2, "error").when(rank == 1, "warning").otherwise("info")


def merge_duplicates(events: DataFrame) -> DataFrame:
    """Merge events that share an id.

    The first event supplies the fields. Later evidence joins in order when its
    source is new. Severity is the highest seen. Strength turns strong when a
    merged event ends up with two pieces of evidence. Evidence is cut to one row
    per source before it is collected, so a group's size is the number of tools.

    Spark sorts what it takes the least struct of. So places are found as plain
    numbers first, and only the events at a least place are merged as a whole.
    """
    told = events.select("id", severity_rank(F.col("severity")).alias("rank"), _place(F.col("seq")).alias("place"), F.posexplode_outer("evidence").alias("at", "item"))
    least = cut_lineage(told.groupBy("id", F.col("item.source").alias("source")).agg(
        F.min("place").alias("place"), F.max("rank").alias("rank"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("n")
    ))
    groups = least.groupBy(F.col("id").alias("_id")).agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))
    picked = cut_lineage(_at_places(events, least))
    first = picked.groupBy("id").agg(F.min_by(F.struct("type", "strength", "location", "metrics", "evidence", "seq"), "seq").alias("e"))
    first = first.join(groups, F.col("id").eqNullSafe(F.col("_id"))).drop("_id")
    offered = picked.select("id", "seq", F.posexplode("evidence").alias("at", "item"))
    place = F.struct("seq", "at")
    per_source = offered.groupBy("id", F.col("item.source").alias("source")).agg(
        F.min(place).alias("place"), F.min_by("item", place).alias("item")
    )
    pool = per_source.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("pool"))
    known = F.transform("e.evidence", lambda x: x["source"])
    fresh = F.transform(F.filter("pool", lambda x: ~F.array_contains(known, x["item"]["source"])), lambda x: x["item"])
    joined = first.join(pool, "id", "left").withColumn("evidence", F.concat("e.evidence", F.coalesce(fresh, F.array().cast("array<struct<source:string,details:string>>"))))
    merged = F.col("n") > 1
    return joined.select(
        "id", F.col("e.type").alias("type"),
        _severity(F.col("rank")).alias("severity"),
        F.when(merged & (F.size("evidence") >= 2), "strong").otherwise(F.col("e.strength")).alias("strength"),
        F.col("e.location").alias("location"), F.col("e.metrics").alias("metrics"), "evidence", F.col("e.seq").alias("seq"),
    )


def in_report_order(events: DataFrame) -> DataFrame:
    return events.orderBy(severity_rank(F.col("severity")).desc(), "type", "seq", "id")
