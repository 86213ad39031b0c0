"""Seven class rules over method facts, and the candidates they lead to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.names import is_excluded_path
from codestrata.operators.classfacts import CLASS, METHOD, interface_links, overrides

# Parents whose constructor need not be called; thresholds; rule order and rank.
CONSTRUCTOR_FREE_PARENTS = ("object", "ABC", "Protocol", "TypedDict", "NamedTuple", "BaseModel")
MIN_TYPE_BRANCHES = 3
MIN_DISPATCH_CC = 5
RULE_ORDER = ("LSP-H-001", "LSP-H-002", "LSP-H-004", "OCP-H-001", "OCP-H-002", "OCP-H-004", "LSP-H-003")
RULE_RANK = {"OCP-H-001": 2, "OCP-H-004": 1, "LSP-H-001": 2, "LSP-H-002": 1}

_ADVICE = {
    "LSP-H-001": ("The override refuses the call that its parent accepts.", "Implement the method or drop the inheritance."),
    "LSP-H-002": ("The override does nothing where its parent promises work.", "Implement the method or refuse the call openly."),
    "LSP-H-003": ("The method asks for the concrete type of a parameter declared as a project base type.", "Move the branches into methods of the base type."),
    "LSP-H-004": ("The constructor leaves the parent's part of the object unset.", "Call the parent constructor first."),
    "OCP-H-001": ("A chain of type checks must grow with every new type.", "Replace the chain with a method of the types."),
    "OCP-H-002": ("A match over types must grow with every new type.", "Replace the match with a method of the types."),
    "OCP-H-004": ("A complex method also dispatches on types.", "Move the type-specific parts into the types."),
}


# Kinds of syntax rows that the facts below every rule read, and those of one rule. None of them reads a text.
_FACT_KINDS = ("class", "base", "class_decorator", "class_body", "class_attr", "alias", "method", "decorator", "body", "call")
_RULE_KINDS = {"LSP-H-001": "raise", "LSP-H-003": "arg", "OCP-H-001": "if", "OCP-H-002": "type_case", "OCP-H-004": "branch"}


def kinds(*rules: str) -> tuple[str, ...]:
    """The kinds of syntax rows that ``findings`` of these rules come from."""
    return (*_FACT_KINDS, *(_RULE_KINDS[r] for r in rules if r in _RULE_KINDS))


def scope(project: DataFrame, patterns: tuple[str, ...] | None = None, keep_dynamic: bool = False) -> DataFrame:
    """Project classes the rules look at: right path, known parents, a role that holds behaviour."""
    kept = project.where(~is_excluded_path(F.col("path"), patterns))
    if not keep_dynamic:
        kept = kept.where(~F.array_contains("bases", "<dynamic>"))
    return kept.where(F.col("class_role") == "DOMAIN")


def findings(rows: DataFrame, project: DataFrame, methods: DataFrame, patterns: tuple[str, ...] | None = None, keep_dynamic: bool = False) -> DataFrame:
    """All rule findings with ``emit`` as their order inside a class."""
    classes = scope(project, patterns, keep_dynamic).select(
        *CLASS, "class_name", "bases", "abstract_methods", "known_interface", "any_dataclass", "place"
    )
    inside = methods.where("top").join(classes, CLASS)
    overridden = overrides(project, methods)
    # An abstract class may leave methods open.
    abstract = F.array_contains("bases", "ABC") | F.col("known_interface") | (F.col("abstract_methods") > 0)
    overriding = inside.where(~abstract).join(overridden, [*CLASS, "method_name"], "left_semi")
    in_top = rows.where("top and meth <> -1")
    isinstance_call = in_top.where("kind = 'call' and form = 'name' and name = 'isinstance'")

    refused = _found(overriding.where("raises_unsupported"), "LSP-H-001", F.concat(F.lit("Override '"), "method_name", F.lit("' raises NotImplementedError")))
    hollow = _found(
        overriding.where("statements = 1 and (passes = 1 or texts = 1)"), "LSP-H-002",
        F.concat(F.lit("Override '"), "method_name", F.lit("' is empty ("), F.when(F.col("passes") == 1, "pass").otherwise("docstring only"), F.lit(")")),
    )

    known = project.select(F.col("class_name").alias("base")).distinct()
    typed = in_top.where("kind = 'arg' and form = 'args' and name not in ('self', 'cls') and base is not null").join(known, "base", "left_semi").select(
        *METHOD, F.col("name").alias("text")
    )
    asked = isinstance_call.where("pos >= 1").join(typed, [*METHOD, "text"], "left_semi")
    checked = _found(
        inside.join(asked.select(*METHOD).distinct(), METHOD, "left_semi"), "LSP-H-003",
        F.concat(F.lit("Method '"), "method_name", F.lit("' checks the concrete type of a base-typed parameter")),
    )

    pure = project.where("class_role = 'PURE_INTERFACE'").select(F.col("class_name").alias("base"))
    free = F.array(*[F.lit(p) for p in CONSTRUCTOR_FREE_PARENTS])
    under_interface = classes.select(*CLASS, F.explode("bases").alias("base")).where(~F.array_contains(free, F.col("base"))).join(pure, "base", "left_semi").select(*CLASS).distinct()
    unset = _found(
        inside.where("not any_dataclass and method_name = '__init__' and not is_async and not calls_super_init")
        .where(F.size(F.array_except("bases", free)) > 0).join(under_interface, CLASS, "left_anti"),
        "LSP-H-004", F.concat(F.lit("__init__ of '"), "class_name", F.lit("' does not call super().__init__()")),
    )

    chains = in_top.where("kind = 'if'").groupBy(*METHOD, "link").agg(F.count(F.lit(1)).alias("length"), F.min(F.struct("depth", "node")).alias("at"))
    checks = isinstance_call.where("link is not null").groupBy(*METHOD, "link").agg(F.countDistinct("num").alias("checks"))
    first_chain = chains.join(checks, [*METHOD, "link"]).where(F.col("checks") >= MIN_TYPE_BRANCHES).groupBy(*METHOD).agg(
        F.min_by(F.struct("checks", "length"), "at").alias("chain")
    )
    chained = _found(
        inside.join(first_chain, METHOD), "OCP-H-001",
        F.concat(F.lit("Method '"), "method_name", F.lit("' has a type chain of "), F.col("chain.checks").cast("string"), F.lit(" checks in "), F.col("chain.length").cast("string"), F.lit(" branches")),
    )

    cases = in_top.where("kind = 'type_case'").groupBy(*METHOD, "link").agg(F.count(F.lit(1)).alias("cases"), F.min(F.struct("depth", "node")).alias("at"))
    first_match = cases.where(F.col("cases") >= MIN_TYPE_BRANCHES).groupBy(*METHOD).agg(F.min_by("cases", "at").alias("cases"))
    matched = _found(
        inside.join(first_match, METHOD), "OCP-H-002",
        F.concat(F.lit("Method '"), "method_name", F.lit("' matches over "), F.col("cases").cast("string"), F.lit(" types")),
    )
    mixed = _found(
        inside.where((F.col("cc") >= MIN_DISPATCH_CC) & F.col("own_isinstance")), "OCP-H-004",
        F.concat(F.lit("Method '"), "method_name", F.lit("' has complexity "), F.col("cc").cast("string"), F.lit(" and checks types")),
    )
    return reduce(DataFrame.unionByName, (refused, hollow, unset, chained, matched, mixed, checked))


def _found(methods: DataFrame, rule: str, message: Column) -> DataFrame:
    explanation, suggestion = _ADVICE[rule]
    return methods.select(
        F.lit(rule).alias("rule"), F.lit(rule[:3]).alias("principle"), *CLASS, "class_name", "method_name", "meth", "place",
        F.lit("warning").alias("severity"), F.lit("heuristic").alias("source"), message.alias("message"),
        F.lit(explanation).alias("explanation"), F.lit(suggestion).alias("suggestion"),
        F.struct(F.lit(RULE_ORDER.index(rule)).alias("rule"), "meth").alias("emit"),
    )


def rule_rank(rule: Column) -> Column:
    rank = F.lit(0)
    for name, value in RULE_RANK.items():
        rank = F.when(rule == name, value).otherwise(rank)
    return rank


def merge_findings(found: DataFrame) -> DataFrame:
    """One finding per (file, class, method): the highest rank wins, then the first emitted.

    The other rules are named in the winner's explanation. Principles do not
    separate groups, so one rule may stand in for another's principle.
    """
    keys = ["path", "class_name", "method_name"]
    rest = [c for c in found.columns if c not in keys]
    groups = found.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct((-rule_rank(F.col("rule"))).alias("r"), "emit")).alias("w"), F.collect_set("rule").alias("rules")
    )
    others = F.array_sort(F.array_except("rules", F.array(F.col("w.rule"))))
    suffix = F.when(F.size(others) > 0, F.concat(F.lit(" Also detected: "), F.array_join(others, ", "), F.lit("."))).otherwise("")
    return groups.select(
        *keys, *[F.col(f"w.{c}").alias(c) for c in rest if c != "explanation"], F.concat(F.coalesce("w.explanation", F.lit("")), suffix).alias("explanation")
    )


def candidate_type(has_ocp: Column, has_lsp: Column, has_hierarchy: Column) -> Column:
    return F.when(has_ocp & has_lsp, "both").when(has_lsp, "lsp").when(has_ocp, "ocp").when(has_hierarchy, "both").otherwise("ocp")


def candidate_priority(reasons: Column, depth: Column, interfaces: Column) -> Column:
    return (reasons * 2 + depth + interfaces).cast("long")


def candidates(project: DataFrame, found: DataFrame, patterns: tuple[str, ...] | None = None, keep_dynamic: bool = False) -> DataFrame:
    """Classes with a finding or a parent. ``found`` are the findings before merging."""
    reasons = found.groupBy(*CLASS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("emit", "rule"))), lambda x: x["rule"]).alias("reasons")
    )
    links = interface_links(project).groupBy("class_name").agg(F.countDistinct("interface").alias("interfaces"))
    joined = (
        scope(project, patterns, keep_dynamic).select(*CLASS, "class_name", "bases", "place")
        .join(reasons, CLASS, "left").join(links, "class_name", "left").na.fill(0, ["interfaces"])
        .withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    )
    hierarchy = (F.size("bases") > 0) | (F.col("interfaces") > 0)
    kept = joined.where((F.size("reasons") > 0) | hierarchy)
    has = lambda p: F.exists("reasons", lambda r: F.contains(r, F.lit(p)))
    return kept.select(
        *CLASS, "class_name", "place", "reasons", candidate_type(has("OCP"), has("LSP"), hierarchy).alias("candidate_type"),
        candidate_priority(F.size("reasons"), F.size("bases"), F.col("interfaces")).alias("priority"),
    )


def merge_candidates(rows: DataFrame) -> DataFrame:
    """Candidates folded on (path, class): reasons united, highest priority, mixed types become ``both``.

    Reasons are made distinct before they are collected, so a group holds at
    most the known rules. A lone candidate keeps its reasons as they are. Where
    rows know the place of their class, the first one's stands.
    """
    keys = ["path", "class_name"]
    placed = [F.min_by("cls", "place").alias("cls"), F.min("place").alias("place")] if {"cls", "place"} <= set(rows.columns) else []
    heads = rows.groupBy(*keys).agg(
        F.max("priority").alias("priority"), F.min("candidate_type").alias("lo"), F.max("candidate_type").alias("hi"),
        F.count(F.lit(1)).alias("n"), F.min("reasons").alias("only"), *placed,
    )
    united = rows.select(*keys, F.explode("reasons").alias("r")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("all"))
    merged = F.when(F.col("n") > 1, F.coalesce("all", F.array().cast("array<string>"))).otherwise(F.col("only"))
    return heads.join(united, keys, "left").select(
        *keys, merged.alias("reasons"), "priority", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("both").alias("candidate_type"),
        *(["cls", "place"] if placed else []),
    )
