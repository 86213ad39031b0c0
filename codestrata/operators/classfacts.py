"""Class and method facts as groupings over syntax rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.names import path_to_module
from codestrata.operators.cohesion import lcom4
from codestrata.operators.relations import lcom4_normalised
from codestrata.session import cut_lineage, merged

CLASS = ["path", "cls"]
METHOD = ["path", "cls", "meth"]

# Base and field names that decide a class's kind and role.
DATA_BASES = ("BaseModel", "Base", "DeclarativeBase", "DeclarativeBaseNoMeta")
ABSTRACT_BASES = ("ABC", "Protocol", "ABCMeta")
INTERFACE_BASES = ("ABC", "Protocol")
INFRA_BASES = ("BaseModel", "GenericModel", "BaseSettings", "DeclarativeBase", "DeclarativeBaseNoMeta", "MappedAsDataclass")
CONFIG_BASES = ("BaseSettings", "Settings", "Config", "AppConfig", "BaseConfig")
ORM_FIELDS = ("Column", "Field", "relationship", "Mapped", "mapped_column")


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def method_facts(rows: DataFrame) -> DataFrame:
    """One row per method definition, in one grouping over all rows inside methods."""
    body = _is("body")
    opening_text = body & (F.col("pos") == 0) & (F.col("name") == "text")
    stub = F.col("name").isin("pass", "ellipsis", "unsupported")
    decorated = _is("decorator")
    isinstance_call = _is("call") & (F.col("form") == "name") & (F.col("name") == "isinstance")
    head = _is("method")
    facts = rows.where("meth <> -1").groupBy(*METHOD).agg(
        F.max(F.when(head, F.col("name"))).alias("method_name"),
        F.max(F.when(head, F.col("line"))).alias("lineno"),
        F.bool_or(F.col("top")).alias("top"),
        F.coalesce(F.bool_or(head & (F.col("form") == "async")), F.lit(False)).alias("is_async"),
        F.coalesce(F.bool_or(decorated & (F.col("text") == "property")), F.lit(False)).alias("is_property"),
        F.coalesce(F.bool_or(decorated & (F.col("text") == "staticmethod")), F.lit(False)).alias("is_static"),
        F.coalesce(F.bool_or(decorated & (F.col("text") == "classmethod")), F.lit(False)).alias("is_class_method"),
        F.coalesce(F.bool_or(decorated & (F.col("name") == "abstractmethod") & F.col("form").isin("name", "attr")), F.lit(False)).alias("is_abstract"),
        F.count_if(body).alias("statements"),
        F.count_if(body & (stub | (F.col("name") == "text"))).alias("empty_statements"),
        F.count_if(opening_text).alias("opening_text"),
        F.count_if(body & stub & ~opening_text).alias("stubs"),
        F.count_if(body & (F.col("name") == "pass")).alias("passes"),
        F.count_if(body & (F.col("name") == "text")).alias("texts"),
        F.coalesce(F.bool_or(_is("raise") & (F.col("name") == "NotImplementedError")), F.lit(False)).alias("raises_unsupported"),
        F.coalesce(F.bool_or(isinstance_call & F.col("own")), F.lit(False)).alias("own_isinstance"),
        (F.lit(1) + F.coalesce(F.sum(F.when(_is("branch") & F.col("own"), F.col("num"))), F.lit(0))).alias("cc"),
        F.coalesce(F.bool_or(_is("call") & (F.col("form") == "super") & (F.col("name") == "__init__")), F.lit(False)).alias("calls_super_init"),
        F.coalesce(F.max(F.when(head, F.col("num"))), F.lit(0)).cast("long").alias("parameter_count"),
    )
    rest = F.col("statements") - F.col("opening_text")
    return facts.withColumn("is_empty", F.col("statements") == F.col("empty_statements")).withColumn(
        "is_trivial", (rest == 0) | ((rest == 1) & (F.col("stubs") == 1))
    )


def signatures(rows: DataFrame) -> DataFrame:
    """Parameter text, return text and flags per method; the lists are as long as a signature."""
    listed = F.when(_is("arg") & (F.col("form") == "vararg"), F.concat(F.lit("*"), "name")).when(
        _is("arg") & (F.col("form") == "kwarg"), F.concat(F.lit("**"), "name")
    ).when(_is("arg"), F.concat("name", F.when(F.col("text").isNotNull(), F.concat(F.lit(": "), "text")).otherwise("")))
    return rows.where("meth <> -1").where(_is("arg") | _is("returns")).groupBy(*METHOD).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(_is("arg"), F.struct("pos", listed.alias("t"))))), lambda x: x["t"]), ", "
        ).alias("parameters"),
        F.max(F.when(_is("returns"), F.col("name"))).alias("return_type"),
    )


def bases(rows: DataFrame) -> DataFrame:
    return rows.where(_is("base")).select(*CLASS, "top", "pos", F.col("name").alias("base"))


def class_facts(rows: DataFrame, methods: DataFrame) -> DataFrame:
    """One row per class with its kind and role.

    Import aliases count for the whole file: ``from x import BaseModel as B``
    makes ``B`` a ``BaseModel``.
    """
    at_class = rows.where("cls <> -1 and kind in ('class', 'base', 'class_decorator', 'class_body', 'class_attr', 'call')")
    plain = _is("class_attr") & (F.col("form") == "plain")
    deco = _is("class_decorator") & (F.col("name") == "dataclass")
    body, head = _is("class_body"), _is("class")
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    facts = at_class.groupBy(*CLASS).agg(
        F.max(F.when(head, F.col("name"))).alias("class_name"),
        F.max(F.when(head, F.col("line"))).cast("long").alias("lineno"),
        F.bool_or(F.col("top")).alias("top"),
        flag(deco & F.col("form").isin("name", "attr")).alias("bare_dataclass"),
        flag(deco).alias("any_dataclass"),
        F.count_if(body & ~F.col("name").isin("FunctionDef", "AsyncFunctionDef", "ClassDef")).alias("statements"),
        F.count_if(body & (F.col("name") == "AnnAssign")).alias("annotated"),
        flag(plain & (F.col("name") == "__tablename__")).alias("has_tablename"),
        flag(plain & (F.col("name") == "model_config")).alias("has_model_config"),
        flag(_is("call") & (F.col("form") == "name") & F.col("name").isin(*ORM_FIELDS)).alias("has_orm_field"),
        F.transform(
            F.array_sort(F.collect_list(F.when(_is("base"), F.struct("pos", "name")))), lambda x: x["name"]
        ).alias("bases"),
    )
    dunder = F.startswith("method_name", F.lit("__")) & F.endswith("method_name", F.lit("__"))
    per_class = methods.groupBy(*CLASS).agg(
        F.count(F.lit(1)).alias("methods"),
        F.count_if(F.col("is_abstract")).alias("abstract_methods"),
        F.count_if(~dunder).alias("named_methods"),
        F.count_if(~dunder & F.col("is_abstract")).alias("named_abstract"),
        F.count_if(F.col("is_abstract") | F.col("is_trivial")).alias("contract_methods"),
    )
    originals = (
        bases(rows).join(aliases(rows), ["path", "base"])
        .groupBy(*CLASS).agg(F.collect_set("original").alias("originals"), F.collect_set("base").alias("renamed"))
    )
    joined = facts.join(per_class, CLASS, "left").na.fill(0).join(originals, CLASS, "left")
    resolved = F.concat(
        F.array_except("bases", F.coalesce("renamed", F.array().cast("array<string>"))), F.coalesce("originals", F.array().cast("array<string>"))
    )
    score = (
        F.when(F.arrays_overlap(resolved, _texts(INFRA_BASES)), 2).otherwise(0)
        + F.col("has_tablename").cast("int") + F.col("has_model_config").cast("int")
        + F.when(F.col("annotated") * 10 > F.col("statements") * 7, 1).otherwise(0) + F.col("has_orm_field").cast("int")
    )
    kind = (
        F.when(F.col("bare_dataclass") | F.arrays_overlap("bases", _texts(DATA_BASES)), "dataclass")
        .when(~F.arrays_overlap("bases", _texts(ABSTRACT_BASES)), "concrete")
        .when(F.col("named_methods") == F.col("named_abstract"), "interface")
        .otherwise("abstract")
    )
    role = (
        F.when((F.col("methods") > 0) & (F.col("contract_methods") == F.col("methods")), "PURE_INTERFACE")
        .when(F.arrays_overlap(resolved, _texts(CONFIG_BASES)), "CONFIG")
        .when(score >= 2, "INFRA_MODEL")
        .otherwise("DOMAIN")
    )
    return joined.select(
        *CLASS, "class_name", "lineno", "top", "bases", "any_dataclass", "methods", "abstract_methods",
        score.alias("infra_score"), kind.alias("class_kind"), role.alias("class_role"),
        F.arrays_overlap("bases", _texts(INTERFACE_BASES)).alias("is_interface"),
    )


def aliases(rows: DataFrame, inside_class: bool = False) -> DataFrame:
    """``(path, base, original)`` renamed imports; the last one in breadth order wins.

    ``inside_class`` reads only imports within the class itself, the narrow rule.
    """
    kept = rows.where(_is("alias")).where("cls <> -1" if inside_class else "cls = -1")
    keys = ["path", "cls", "name"] if inside_class else ["path", "name"]
    best = kept.groupBy(*keys).agg(F.max_by("base", F.struct("depth", "node", "pos")).alias("original"))
    return best.withColumnRenamed("name", "base")


def top_imports(rows: DataFrame) -> DataFrame:
    """Distinct first parts of module-level imports, in order of first appearance."""
    first = rows.where(_is("import") & (F.col("form") == "top") & F.col("name").isNotNull()).select(
        "path", F.split("name", r"\.")[0].alias("package"), F.struct("node", "pos").alias("at")
    )
    return first.groupBy("path", "package").agg(F.min("at").alias("at"))


def import_graph(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``(importer, imported)`` modules; ``files(path)`` adds modules that hold no syntax rows.

    ``from a import b`` means ``a.b`` where that is a module of the project and
    ``a`` otherwise. Modules outside the project count as their root package.
    """
    found = rows.where(_is("import"))
    paths = rows.select("path") if files is None else rows.select("path").union(files.select("path"))
    modules = paths.distinct().select(_module(F.col("path")).alias("known"))
    parts = F.split(_package_of(F.col("path")), r"\.")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("num") + 1, F.lit(0))), ".")
    origin = F.when(F.col("num") > 0, F.concat_ws(".", F.nullif(up, F.lit("")), "name")).otherwise(F.col("name"))
    named = found.select(
        _module(F.col("path")).alias("importer"), origin.alias("origin"),
        F.when(F.col("base").isNotNull(), F.concat_ws(".", origin, "base")).alias("deep"),
    ).distinct()
    first = modules.select(F.col("known").alias("deep"), F.lit(True).alias("_deep"))
    second = modules.select(F.col("known").alias("origin"), F.lit(True).alias("_origin"))
    joined = named.join(first, "deep", "left").join(second, "origin", "left")
    target = F.when(F.col("_deep"), F.col("deep")).when(F.col("_origin"), F.col("origin")).otherwise(F.split("origin", r"\.")[0])
    return joined.select("importer", target.alias("imported")).where("imported <> '' and importer <> imported").distinct()


def _module(path: Column) -> Column:
    return F.regexp_replace(path_to_module(path), r"\.__init__$", "")


def _package_of(path: Column) -> Column:
    """The package a relative import starts from."""
    return F.regexp_replace(F.translate(F.regexp_replace(path, r"/?[^/]*$", ""), "/", "."), r"^\.", "")


def project_classes(classes: DataFrame) -> DataFrame:
    """Top-level classes by bare name: the last one in path order stands for the name, at the first one's place."""
    place = F.struct("path", "cls")
    rest = [c for c in classes.columns if c not in ("class_name", "top")]
    best = classes.where("top").groupBy("class_name").agg(
        F.max_by(F.struct(*rest), place).alias("_row"), F.min(place).alias("place"), F.count(F.lit(1)).alias("definitions"),
        F.bool_or("is_interface").alias("known_interface"),
    )
    return best.select("class_name", *[F.col(f"_row.{c}").alias(c) for c in rest], "place", "definitions", "known_interface")


def name_collisions(classes: DataFrame) -> DataFrame:
    """Top-level class names defined more than once."""
    return project_classes(classes).where("definitions > 1").select("class_name", "definitions", F.col("path").alias("kept_path"))


def overrides(project: DataFrame, methods: DataFrame) -> DataFrame:
    """``(path, cls, method_name)`` of methods that a direct parent, found by name, also defines."""
    own = project.select(*CLASS, "class_name", "bases").join(methods.select(*CLASS, "method_name"), CLASS)
    offered = own.select(F.col("class_name").alias("base"), "method_name").distinct()
    asked = own.select(*CLASS, "method_name", F.explode(F.array_distinct("bases")).alias("base"))
    return asked.join(offered, ["base", "method_name"], "left_semi").select(*CLASS, "method_name").distinct()


def interface_links(project: DataFrame) -> DataFrame:
    """``(class_name, interface)`` for direct bases that are known interfaces."""
    asked = project.select("class_name", F.explode(F.array_distinct("bases")).alias("interface"))
    return asked.join(project.where("known_interface").select(F.col("class_name").alias("interface")), "interface", "left_semi").select(
        "class_name", "interface"
    )


# ------------------------------------------------------------ ancestors, LCOM4


def base_index(definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions by name, and by name and file: each with its count and, where there is one only, the definition."""
    one = F.min(F.struct(F.col("path").alias("p"), F.col("cls").alias("c")))
    counted = [F.count(F.lit(1)).alias("n"), one.alias("d")]
    anywhere = definitions.groupBy("class_name").agg(*counted).select(F.col("class_name").alias("base"), "n", F.when(F.col("n") == 1, F.col("d")).alias("single"))
    here = definitions.groupBy("class_name", "path").agg(*counted).where("n = 1").select(F.col("class_name").alias("base"), "path", F.col("d").alias("local"))
    return anywhere, here


def resolve_base(asked: DataFrame, index: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Find the definition a base name means for the caller's file.

    A single definition anywhere wins; among several only a single one in the
    caller's own file does. Names that stay open keep null columns.
    """
    anywhere, here = index
    found = asked.join(anywhere, "base", "left").join(here, ["base", "path"], "left")
    chosen = F.coalesce("single", "local")
    return found.select(*asked.columns, chosen["p"].alias("found_path"), chosen["c"].alias("found_cls"), F.coalesce("n", F.lit(0)).alias("hits"))


def ancestors(rows: DataFrame) -> DataFrame:
    """``(path, cls, found_path, found_cls)``: every ancestor a class reaches by base names.

    Each name is followed once per class. One round climbs one level for all
    classes at once; only the new names of the last round move on.
    """
    heads = cut_lineage(rows.where(_is("class")).select(*CLASS, F.col("name").alias("class_name")))
    links = cut_lineage(bases(rows).where("base <> '<dynamic>'").select(F.col("path").alias("at_path"), F.col("cls").alias("at_cls"), "base").distinct())
    anywhere, here = base_index(heads)
    index = cut_lineage(anywhere), cut_lineage(here)
    visited = [heads.select(*CLASS, F.col("class_name").alias("base"))]
    front = heads.select(*CLASS, F.col("path").alias("at_path"), F.col("cls").alias("at_cls"))
    found: list[DataFrame] = []
    while True:
        known = reduce(DataFrame.unionByName, visited)
        asked = front.join(links, ["at_path", "at_cls"]).select(*CLASS, "base").distinct().join(known, [*CLASS, "base"], "left_anti")
        step = cut_lineage(resolve_base(asked, index))
        if step.isEmpty():
            break
        visited = merged([*visited, step.select(*CLASS, "base")])
        reached = step.where("found_path is not null").select(*CLASS, "found_path", "found_cls")
        found = merged([*found, reached])
        front = reached.withColumnsRenamed({"found_path": "at_path", "found_cls": "at_cls"})
    if not found:
        return heads.select(*CLASS, F.col("path").alias("found_path"), F.col("cls").alias("found_cls")).limit(0)
    return reduce(DataFrame.unionByName, found).distinct()


def init_attributes(rows: DataFrame, methods: DataFrame) -> DataFrame:
    """Attributes assigned on ``self`` or ``cls`` anywhere in a plain ``__init__``."""
    inits = methods.where("method_name = '__init__' and not is_async").select(*METHOD)
    return rows.where(_is("self_assign")).join(inits, METHOD, "left_semi").select(*CLASS, F.col("name").alias("attr")).distinct()


def inherited_attributes(rows: DataFrame, initial: DataFrame) -> DataFrame:
    """``(path, cls, attr)`` set by the constructors of ancestors; ``initial`` are all classes' own ones."""
    own = initial.withColumnsRenamed({"path": "found_path", "cls": "found_cls"})
    return ancestors(rows).join(own, ["found_path", "found_cls"]).select(*CLASS, "attr").distinct()


def cohesion_rows(rows: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Cohesion of every class that keeps at least one method.

    Constructors, properties and empty methods drop out. Where a name is defined
    twice, the last definition carries the usage.
    """
    kept = methods.where("method_name <> '__init__' and not is_property and not is_empty")
    names = kept.select(*CLASS, "method_name").distinct()
    vertices = cut_lineage(names.withColumn("method_id", F.monotonically_increasing_id()))
    last = methods.groupBy(*CLASS, "method_name").agg(F.max("meth").alias("meth"))
    active = last.join(kept.select(*METHOD), METHOD, "left_semi").join(vertices, [*CLASS, "method_name"]).select(*METHOD, "method_id")
    own = cut_lineage(init_attributes(rows, methods))
    attributes = (
        rows.where(_is("class_attr")).select(*CLASS, F.col("name").alias("attr")).union(own).union(inherited_attributes(rows, own)).distinct()
    )
    class_id = F.struct(*CLASS).alias("class_id")
    uses = (
        rows.where(_is("attr")).select(*METHOD, F.col("name").alias("attr")).distinct()
        .join(attributes, [*CLASS, "attr"], "left_semi").join(active, METHOD).select(class_id, "method_id", "attr")
    )
    calls = (
        rows.where(_is("self_call")).select(*METHOD, F.col("name").alias("method_name")).distinct()
        .join(active.withColumnRenamed("method_id", "u"), METHOD)
        .join(vertices.withColumnRenamed("method_id", "v"), [*CLASS, "method_name"]).select("u", "v")
    )
    scored = lcom4(
        vertices.select(class_id, "method_id"), uses, calls, kept.select(class_id)
    ).select("class_id.*", "methods_count", "lcom4")
    score = F.col("lcom4").cast("double")
    return scored.join(classes.select(*CLASS, "class_name", "lineno", "class_kind"), CLASS).select(
        *CLASS, F.col("class_name").alias("name"), F.col("path").alias("filepath"), "lineno", "methods_count",
        score.alias("cohesion_score"), lcom4_normalised(score).alias("cohesion_score_norm"), "class_kind",
        (F.col("class_kind") != "concrete").alias("excluded_from_aggregation"),
    )
