"""Call graph from source: what the used names stand for, by joins over scopes and bindings.

Every distinct expression of a scope is a state that moves on until it stands for a scope:
a first name is looked up in the nearest visible scope of its file that binds it; an attribute in the bindings
of what stands before it, in the base classes of a class, or among the modules of a package;
an import or an assignment is replaced by what it names. A round moves the states of the
last round only, and a state seen before ends, so chains and rings of aliases reach a fixpoint.

All lookups are one relation of steps that is built once. A round joins the states that are left with the steps that a filter of fixed
size lets through, and known states are kept as hashes, so late rounds move little.

What a value of unknown type does with an attribute is one use of ``*.name``. It stands for
the only method or function in a class of that name where there is just one; else it stays
as it is and is ambiguous, so a common name costs one row a use, not one per definition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut_lineage, merged

# A state stands at a scope of some sort, ``at`` where its first part is still to be looked up among the visible scopes.
STATE = ["place", "sort", "rest"]
# A chain of parts that grows beyond this names itself in a ring and stands for nothing.
MOST_PARTS = 16
# Bits of the filter that leads the states of a round to their steps.
PLACES = 1 << 25


def call_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes(name), edges(source, target, confidence), suspicious(block))`` of stored scope rows."""
    scopes = rows.where("kind = 'scope'").select(F.col("scope").alias("sym"), F.col("form").alias("sort"))
    modules = _packages(scopes)
    kinds = cut_lineage(scopes.unionByName(modules.select(F.col("module").alias("sym"), F.lit("module").alias("sort"))).distinct())
    modules = kinds.where("sort = 'module'").select(F.col("sym").alias("module"))
    written = rows.where("kind = 'base'").select("scope", F.col("target").alias("at"), "parts").distinct()
    used = rows.where("kind = 'use'").select("scope", "parts").distinct()
    steps = cut_lineage(_steps(rows, cut_lineage(_bindings(rows, modules)), kinds, modules))
    # Base classes first, so that an attribute then climbs one class a round.
    asked = cut_lineage(written.withColumn("id", F.monotonically_increasing_id()))
    ends = _resolved(asked.select("id", F.col("at").alias("place"), F.lit("at").alias("sort"), F.col("parts").alias("rest")), steps, written.select("scope", F.col("at").alias("up"), F.lit("at").alias("up_sort"), F.col("parts").alias("base")))
    found = asked.select("id", "scope").join(ends.where("sym is not null").select("id", F.col("sym").alias("up")), "id").select("scope", "up").distinct()
    bases = found.join(kinds.toDF("up", "up_sort"), "up").select("scope", "up", "up_sort", F.array().cast("array<string>").alias("base"))
    bases = cut_lineage(bases)
    uses = cut_lineage(used.withColumn("id", F.monotonically_increasing_id()))
    found = _resolved(uses.select("id", F.col("scope").alias("place"), F.lit("at").alias("sort"), F.col("parts").alias("rest")), steps, bases)
    methods = kinds.where("sort = 'function'").join(kinds.where("sort = 'class'").select(F.col("sym").alias("_in")), F.regexp_replace("sym", r"\.[^.]*$", "") == F.col("_in"))
    single = methods.groupBy(F.regexp_extract("sym", r"[^.]*$", 0).alias("any")).agg(F.min("sym").alias("only"), F.count(F.lit(1)).alias("n")).where("n = 1")
    guessed = found.where("sym is null").join(single, "any", "left").select("id", F.coalesce("only", F.concat(F.lit("*."), "any")).alias("target"))
    placed = found.where("sym is not null").select("id", F.col("sym").alias("target")).unionByName(guessed)
    several = placed.groupBy("id").agg((F.min("target") < F.max("target")).alias("several"))
    low = F.startswith("target", F.lit("*.")) | F.col("several")
    every = uses.select("id", F.col("scope").alias("source")).join(placed.join(several, "id"), "id").where("source <> target")
    edges = cut_lineage(every.groupBy("source", "target").agg(F.when(F.bool_or(low), "low").otherwise("high").alias("confidence")))
    nodes = rows.where("kind = 'scope'").select(F.col("scope").alias("name")).union(edges.select("target")).distinct()
    return nodes, edges, edges.where("confidence = 'low'").select(F.col("source").alias("block")).distinct()


def _resolved(start: DataFrame, steps: DataFrame, bases: DataFrame) -> DataFrame:
    """``(id, sym, any)``: what every expression ends at, by rounds over the states that are new."""
    seen, ends = [], []
    fresh = cut_lineage(_settled(start.withColumn("any", F.lit(None).cast("string"))))
    while True:
        ends = merged([*ends, fresh.where("ended").select("id", "sym", "any")])
        going = fresh.where("not ended").select("id", *STATE)
        if going.isEmpty():
            return reduce(DataFrame.unionByName, ends).distinct()
        seen = merged([*seen, going.select("id", F.xxhash64(*STATE).alias("mark"))])
        moved = _settled(_moved(going, steps, bases).where(f"any is not null or size(rest) <= {MOST_PARTS}"))
        moved = moved.withColumn("mark", F.xxhash64(*STATE, "any")).dropDuplicates(["id", "mark"])
        known = _possible(reduce(DataFrame.unionByName, seen), going, ["id"])
        fresh = cut_lineage(moved.join(known, ["id", "mark"], "left_anti").drop("mark"))


def _settled(states: DataFrame) -> DataFrame:
    """The states as they stand before a lookup, with what they end at; those that stand for nothing are gone.

    ``ended`` states carry ``sym`` or ``any``, the attribute of an unknown value. Calling a class gives the class.
    """
    first, at, text = F.get("rest", F.lit(0)), F.col("sort") == "at", F.lit(None).cast("string")
    kept = F.coalesce(F.array_position(F.transform("rest", lambda p: p != "()"), True), F.size("rest") + 1)
    states = states.withColumn("rest", F.when((F.col("sort") == "class") & (first == "()"), F.slice("rest", kept.cast("int"), F.size("rest") + 1)).otherwise(F.col("rest")))
    known = F.col("any").isNull() & ~at & (F.size("rest") == 0)
    unknown = F.col("any").isNull() & (F.size("rest") > 0) & F.when(at, first == "?").otherwise(first == "()")
    states = states.withColumn("sym", F.when(known, F.col("place")).otherwise(text)).withColumn("_lost", F.coalesce(unknown, F.lit(False)))
    states = states.withColumn("any", F.when(F.col("_lost"), _last(_tail())).otherwise(F.col("any")))
    states = states.where("any is not null or (not _lost and (sym is not null or size(rest) > 0))")
    return states.select("id", *STATE, "sym", "any", F.expr("any is not null or sym is not null").alias("ended"))


def _moved(going: DataFrame, steps: DataFrame, bases: DataFrame) -> DataFrame:
    """``(id, place, sort, rest, any)`` after one step; an attribute that a class does not bind goes on to its bases."""
    asked = going.withColumn("name", F.col("rest")[0])
    key, none = ["place", "name"], F.array().cast("array<string>")
    fits = F.when(F.col("s.form") == "own", F.col("a.sort") != "at").otherwise(F.col("s.form") == F.col("a.sort"))
    met = [F.col(f"a.{c}") == F.col(f"s.{c}") for c in key]
    hit = asked.alias("a").join(_possible(steps, asked, key).alias("s"), [*met, fits], "left")
    hit = cut_lineage(hit.select("id", *[f"a.{c}" for c in STATE], "to", "to_sort", "parts", "unknown"))
    rest = F.when(F.col("unknown"), none).otherwise(F.concat("parts", _tail()))
    bound = hit.where("unknown is not null").select("id", F.col("to").alias("place"), F.col("to_sort").alias("sort"), rest.alias("rest"), F.when(F.col("unknown"), _last(_tail())).alias("any"))
    above = hit.where("unknown is null and sort = 'class'").select("id", F.col("place").alias("scope"), "rest")
    climbed = above.join(_possible(bases, above, ["scope"]), "scope")
    return bound.where("sort is not null or any is not null").unionByName(
        climbed.select("id", F.col("up").alias("place"), F.col("up_sort").alias("sort"), F.concat("base", "rest").alias("rest"), F.lit(None).cast("string").alias("any"))
    )


def _possible(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is wanted, and a few more: a filter of at most ``PLACES`` bits, whatever the number of keys."""
    place = F.pmod(F.xxhash64(*key), F.lit(PLACES))
    places = wanted.select(place.alias("p"))
    bits = places.groupBy(F.floor(F.col("p") / 64).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_b"))
    held = rows.withColumn("_p", place).withColumn("_w", F.floor(F.col("_p") / 64)).join(F.broadcast(bits), "_w")
    return held.where(F.getbit("_b", F.pmod("_p", F.lit(64)).cast("int")) == 1).select(*rows.columns)


def _steps(rows: DataFrame, binds: DataFrame, kinds: DataFrame, modules: DataFrame) -> DataFrame:
    """``(place, form, name, to, to_sort, parts, unknown)``: where a state that stands at a place goes on with its next part.

    Steps of first names have form ``at``, names that the place binds ``own``, modules of a package ``module``.
    """
    plain = binds.select("scope", "name", F.coalesce("sym", "next_at").alias("to"), F.col("sym").isNotNull().alias("_is"), "parts", "unknown")
    leaf, above = F.regexp_extract("module", r"[^.]*$", 0), F.regexp_replace("module", r"\.?[^.]*$", "")
    below = modules.select(above.alias("scope"), leaf.alias("name"), F.col("module").alias("to"), F.lit(True).alias("_is"), F.array().cast("array<string>").alias("parts"), F.lit(False).alias("unknown"))
    below = below.where("scope <> ''").join(binds.select("scope", "name").distinct(), ["scope", "name"], "left_anti")
    either = plain.withColumn("_own", F.lit(True)).unionByName(below.withColumn("_own", F.lit(False)))
    # What a step leads to has a sort of its own, unless it is an expression to read elsewhere.
    named = either.where("_is").join(kinds.toDF("to", "to_sort"), "to")
    others = either.where("not _is").withColumn("to_sort", F.when(F.col("to").isNotNull(), "at"))
    entries = cut_lineage(named.unionByName(others).drop("_is"))
    own = entries.select(F.col("scope").alias("place"), F.when(F.col("_own"), "own").otherwise("module").alias("form"), "name", "to", "to_sort", "parts", "unknown")
    near = rows.where("kind = 'near'").select(F.col("scope").alias("at"), "name", F.col("target").alias("scope")).distinct()
    seen = near.join(entries.where("_own"), ["scope", "name"]).select(F.col("at").alias("place"), F.lit("at").alias("form"), "name", "to", "to_sort", "parts", "unknown")
    return own.unionByName(seen)


def _packages(scopes: DataFrame) -> DataFrame:
    """All modules and the packages above them."""
    parts = F.split("sym", r"\.")
    leading = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    return scopes.where("sort = 'module'").select(F.explode(leading).alias("module")).distinct()


def _bindings(rows: DataFrame, modules: DataFrame) -> DataFrame:
    """``(scope, name, sym, next_at, parts, unknown)``: a scope, an expression to read elsewhere, or unknown.

    An import stands for its longest leading module with the other parts to look up there.
    Names from outside the project have no binding.
    """
    given = rows.where("kind = 'bind'").select("scope", "name", "form", "target", "parts").distinct()
    none = F.array().cast("array<string>")
    local = given.where("form <> 'import'").select(
        "scope", "name", F.when(F.col("form").isin("def", "self"), F.col("target")).alias("sym"), F.when(F.col("form") == "value", F.col("target")).alias("next_at"),
        F.coalesce("parts", none).alias("parts"), (F.col("form") == "other").alias("unknown"),
    )
    taken = given.where("form = 'import'").select("scope", "name", "target")
    words = F.split("target", r"\.")
    tries = taken.select("target").distinct().select("target", F.explode(F.sequence(F.lit(1), F.size(words))).alias("n")).withColumn("module", F.array_join(F.slice(words, F.lit(1), F.col("n")), "."))
    best = tries.join(modules, "module").groupBy("target").agg(F.max(F.struct("n", "module")).alias("m"))
    far = taken.join(best, "target").select(
        "scope", "name", F.col("m.module").alias("sym"), F.lit(None).cast("string").alias("next_at"),
        F.slice(words, F.col("m.n") + 1, F.size(words)).alias("parts"), F.lit(False).alias("unknown"),
    )
    return local.unionByName(far)


def _tail(n: int = 1) -> Column:
    return F.slice("rest", n + 1, F.size("rest"))


def _last(rest: Column) -> Column:
    """The last attribute of what is left, if it is one."""
    return F.try_element_at(F.filter(rest, lambda p: p != "()"), F.lit(-1))
