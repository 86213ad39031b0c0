"""Import contracts checked on the module graph itself, chains of imports included.

A contract names groups of modules and the ordered pairs of groups that must not be
linked. A breach is a chain of imports from a module of the first group to one of the
second. It is found by breadth-first search from all modules of a group at once: every
round joins only the modules reached last with the edges, keeps one predecessor for each
new one, and leaves out what was reached before. A group whose forbidden targets are all
found leaves the search. One shortest chain stands for each breached pair; it is read back
from the predecessors, so no path is carried along and no list of chains is built.

Relations, all of the configuration's size but the first:

* ``imports(importer, imported)``
* ``groups(contract, grp, prefix)``: a module belongs to the group with its longest prefix
* ``pairs(contract, origin, target)``: groups of which the first must not reach the second
* ``modes(contract, through, direct_only)``: whether chains may pass modules of groups, and
  whether only imports without a module between count
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut_lineage, merged

STATE = ["contract", "origin", "module"]
PAIR = ["contract", "origin", "target"]


def members(imports: DataFrame, groups: DataFrame) -> DataFrame:
    """``(contract, module, grp)`` for the modules at either end of an import."""
    modules = imports.select(F.col("importer").alias("module")).union(imports.select("imported")).distinct()
    parts = F.split("module", r"\.")
    leading = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    named = modules.select("module", F.posexplode(leading).alias("depth", "prefix")).join(groups, "prefix")
    return named.groupBy("contract", "module").agg(F.max_by("grp", F.struct("depth", "grp")).alias("grp"))


def direct_breaches(imports: DataFrame, placed: DataFrame, pairs: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Every single import between the two groups of a pair: ``PAIR`` and its ends."""
    source = placed.select("contract", F.col("module").alias("importer"), F.col("grp").alias("origin"))
    goal = placed.select("contract", F.col("module").alias("imported"), F.col("grp").alias("target"))
    found = imports.join(source, "importer").join(goal, ["contract", "imported"]).join(pairs, PAIR, "left_semi")
    return _kept(found, ignored).select(*PAIR, "importer", "imported")


def breaches(imports: DataFrame, groups: DataFrame, pairs: DataFrame, modes: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """``(contract, origin, target, chain_length, chain, direct_imports)``, one row per breached pair.

    ``chain_length`` counts imports. Of equally short chains the one that ends in the smallest
    module name stands, led back over the smallest predecessors. ``ignored(contract, importer,
    imported)`` takes single imports out of a contract.
    """
    edges = cut_lineage(imports.where("importer <> imported").select("importer", "imported").distinct())
    placed = cut_lineage(members(edges, groups))
    pairs = pairs.distinct()
    starts = placed.join(pairs.select("contract", F.col("origin").alias("grp")).distinct(), ["contract", "grp"], "left_semi")
    first = starts.select("contract", F.col("grp").alias("origin"), "module", F.lit(None).cast("string").alias("pred"))
    levels, hits = [cut_lineage(first)], []
    seen = levels[-1:]
    open_pairs = pairs
    while True:
        reached = _step(levels, seen, edges, placed, modes, open_pairs, ignored)
        if reached.isEmpty():
            break
        levels.append(reached)
        seen = merged([*seen, reached])
        goal = placed.select("contract", "module", F.col("grp").alias("target"))
        hit = reached.join(goal, ["contract", "module"]).join(open_pairs, PAIR, "left_semi").groupBy(*PAIR).agg(F.min("module").alias("end"))
        hits.append(cut_lineage(hit.withColumn("chain_length", F.lit(len(levels) - 1).cast("long"))))
        open_pairs = cut_lineage(open_pairs.join(hits[-1], PAIR, "left_anti"))
        if open_pairs.isEmpty():
            break
    if not hits:
        ends = pairs.limit(0).select(*PAIR, F.lit("").alias("end"), F.lit(0).cast("long").alias("chain_length"))
    else:
        ends = reduce(DataFrame.unionByName, hits)
    direct = direct_breaches(edges, placed, pairs, ignored).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("direct_imports"))
    return _chains(ends, levels).join(direct, PAIR, "left").na.fill(0, ["direct_imports"])


def broken_imports(found: DataFrame, direct: DataFrame, order: DataFrame) -> DataFrame:
    """Rows ``(importer, imported, contract_name, seq)`` as a report of the contracts would list them.

    Single imports stand for themselves, a pair that only a longer chain links for its two
    ends. ``order(contract, seq)`` is the order of the contracts.
    """
    far = found.where("direct_imports = 0").select("contract", F.col("chain")[0].alias("importer"), F.element_at("chain", -1).alias("imported"))
    rows = direct.select("contract", "importer", "imported").unionByName(far).distinct()
    return rows.join(order, "contract").select("importer", "imported", F.col("contract").alias("contract_name"), F.col("seq").cast("long").alias("seq"))


def totals(found: DataFrame, order: DataFrame) -> DataFrame:
    """One row ``(kept, broken)`` over the contracts of ``order``."""
    bad = found.select("contract").distinct().withColumn("bad", F.lit(True))
    return order.join(bad, "contract", "left").agg(F.count_if(F.col("bad").isNull()).alias("kept"), F.count_if(F.col("bad")).alias("broken"))


def ignored_imports(imports: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame | None:
    """``(contract, importer, imported)`` for ``(contract, importer pattern, imported pattern)``.

    ``*`` stands for one part of a name, ``**`` for any number of parts.
    """
    parts = [
        imports.where(F.col("importer").rlike(_regex(a)) & F.col("imported").rlike(_regex(b))).select(F.lit(name).alias("contract"), "importer", "imported")
        for name, a, b in patterns
    ]
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def _regex(pattern: str) -> str:
    words = {"*": r"[^.]+", "**": r"[^.]+(\.[^.]+)*"}
    return "^" + r"\.".join(words.get(p, r"\Q" + p + r"\E") for p in pattern.split(".")) + "$"


def _kept(rows: DataFrame, ignored: DataFrame | None) -> DataFrame:
    return rows if ignored is None else rows.join(ignored, ["contract", "importer", "imported"], "left_anti")


def _step(levels: list[DataFrame], seen: list[DataFrame], edges: DataFrame, placed: DataFrame, modes: DataFrame, open_pairs: DataFrame, ignored: DataFrame | None) -> DataFrame:
    """The modules first reached in this round, each with its smallest predecessor."""
    frontier = levels[-1].select(*STATE).join(open_pairs.select("contract", "origin").distinct(), ["contract", "origin"], "left_semi")
    if len(levels) > 1:
        inner = frontier.join(modes.where("not direct_only"), "contract").join(placed, ["contract", "module"], "left")
        frontier = inner.where("grp is null or through").select(*STATE)
    walked = _kept(frontier.withColumnRenamed("module", "importer").join(edges, "importer"), ignored)
    fresh = walked.groupBy("contract", "origin", F.col("imported").alias("module")).agg(F.min("importer").alias("pred"))
    return cut_lineage(fresh.join(reduce(DataFrame.unionByName, seen).select(*STATE), STATE, "left_anti"))


def _chains(ends: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Walks back from every end; in each round only the chains that are this long or longer join."""
    walk = ends.withColumn("chain", F.array("end")).drop("end")
    for length in range(len(levels) - 1, 0, -1):
        back = levels[length].select("contract", "origin", F.col("module").alias("_at"), "pred")
        at = F.when(F.col("chain_length") >= length, F.col("chain")[0])
        walk = walk.withColumn("_at", at).join(back, ["contract", "origin", "_at"], "left").withColumn("chain", F.concat(_one(F.col("pred")), "chain")).drop("_at", "pred")
        walk = cut_lineage(walk) if length % 8 == 0 else walk
    return walk.select(*PAIR, "chain_length", "chain")


def _one(value: Column) -> Column:
    return F.array_compact(F.array(value))
