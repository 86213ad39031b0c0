"""Graph kernels that move one row per edge and round, never a pair per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from codestrata.session import cut_lineage

# Parts of a key's rows, so also the most rows of one key that a window holds.
PARTS = 64
# Paths and rings are contracted while they hold this share of the edges.
LEAST_TIGHT = 0.1


def _marked(df: DataFrame, value: Column | None = None) -> tuple[DataFrame, dict]:
    """``df`` written, with a fingerprint that comes with the write: the count and an order-free sum of hashes, or of ``value`` where it is not null."""
    mark = Observation()
    h = F.xxhash64(*df.columns) if value is None else value
    return cut_lineage(df.observe(mark, F.count(h).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("sum"))), mark.get


def with_least(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the least ``value`` under the same ``keys``.

    A key's rows are dealt over ``PARTS`` parts by a hash of the value. Each part finds its
    own minimum, a key has at most ``PARTS`` of these, and every part takes the least of them
    back. A key with a third of all rows is then no more than a ``PARTS``-th of that in one task.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(PARTS)).cast("int"))
    parts = dealt.groupBy(*keys, "_part").agg(F.min(value).alias(name))
    parts = parts.withColumn(name, F.min(name).over(Window.partitionBy(*keys)))
    return dealt.join(parts, [*keys, "_part"]).drop("_part")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for an undirected ``edges(u, v)`` of comparable ids.

    Alternating star contraction (Kiveris et al., 2014): neighbours move to the
    smallest known id in O(log^2 n) rounds and the edge count never grows. A
    hub's edges are spread, see ``with_least``.
    """
    apart = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current, before = _marked(apart.distinct())
    while before["n"]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, ["u"], "v", "m").where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # Each row hands on two edges, so the joined rows are made only once.
        moved = with_least(large, ["u"], "v", "m").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        small = moved.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()
        current, after = _marked(small)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def strong_components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """``(node, component)`` for the nodes on cycles of a directed ``edges(source, target)``.

    While many edges are the only one out of their source and the only one into their target,
    a round contracts the paths and rings that these form, see ``_contracted``. Any other round
    gives the nodes random ranks. A node's colour is the highest rank that reaches
    it, its echo the highest rank that it reaches inside its colour; where both are the same
    node, the node lies on a cycle with it. Members of one component share colour and echo, so
    all edges between nodes that differ in either are dropped, along with edges that nothing
    enters or that lead nowhere. Random ranks split a chain of components near its middle, so
    the rounds grow with its logarithm. A component is named by its largest node.

    ``rounds`` receives the number of jobs that each round needed for its paths, or its colours and echoes.
    """
    plain = cut_lineage(edges.where(F.col("source") != F.col("target")).select("source", "target").distinct())
    rest = cut_lineage(_trimmed(plain))
    found: list[tuple[DataFrame, DataFrame | None]] = []
    while n := rest.count():
        tight = cut_lineage(_tight(rest))
        if tight.count() >= n * LEAST_TIGHT:
            rest, rings, heads, jobs = _contracted(rest, tight)
            found.append((rings, heads))
        else:
            rest, members, jobs = _coloured(rest, len(found))
            found.append((members, None))
        if rounds is not None:
            rounds.append(jobs)
    members = plain.select(F.col("source").alias("node"), F.col("target").alias("component")).limit(0)
    # From the last round back: a node shares the outermost cycle that its path or ring is on.
    for own, heads in reversed(found):
        if heads is None:
            members = members.unionByName(own)
            continue
        members = members.unionByName(own.join(members, "node", "left_anti").select("node", F.col("node").alias("component")))
        inside = heads.join(members.withColumnRenamed("node", "head"), "head").select("node", "component")
        members = cut_lineage(members.unionByName(inside))
    names = members.groupBy("component").agg(F.max("node").alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(names, "component").select("node", F.col("name").alias("component"))


def _coloured(rest: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """The edges left after one round of colours and echoes, the members it found and the number of jobs."""
    colours, jobs = _summits(rest, seed)
    same = (
        rest.join(colours.select(F.col("node").alias("source"), F.col("top").alias("colour")), "source")
        .join(colours.select(F.col("node").alias("target"), F.col("top").alias("_other")), "target")
        .where(F.col("colour") == F.col("_other")).select("source", "target", "colour")
    )
    same = cut_lineage(same)
    echoes, more = _summits(same.select(F.col("target").alias("source"), F.col("source").alias("target")), seed)
    of = same.select(F.col("source").alias("node"), "colour").union(same.select("target", "colour")).distinct()
    told = cut_lineage(echoes.join(of, "node"))
    left = told.where("top <> colour").select("node", "top")
    kept = (
        same.join(left.withColumnRenamed("node", "source"), "source")
        .join(left.select(F.col("node").alias("target"), F.col("top").alias("_other")), "target")
        .where(F.col("top") == F.col("_other")).select("source", "target")
    )
    return cut_lineage(_trimmed(kept)), told.where("top = colour").select("node", F.col("colour.node").alias("component")), jobs + more


def _tight(edges: DataFrame) -> DataFrame:
    """The edges that are the only one out of their source and the only one into their target."""
    one = F.count(F.lit(1)).alias("n")
    out = edges.groupBy("source").agg(F.min("target").alias("target"), one).where("n = 1").drop("n")
    into = edges.groupBy("target").agg(F.min("source").alias("source"), one).where("n = 1").drop("n")
    return out.join(into, ["source", "target"])


def _contracted(edges: DataFrame, tight: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Edges between heads, ``rings(node)`` of heads that are cycles of their own, ``heads(node, head)``, jobs.

    A cycle through either end of a tight edge passes both, so all nodes of a path lie on the
    same cycles, and so do those of a ring. The head is a path's first node and a ring's least.
    Each job doubles how far a node has looked back; a ring is through when its least stays.
    """
    back = tight.select(F.col("target").alias("node"), F.col("source").alias("to"), F.least("source", "target").alias("low"), F.lit(False).alias("over"))
    still = F.when(~F.col("over"), F.xxhash64("node", "low"))
    back, before = _marked(back, still)
    jobs = 1
    while True:
        ahead = back.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"), F.col("over").alias("_over"))
        far = back.where("not over").join(ahead, "to", "left").select(
            "node", F.coalesce("_to", "to").alias("to"), F.least("low", "_low").alias("low"), F.coalesce("_over", F.lit(True)).alias("over")
        )
        back, after = _marked(back.where("over").unionByName(far), still)
        jobs += 1
        if after == before or not after["n"]:
            break
        before = after
    heads = cut_lineage(back.select("node", F.when(F.col("over"), F.col("to")).otherwise(F.col("low")).alias("head")).where("node <> head"))
    at = lambda end: heads.select(F.col("node").alias(end), F.col("head").alias(f"_{end}"))
    others = edges.join(tight, ["source", "target"], "left_anti").join(at("source"), "source", "left").join(at("target"), "target", "left")
    moved = cut_lineage(others.select(F.coalesce("_source", "source").alias("source"), F.coalesce("_target", "target").alias("target")).distinct())
    rings = back.where("not over").select(F.col("low").alias("node")).union(moved.where("source = target").select("source")).distinct()
    return cut_lineage(_trimmed(moved.where("source <> target"))), cut_lineage(rings), heads, jobs


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges whose source nobody enters or whose target leads nowhere."""
    return edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(
        edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi"
    )


def _summits(edges: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """For each node the highest-ranked node that leads to it, and the number of jobs.

    In a job a node first takes over what its own summit knows, which doubles the distance
    covered, and then what stands up to two edges before it.
    """
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    tops = cut_lineage(nodes.select("node", F.struct(F.xxhash64(F.lit(seed), "node").alias("rank"), "node").alias("top")))
    # A loop on every node lets a value stay where it is, so a step reads the values only once.
    loops = nodes.select(F.col("node").alias("source"), F.col("node").alias("target"))
    looped = cut_lineage(edges.select("source", "target").unionByName(loops))
    before, jobs = None, 0
    while True:
        known = tops.select(F.col("node").alias("_at"), F.col("top").alias("_higher"))
        moved = tops.join(known, F.col("top.node") == F.col("_at")).select("node", F.greatest("top", "_higher").alias("top"))
        for _ in range(2):
            pushed = looped.join(moved.withColumnRenamed("node", "source"), "source")
            moved = pushed.groupBy(F.col("target").alias("node")).agg(F.max("top").alias("top"))
        tops, after = _marked(moved)
        jobs += 1
        if after == before:
            return tops, jobs
        before = after
