"""Near duplicates of embedding vectors by a pivot-permutation index.

Each vector is described by the order of its nearest reference points (pivots). Vectors
with a cosine of 0.95 share most of them, so a pair is looked at where both have the same
``SHARED`` pivots among their ``NEAREST``: the inverted lists are keyed by sets of that many
pivots, and standing in a common list means that the shared-pivot count is reached. A pair
counts in one list only, that of its smallest shared pivots, and is verified there by its
cosine in double precision. Lists with one vector are dropped before any vector travels.

Equal vectors are one node with a count. A list is cut into chunks of ``CHUNK`` nodes that
meet chunk against chunk, each meeting a task of its own, so no list, however long, is held
by one task. No pairs are emitted: a meeting gives, for each node, the number of rows it is linked
to and one edge towards the least node it reaches there.

Pivots are spread-out vectors of a sample: of the ``4 * pivots`` vectors with the smallest hashes
each next one is that farthest from all chosen, and none has a cosine of 0.9 with another.
Their number grows with the cube root of the number of vectors, so that lists stay short,
and stops at ``MOST_PIVOTS``, which bounds what travels with the tasks. All vectors are indexed.
A linked pair with fewer shared pivots is missed; a link below the bound is never given.

Defined results: vectors that are null, empty or zero, hold null or non-finite entries or
have another length than the commonest one (the longest of equally common ones) link with
nothing; equal vectors link whatever their ids; a null id counts as a link but never names
a component, unless it stands alone; repeated ids and rows are rows of their own; an empty table
gives no rows; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.graph import connected_components
from codestrata.session import Scratch

COSINE = 0.95
NEAREST, SHARED = 8, 3
MOST_PIVOTS = 16_384
CHUNK = 512
# Vectors scored against the pivots, and list rows verified, at once.
ROWS_AT_ONCE, MEMBERS_AT_ONCE = 512, 8192


def components(df: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row."""
    v = F.col("v")
    short = df.schema[vector].dataType.simpleString() == "array<float>"
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) <= F.lit(1.7976931348623157e308), F.lit(False)))
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<float>" if short else "array<double>").alias("v"))
    good = rows.where(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    common = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = 0 if common is None else common["d"]
    # Minus zero is written as zero, so that equal vectors have equal keys.
    flat = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))
    right = v.isNotNull() & (F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0)
    keyed = rows.withColumn("a", F.when(right, F.xxhash64(flat))).withColumn("b", F.when(right, F.xxhash64(F.lit(1), flat)))
    with Scratch(df.sparkSession) as scratch:
        nodes = scratch.keep(
            keyed.where("a is not null").groupBy("a", "b").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("v").alias("v"))
            .withColumn("node", F.monotonically_increasing_id())
        )
        found = scratch.keep(_linked(scratch, nodes, dims, cosine))
        # A node is named by its smallest id first, so that a component's label holds its smallest id.
        name = lambda key: nodes.select(F.col("node").alias(key), F.struct(F.col("least").isNull().alias("none"), "least", "node").alias(f"{key}_name"))
        edges = found.where("u is not null").select("u", "v").distinct().join(name("u"), "u").join(name("v"), "v")
        joined = connected_components(edges.select(F.col("u_name").alias("u"), F.col("v_name").alias("v")))
        counts = found.where("u is null").groupBy("node").agg(F.sum("links").alias("links"))
        near = joined.select(F.col("node.node").alias("node"), F.col("component.least").alias("component"))
        facts = nodes.select("a", "b", "copies", "least", "node").join(counts, "node", "left").join(near, "node", "left")
        told = facts.select("a", "b", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
        out = keyed.select("id", "a", "b").join(told, ["a", "b"], "left")
        component = F.coalesce("component_id", "id")
        return scratch.result(out.select(
            F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        ))


def pivots_for(n: int) -> int:
    return min(MOST_PIVOTS, max(64, round(12 * n ** (1 / 3))))


def spread(sample: np.ndarray, count: int, closest: float = 0.9) -> np.ndarray:
    """Up to ``count`` unit vectors of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        at = int(nearest.argmin())
        if nearest[at] >= closest:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, sample @ sample[at])
    return sample[chosen]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest entry is divided out first, so that no square leaves the range."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _linked(scratch: Scratch, nodes: DataFrame, dims: int, cosine: float) -> DataFrame:
    """Rows ``(node, links)``, and rows ``(u, v)`` that connect what is linked."""
    count = pivots_for(nodes.count())
    sample = [r["v"] for r in nodes.orderBy("a", "b").limit(4 * count).select("v").collect()]
    pivots = spread(unit(np.array(sample).reshape(-1, dims)), count) if sample else np.zeros((0, 1))
    held = scratch.spark.sparkContext.broadcast(pivots)
    postings = nodes.select("node", "v").mapInArrow(_postings(held), "list long, node long, before binary")
    crowded = scratch.keep(postings.groupBy("list").count().where("count > 1"))
    chunks = F.ceil(F.col("count") / CHUNK).cast("int")
    members = (
        postings.join(crowded, "list").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node", "list"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("list", "node", "before", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    )
    met = members.join(nodes.select("node", "copies", "v"), "node")
    order = ["list", "low", "high"]
    return met.repartition(*order).sortWithinPartitions(*order).mapInArrow(_meetings(cosine), "node long, links long, u long, v long")


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)


def _postings(held):
    """One row for each set of ``SHARED`` pivots among a vector's nearest.

    ``before`` holds the vector's near pivots that are smaller than the largest of the set and not in it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = held.value
        nearest = min(NEAREST, len(pivots))
        sets = list(combinations(range(nearest), min(SHARED, nearest)))
        for batch in batches:
            vectors, ids = _vectors(batch), batch.column("node").to_numpy()
            for at in range(0, len(ids), ROWS_AT_ONCE):
                scores = unit(vectors[at : at + ROWS_AT_ONCE]) @ pivots.T
                near = np.argpartition(-scores, nearest - 1, axis=1)[:, :nearest] if nearest < len(pivots) else np.tile(np.arange(nearest), (len(scores), 1))
                near = np.sort(near, axis=1)
                lists, before = [], []
                for chosen in sets:
                    key = np.zeros(len(near), dtype=np.int64)
                    for k in chosen:
                        key = key * (MOST_PIVOTS + 1) + near[:, k] + 1
                    lists.append(key)
                    earlier = near[:, [k for k in range(chosen[-1]) if k not in chosen]].astype(np.int32)
                    before.extend(row.tobytes() for row in np.ascontiguousarray(earlier))
                node = np.tile(ids[at : at + ROWS_AT_ONCE], len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(node), pa.array(before, pa.binary())], names=["list", "node", "before"])

    return run


def _meetings(cosine: float):
    """Verifies the pairs of each meeting of two chunks; meetings may run over batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, MEMBERS_AT_ONCE):
                part = batch.slice(at, MEMBERS_AT_ONCE)
                rest = part if rest is None else pa.concat_batches([rest, part])
                keys = np.stack([rest.column(c).to_numpy().astype(np.int64) for c in ("list", "low", "high")])
                cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
                if cuts.size:
                    yield from _verified(rest.slice(0, cuts[-1]), cuts[:-1], cosine)
                    rest = rest.slice(cuts[-1])
        if rest is not None:
            keys = np.stack([rest.column(c).to_numpy().astype(np.int64) for c in ("list", "low", "high")])
            yield from _verified(rest, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, cosine)

    return run


def _verified(batch: pa.RecordBatch, cuts: np.ndarray, cosine: float) -> Iterator[pa.RecordBatch]:
    vectors, ids = unit(_vectors(batch)), batch.column("node").to_numpy()
    copies, before = batch.column("copies").to_numpy(), batch.column("before").to_pylist()
    chunk, low, high = (batch.column(c).to_numpy() for c in ("chunk", "low", "high"))
    nodes, links, us, vs = [], [], [], []
    edges = [0, *cuts.tolist(), len(ids)]
    for a, b in zip(edges, edges[1:]):
        if b - a < 2:
            continue
        near = vectors[a:b] @ vectors[a:b].T >= cosine
        np.fill_diagonal(near, False)
        if low[a] != high[a]:
            near &= chunk[a:b, None] != chunk[None, a:b]
        if not near.any():
            continue
        near &= _first_list(before[a:b])
        linked = np.flatnonzero(near.any(1))
        if not linked.size:
            continue
        nodes.append(ids[a:b][linked])
        links.append(near[linked] @ copies[a:b])
        root = _roots(near)
        moved = np.flatnonzero(root != np.arange(b - a))
        us.append(ids[a:b][moved])
        vs.append(ids[a:b][root[moved]])
    if nodes:
        counted, joined = sum(map(len, nodes)), sum(map(len, us))
        whole = lambda parts, ahead, behind: pa.concat_arrays([pa.nulls(ahead, pa.int64()), pa.array(np.concatenate(parts), pa.int64()), pa.nulls(behind, pa.int64())])
        yield pa.RecordBatch.from_arrays([whole(nodes, 0, joined), whole(links, 0, joined), whole(us, counted, 0), whole(vs, counted, 0)], names=["node", "links", "u", "v"])


def _first_list(before: list[bytes]) -> np.ndarray:
    """Whether this list is the first one of each pair: no smaller shared pivots outside it."""
    kinds: dict[bytes, int] = {}
    of = np.array([kinds.setdefault(x, len(kinds)) for x in before])
    pivots: dict[int, int] = {}
    sets = [[pivots.setdefault(p, len(pivots)) for p in np.frombuffer(x, dtype=np.int32).tolist()] for x in kinds]
    held = np.zeros((len(kinds), max(len(pivots), 1)), dtype=np.float32)
    for k, some in enumerate(sets):
        held[k, some] = 1
    return (held @ held.T == 0)[of[:, None], of[None, :]]


def _roots(near: np.ndarray) -> np.ndarray:
    """For each place the smallest place that links lead to."""
    root = np.full(len(near), -1)
    for start in range(len(near)):
        if root[start] < 0:
            root[start], front = start, np.array([start])
            while front.size:
                front = np.flatnonzero(near[front].any(0) & (root < 0))
                root[front] = start
    return root
