"""The trie of conversation prefixes, built from sorted shards and a skeleton of splitters.

A conversation is a path of turns; each turn travels as a digest of 16 bytes and the
length of its text. Paths are range-partitioned and sorted, so the members of a node stand
next to each other. The first paths of the shards are the splitters. Only prefixes of a
splitter can have members in two shards: the trie of the splitters, the skeleton, is
broadcast, every task finishes all other nodes of its shard alone, and for skeleton nodes
it emits what it saw. Those partial rows are added up, so a first turn or a whole
conversation that a third of all conversations share is spread over as many shards as its
members fill, and costs one row a shard.

Bounds: a shard holds about ``TURNS`` turns; one conversation's digests are one row, its
texts never are. Splitters above ``SKELETON`` bytes in all are thinned by merging
neighbouring shards, so the broadcast and the rows of the skeleton on the driver are bounded.

Defined results: null roles and texts are empty; a null turn comes first; equal turns are
ordered by role, then by digest of the text; rows without a conversation id belong to
none; repeated rows are turns of their own; conversations without turns belong to the root;
without conversations there is no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import Scratch

WIDTH = 16
TURNS = 2_000_000
SKELETON = 32_000_000
IDS_AT_ONCE = 1000
NOBODY = hashlib.sha256(b"").hexdigest()
NODES = (
    "conv_id long, depth long, parent_conv_id long, under int, owner int, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, length long, ends string, shard int, seq int"
)


def paths(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns in order, as ``(digest, length)``."""
    words = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = turns.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), words(role).alias("role"), words(text).alias("text"))
    whole = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    item = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", F.substring(whole, 1, 2 * WIDTH).alias("digest"), F.length("text").alias("length"))
    ordered = rows.select("conv_id", item.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["length"].alias("length"))).alias("turns"))


def grafted(own: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation ``c`` behind the first turns of conversation ``c - c % every``.

    Their number is the checksum of ``c`` modulo ``heads``, and as many of its own first
    turns go. A base has at most ``2 * every - 1`` conversations.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    first = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = own.withColumn("_base", base).join(first, "_base", "left").withColumn("_h", taken)
    head = F.when(F.col("_head").isNotNull(), F.slice("_head", F.lit(1), F.col("_h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def trie(scratch: Scratch, conversations: DataFrame, most_turns: int = TURNS) -> DataFrame:
    """One row per node of the trie of ``conversations(conv_id, turns)``, whose ids are unique.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, the digest of the ascending ids that end there.
    """
    flat = conversations.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["length"].cast("int")).alias("lengths")
    )
    spark = conversations.sparkSession
    size = conversations.agg(F.sum(F.size("turns") + 1)).first()[0]
    if size is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // most_turns))
    dealt = scratch.keep(flat.repartitionByRange(width, "key", "conv_id").withColumn("shard", F.spark_partition_id()))
    skeleton = _skeleton(dealt)
    step = skeleton.step
    placed = dealt.withColumn("shard", F.floor(F.col("shard") / step).cast("int"))
    # Plain values, so that executors unpack them without this package.
    held = spark.sparkContext.broadcast((skeleton.step, skeleton.shards, skeleton.keys, skeleton.owners))
    seen = scratch.keep(
        placed.repartitionById(-(-width // step), "shard").sortWithinPartitions("shard", "key", "conv_id").mapInArrow(_shards(held), NODES)
    )
    names, top = _finished(spark, skeleton, seen.where("owner is not null"))
    local = seen.where("owner is null")
    under = local.where("under is not null").drop("parent_conv_id").join(
        top.select(F.col("owner").alias("under"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id")), ["under", "depth"]
    )
    joined = local.where("under is null").select(*names, "ends").unionByName(under.select(*names, "ends")).unionByName(top.select(*names, "ends"))
    return joined.withColumnRenamed("ends", "ends_sha256")


@dataclass(frozen=True)
class Skeleton:
    """The splitters, and for each of their prefixes the first splitter that has it."""

    step: int
    shards: tuple[int, ...]
    keys: tuple[bytes, ...]
    owners: tuple[np.ndarray, ...]

    def owner(self, at: int, depth: np.ndarray) -> np.ndarray:
        return self.owners[at][depth]


def _skeleton(dealt: DataFrame) -> Skeleton:
    firsts = dealt.groupBy("shard").agg(F.min_by("key", F.struct("key", "conv_id")).alias("key"))
    bytes_ = firsts.agg(F.sum(F.length("key"))).first()[0]
    step = 1 + bytes_ // SKELETON
    kept = firsts.withColumn("to", F.floor(F.col("shard") / step).cast("int")).groupBy("to").agg(F.min_by("key", "shard").alias("key"))
    rows = sorted((r["to"], bytes(r["key"])) for r in kept.collect())[1:]
    owners: list[np.ndarray] = []
    for at, (_, key) in enumerate(rows):
        common = shared(rows[at - 1][1], key) if at else -1
        fresh = np.full(len(key) // WIDTH - common, at, dtype=np.int32)
        owners.append(np.concatenate([owners[-1][: common + 1], fresh]) if at else fresh)
    return Skeleton(step, tuple(s for s, _ in rows), tuple(k for _, k in rows), tuple(owners))


def shared(a: bytes, b: bytes) -> int:
    """How many first turns two paths have in common."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: high * WIDTH] == b[: high * WIDTH]:
        return high
    step = 1
    while a[low * WIDTH : (low + step) * WIDTH] == b[low * WIDTH : (low + step) * WIDTH]:
        low, step = low + step, 2 * step
    high = min(high, low + step)
    while low + 1 < high:
        middle = (low + high) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle
    return low


def _shards(held):
    """Rows of ``NODES`` for every shard: finished nodes, or parts of skeleton nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton = Skeleton(*held.value)
        ids: list[np.ndarray] = []
        keys: list[bytes] = []
        lengths: list[np.ndarray] = []
        at = None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            for start, end in _runs(shards):
                if at is not None and shards[start] != at:
                    yield from _shard(skeleton, at, ids, keys, lengths)
                    ids, keys, lengths = [], [], []
                at, part = shards[start], batch.slice(start, end - start)
                ids.append(part.column("conv_id").to_numpy())
                keys.extend(part.column("key").to_pylist())
                lengths.append(part.column("lengths").flatten().to_numpy())
        if at is not None:
            yield from _shard(skeleton, at, ids, keys, lengths)

    return run


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _levels(ids: np.ndarray, depth: np.ndarray, common: np.ndarray) -> list[dict[str, np.ndarray]]:
    """For each depth the nodes of a sorted shard, in order: first row, members, ends."""
    levels, active = [], np.arange(len(ids))
    while active.size:
        d = len(levels)
        cut = np.flatnonzero(common[active] < d)
        ending = depth[active] == d
        levels.append({
            "start": active[cut], "last": active[np.append(cut[1:], active.size) - 1], "n": np.diff(np.append(cut, active.size)),
            "least": np.minimum.reduceat(ids[active], cut), "ends": np.add.reduceat(ending.astype(np.int64), cut),
        })
        active = active[~ending]
    return levels


def _shard(skeleton: Skeleton, shard: int, parts: list[np.ndarray], keys: list[bytes], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    ids, lengths = np.concatenate(parts), np.concatenate(sizes)
    depth = np.array([len(k) // WIDTH for k in keys])
    common = np.array([-1, *(shared(a, b) for a, b in zip(keys, keys[1:]))])
    offset = np.cumsum(depth) - depth
    here = int(np.searchsorted(skeleton.shards, shard))
    mine = here if here < len(skeleton.shards) and skeleton.shards[here] == shard else None
    after = here + (mine is not None)
    ahead = shared(keys[-1], skeleton.keys[after]) if after < len(skeleton.keys) else -1
    levels = _levels(ids, depth, common)
    below = None
    for d in range(len(levels) - 1, -1, -1):
        level = levels[d]
        m = len(level["n"])
        owner = np.full(m, -1)
        if mine is not None and level["start"][0] == 0:
            owner[0] = skeleton.owner(mine, d)
        if d <= ahead and level["last"][-1] == len(ids) - 1:
            owner[-1] = skeleton.owner(after, d)
        length = lengths[offset[level["start"]] + d - 1].astype(np.int64) if d else np.zeros(m, np.int64)
        children, leaves, saved = np.zeros((3, m), np.int64)
        if below is not None:
            up = np.searchsorted(level["start"], below["start"], "right") - 1
            whole = below["owner"] < 0
            for into, values in ((children, np.ones(len(up), np.int64)), (leaves, below["leaves"]), (saved, below["saved"])):
                np.add.at(into, up[whole], values[whole])
            open_ = owner[up] >= 0
            yield from _rows(ids, shard, d + 1, below, np.where(open_ | ~whole, -1, up), level["least"], np.where(open_ & whole, owner[up], -1))
        done = owner < 0
        leaves[done & (children == 0)] = 1
        saved[done] += (level["n"][done] - 1) * length[done]
        below = level | {"owner": owner, "children": children, "leaves": leaves, "saved": saved, "length": length}
    yield from _rows(ids, shard, 0, below, np.array([-1]), below["least"], np.array([-1]))


def _rows(ids: np.ndarray, shard: int, d: int, level: dict, up: np.ndarray, least: np.ndarray, under: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes of one depth, and the ends of its skeleton nodes in pieces."""
    ends: list[str | None] = []
    pieces: list[tuple[int, int, str]] = []
    for start, count, owner in zip(level["start"].tolist(), level["ends"].tolist(), level["owner"].tolist()):
        if owner >= 0:
            for seq, at in enumerate(range(start, start + count, IDS_AT_ONCE)):
                pieces.append((owner, seq, ",".join(map(str, ids[at : min(at + IDS_AT_ONCE, start + count)].tolist()))))
            ends.append(None)
        else:
            ends.append(hashlib.sha256(",".join(map(str, ids[start : start + count].tolist())).encode()).hexdigest() if count else NOBODY)
    m = len(ends)
    fill = lambda values, none: pa.array(values, mask=none)
    columns = {
        "conv_id": pa.array(level["least"]), "depth": pa.array(np.full(m, d)), "parent_conv_id": fill(least[up], up < 0),
        "under": fill(under.astype(np.int32), under < 0), "owner": fill(level["owner"].astype(np.int32), level["owner"] < 0), "n_convs": pa.array(level["n"]),
        "n_children": pa.array(level["children"]), "n_leaves": pa.array(level["leaves"]), "saved_tokens": pa.array(level["saved"]), "length": pa.array(level["length"]),
        "ends": pa.array(ends, pa.string()), "shard": pa.array(np.full(m, shard, np.int32)), "seq": pa.nulls(m, pa.int32()),
    }
    yield pa.RecordBatch.from_pydict(columns)
    for at in range(0, len(pieces), IDS_AT_ONCE):
        some = pieces[at : at + IDS_AT_ONCE]
        given = {"depth": [d] * len(some), "owner": [p[0] for p in some], "seq": [p[1] for p in some], "ends": [p[2] for p in some], "shard": [int(shard)] * len(some)}
        yield pa.RecordBatch.from_arrays([pa.array(given[n], t.type) if n in given else pa.nulls(len(some), t.type) for n, t in zip(columns, columns.values())], names=list(columns))


def _finished(spark, skeleton: Skeleton, seen: DataFrame) -> tuple[list[str], DataFrame]:
    """The skeleton nodes from their parts; with one shard there are none."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = seen.where("seq is null").groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("length").alias("length"), *sums)
    nodes = {(r["owner"], r["depth"]): r.asDict() for r in parts.collect()}
    for (owner, depth), node in sorted(nodes.items(), key=lambda x: -x[0][1]):
        node["saved_tokens"] += (node["n_convs"] - 1) * node["length"]
        node["n_leaves"] = node["n_leaves"] if node["n_children"] else 1
        node["above"] = (int(skeleton.owner(owner, depth - 1)), depth - 1) if depth else None
        if depth:
            parent = nodes[node["above"]]
            parent["n_children"] += 1
            parent["n_leaves"] += node["n_leaves"]
            parent["saved_tokens"] += node["saved_tokens"]
    rows = [(key[0], *(nodes[n["above"]]["conv_id"] if c == "parent_conv_id" and n["above"] else n.get(c) for c in names)) for key, n in nodes.items()]
    top = spark.createDataFrame(rows, "owner int, " + ", ".join(f"{c} long" for c in names))
    pieces = seen.where("seq is not null").select("owner", "depth", "shard", "seq", "ends")
    ends = pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "shard", "seq").mapInArrow(_digests, "owner int, depth long, ends string")
    return names, top.join(ends, ["owner", "depth"], "left").fillna({"ends": NOBODY})


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node over its pieces in order; only the running state is held."""
    at, state = None, None
    done: list[tuple[int, int, str]] = []
    for batch in batches:
        for owner, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ends"))):
            if at == (owner, depth):
                state.update(b",")
            else:
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (owner, depth), hashlib.sha256()
            state.update(piece.encode())
    if at is not None:
        done.append((*at, state.hexdigest()))
    columns = list(zip(*done)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string()))], names=["owner", "depth", "ends"])
