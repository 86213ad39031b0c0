"""Jaccard self-join of word shingles over parity sketches.

The sketch of a shingle set has one bit per position and every shingle flips one bit,
so the Hamming distance of two sketches is at most the size of the symmetric
difference. Two sets of sizes a and b with Jaccard similarity of 75 % differ in at most
(a + b) / 7 shingles. Sets are put into bands of size; the sketch of a band is cut into
more blocks than that number, so linked sets agree in at least one block, and blocks
are joined on equality. Short sketches then drop candidates whose Hamming distance is
too large, and what is left is verified on whole shingle sets.

Which blocks are sent: all blocks of a band stand in one fixed order, those with many
shingles first and empty ones last. If at most d of m blocks differ, the first block
both agree in is among the first d + 1 of either, so only those are sent. A block
travels as the XOR of 64-bit keys of its set bits.

Equal sets are one node, so copies give no pairs. Tasks first join within
their own rows and forward one leader. A block shared by more than ``SMALL`` nodes gives
pairs with its leader and between neighbours only; what they link is contracted, and
only blocks still shared by several components are compared further, chunk against
chunk, across components, emitting pairs that pass the Hamming bound. In a large group of
sets just under the bound nearly all pairs pass it and are verified one by one.

Defined results: texts without words and null texts have no shingles, link with nothing
and are
their own component; fewer words than a shingle are one shingle; a row without an id
keeps its set size and has a null component; equal sets always link, whatever their ids;
rows that repeat an id with another text are not linked by that; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import words as W
from codestrata.llm.bitmaps import bitmap, possible
from codestrata.operators.graph import connected_components
from codestrata.session import Scratch

SHINGLE = 5
PERCENT = 75
RATIO = 4  # of the largest to the smallest size in a band
SMALL = 4  # nodes of a block that are compared with each other outright
CHUNK = 256
TOKENS_AT_ONCE = 1_000_000
SEEN_AT_ONCE = 200_000


def components(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(id, n_shingles, component_id)`` for each row; a component's id is its smallest document id."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        facts = scratch.keep(rows.mapInArrow(_facts(width), "id long, n long, hi long, lo long, sketch binary"))
        nodes = scratch.keep(
            facts.where("n > 0 and id is not null").groupBy("hi", "lo")
            .agg(F.min("id").alias("rep"), F.min_by(F.struct("n", "sketch"), "id").alias("s")).select("hi", "lo", "rep", "s.n", "s.sketch")
        )
        blocks = rows.where("id is not null").mapInArrow(_blocks(width), "route long, token long, node long, flag int, other long")
        found = scratch.keep(
            blocks.repartition("route").sortWithinPartitions("token", "node").mapInArrow(_agreeing, "token long, a long, b long")
        )
        pairs = found.where("b is not null").select("a", "b")
        links = scratch.keep(_verified(scratch, rows, _close(pairs, nodes), nodes, width))
        joined = scratch.keep(connected_components(links))
        more = _across(scratch, found.where("b is null").select("token", F.col("a").alias("node")), nodes, joined)
        if more is not None:
            extra = scratch.keep(_verified(scratch, rows, more, nodes, width))
            joined = scratch.keep(connected_components(links.unionByName(extra)))
        placed = nodes.select("hi", "lo", "rep").join(joined.withColumnRenamed("node", "lo"), "lo", "left").withColumn("component", F.coalesce("component", "lo"))
        named = placed.join(placed.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("hi", "lo", "component_id")
        result = facts.drop("sketch").join(named, ["hi", "lo"], "left").select(
            F.col("id").alias(id), F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        )
        return scratch.result(result)


def most_differing(a: int, b: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of linked sets of these sizes: 100 |I| >= percent |U|."""
    return (100 - percent) * (a + b) // (100 + percent)


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets of hashes are similar enough."""
    common = np.intersect1d(a, b, assume_unique=True).size
    return 100 * common >= percent * (a.size + b.size - common) and common > 0


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _facts(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.Hasher()
        for batch in batches:
            sizes, keys, sketches = [], [], []
            for data in W.texts(batch.column("text")):
                shingles = W.shingle_hashes(hasher(W.lower_ascii(data or b"").split()), width)
                sizes.append(shingles.size)
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                sketches.append(sketch(shingles))
            both = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(sketches, pa.binary())],
                names=["id", "n", "hi", "lo", "sketch"],
            )

    return run


def sketch(shingles: np.ndarray) -> bytes:
    """The parity of each of 2**k positions, at least two positions per shingle."""
    bits = max(64, 1 << (2 * max(shingles.size, 1) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches; the longer one is folded, which keeps it a parity sketch."""
    return _distance(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64))


def _distance(x: np.ndarray, y: np.ndarray) -> int:
    n = min(x.size, y.size)
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, n)) ^ np.bitwise_xor.reduce(y.reshape(-1, n))).sum())


def _bands(n: int) -> list[tuple[int, int, int]]:
    """``(band, blocks, sent)`` for a set of n shingles: its own band, and the next if a larger partner may be there."""
    band, low = 0, 1
    while low * RATIO <= n:
        band, low = band + 1, low * RATIO
    out = []
    largest = 100 * n // PERCENT
    for k, first in ((band, low), (band + 1, low * RATIO)):
        last = first * RATIO - 1
        if largest >= first:
            most = most_differing(last, last)
            out.append((k, most + 1 + most // 7, most_differing(n, min(largest, last)) + 1))
    return out


def tokens(shingles: np.ndarray) -> np.ndarray:
    """The blocks to send, as 64-bit tokens that name band, place and content."""
    out = []
    keys = W.mix(shingles + W.STEP)
    for band, blocks, sent in _bands(shingles.size):
        # Shingles are sorted and a block is a range of hashes, so each block is a run.
        place = ((shingles >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        salt = np.uint64(band << 40)
        made = W.mix(np.bitwise_xor.reduceat(keys, starts) ^ W.mix(place[starts] + salt))
        filled = np.diff(np.append(starts, shingles.size))
        order = (np.uint64(255) - np.minimum(filled, 255).astype(np.uint64) << np.uint64(56)) | (made >> np.uint64(8))
        if made.size > sent:
            made = made[np.argpartition(order, sent - 1)[:sent]]
        elif made.size < sent:
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), place[starts])[: sent - made.size]
            made = np.concatenate([made, W.mix(W.mix(empty + salt))])
        out.append(made)
    return np.concatenate(out)


def _blocks(width: int):
    """Rows of ``(route, token, node, flag, other)``: tokens to be joined, and what a task has already joined."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = W.Hasher(), set()
        held, nodes, size = [], [], 0
        for batch in batches:
            for data in W.texts(batch.column("text")):
                shingles = W.shingle_hashes(hasher(W.lower_ascii(data or b"").split()), width)
                key = xxhash.xxh3_128_digest(shingles.tobytes())
                if not shingles.size or key in seen:
                    continue
                if len(seen) >= SEEN_AT_ONCE:
                    seen.clear()
                seen.add(key)
                made = tokens(shingles)
                held.append(made)
                nodes.append(np.full(made.size, np.frombuffer(key, dtype=np.int64)[1]))
                size += made.size
                if size >= TOKENS_AT_ONCE:
                    yield from _combined(held, nodes)
                    held, nodes, size = [], [], 0
        if size:
            yield from _combined(held, nodes)

    return run


def _combined(held: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Join tokens that many nodes of this task share; forward their leader, flagged, and all other tokens."""
    token, node = np.concatenate(held).view(np.int64), np.concatenate(nodes)
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    lengths = np.diff(np.append(starts, token.size))
    large = lengths > 2 * SMALL
    inside = np.repeat(large, lengths)
    first = np.zeros(token.size, dtype=bool)
    first[starts] = True
    send = ~inside | first
    yield _rows(token[send], token[send], node[send], inside[send].astype(np.int32), None)
    if inside.any():
        members = inside
        yield _rows(node[members], token[members], node[members], np.full(members.sum(), 2, np.int32), None)
        leader = np.repeat(node[starts], lengths)
        yield _pairs_of(token, node, leader, inside)


def _pairs_of(token: np.ndarray, node: np.ndarray, leader: np.ndarray, inside: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs with the leader and with the neighbour in the run."""
    near = inside[1:] & (token[1:] == token[:-1])
    pairs = np.unique(np.concatenate([np.stack([leader[inside], node[inside]], 1), np.stack([node[:-1][near], node[1:][near]], 1)]), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    a, b = np.minimum(pairs[:, 0], pairs[:, 1]), np.maximum(pairs[:, 0], pairs[:, 1])
    return _rows(a ^ b, np.zeros(a.size, np.int64), a, np.full(a.size, 3, np.int32), b)


def _rows(route, token, node, flag, other) -> pa.RecordBatch:
    last = pa.nulls(len(route), pa.int64()) if other is None else pa.array(other)
    return pa.RecordBatch.from_arrays([pa.array(route), pa.array(token), pa.array(node), pa.array(flag), last], names=["route", "token", "node", "flag", "other"])


def _agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal tokens, in order: pairs ``(null, a, b)``, and members ``(token, a, null)`` of large runs.

    A run holds a few nodes per task at most, since tasks have combined before, so the one
    run that crosses two batches is kept whole.
    """
    rest = None
    for batch in batches:
        part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 4)] + [batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)]
        if rest is not None:
            part = [np.concatenate(x) for x in zip(rest, part, strict=True)]
        cut = np.searchsorted(part[0], part[0][-1]) if part[0].size else 0
        rest = [x[cut:] for x in part]
        yield _runs(*[x[:cut] for x in part])
    if rest is not None and rest[0].size:
        yield _runs(*rest)


def _runs(token: np.ndarray, node: np.ndarray, flag: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    done = flag == 3
    out = [(np.zeros(done.sum(), np.int64), node[done], other[done])]
    gone = flag == 2
    members = [(token[gone], node[gone])]
    token, node, flag = (x[~done & ~gone] for x in (token, node, flag))
    if token.size:
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        hot = np.unique(token[flag == 1])
        token, node = token[new], node[new]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        lengths = np.diff(np.append(starts, token.size))
        large = (lengths > SMALL) | np.isin(token[starts], hot)
        for gap in range(1, SMALL):
            a, b = node[:-gap], node[gap:]
            same = (token[:-gap] == token[gap:]) & ~np.repeat(large, lengths)[gap:]
            out.append((np.zeros(same.sum(), np.int64), a[same], b[same]))
        inside = np.repeat(large, lengths)
        if inside.any():
            members.append((token[inside], node[inside]))
            made = _pairs_of(token, node, np.repeat(node[starts], lengths), inside)
            out.append((np.zeros(made.num_rows, np.int64), made.column("node").to_numpy(), made.column("other").to_numpy()))
    a, b = np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])
    if a.size:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        a, b = pairs[:, 0], pairs[:, 1]
    t, m = np.concatenate([x[0] for x in members]), np.concatenate([x[1] for x in members])
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([pa.nulls(a.size, pa.int64()), pa.array(t)]), pa.array(np.concatenate([a, m])), pa.concat_arrays([pa.array(b), pa.nulls(m.size, pa.int64())])],
        names=["token", "a", "b"],
    )


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes whose sketches are no further apart than linked sets may be."""
    side = lambda s: nodes.select(F.col("lo").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    fitting = both.where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, s_a, s_b = (batch.column(k).to_pylist() for k in range(2, 6))
            near = [hamming(x, y) <= most_differing(a, b) for a, b, x, y in zip(n_a, n_b, s_a, s_b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return fitting.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _verified(scratch: Scratch, rows: DataFrame, pairs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The pairs ``(u, v)`` whose whole shingle sets are similar enough."""
    pairs = scratch.keep(pairs)
    ends = pairs.select(F.col("u").alias("lo")).unionByName(pairs.select(F.col("v").alias("lo"))).distinct()
    wanted = scratch.keep(nodes.select("lo", F.col("rep").alias("id")).join(ends, "lo"))
    found = possible(rows, "id", bitmap(wanted, "id")).join(wanted, "id").select("lo", "text")
    held = scratch.keep(found.mapInArrow(_of_node(width), "node long, text string").dropDuplicates(["node"]))
    both = pairs.join(held.toDF("u", "text_u"), "u").join(held.toDF("v", "text_v"), "v").select("u", "v", "text_u", "text_v")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.Hasher()
        made = lambda data: W.shingle_hashes(hasher(W.lower_ascii(data or b"").split()), width)
        for batch in batches:
            last, known, fits = None, None, []
            for x, y in zip(W.texts(batch.column("text_u")), W.texts(batch.column("text_v")), strict=True):
                if x != last:
                    last, known = x, made(x)
                fits.append(links(known, made(y)))
            yield batch.select(["u", "v"]).filter(pa.array(fits, pa.bool_()))

    return both.mapInArrow(run, "u long, v long").distinct()


def _of_node(width: int):
    """Texts that have the node's set; an id may stand on other rows too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.Hasher()
        for batch in batches:
            made = [W.shingle_hashes(hasher(W.lower_ascii(data or b"").split()), width) for data in W.texts(batch.column("text"))]
            keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[1] for s in made], dtype=np.int64)
            same = pa.array(keys == batch.column("lo").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("lo"), batch.column("text")], names=["node", "text"]).filter(same)

    return run


def _across(scratch: Scratch, members: DataFrame, nodes: DataFrame, joined: DataFrame) -> DataFrame | None:
    """Close pairs between components that still share a block; None if no block is shared any more."""
    placed = members.distinct().join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = scratch.keep(placed)
    open_ = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high")
    open_ = scratch.keep(open_.select("token", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")))
    if open_.isEmpty():
        return None
    rows = placed.join(open_, "token").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # Sketches come last, so only rows of blocks that are still open carry them.
    rows = rows.join(nodes.select(F.col("lo").alias("node"), "n", "sketch").dropDuplicates(["node"]), "node")
    rows = rows.select("token", F.least("chunk", "with").alias("c1"), F.greatest("chunk", "with").alias("c2"), "chunk", "node", "component", "n", "sketch")
    together = rows.repartition("token", "c1", "c2").sortWithinPartitions("token", "c1", "c2")
    return together.mapInArrow(_compared, "u long, v long").distinct()


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (block, two chunks) to close pairs between the chunks and across components.

    A group is at most two chunks of rows, so the one that crosses two batches is kept whole.
    """
    rest = None
    for batch in batches:
        table = batch if rest is None else pa.concat_batches([rest, batch])
        keys = np.stack([table.column(k).to_numpy() for k in range(3)])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])) if table.num_rows else np.zeros(0, np.int64)
        if not starts.size:
            continue
        yield _close_in(table, starts)
        rest = table.slice(int(starts[-1]))
    if rest is not None:
        yield _close_in(rest, np.array([0, rest.num_rows]))


def _close_in(table: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    c1, c2, chunk, node, comp, n = (table.column(k).to_numpy() for k in range(1, 7))
    found = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        size, group = n[a:b], comp[a:b]
        i, j = np.triu_indices(b - a, 1)
        fits = (group[i] != group[j]) & (100 * np.minimum(size[i], size[j]) >= PERCENT * np.maximum(size[i], size[j]))
        if c1[a] != c2[a]:
            fits &= chunk[a:b][i] != chunk[a:b][j]
        i, j = i[fits], j[fits]
        if not i.size:
            continue
        marks = [np.frombuffer(s, dtype=np.uint64) for s in table.column(7).slice(a, b - a).to_pylist()]
        words = min(m.size for m in marks)
        folded = np.stack([np.bitwise_xor.reduce(m.reshape(-1, words)) for m in marks])
        most = (100 - PERCENT) * (size[i] + size[j]) // (100 + PERCENT)
        # The short sketches first, in slabs of bounded size, then the whole ones of what is left.
        near = np.concatenate([np.bitwise_count(folded[i[k : k + 20_000]] ^ folded[j[k : k + 20_000]]).sum(1) for k in range(0, i.size, 20_000)]) <= most
        found += [(node[a + x], node[a + y]) for x, y, m in zip(i[near], j[near], most[near]) if _distance(marks[x], marks[y]) <= m]
    pairs = np.unique(np.sort(np.array(found, dtype=np.int64).reshape(-1, 2), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])
