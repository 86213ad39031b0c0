"""Removal of word windows that occur more than once, by super-k-mer partitioning.

A window is ``width`` consecutive words. Its minimiser is the run of ``seed`` words in
it with the smallest hash. Consecutive windows that share a minimiser travel together as
one packed string to the minimiser's bucket; equal windows have equal minimisers, so
they meet there, and sorting window hashes counts them. A packed string holds 40 bits for
each word. Windows count as equal if these, and the minimiser's 64-bit hash, give the
same 64-bit hash: of a million million pairs of windows that differ in one word, one is
taken for equal.

Tasks count within their own block of texts first: a window that occurs twice there is
marked at once, and only its first occurrence is sent on. However often a passage
occurs, a bucket gets it once per block.

Defined results: a null or empty text has no words and keeps the empty text; a text of
fewer words than a window keeps all; windows do not cross texts; rows that repeat id and
text make each other's windows repeated; ids may be null or repeat with other texts; an
empty table gives no rows; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import words as W
from codestrata.session import Scratch

WIDTH = 35
SEED = 5
# Windows in one packed string at most, so a monotonous text is many strings.
PACKED = 64
CODE = 5  # bytes of a word in a packed string
# Bytes of text counted together before anything is sent, and bytes of strings sorted together.
BLOCK = 24_000_000
BUCKETS = 16_000_000


def cleaned(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``(id, text, n_words, n_removed)``: the words no repeated window covers, joined by one space."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).withColumn("key", F.xxhash64("id", "text"))
    with Scratch(docs.sparkSession) as scratch:
        sent = rows.where(F.col("text").isNotNull()).select("key", "text").mapInArrow(_super_kmers(width, seed), "route long, seed long, packed binary, key long, start int, windows int, flag boolean")
        marks = scratch.keep(sent.repartition("route").sortWithinPartitions("seed").mapInArrow(_repeated(width), "key long, start int, stop int"))
        spans = scratch.keep(marks.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
        joined = rows.join(spans, "key", "left").select("id", "text", "spans.start", "spans.stop")
        return scratch.result(joined.mapInArrow(_kept, f"id {docs.schema[id].dataType.simpleString()}, text string, n_words long, n_removed long").withColumnRenamed("id", id))


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    reach = 1
    least = hashes
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(least[: least.size - rest], least[rest:]) if rest else least


def _super_kmers(width: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.Hasher()
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for batch in batches:
            for key, data in zip(batch.column("key").to_pylist(), W.texts(batch.column("text")), strict=True):
                held.append((key, hasher(data.split())))
                size += len(data)
                if size >= BLOCK:
                    yield from _block(held, width, seed)
                    held, size = [], 0
        if held:
            yield from _block(held, width, seed)

    return run


def _block(held: list[tuple[int, np.ndarray]], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    keys, sizes, windows, minima, codes = [], [], [], [], []
    for key, h in held:
        if h.size >= width:
            keys.append(key)
            sizes.append(h.size - width + 1)
            windows.append(W.window_hashes(h, width))
            minima.append(W.window_hashes(h, seed))
            minima[-1] = window_minima(minima[-1], width - seed + 1)
            codes.append(h.view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes())
    if not keys:
        return
    count, total = np.array(sizes), int(sum(sizes))
    window, least = np.concatenate(windows), np.concatenate(minima)
    doc = np.repeat(np.arange(count.size), count)
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    order = np.argsort(window, kind="stable")
    new = np.concatenate([[True], window[order][1:] != window[order][:-1]])
    first, twice = np.zeros(total, bool), np.zeros(total, bool)
    first[order] = new
    alone = new & np.append(new[1:], True)
    twice[order] = ~alone
    owners = np.array(keys)
    # Marks of what this block has found itself.
    starts, ends = _stretches(twice, doc)
    if starts.size:
        yield _sent(owners[doc[starts]], np.zeros(starts.size, np.int64), pa.nulls(starts.size, pa.binary()), owners[doc[starts]], at[starts], ends - starts, np.ones(starts.size, bool))
    # What is sent on: first occurrences, cut where the minimiser, the text or the mark changes.
    edge = np.ones(total, bool)
    edge[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (twice[1:] != twice[:-1]) | (first[1:] != first[:-1])
    place = np.arange(total)
    since = place - np.maximum.accumulate(np.where(edge, place, 0))
    edge |= since % PACKED == 0
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], total)
    some = first[starts]
    starts, ends = starts[some], ends[some]
    cuts = zip(doc[starts].tolist(), (at[starts] * CODE).tolist(), ((at[starts] + ends - starts + width - 1) * CODE).tolist(), strict=True)
    packed = [codes[d][a:b] for d, a, b in cuts]
    for k in range(0, starts.size, 20_000):
        cut = slice(k, k + 20_000)
        s = starts[cut]
        mini = least[s].view(np.int64)
        yield _sent(mini, mini, pa.array(packed[cut], pa.binary()), owners[doc[s]], at[s], ends[cut] - s, twice[s])


def _stretches(on: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true values inside one document."""
    before = np.concatenate([[False], on[:-1] & (doc[1:] == doc[:-1])])
    after = np.concatenate([on[1:] & (doc[1:] == doc[:-1]), [False]])
    return np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1


def _sent(route, seed, packed, key, start, windows, flag) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(route), pa.array(seed), packed, pa.array(key), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(flag)],
        names=["route", "seed", "packed", "key", "start", "windows", "flag"],
    )


def _repeated(width: int):
    """Buckets, sorted by minimiser, to marked word ranges."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            packed = batch.column("packed")
            if packed.null_count:
                done = batch.filter(packed.is_null())
                yield _marks(done.column("key").to_numpy(), done.column("start").to_numpy(), done.column("windows").to_numpy(), width)
                batch = batch.filter(packed.is_valid())
            if not batch.num_rows:
                continue
            seeds = batch.column("seed").to_numpy()
            if size >= BUCKETS:
                # A bucket ends where the minimiser changes; all before that place is complete.
                cut = int(np.argmax(seeds != held[-1].column("seed")[-1].as_py())) if seeds[-1] != held[-1].column("seed")[-1].as_py() else 0
                if seeds[0] != held[-1].column("seed")[-1].as_py() or cut:
                    yield from _counted([*held, batch.slice(0, cut)], width)
                    batch, held, size = batch.slice(cut), [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from _counted(held, width)

    return run


def _counted(held: list[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    seed, key, start, count, flag = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("seed", "key", "start", "windows", "flag"))
    parts = []
    for packed in (b.column("packed") for b in held if b.num_rows):
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        data = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, CODE)
        words = np.zeros((data.shape[0], 8), np.uint8)
        words[:, :CODE] = data
        every = W.window_hashes(W.mix(words.view(np.uint64).ravel()), width)
        # Windows over two strings are left out.
        valid = np.ones(data.shape[0], bool)
        ends = (offsets[1:] - offsets[0]) // CODE
        for gap in range(1, width):
            valid[ends - gap] = False
        parts.append(every[valid[: every.size]])
    row = np.repeat(np.arange(seed.size), count)
    offset = np.arange(row.size) - np.repeat(np.cumsum(count) - count, count)
    window = np.concatenate(parts) ^ W.mix(seed[row].view(np.uint64))
    order = np.argsort(window, kind="stable")
    new = np.concatenate([[True], window[order][1:] != window[order][:-1]])
    alone = new & np.append(new[1:], True)
    twice = np.zeros(row.size, bool)
    twice[order] = ~alone
    twice &= ~flag[row]
    starts, ends = _stretches(twice, row)
    if starts.size:
        yield _marks(key[row[starts]], start[row[starts]] + offset[starts], ends - starts, width)


def _marks(key: np.ndarray, start: np.ndarray, windows: np.ndarray, width: int) -> pa.RecordBatch:
    start = start.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(start), pa.array((start + windows + width - 1).astype(np.int32))], names=["key", "start", "stop"])


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, n_words, n_removed = [], [], []
        for data, starts, stops in zip(W.texts(batch.column("text")), batch.column("start").to_pylist(), batch.column("stop").to_pylist(), strict=True):
            words = (data or b"").split()
            kept = words
            if starts:
                change = np.zeros(len(words) + 1, np.int32)
                np.add.at(change, starts, 1)
                np.add.at(change, stops, -1)
                kept = [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
            out.append(b" ".join(kept))
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
        text = pa.array(out, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("id"), text, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["id", "text", "n_words", "n_removed"])
