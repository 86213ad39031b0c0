"""Benchmark items found inside documents: exact prefix filter, verified exactly.

Sets of word shingles, A-Z lower-cased, are compared. An item of n shingles is found where
at least 75 % of them occur, so a document that contains it lacks at most n / 4: of any
n - ceil(3 n / 4) + 1 of its shingles at least one occurs there. Those with the smallest
mixed hashes are the item's keys. A document probes all its shingles, so every pair that
fits is a candidate, whatever the size of item and document. Candidates are verified on
whole shingle sets.

What travels to all tasks is one bitmap of fixed size over the items' keys. It only drops
shingles that are no key; those left are joined by Spark.

Defined results: items or documents without words match nothing; fewer words than a
shingle are one shingle; repeated ids are matched row by row and reported once per pair
of ids, and rows and items without an id have no pair to report; ``keep_clean`` judges
each row by its own text against every item, whatever their ids; empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import words as W
from codestrata.session import Scratch

SHINGLE = 5
PERCENT = 75
BITMAP_BITS = 1 << 23


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(item_id, doc_id, n_item, n_shared)`` for every document that contains an item."""
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("text")).where("d is not null and text is not null")
    wanted = items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("text")).where("i is not null and text is not null")
    kind = {"d": docs.schema[doc_id].dataType.simpleString(), "i": items.schema[item_id].dataType.simpleString()}
    with Scratch(docs.sparkSession) as scratch:
        named = scratch.keep(wanted.mapInArrow(_item_keys(width), f"i {kind['i']}, value long"))
        bitmap = _bitmap(named)
        found = rows.mapInArrow(_doc_keys(width, bitmap), f"d {kind['d']}, value long")
        pairs = scratch.keep(found.join(named, "value").select("i", "d").distinct())
        held = scratch.keep(rows.join(pairs.select("d").distinct(), "d", "left_semi"))
        both = pairs.join(held.withColumnRenamed("text", "whole"), "d").join(wanted, "i").select("i", "d", "whole", "text")
        checked = both.mapInArrow(_contained(width), f"i {kind['i']}, d {kind['d']}, n_item long, n_shared long")
        best = checked.groupBy("i", "d").agg(F.max_by(F.struct("n_item", "n_shared"), F.struct("n_shared", "n_item")).alias("m"))
        return scratch.result(best.select(F.col("i").alias(item_id), F.col("d").alias(doc_id), "m.n_item", "m.n_shared"))


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows whose text contains no item, with their own columns. Texts are told apart by a hash, so ids may be null or repeat."""
    row = F.xxhash64(F.col(text).cast("string"))
    given, wanted = (table.select(row.alias(name), text) for table, name in ((docs, doc_id), (items, item_id)))
    found = matches(given, wanted, doc_id, item_id, text).select(F.col(doc_id).alias("_found")).distinct()
    return docs.join(found, F.xxhash64(docs[text].cast("string")) == F.col("_found"), "left_anti")


def keys(shingles: np.ndarray) -> np.ndarray:
    """So many of an item's shingles that a document with the required share of them has one at least."""
    lacking = shingles.size * (100 - PERCENT) // 100
    return shingles[np.argsort(W.mix(shingles))[: lacking + 1]]


def _shingles(hasher: W.Hasher, data: bytes | None, width: int) -> np.ndarray:
    return W.shingle_hashes(hasher(W.lower_ascii(data or b"").split()), width)


def _item_keys(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.Hasher()
        for batch in batches:
            rows, values = [], []
            for at, data in enumerate(W.texts(batch.column("text"))):
                shingles = _shingles(hasher, data, width)
                if shingles.size:
                    made = keys(shingles)
                    rows.append(np.full(made.size, at))
                    values.append(made)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(values).view(np.int64))], names=["i", "value"])

    return run


def _bitmap(named: DataFrame) -> np.ndarray:
    """Which of ``BITMAP_BITS`` places the items' keys fall on: words of 64 bits, made by a grouping."""
    place = F.pmod(F.col("value"), F.lit(BITMAP_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(value, {BITMAP_BITS}) % 64 as int))")
    words = named.select(F.floor(place / 64).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _doc_keys(width: int, bitmap: np.ndarray):
    packed = np.packbits(bitmap, bitorder="little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = W.Hasher(), np.unpackbits(packed, bitorder="little").view(bool)
        for batch in batches:
            rows, values = [], []
            for at, data in enumerate(W.texts(batch.column("text"))):
                made = _shingles(hasher, data, width)
                made = made[known[(made & np.uint64(BITMAP_BITS - 1)).astype(np.int64)]]
                if made.size:
                    rows.append(np.full(made.size, at))
                    values.append(made)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("d").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(values).view(np.int64))], names=["d", "value"])

    return run


def _contained(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.Hasher()
        for batch in batches:
            whole, items = W.texts(batch.column("whole")), W.texts(batch.column("text"))
            last, held, sizes, shared = None, None, [], []
            for data, item in zip(whole, items, strict=True):
                if data is not last:
                    last, held = data, _shingles(hasher, data, width)
                wanted = _shingles(hasher, item, width)
                sizes.append(wanted.size)
                shared.append(np.intersect1d(held, wanted, assume_unique=True).size)
            n, s = np.array(sizes, dtype=np.int64), np.array(shared, dtype=np.int64)
            fits = pa.array((100 * s >= PERCENT * n) & (s > 0))
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("d"), pa.array(n), pa.array(s)], names=["i", "d", "n_item", "n_shared"]).filter(fits)

    return run
