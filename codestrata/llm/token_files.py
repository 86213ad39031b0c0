"""Documents counted in flat token files that have no index.

A token file is token ids of fixed width one after the other; each document ends with a
separator id. The scan cuts files into blocks of bytes, finds the separators of a block
with one vectorised comparison, and stitches documents that run over blocks by a prefix
scan over block summaries: the number of separators before a block gives the ordinal of
its first document, the last separator before it gives that document's start.

Defined results: a null or empty text is a document of no tokens; tokens behind the last
separator are one more document with ``closed`` false; a file without tokens has no
documents; repeated rows are separate documents; a file whose size is no multiple of the
token width raises an error, as do ids that do not fit it or a separator that is a token; other columns are not read. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm import stores
from codestrata.llm import words as W
from codestrata.llm.models import RANKS, model_bytes
from codestrata.session import Scratch

SEPARATOR = 50_256
# The published split of the byte-level vocabulary, a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FILE_BYTES = 64_000_000
BLOCK_BYTES = 4_000_000
KIND = "<u2"


def write(docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text", ranks: str = RANKS, separator: int = SEPARATOR, limit: int = FILE_BYTES) -> DataFrame:
    """Write token files of about ``limit`` bytes: ``(path, ordinal, id)`` names each document's place.

    File names are new in each attempt; only those in the returned rows belong to the result.
    """
    vocabulary = model_bytes(docs.sparkSession, ranks)
    most = np.iinfo(KIND).max
    ids = {int(line.split()[1]) for line in vocabulary.splitlines() if line}
    if max(ids, default=0) > most or not 0 <= separator <= most or separator in ids:
        raise ValueError(f"the vocabulary and the separator {separator} need ids of at most {most} that differ")
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        path, stream, size, ordinal = None, None, 0, 0
        end = np.array([separator], KIND).tobytes()
        for batch in batches:
            paths, ordinals = [], []
            for data in W.texts(batch.column("text")):
                if stream is None:
                    path, size, ordinal = f"{folder}/{uuid.uuid4().hex}.tokens", 0, 0
                    stream = stores.writer(path)
                made = encode((data or b"").decode("utf-8", "replace")).astype(KIND).tobytes() + end
                stream.write(made)
                paths.append(path)
                ordinals.append(ordinal)
                size, ordinal = size + len(made), ordinal + 1
                if size >= limit:
                    stream.close()
                    stream = None
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(ordinals, pa.int64()), batch.column("id")], names=["path", "ordinal", "id"])
        if stream is not None:
            stream.close()

    return rows.mapInArrow(run, f"path string, ordinal long, id {docs.schema[id].dataType.simpleString()}")


def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    made = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda text: made.encode_to_numpy(text, disallowed_special=())


def blocks(paths: DataFrame, separator: int = SEPARATOR, size: int = BLOCK_BYTES, kind: str = KIND) -> DataFrame:
    """``(path, block, tokens, separators)``: the places of separators, counted from the file's start."""
    width = np.dtype(kind).itemsize
    step = size - size % width

    def lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("path").to_pylist()
            sizes = []
            for path in found:
                with stores.reader(path) as file:
                    sizes.append(file.size())
            if any(n % width for n in sizes):
                raise ValueError(f"a token file is not a multiple of {width} bytes")
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, n in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "bytes")), strict=True):
                with stores.reader(path) as file:
                    tokens = np.frombuffer(file.read_at(min(step, n - block * step), block * step), kind)
                at = np.flatnonzero(tokens == separator) + block * (step // width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int64()), pa.array([tokens.size], pa.int64()), pa.array([at], pa.list_(pa.int64()))], names=["path", "block", "tokens", "separators"]
                )

    known = paths.mapInArrow(lengths, "path string, bytes long").where("bytes > 0")
    cut = known.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / step))).alias("block"))
    return cut.repartition(stores.reading_tasks(known, "bytes"), "path", "block").mapInArrow(scan, "path string, block long, tokens long, separators array<long>")


def documents(scanned: DataFrame) -> DataFrame:
    """``(path, ordinal, n_tokens, closed)`` from scanned blocks, which must be a written table."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.size("separators") > 0, F.element_at("separators", -1))
    brief = scanned.select("path", "block", F.size("separators").alias("n"), own.alias("last"))
    carried = brief.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"))
    # Merged, not broadcast: on disk a path costs next to nothing, in memory a hundred bytes a row.
    stitched = scanned.hint("merge").join(carried.hint("merge"), ["path", "block"]).withColumn("places", F.concat(F.array("previous"), "separators"))
    inside = stitched.select("path", "first", F.posexplode(F.transform("separators", lambda s, i: s - F.get("places", i) - 1)).alias("k", "n_tokens"))
    closed = inside.select("path", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    whole = scanned.groupBy("path").agg(F.sum("tokens").alias("tokens"), F.sum(F.size("separators")).alias("ordinal"), F.coalesce(F.max(own), F.lit(-1)).alias("last"))
    rest = whole.where("tokens > last + 1").select("path", "ordinal", (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_tokens)`` of each document, counted in the files that it was written to."""
    with Scratch(docs.sparkSession) as scratch:
        places = scratch.keep(write(docs, scratch.path("tokens"), id, text))
        found = documents(scratch.keep(blocks(places.select("path").distinct())))
        # As above: the few bytes that the rows take on disk would have all of them collected by the driver.
        return scratch.result(places.hint("merge").join(found.hint("merge"), ["path", "ordinal"]).select(F.col("id").alias(id), "n_tokens"))
