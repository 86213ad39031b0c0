"""Large JSON documents read by many tasks, cut at the entries of their root.

A block of a file cannot know whether it starts inside a string. Each block is therefore
read for both cases: the quotes that it holds and how deep it leads in either. Running sums
over these small rows give every block's true state, and a second pass cuts the entries
that start in it. An entry that ends in a later block is read on to its end, so one value
always is in one task, and nothing else is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.session import cut_lineage
from codestrata.sources.stores import opened

BLOCK = 4_000_000
_QUOTE, _COMMA, _OPENING, _CLOSING, _BACKSLASH = 34, 44, (91, 123), (93, 125), 92
_NOTES = "file string, block long, start long, length long, quotes long, outside long, inside long, root string"
_ENTRIES = "file string, place long, key string, value string, problem string"


def entries(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """``(file, place, key, value, problem)``: a row for each entry of the root of each file under ``path``.

    ``place`` is the entry's offset, ``value`` its JSON text; elements of a list have no key. Repeated
    keys keep all their rows. A file whose brackets or strings are not closed, whose root is no object
    or list, or that holds more than its root, has a row with a ``problem``, and so has an entry without a value.
    Other faults inside a value are left to whoever parses it. An empty root and a file of no bytes give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("size", F.lit(1)) - 1, F.lit(block).cast("long")))
    cut = files.select("file", "size", starts.alias("start")).select(
        "file", F.floor(F.col("start") / block).alias("block"), "start", F.least(F.lit(block), F.col("size") - F.col("start")).cast("long").alias("length")
    )
    total = files.agg(F.sum(F.greatest(F.ceil(F.col("size") / block), F.lit(1)))).first()[0] or 1
    dealt = cut.repartition(max(1, int(total)), "file", "block")
    notes = cut_lineage(dealt.mapInPandas(_noted, _NOTES))
    # One small row for each block of a file, in the order of the file.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    quoted = notes.withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    led = quoted.withColumn("leads", F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside")))
    led = led.withColumn("root", F.first("root", True).over(upto)).withColumn("depth", F.coalesce(F.sum("leads").over(before), F.lit(0)))
    led = cut_lineage(led.select("file", "block", "start", "length", "quotes", "quoted", "leads", "depth", "root"))
    found = led.repartition(max(1, int(total)), "file", "block").mapInPandas(_cut, _ENTRIES)
    ends = led.groupBy("file").agg((F.sum("quotes") % 2).alias("open"), F.sum("leads").alias("deep"), F.max("root").alias("root"))
    wrong = F.when(F.col("root").isNull() | ~F.col("root").isin("{", "["), "no JSON object or list").when((F.col("open") != 0) | (F.col("deep") != 0), "not closed")
    broken = ends.select("file", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), wrong.alias("problem"))
    return found.unionByName(broken.where("problem is not null"))


def _signs(store, place: str, start: int, length: int):
    """A block's bytes, the places of its brackets, commas and real quotes, and their kinds."""
    import numpy as np

    with store.open_input_file(place) as file:
        data = file.read_at(length, start)
        back, run = start, 0
        while back > 0:
            size = min(back, 4096)
            piece = file.read_at(size, back - size)
            kept = len(piece.rstrip(b"\\"))
            run, back = run + size - kept, back - size
            if kept:
                break
    codes = np.frombuffer(data, np.uint8)
    wanted = np.zeros(256, bool)
    wanted[[_QUOTE, _COMMA, *_OPENING, *_CLOSING]] = True
    at = np.flatnonzero(wanted[codes])
    kinds = codes[at]
    plain = np.where(codes != _BACKSLASH, np.arange(len(codes), dtype=np.int32), np.int32(-1))
    plain = np.maximum.accumulate(plain) if len(plain) else plain
    quotes = at[kinds == _QUOTE]
    last = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], -1)
    # A quote is escaped by an odd number of backslashes, which may begin before the block.
    slashes = quotes - 1 - last + np.where(last < 0, run, 0)
    real = np.ones(len(at), bool)
    real[kinds == _QUOTE] = slashes % 2 == 0
    return data, at[real], kinds[real]


def _steps(kinds, quoted: bool):
    """Which signs lie in a string that may be open from the start, and how each changes the depth."""
    import numpy as np

    string = (np.cumsum(kinds == _QUOTE) + quoted) % 2 == 1
    return string, np.where(string, 0, np.isin(kinds, _OPENING).astype(np.int64) - np.isin(kinds, _CLOSING))


def _noted(frames: Iterator) -> Iterator:
    import pandas as pd

    for frame in frames:
        for r in frame.itertuples():
            store, place = opened(r.file)
            data, _, kinds = _signs(store, place, r.start, r.length)
            first = data.removeprefix(b"\xef\xbb\xbf" if r.start == 0 else b"").lstrip()[:1].decode("latin-1") or None
            sums = [int(_steps(kinds, q)[1].sum()) for q in (False, True)]
            yield pd.DataFrame([(r.file, r.block, r.start, r.length, int((kinds == _QUOTE).sum()), *sums, first)], columns=_columns(_NOTES))


def _cut(frames: Iterator) -> Iterator:
    import pandas as pd

    for frame in frames:
        for r in frame.itertuples():
            rows = [(r.file, *row) for row in _found(r)]
            if rows:
                yield pd.DataFrame(rows, columns=_columns(_ENTRIES))


def _found(r) -> Iterator[tuple]:
    """The entries that start in a block, and what stands outside of the root."""
    store, place = opened(r.file)
    data, marks, garbage, quoted, depth = _borders(store, place, r.start, r.length, bool(r.quoted), int(r.depth))
    if garbage:
        yield r.start, None, None, "more than one value"
    for n, (at, opens) in enumerate(marks):
        if opens is None:
            continue
        if n + 1 < len(marks):
            text, last = data[at + 1 : marks[n + 1][0]], marks[n + 1][1] is None
        else:
            text, last = _read_on(store, place, data[at + 1 :], r.start + len(data), quoted, depth)
        if text.strip() or not (opens and last):
            yield _entry(r.start + at + 1, text, r.root)


def _borders(store, place: str, start: int, length: int, quoted: bool, depth: int):
    """A block with the borders of its root's entries as ``(place, opens)``: True at the root's bracket, False at a comma, None at its end."""
    import numpy as np

    data, at, kinds = _signs(store, place, start, length)
    string, steps = _steps(kinds, quoted)
    after = depth + np.cumsum(steps)
    begins = (steps == 1) & (after == 1)
    ends = (steps == -1) & (after == 0)
    commas = ~string & (kinds == _COMMA) & (after == 1)
    marks = [(int(at[i]), bool(begins[i]) if not ends[i] else None) for i in np.flatnonzero(begins | ends | commas)]
    # Outside of the root only spaces may stand, and its bracket opens once.
    rest, here = [], 0 if depth == 0 and not quoted else None
    for border, opens in marks:
        if opens and here is not None:
            rest.append(data[here:border])
            here = None
        elif opens is None:
            here = border + 1
    if here is not None:
        rest.append(data[here:])
    outside = b"".join(rest)
    outside = outside.removeprefix(b"\xef\xbb\xbf") if start == 0 else outside
    again = sum(opens is True for _, opens in marks) > 1 or (start > 0 and depth == 0 and any(m[1] is True for m in marks) and _said_before(store, place, start))
    return data, marks, bool(outside.strip()) or again, bool(quoted) ^ bool((kinds == _QUOTE).sum() % 2), depth + int(steps.sum())


def _said_before(store, place: str, start: int) -> bool:
    """Whether anything but spaces stands before a block that starts outside of the root."""
    with store.open_input_file(place) as file:
        while start > 0:
            size = min(start, BLOCK)
            piece = file.read_at(size, start - size)
            start -= size
            if (piece.removeprefix(b"\xef\xbb\xbf") if start == 0 else piece).strip():
                return True
    return False


def _read_on(store, place: str, begun: bytes, start: int, quoted: bool, depth: int) -> tuple[bytes, bool]:
    """An entry that leaves its block, up to its border, and whether the root ends there."""
    parts = [begun]
    with store.open_input_file(place) as file:
        size = file.size()
    step = 64_000
    while start < size:
        length = min(step, size - start)
        data, marks, _, quoted, depth = _borders(store, place, start, length, quoted, depth)
        if marks:
            return b"".join([*parts, data[: marks[0][0]]]), marks[0][1] is None
        parts.append(data)
        start, step = start + length, min(2 * step, BLOCK)
    return b"".join(parts), False


def _entry(at: int, raw: bytes, root: str) -> tuple:
    try:
        text = raw.decode().strip()
        if root == "[":
            return at, None, text or None, None if text else "an entry without a value"
        key, end = json.JSONDecoder().raw_decode(text)
        colon, value = text[end:].lstrip()[:1], text[end:].lstrip()[1:].strip()
    except ValueError:
        return at, None, None, "an entry that cannot be read"
    fine = isinstance(key, str) and colon == ":" and value
    return (at, key, value, None) if fine else (at, None, None, "an entry without a value")


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]
