"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into units that no piece crosses (runs of spaces with the
characters behind them). Texts are handled in runs of two megabytes, also inside one text, cut
between units. A run's distinct new units are concatenated, half a megabyte at a time, a suffix array orders
all positions by as many characters as the longest piece has, and binary search
gives every piece's range of occurrences. Each occurrence is an edge from its start to
its end. Edges are placed by position and length, and segmentations relax over them: a BPE model
applies, in each unit, the edge of the best score between two neighbouring segments
until none is left. The ids equal those of the public library for the same model.

Characters that are no piece become their UTF-8 bytes (byte fallback). Decoding joins
pieces and bytes and drops the prefix space, which returns the text exactly, except that
the space mark U+2581 itself decodes as a space.

Defined results: a null text has null ids and decodes to null; an empty text has no ids;
repeated rows are encoded alike; units of any length are encoded whole, and a unit longer than
a run is held in one; an empty table gives no rows; ``encode`` replaces a column that has the name of the new one.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codestrata.llm import words as W
from codestrata.llm.models import MODEL, model_bytes

SPACE = "▁"
# Longer units are merged one by one with a heap, as rounds over all units would be as many as characters.
SHORT = 64
# Characters of new units that are indexed together, as many of these as a run of text has characters, places for edges
# of an index, and bytes of text whose ids become one batch.
RUN = 500_000
RUNS = 4
PLACES = 16_000_000
SLICE = 2_000_000
# Characters of units that a task remembers.
REMEMBERED = 8_000_000
# Rows that are decoded together.
ROWS = 256
NONE = np.iinfo(np.int32).max


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows with an array column of piece ids."""
    rest = docs.drop(ids)
    encoder = Encoder(model_bytes(docs.sparkSession, model))
    at = rest.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, encoder(part.column(at))], names=[*part.schema.names, ids])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))]))


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """The rows with a string column decoded from the ids."""
    rest = rows.drop(text)
    decoder = Decoder(model_bytes(rows.sparkSession, model))
    at = rest.columns.index(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decoder(batch.column(at))], names=[*batch.schema.names, text])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(text, T.StringType())]))


def _small(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``SLICE`` bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // SLICE)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _ordered(keys: np.ndarray) -> np.ndarray:
    """The order of rows of numbers. Most suffixes end within the first, which sorts fast; the others are put between them."""
    first = np.ascontiguousarray(keys[:, 0])
    long = keys[:, 1:].any(axis=1)
    short, rest = np.flatnonzero(~long), np.flatnonzero(long)
    short = short[np.argsort(first[short])]
    rest = rest[np.lexsort(keys[rest].T[::-1])]
    return np.insert(short, np.searchsorted(first[short], first[rest], "right"), rest)


class _Model:
    """A model that travels as bytes and is loaded once per task."""

    def __init__(self, model: bytes):
        self.model, self._ready = model, False

    def __getstate__(self) -> dict:
        return {"model": self.model, "_ready": False}

    def _load(self) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.names = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.names) if lib.is_byte(i)}
        odd = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(len(self.names))]
        self.pieces = [i for i, skip in enumerate(odd) if not skip]
        self.score = np.array([lib.get_score(i) for i in range(len(self.names))])
        self._ready = True


def _is_text(made: np.ndarray) -> bool:
    try:
        made.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


class Decoder(_Model):
    def __call__(self, column: pa.Array) -> pa.Array:
        if not self._ready:
            self._load()
            self.content = [n.replace(SPACE, " ").encode() for n in self.names]
            for value, i in self.bytes.items():
                self.content[i] = bytes([value])
            self.sizes = np.array(list(map(len, self.content)))
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.letters = np.frombuffer(b"".join(self.content), np.uint8)
        whole = [self._joined(column.slice(k, ROWS)) for k in range(0, len(column), ROWS)]
        return pa.concat_arrays(whole) if whole else pa.array([], pa.string())

    def _joined(self, column: pa.Array) -> pa.Array:
        """The bytes of all rows at once, where these are text; else row by row."""
        ids = column.flatten().to_numpy()
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        made = self.letters[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if ids.size else 0)]
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        starts, stops = cuts[:-1].copy(), cuts[1:]
        filled = np.flatnonzero(stops > starts)
        # No row starts inside a character, and the prefix space goes.
        if (made[starts[filled]] & 0xC0 == 0x80).any() or not _is_text(made):
            return self._each(column)
        space = filled[made[starts[filled]] == 0x20]
        starts[space] += 1
        if space.size:
            made = np.delete(made, starts[space] - 1)
        offsets = np.concatenate([[0], np.cumsum(stops - starts)])
        null = column.is_null().to_numpy(zero_copy_only=False)
        given = None if not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
        return pa.StringArray.from_buffers(len(column), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(made), given)

    def _each(self, column: pa.Array) -> pa.Array:
        out = [None if ids is None else b"".join(map(self.content.__getitem__, ids)) for ids in column.to_pylist()]
        return pa.array([t if t is None else t.removeprefix(b" ").decode("utf-8", "replace") for t in out], pa.string())


class Encoder(_Model):
    def __call__(self, column: pa.Array) -> pa.Array:
        if not self._ready:
            self._load()
            self._index()
        counts, values = [], []
        for texts in self._runs(column):
            if len(self.units) > W.VOCABULARY or self.remembered > REMEMBERED:
                self._forget()
            split = [self.cut.findall(t) for _, t in texts]
            known = len(self.units)
            at = np.fromiter(map(self.units.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sum(map(len, split)))
            for new in self._parts(list(islice(self.units, known, None))):
                self._learn(new)
            lengths = np.diff(self.ends)[at]
            before = np.concatenate([[0], np.cumsum(lengths)])
            values.append(self.ids[np.repeat(self.ends[at] - before[:-1], lengths) + np.arange(before[-1])])
            stops = before[np.cumsum(list(map(len, split)), dtype=np.int64)]
            counts.append((np.array([row for row, _ in texts]), np.diff(stops, prepend=0)))
        per_row = np.zeros(len(column), np.int64)
        for rows, n in counts:
            np.add.at(per_row, rows, n)
        offsets = np.concatenate([[0], np.cumsum(per_row)])
        null = np.append(column.is_null().to_numpy(zero_copy_only=False), False)
        made = np.concatenate(values) if values else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=null if null.any() else None), pa.array(made, pa.int32()))

    def _runs(self, column: pa.Array) -> Iterator[list[tuple[int, str]]]:
        """Parts of texts, spaces marked, in lists of about ``RUNS * RUN`` characters; a text is cut only between units."""
        run, size, most = [], 0, RUNS * RUN
        for row, value in enumerate(column):
            text = value.as_py()
            start = 0
            while text and start < len(text):
                between = self.between.search(text, start + most - size) if len(text) - start > most - size else None
                stop = between.start() if between else len(text)
                run.append((row, (SPACE if start == 0 else "") + text[start:stop].replace(" ", SPACE)))
                size += stop - start
                start = stop
                if size >= most:
                    yield run
                    run, size = [], 0
        if run:
            yield run

    def _parts(self, units: list[str]) -> Iterator[list[str]]:
        """Runs of units of about ``RUN`` characters, fewer where pieces are long."""
        most = min(RUN, PLACES // self.place)
        part, size = [], 0
        for unit in units:
            if part and size + len(unit) > most:
                yield part
                part, size = [], 0
            part.append(unit)
            size += len(unit)
        if part:
            yield part

    def _forget(self) -> None:
        # A unit that is asked for takes the next number.
        self.units: defaultdict[str, int] = defaultdict(count().__next__)
        self.remembered = 0
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _index(self) -> None:
        """Character codes, and the pieces as rows of codes in order."""
        self._forget()
        inner = any(SPACE in n.lstrip(SPACE) or "\n" in n for n in map(self.names.__getitem__, self.pieces))
        self.cut = re.compile(r"(?s).+" if inner else rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        # Places where one unit always ends: ahead of a line break, and ahead of spaces behind something else.
        self.between = re.compile(r"(?!)" if inner else rf"(?=\n)|(?<=[^ {SPACE}])(?=[ {SPACE}])")
        chars = sorted({c for i in self.pieces for c in self.names[i]})
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.single = {self.names[i]: i for i in self.pieces if len(self.names[i]) == 1}
        self.of_code = np.array([-1] + [self.single.get(c, -1) for c in chars])
        # In order of their codes, so that one search continues where the last ended.
        many = sorted((i for i in self.pieces if len(self.names[i]) > 1), key=lambda i: self.names[i])
        # Keys are compared four characters at a time, and ``place`` is above every length.
        self.longest = max((len(self.names[i]) for i in many), default=2)
        self.width = -(-self.longest // 4) * 4
        self.place = 1 << self.longest.bit_length()
        self.many = np.array(many)
        self.length = np.array([len(self.names[i]) for i in many])
        codes = np.zeros((len(many), self.width), ">u2")
        high = np.full((len(many), self.width), 0xFFFF, ">u2")
        for row, i in enumerate(many):
            made = self.code[[ord(c) for c in self.names[i]]]
            codes[row, : made.size] = made
            high[row, : made.size] = made
        self.low, self.high = (x.view(f"S{2 * self.width}").ravel() for x in (codes, high))
        self.rank = np.empty(len(self.names), np.int64)
        self.rank[np.argsort(-self.score, kind="stable")] = np.arange(len(self.names))
        self.by_rank = np.argsort(self.rank)

    def _learn(self, units: list[str]) -> None:
        """Ids of the units with the next numbers."""
        sizes = np.array(list(map(len, units)))
        text = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        edges = self._edges(text, starts)
        unit = np.repeat(np.arange(sizes.size), sizes)
        short = (sizes <= SHORT)[unit]
        begin = np.concatenate([self._rounds(np.flatnonzero(short), unit, text.size, edges), *(self._heap(int(starts[k]), int(sizes[k]), edges) for k in np.flatnonzero(sizes > SHORT))])
        begin.sort()
        ids, lengths = self._named(text, begin, np.append(begin[1:], text.size), edges)
        made = np.bincount(unit[np.repeat(begin, lengths)], minlength=sizes.size)
        self.remembered += text.size
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(made)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def _edges(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The ranks of pieces of two characters or more at ``position * place + length`` of their occurrences."""
        # A zero between units keeps matches inside them; ``shift`` maps places back.
        shift = np.zeros(text.size, np.int64)
        shift[starts] = 1
        shift = np.cumsum(shift) - 1
        codes = np.zeros(text.size + starts.size + self.width, ">u2")
        codes[np.arange(text.size) + shift] = self.code[text]
        suffix = np.lib.stride_tricks.sliding_window_view(codes, self.width)[np.arange(text.size) + shift]
        order = _ordered(suffix.view(">u8").astype(np.uint64))
        ordered = suffix[order].view(f"S{2 * self.width}").ravel()
        low, high = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        found = high - low
        piece = np.repeat(np.arange(self.many.size), found)
        at = order[np.repeat(low - (np.cumsum(found) - found), found) + np.arange(found.sum())]
        edges = np.full(text.size * self.place, NONE, np.int32)
        edges[at * self.place + self.length[piece]] = self.rank[self.many[piece]]
        return edges

    def _rank_of(self, start: np.ndarray, stop: np.ndarray, edges: np.ndarray) -> np.ndarray:
        length = stop - start
        return np.where(length <= self.longest, edges[start * self.place + np.minimum(length, self.longest)], NONE)

    def _rounds(self, begin: np.ndarray, unit: np.ndarray, size: int, edges: np.ndarray) -> np.ndarray:
        """Segment starts of the short units: in each round every unit takes its best edge, the leftmost of equals."""
        done = []
        owner = unit[begin]
        last = np.concatenate([np.flatnonzero(unit[1:] != unit[:-1]) + 1, [size]])
        while begin.size:
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            final = np.append(new[1:], True)
            stop = np.where(final, last[owner], np.append(begin[1:], size))
            pair = np.full(begin.size, NONE)
            left = np.flatnonzero(~final)
            pair[left] = self._rank_of(begin[left], stop[left + 1], edges)
            heads = np.flatnonzero(new)
            best = np.minimum.reduceat(pair, heads)
            group = np.cumsum(new) - 1
            live = (best < NONE)[group]
            done.append(begin[~live])
            hit = np.flatnonzero(live & (pair == best[group]))
            hit = hit[np.concatenate([[True], group[hit][1:] != group[hit][:-1]])] if hit.size else hit
            keep = live.copy()
            keep[hit + 1] = False
            begin, owner = begin[keep], owner[keep]
        return np.concatenate(done) if done else begin

    def _heap(self, start: int, size: int, edges: np.ndarray) -> np.ndarray:
        """Segment starts of one long unit."""
        first = start * self.place
        own = edges[first : first + size * self.place]
        held = np.flatnonzero(own < NONE)
        known = dict(zip((held + first).tolist(), own[held].tolist(), strict=True))
        after = {p: p + 1 for p in range(start, start + size)}
        before = {p + 1: p for p in range(start, start + size)}
        waiting: list[tuple[int, int, int]] = []

        def offer(p: int) -> None:
            end = after.get(after[p])
            if end is not None and end - p <= self.longest and (rank := known.get(p * self.place + end - p)) is not None:
                heapq.heappush(waiting, (rank, p, end))

        for p in range(start, start + size - 1):
            offer(p)
        while waiting:
            _, p, end = heapq.heappop(waiting)
            middle = after.get(p)
            if middle is None or after.get(middle) != end:
                continue
            del after[middle]
            after[p], before[end] = end, p
            offer(p)
            if p in before:
                offer(before[p])
        return np.array(sorted(after), dtype=np.int64)

    def _named(self, text: np.ndarray, begin: np.ndarray, stop: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments in a row, and how many of them each has: one, or its bytes."""
        one = stop - begin == 1
        ids = np.full(begin.size, -1, np.int64)
        ids[one] = self.of_code[self.code[text[begin[one]]]]
        ids[~one] = self.by_rank[self._rank_of(begin[~one], stop[~one], edges)]
        lengths = np.ones(begin.size, np.int64)
        spelled = np.flatnonzero(ids < 0)
        if not spelled.size:
            return ids, lengths
        letters = [chr(p).encode() for p in text[begin[spelled]].tolist()]
        lengths[spelled] = list(map(len, letters))
        made = np.repeat(ids, lengths)
        made[made < 0] = [self.bytes[b] for b in b"".join(letters)]
        return made, lengths
