"""Shards cut from a Hilbert curve over several metadata dimensions.

Each dimension is quantised to a few bits, the cells get their index on a Hilbert
curve, rows are sorted by that index, and the order is cut into runs of equal
count. Rows of a shard lie close in every dimension at once, so a reader that
filters on any of them skips most files. Only DataFrame and SQL functions run, and
texts are never moved: only their size, checksum and cell are.

Law ``rows``: shard sizes differ by one row at most. Equal texts share size and
checksum, so inside a cell they stand next to each other.

Defined results: a null text has no bytes, thus size 16 and checksum 0; a null in a
dimension is cell 0; a null id sorts first; repeated rows each get a place of their
own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.ordered import numbered

BITS = 4
ROW_BYTES = 16


def category(value: Column) -> Column:
    """A cell for equality filters: the first hexadecimal digit of a digest; null is 0."""
    return F.coalesce(F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 1), 16, 10).cast("int"), F.lit(0))


def magnitude(value: Column, bits: int = BITS) -> Column:
    """A cell for range filters: the binary digits of a whole number, less four."""
    digits = F.length(F.bin(F.greatest(value, F.lit(0)).cast("long")))
    return F.coalesce(F.least(F.greatest(digits - 4, F.lit(0)), F.lit(2**bits - 1)), F.lit(0))


def hilbert_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """The place of a cell on the Hilbert curve through a cube of ``2**bits`` cells a side."""
    n = len(cells)
    table = F.expr(f"array({','.join(map(str, transitions(n)))})")
    cube, state = 1 << n, _states(n)
    levels = F.array(*[sum((F.shiftright(c, level).bitwiseAND(1) * (1 << k) for k, c in enumerate(cells)), F.lit(0)) for level in range(bits - 1, -1, -1)])

    def step(acc: Column, corner: Column) -> Column:
        found = F.element_at(table, (acc["state"] * cube + corner + 1).cast("int"))
        return F.struct((acc["h"] * cube + F.pmod(found, F.lit(cube))).cast("long").alias("h"), F.floor(found / cube).cast("int").alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(state.index((0, 0))).cast("int").alias("state"))
    return F.aggregate(levels, start, step)["h"]


def _states(n: int) -> list[tuple[int, int]]:
    return [(entry, axis) for entry in range(1 << n) for axis in range(n)]


def transitions(n: int) -> list[int]:
    """For each (state, corner): next state times ``2**n`` plus the corner's rank on the curve.

    A state is the corner where the curve enters a cube and the axis it leaves along. The
    corner is turned into the standard cube, its rank is the inverse Gray code, and entry
    and axis of the sub-cube follow from the rank (Hamilton, Compact Hilbert Indices).
    """
    whole, mask = 1 << n, (1 << n) - 1
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & mask
    gray = lambda x: x ^ (x >> 1)
    rank = {gray(x): x for x in range(whole)}
    ones = lambda x: next(k for k in range(n + 1) if not x >> k & 1)  # noqa: E731  trailing ones
    states, out = _states(n), []
    for entry, axis in states:
        for corner in range(whole):
            w = rank[turn(corner ^ entry, n - (axis + 1) % n)]
            enter = gray(2 * ((w - 1) // 2)) if w else 0
            along = (ones(w) if w % 2 else ones(w - 1)) % n if w else 0
            out.append(states.index((entry ^ turn(enter, axis + 1), (axis + along + 1) % n)) * whole + w)
    return out


def shards(docs: DataFrame, count: int, categories: Sequence[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its size, checksum, Hilbert index, shard and slot in the shard.

    The dimensions are the named categories and the size. The order is total up to rows that
    agree in every output column, and is found by a range partitioning plus one count per range.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    size = (F.octet_length(body) + ROW_BYTES).cast("long")
    cells = [category(F.col(c)) for c in categories] + [magnitude(size)]
    rows = docs.select(F.col(id).alias(id), size.alias("size"), F.crc32(body).alias("text_crc32"), hilbert_index(cells).alias("hilbert"))
    total = docs.count()
    placed = numbered(rows, ["hilbert", "size", "text_crc32", id], "_rank")
    shard = F.expr(f"_rank * {count} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {count - 1}) div {count}")
    return (
        placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_rank") - first).cast("long"))
        .select(id, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id: str = "doc_id") -> None:
    """Write the documents to one folder per shard, each sorted by slot. Ids must be unique."""
    joined = docs.join(placed.select(id, "shard", "slot"), id)
    joined.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def crc_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a text's bytes, which that engine lacks."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || hex(encode({text}))[2 * i + 1 : 2 * i + 2])::UBIGINT)"
    fold = f"list_reduce(list_prepend(4294967295::UBIGINT, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]))"
    return f"(SELECT xor({fold}, 4294967295::UBIGINT)::BIGINT FROM (SELECT {table}::UBIGINT[] AS t))"


def oracle(count: int, categories: Sequence[str], bits: int = BITS) -> str:
    n, width = len(categories) + 1, 1 << (len(categories) + 1)
    cells = [f"coalesce(('0x' || md5({c}::VARCHAR)[1:1])::INT, 0)" for c in categories] + [f"least(greatest(length(bin(size)) - 4, 0), {2**bits - 1})::INT"]
    source = "SELECT *, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents"
    step = f"SELECT doc_id, size, text, {', '.join(f'{c} AS c{k}' for k, c in enumerate(cells))}, 0::BIGINT AS h, {_states(n).index((0, 0))} AS s, {transitions(n)} AS t FROM ({source})"
    for level in range(bits - 1, -1, -1):
        corner = " + ".join(f"((c{k} >> {level}) & 1) * {1 << k}" for k in range(n))
        step = f"SELECT * REPLACE (h * {width} + f % {width} AS h, f // {width} AS s) FROM (SELECT * , t[s * {width} + {corner} + 1] AS f FROM ({step.replace(', f FROM', ' FROM')}))"
        step = f"SELECT * EXCLUDE (f) FROM ({step})"
    crc = crc_sql("coalesce(text, '')")
    ranked = f"SELECT *, row_number() OVER (ORDER BY h, size, text_crc32, doc_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT *, {crc} AS text_crc32 FROM ({step}))"
    return (
        f"SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (r * {count} // n)::INT AS shard, (r - ((r * {count} // n) * n + {count - 1}) // {count})::BIGINT AS slot, "
        f"NULL::INT AS grown_shard, h AS hilbert FROM ({ranked})"
    )
