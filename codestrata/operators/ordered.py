"""Order-dependent operators without a group that one task must hold.

A window over a whole group puts the group in one task. Each operator here is
a sorted scan with carry instead: one exchange sorts every slice of the order,
one pass over it is written, and a slice hands its last state to the next
through one summary row. The input is read once for that, and a second time
only where its rows are needed beside the result. The caller names the slice
column, which must grow with the order. ``slices`` builds one where no number
can be cut into ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import cut_lineage


def slices(df: DataFrame, order: Sequence[Column | str], name: str = "slice", count: int | None = None) -> DataFrame:
    """Range-partition by ``order`` and keep the partition number as a column.

    ``order`` must end in something unique, so that no value is too common to
    be cut. Writing the result fixes the numbers for every later read.
    """
    width = count or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(width, *order).withColumn(name, F.spark_partition_id()))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "seq") -> DataFrame:
    """Add consecutive numbers from 0 in the given order, which must be total."""
    cut = slices(df, order, "_slice")
    sizes = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy().orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy("_slice").orderBy(*order)
    return (
        cut.withColumn("_at", F.row_number().over(inner)).join(offsets, "_slice")
        .withColumn(name, (F.col("_off") + F.col("_at") - 1).cast("long")).drop("_slice", "_at", "_off")
    )


def fill_down(df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[Column | str], fills: Mapping[str, str]) -> DataFrame:
    """Add, for each ``name: value`` of ``fills``, the last non-null value at or before each row of the same key.

    The scan is written with all columns of ``df``, so it should hold no more than is needed.
    Only slices that begin under a value from an earlier slice have a carry row to join.
    """
    names = list(fills)
    inner = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = cut_lineage(df.withColumns({n: F.last(v, ignorenulls=True).over(inner) for n, v in fills.items()}))
    ends = scanned.groupBy(*keys, slice_col).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_end"))
    across = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, slice_col, *[F.last(F.col("_end")[n], ignorenulls=True).over(across).alias(f"_carry_{n}") for n in names])
    # Written, so that its true size decides how it is joined.
    carried = cut_lineage(carried.where(" or ".join(f"_carry_{n} is not null" for n in names)))
    joined = scanned.join(carried, [*keys, slice_col], "left")
    return joined.withColumns({n: F.coalesce(n, f"_carry_{n}") for n in names}).drop(*[f"_carry_{n}" for n in names])


def running_total(df: DataFrame, levels: Sequence[str], order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before each row.

    ``levels`` are slice columns from coarse to fine that together follow the
    order. Every window then covers the children of one parent slice only. The
    sums of the finest slices are taken once; those of coarser ones add them up.
    """
    finest = cut_lineage(df.groupBy(*levels).agg(F.sum(value).alias("_sum")))
    offsets = finest.select(*levels, F.lit(0).cast("long").alias("_off"))
    for depth in range(len(levels)):
        whole = list(levels[: depth + 1])
        before = Window.partitionBy(*levels[:depth]).orderBy(levels[depth]).rowsBetween(Window.unboundedPreceding, -1)
        sums = finest.groupBy(*whole).agg(F.sum("_sum").alias("_sum")).select(*whole, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_add"))
        offsets = offsets.join(sums, whole).withColumn("_off", F.col("_off") + F.col("_add")).drop("_add")
    inner = Window.partitionBy(*levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(cut_lineage(offsets), list(levels))
    return joined.withColumn(name, F.col("_off") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_off")


def as_of(
    points: DataFrame,
    starts: DataFrame,
    keys: Sequence[str],
    position: str,
    payload: Sequence[str],
    tie: Sequence[str] = (),
    width: int = 4096,
) -> DataFrame:
    """Give each point the payload of the latest start at or before it, per key.

    ``position`` is a whole number present on both sides. Among starts at one
    position the highest ``tie`` wins. Points without a start are dropped.

    Both sides shrink together to one row per (key, position) before the scan, so
    a slice holds at most ``width`` positions however many rows repeat them.
    """
    place = [*keys, position]
    order = [F.col(t) for t in tie] or [F.lit(0)]
    begun = starts.select(*place, F.struct(*payload).alias("_start"), F.struct(*order).alias("_tie"))
    asked = points.select(*place, *[F.lit(None).cast(begun.schema[c].dataType).alias(c) for c in ("_start", "_tie")])
    merged = begun.unionByName(asked).groupBy(*place).agg(F.max_by("_start", "_tie").alias("_start"))
    filled = fill_down(merged.withColumn("_slice", F.floor(F.col(position) / width)), keys, "_slice", [position], {"_bound": "_start"})
    bound = filled.where(F.col("_bound").isNotNull()).select(*place, *[F.col("_bound")[p].alias(p) for p in payload])
    return points.join(bound, place)
