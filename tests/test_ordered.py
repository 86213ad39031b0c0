import random

from pyspark.sql import functions as F

from codestrata.operators.ordered import as_of, fill_down, numbered, running_total


def test_fill_down_crosses_slices_and_keeps_keys_apart(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", i, f"v{i}" if rng.random() < 0.05 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, n long, v string").withColumn("s", F.floor(F.col("n") / 16))
    got = {(r.k, r.n): r.out for r in fill_down(df, ["k"], "s", ["n"], {"out": "v"}).collect()}
    last = {}
    for k, n, v in rows:
        last[k] = v if v is not None else last.get(k)
        assert got[k, n] == last[k]


def test_as_of_takes_last_start_and_highest_tie(spark):
    rng = random.Random(2)
    starts = [(rng.choice("ab"), rng.randrange(300), f"s{i}", i) for i in range(80)]
    points = [(rng.choice("abc"), rng.randrange(300), i) for i in range(400)]
    got = as_of(
        spark.createDataFrame(points, "k string, at long, p long"), spark.createDataFrame(starts, "k string, at long, s string, seq long"),
        ["k"], "at", ["s"], ["seq"], width=32,
    )
    found = {r.p: r.s for r in got.collect()}
    for k, at, p in points:
        fits = [(a, seq, s) for sk, a, s, seq in starts if sk == k and a <= at]
        assert found.get(p) == (max(fits)[2] if fits else None)


def test_running_total_over_levels(spark):
    rows = [(p, i, (i * 7) % 11) for i, p in enumerate([2, 0, 2, 1, 2, 2, 0, 1, 2, 2, 2, 2])]
    df = spark.createDataFrame(rows, "p long, n long, v long").withColumn("s", F.floor(F.col("n") / 3))
    got = {r.n: r.t for r in running_total(df, ["p", "s"], ["n"], "v", "t").collect()}
    total = 0
    for p, n, v in sorted(rows):
        assert got[n] == total
        total += v


def test_numbers_are_consecutive(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"))
    assert {r.x: r.seq for r in numbered(df, ["x"]).collect()} == {i: i for i in range(500)}


def _counted(spark, df):
    """The frame, and a function that says how often its rows have been read."""
    seen, size = spark.sparkContext.accumulator(0), df.count()

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(read, df.schema), lambda: seen.value / size


def test_inputs_are_scanned_once_or_twice(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"), F.when(F.col("id") % 50 == 0, F.col("id")).alias("v"), F.when(F.col("id") % 70 == 0, F.lit("x")).alias("w"), F.floor(F.col("id") / 100).alias("s"))
    df, reads = _counted(spark, rows)
    got = fill_down(df, ["k"], "s", ["n"], {"a": "v", "b": "w"})
    assert got.where("a is not null").count() > 2800 and got.where("b is null").count() < 220 and reads() == 1
    df, reads = _counted(spark, rows)
    assert running_total(df, ["k", "s"], ["n"], "n", "t").agg(F.max("t")).first()[0] > 0 and reads() <= 2
    points, point_reads = _counted(spark, rows.select("k", "n"))
    starts, start_reads = _counted(spark, rows.where("v is not null").select("k", "n", "v"))
    found = as_of(points, starts, ["k"], "n", ["v"], width=64)
    assert found.where("v <= n").count() > 2800 and point_reads() <= 2 and start_reads() == 1
