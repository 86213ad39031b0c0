import zlib
from collections import Counter

from pyspark.sql import functions as F

from codestrata.llm import sharding


def test_curve_visits_every_cell_once_in_steps_of_one(spark):
    for n, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = spark.range(side**n).select(*[(F.col("id") / side**k % side).cast("int").alias(f"c{k}") for k in range(n)])
        rows = cells.select("*", sharding.hilbert_index([F.col(f"c{k}") for k in range(n)], bits).alias("h")).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(side**n))
        assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards(odd_docs, odd_rows, no_docs):
    got = sharding.shards(odd_docs, 7, ["lang", "source"]).collect()
    data = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == data
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in ordered] == sorted(r.hilbert for r in got)
    assert sharding.shards(no_docs, 7, ["lang"]).count() == 0
    assert {r.shard for r in sharding.shards(odd_docs.limit(3), 40, ["lang"]).collect()} <= set(range(40))


def test_written_shards_prune_by_every_dimension(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(pow(2, id % 12) as int))").alias("text"), F.concat(F.lit("l"), F.col("id") % 8).alias("lang"), F.concat(F.lit("s"), F.expr("id div 8 % 16")).alias("source"))
    placed = sharding.shards(docs, 40, ["lang", "source"]).cache()
    sharding.write_shards(docs, placed, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 4000
    for column in ("lang", "source"):
        files = back.groupBy(column).agg(F.countDistinct("shard").alias("n")).agg(F.max("n")).first()[0]
        assert files < 40
