import random

from pyspark.sql import functions as F

from codestrata.functions.numbers import ratio, round_binary


def test_rounds_like_python(spark):
    rng = random.Random(7)
    values = [0.125, 0.375, 2.675, 2.665, 0.145, 1.005, -2.675, 0.0, 99.995, 1e6 + 0.125]
    values += [a / b for a in range(0, 60) for b in range(1, 60)]
    values += [rng.uniform(-200, 200) for _ in range(3000)]
    for digits in (2, 4):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for row in df.select("x", round_binary(F.col("x"), digits).alias("r")).collect():
            assert row.r == round(row.x, digits), row


def test_ratio_of_nothing(spark):
    assert spark.range(1).select(ratio(F.lit(3), F.lit(0), 2)).first()[0] == 0.0
