import random

from pyspark.sql import functions as F

from spanforge.operators import dedup


def test_banded_join_is_brute_force(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(40)]
    values = base + [b ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for b in base] + [b ^ 0b10111 for b in base[:10]] + [base[0], 0]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id int, hash long")
    for distance in (0, 3, 4, 6):
        got = dedup.hamming_join(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), distance)
        rows = sorted((r["a"], r["b"], r["hamming"]) for r in got.collect())
        wanted = sorted((i, j, (x ^ y).bit_count()) for i, x in enumerate(values) for j, y in enumerate(values) if (x ^ y).bit_count() <= distance)
        assert rows == wanted


def test_distance_cut(spark):
    df = spark.createDataFrame([(0, 0b1011), (1, 0b11111)], "a int, hash long")
    zero = spark.createDataFrame([(9, 0)], "b int, hash long")
    assert [r["a"] for r in dedup.hamming_join(df, zero, 4).collect()] == [0]


def test_first_of_group(spark):
    rows = [("x", "b", 2), ("x", "a", 1), (None, "c", 3), (None, "c", 4)]
    got = dedup.first_of_group(spark.createDataFrame(rows, "k string, p string, i int"), "k", [F.col("p")])
    assert sorted((r["i"], r["n_rows"]) for r in got.collect()) == [(1, 2), (3, 1), (4, 1)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (2, 1)], "a int, b int")
    got = {r["node"]: r["component"] for r in dedup.components(spark, edges, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert dedup.components(spark, edges.limit(0), "a", "b").collect() == []
