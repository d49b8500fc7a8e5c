import numpy as np
from pyspark.sql import functions as F

from spanforge.llm.splits import Placement, dealt, grouped_split, node, spanning_groups, with_groups

ROWS = [(1, "a", "x", "train"), (2, "a", None, "val"), (3, None, "x", "train"), (4, "b", "y", "train"), (5, "b", None, None), (6, None, None, "test"), (7, "c", None, "train"), (8, "c", None, "test"), (9, None, "z", "val"), (1, "a", "x", "train"), (None, "d", None, "val")]


def frame(spark, rows=ROWS):
    df = spark.createDataFrame([(*r, "?", 0) for r in rows], "rid long, source string, digest string, old string, component string, n int")
    return df.withColumn("s", node(0, F.col("source"))).withColumn("d", node(1, F.col("digest")))


def test_spanning(spark):
    got = spanning_groups(spark, frame(spark), ["s", "d"], "old")
    assert sorted({r["rid"] for r in got.collect()}) == [1, 2, 3, 7, 8]
    assert {bytes(r["group"])[1:] for r in got.collect()} == {b"a", b"c"}
    assert spanning_groups(spark, frame(spark).limit(0), ["s", "d"], "old").collect() == []


def test_groups_stay_whole_and_shares_are_met(spark):
    rows = [(i, f"s{i % 400}", f"d{i // 3}" if i % 5 == 0 else None, "train") for i in range(3000)] + [(3000 + i, "hot", None, "val") for i in range(1500)]
    grouped = with_groups(spark, frame(spark, rows), ["s", "d"])
    labels = {"even": F.col("rid") % 2 == 0, "rare": F.col("rid") % 97 == 0, "never": F.lit(False), "null": F.lit(None).cast("boolean")}
    shares = {"train": 0.8, "val": 0.1, "test": 0.1}
    out = grouped_split(spark, grouped, "rid", "group", labels, shares)
    assert out.count() == 4500
    joined = grouped.join(out, "rid").groupBy("group").agg(F.countDistinct("split").alias("n"))
    assert joined.where("n > 1").count() == 0
    got = {r["split"]: r["count"] / 4500 for r in out.groupBy("split").count().collect()}
    assert all(abs(got[k] - v) < 0.03 for k, v in shares.items())
    again = grouped_split(spark, grouped.repartition(5), "rid", "group", labels, shares)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_odd_rows(spark):
    out = grouped_split(spark, with_groups(spark, frame(spark), ["s", "d"]), "rid", "group", {}, {"train": 1, "test": 1})
    assert sorted((r["rid"] for r in out.collect()), key=str) == [1, 2, 3, 4, 5, 6, 7, 8, 9, None]
    assert grouped_split(spark, with_groups(spark, frame(spark).limit(0), ["s", "d"]), "rid", "group", {}, {"train": 1}).collect() == []


def test_rarest_label_first():
    vectors = np.array([[10, 10, 0], [1, 1, 1], [9, 9, 0]], float)
    placed = Placement(vectors.T @ [1, 2, 1], np.array([0.5, 0.5])).run(vectors, np.array([1, 2, 1]))
    assert placed.tolist()[1] == [1, 1] and placed[0].argmax() != placed[2].argmax() and placed.sum(1).tolist() == [1, 2, 1]


def test_many_equal_items_are_dealt_as_one_by_one():
    rng = np.random.default_rng(4)
    for _ in range(200):
        want, room, size, copies = rng.integers(-5, 60, 3).astype(float), rng.integers(0, 9, 3).astype(float), float(rng.integers(1, 5)), int(rng.integers(0, 60))
        now, out = want.copy(), np.zeros(3, int)
        for _ in range(copies):
            s = np.lexsort((np.arange(3), -room, -now))[0]
            out[s] += 1
            now[s] -= size
        got = dealt(want, room, size, copies)
        assert got.sum() == copies and np.abs(got - out).max() <= 1


def test_the_rule_is_the_same_at_any_size(spark):
    """Groups by themselves meet the shares of every label, below and above the ranges in which they are ranked."""
    rows = [(i, i // 3, i % 7 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "rid long, k int, l boolean").withColumn("group", F.col("k").cast("string").cast("binary"))
    for per_task in (5, 10_000):
        out = grouped_split(spark, df, "rid", "group", {"l": F.col("l")}, {"train": 0.5, "test": 0.5}, per_task)
        got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
        assert abs(got["train"] - 150) <= 3 and abs(got["test"] - 150) <= 3
        assert {r["split"]: r["count"] for r in out.join(df.where("l"), "rid").groupBy("split").count().collect()}["train"] in (21, 22)
