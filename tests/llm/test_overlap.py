import random

import pytest
from pyspark.sql import functions as F

from spanforge.llm import overlap
from spanforge.llm.overlap import PrefixIndex, Shingling, cross_split, ladder, near_probe

D = [f"{i:064x}" for i in range(1, 9)]
SCHEMA = "manifest_index long, split string, image string, sha256 string, phash string, h int, d int"


def signed(v):
    return v - 2**64 if v >= 2**63 else v


@pytest.mark.parametrize("step", [0, 1, 2])
def test_prefixes_lose_nothing(spark, step, monkeypatch):
    random.seed(step)
    base = [random.getrandbits(64) for _ in range(30)]
    near = [x ^ sum(1 << b for b in random.sample(range(64), k)) for x in base for k in (1, 4, 5)]
    hot = [base[0] ^ (1 << b) for b in range(64)]
    probe, index = base + [0, 2**64 - 1], near + hot + [0]
    monkeypatch.setattr(overlap, "ladder", lambda d: [ladder(d)[step]])
    frames = [spark.createDataFrame([(signed(v),) for v in vs] + [(None,)], "h long") for vs in (probe, index)]
    got = {r["h"] for r in near_probe(spark, *frames).collect()}
    assert got == {signed(p) for p in probe if any((p ^ t).bit_count() <= 4 for t in index)}


def test_shingles(spark):
    s = Shingling(7, 2, 4)
    assert (s.size, s.least_shared, s.prefix) == (21, 3, 19) and sum(b for _, b in s.bounds) == 64
    rows = PrefixIndex(s, {}).rows(spark.createDataFrame([(-1,)], "h long"))
    assert rows.count() == s.prefix and rows.select("shingle").distinct().count() == s.prefix


def test_shingles_are_few_and_never_broadcast(spark):
    """The rows of the shingles are many times the hashes that the planner knows of."""
    assert [s.prefix for s in ladder(4)] == [15, 35, 70] and all(s.least_shared >= 1 for s in ladder(4))
    frames = [spark.createDataFrame([(v,) for v in vs], "h long") for vs in ([7, 1 << 40], [6, 99])]
    plan = near_probe(spark, *frames)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_kinds(spark):
    rows = [
        (1, "train", "images/train/ds/c/a.jpg", D[0], "00000000000000f0"), (2, " TRAIN", "images/train/ds/c/b.jpg", None, "f000000000000000"), (3, None, "images\\train\\ds\\c\\c.jpg", D[2], None),
        (10, "val", "images/val/ds/c/a.jpg", "SHA256:" + D[0], None), (11, "Test", "images/test/ds/c/a.jpg", D[4], "0xf1"), (12, "test", "images/test/ds/c/a.jpg", D[5], "00ff"), (13, None, "images/val/ds/c/a.jpg", D[2], "1"),
        (14, "test", "images/test/ds/c/a.jpg", "0" * 64, "0"), (15, None, None, D[0], "f0"), (16, "val", "x", None, None), (10, "val", "images/val/ds/c/a.jpg", "SHA256:" + D[0], None), (17, "external-eval", "images/train/ds/c/a.jpg", D[0], "f0"),
    ]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    got = {r["manifest_index"]: r["match_kind"] for r in cross_split(spark, df).collect()}
    assert got == {10: "exact", 11: "near", 12: "near", 13: "exact", 14: None, 16: None, 17: "exact"}
    assert {r["dataset"] for r in cross_split(spark, df).collect()} == {"ds", None}
    assert cross_split(spark, df.limit(0)).collect() == [] and cross_split(spark, df.where(F.col("split") == "train")).collect() == []
