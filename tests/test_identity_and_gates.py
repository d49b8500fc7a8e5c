import hashlib
import json

import pytest
from pyspark.sql import functions as F

from spanforge.operators import gates, identity, sampling


def test_digests(spark):
    doc = {"b": [1, 2.5], "a": "ü"}
    wanted = hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert identity.canonical_digest({"a": "ü", "b": [1, 2.5]}) == wanted
    assert identity.canonical_digest(doc, spaced=True) != wanted
    df = spark.createDataFrame([('{"a": "ü", "b": [1, 2.5]}',), ("{",), (None,)], "j string")
    assert [r[0] for r in df.select(identity.canonical_json_digest("j")).collect()] == [wanted, None, None]
    assert identity.tag("x_", "0123456789abcdef" * 4) == "x_0123456789ab"
    with pytest.raises(ValueError):
        identity.tag("x_", "12")
    df = spark.createDataFrame([("x_0123456789ab, x_0123456789abc and x_aaaaaaaaaaaa x_0123456789ab",)], "t string")
    assert df.select(identity.tags_in(F.col("t"), "x_")).first()[0] == ["x_0123456789ab", "x_aaaaaaaaaaaa"]


def test_configuration():
    docs = {"a": {"x": {"y": 1, "z": 2}}, "b": {"inherits": "a", "x": {"y": 3}}, "c": {"inherits": "d"}, "d": {"inherits": "c"}}
    assert identity.inherited("b", docs) == {"x": {"y": 3, "z": 2}}
    assert identity.dotted(identity.inherited("b", docs), "x.z") == 2 and identity.dotted({}, "x.z", 0) == 0
    with pytest.raises(ValueError, match="cycle"):
        identity.inherited("c", docs)
    assert identity.config_digest({"a": 1, "runtime": 2}) == identity.config_digest({"a": 1})


def test_states(spark):
    state = spark.createDataFrame([("s", "complete", "c", "i", "o", 1), ("s", "failed", "c", "i", "o", 0), ("t", "complete", "c", "i", "o", 1), ("u", "complete", "c", "x", "o", 1)], "stage string, status string, config_hash string, input_hash string, output_hash string, updated_at int")
    wanted = spark.createDataFrame([("s", "c", "i", "o"), ("t", "d", "i", "o"), ("u", "c", "i", "o"), ("v", "c", "i", "o")], "stage string, config_hash string, input_hash string, output_hash string")
    assert {r["stage"]: r["reason"] for r in identity.reusable(state, wanted).collect()} == {"s": None, "t": "config_changed", "u": "input_changed", "v": "no_state"}
    runs = spark.createDataFrame([("a", "h", 5, 10), ("b", "h", 10, 10), ("c", "g", 1, 10)], "run string, train_hash string, epoch int, epochs int")
    want = spark.createDataFrame([(x, "h") for x in "abcd"], "run string, train_hash string")
    assert {r["run"]: r["decision"] for r in identity.resume(runs, want).collect()} == {"a": "RESUME", "b": "ALREADY", "c": "STALE", "d": "FRESH"}
    a, b = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", "1")], "path string, sha256 string"), spark.createDataFrame([("p", "1"), ("q", "2"), ("s", "1")], "path string, sha256 string")
    assert {r["path"]: r["status"] for r in identity.verified(a, b).collect()} == {"p": "ok", "q": "CHANGED", "r": "MISSING", "s": "extra"}
    registry = spark.createDataFrame([("v1", "d")], "name string, digest string")
    assert identity.freeze(registry, "v1", "d").count() == 1 and identity.freeze(registry, "v2", "e").count() == 2
    with pytest.raises(ValueError):
        identity.freeze(registry, "v1", "e")


def test_gates(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    with pytest.raises(gates.GateError, match="broken"):
        gates.assert_empty(df, "broken")
    gates.assert_empty(df.limit(0), "fine")
    assert [tuple(r) for r in gates.problems(df, ["k"], {"high": F.col("v") > 3, "none": F.col("v").isNull()}).collect()] == [(1, "high"), (2, "none")]
    twice = df.unionByName(df)
    assert sorted(r["side"] for r in gates.set_difference(twice, df).collect()) == ["left", "left"]
    assert [tuple(r) for r in gates.count_conflicts(df, {"rows": (F.lit(True), 2), "high": (F.col("v") > 3, 7)}).collect()] == [("high", 1, 7)]


def test_sampling(spark):
    sizes = {"a": 1000, "b": 100, "c": 3}
    got = sampling.largest_remainder(sizes, 110, 10)
    assert sum(got.values()) == 110 and got["c"] == 3 and got["b"] >= 10
    assert sampling.largest_remainder(sizes, 5000) == sizes and sampling.largest_remainder({}, 5) == {}
    df = spark.range(2000).withColumn("s", F.when(F.col("id") % 10 == 0, "b").otherwise("a"))
    rows = sampling.stratified(df, "s", "id", {"a": 50, "b": 20}, "seed")
    assert {r["s"]: r["count"] for r in rows.groupBy("s").count().collect()} == {"a": 50, "b": 20}
    assert sorted(rows.select("id").collect()) == sorted(sampling.stratified(df.repartition(7), "s", "id", {"a": 50, "b": 20}, "seed").select("id").collect())
    share = df.where(sampling.fraction(F.col("id")) < 0.8).count() / 2000
    assert 0.75 < share < 0.85
    assert df.select(sampling.seeded(F.lit("a"), F.col("id"))).first()[0] < 2**60
