import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.plans import metrics as m
from tests.test_metrics import slow_ap

SCHEMA = "model int, cls int, conf double, tp int, unit long"


def sample(spark, seed=5):
    r = np.random.default_rng(seed)
    rows = [(k, int(r.integers(0, 3)), float(r.integers(1, 9) / 9), int(r.integers(0, 2)), int(r.integers(0, 40))) for k in (0, 1) for _ in range(150)]
    labels = [(c, u) for c in range(3) for u in range(40) for _ in range(3)]
    return rows, labels, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "cls int, unit long")


def test_rounds_like_a_loop(spark):
    rows, labels, matched, gt = sample(spark)
    got = {(r["model"], r["cls"], r["round"]): r["ap"] for r in m.bootstrap_ap(matched, gt, 60).collect()}
    assert len(got) == 2 * 3 * 61
    hashes = dict(gt.select("unit", F.xxhash64("unit")).distinct().collect())
    for r in (0, 1, 37, 60):
        w = {u: int(m.poisson_weights(np.array([h]), 60)[0, r]) for u, h in hashes.items()}
        for k in (0, 1):
            for c in range(3):
                drawn = [(x[2], x[3]) for x in rows if x[:2] == (k, c) for _ in range(w[x[4]])]
                npos = sum(w[u] for x, u in labels if x == c)
                assert got[k, c, r] == pytest.approx(slow_ap([x[0] for x in drawn], [x[1] for x in drawn], npos), abs=1e-9)


def test_weights_are_poisson():
    w = m.poisson_weights(np.random.default_rng(1).integers(-(2**63), 2**63, 500), 1000)
    assert (w[:, 0] == 1).all() and w[:, 1:].mean() == pytest.approx(1, abs=0.01) and w[:, 1:].var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.2


def test_units_are_drawn_together_and_models_paired(spark):
    rows, labels, matched, gt = sample(spark)
    same = matched.where("model = 0").unionByName(matched.where("model = 0").withColumn("model", F.lit(1)))
    out = {(r["setting"], r["measure"]): r for r in m.bootstrap_summary(m.bootstrap_ap(same, gt, 100), 0.0).collect()}
    assert all(r["low"] == r["high"] == 0 and r["p_above"] == 0 for k, r in out.items() if k[0] == "model_1 - model_0")
    assert out["model_0", "MEAN_5"]["low"] < out["model_0", "MEAN_5"]["high"] and out["model_0", "MEAN_5"]["p_above"] == 1
    # one unit for all: every drawn sample is the same or empty
    one = m.bootstrap_ap(same.withColumn("unit", F.lit(1)), gt.withColumn("unit", F.lit(1)), 30).where("model = 0 and cls = 1").collect()
    assert len({round(r["ap"], 9) for r in one} - {0.0}) == 1


def test_at_least_a_thousand_rounds_and_the_plain_value(spark, sf_dir):
    rows = {(r["setting"], r["measure"]): r for r in m.bootstrap_intervals(spark, sf_dir).collect()}
    assert len(rows) == 3 * 7 and all(r["rounds"] >= 1000 for r in rows.values())
    plain = {r["cls"]: r["ap50"] for r in m.ap101(spark, sf_dir).collect()}
    assert all(rows["model_0", f"class_{c}"]["value"] == pytest.approx(x, abs=2e-6) for c, x in plain.items())
    assert all(r["low"] <= r["high"] for r in rows.values())
