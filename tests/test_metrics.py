import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.plans.metrics import average_precision


def slow_ap(conf, tp, npos):
    """Steps of equal confidence, envelope, 101 points, trapezoids."""
    if not npos or not len(conf):
        return 0.0
    rec, prec = [0.0], [1.0]
    for c in sorted(set(conf), reverse=True):
        at = np.array(conf) >= c
        rec.append(np.array(tp)[at].sum() / npos)
        prec.append(np.array(tp)[at].mean())
    rec.append(1.0)
    prec.append(0.0)
    env = np.maximum.accumulate(prec[::-1])[::-1]
    x = np.linspace(0, 1, 101)
    return np.trapezoid(np.interp(x, rec, env), x)


def ap(spark, conf, tp, npos):
    rows = spark.createDataFrame([(0, float(c), int(t)) for c, t in zip(conf, tp)], "cls int, conf double, tp int")
    return average_precision(rows, spark.createDataFrame([(0, npos)], "cls int, npos int"), ["cls"]).first()["ap"]


@pytest.mark.parametrize("seed", range(4))
def test_like_a_loop(spark, seed):
    r = np.random.default_rng(seed)
    conf, tp = r.integers(0, 12, 30) / 12, r.integers(0, 2, 30)
    assert ap(spark, conf, tp, int(tp.sum()) + 4) == pytest.approx(slow_ap(conf, tp, int(tp.sum()) + 4), abs=0.006)


def test_ends(spark):
    assert ap(spark, [0.9, 0.8], [1, 1], 2) == pytest.approx(1.0)
    assert ap(spark, [0.9], [0], 2) == pytest.approx(0.0, abs=0.01)
    assert ap(spark, [], [], 3) == 0.0 and ap(spark, [0.5], [0], 0) == 0.0


def test_weights_of_one_change_nothing(spark):
    rows = spark.createDataFrame([(0, i / 9, i % 2) for i in range(9)], "cls int, conf double, tp int")
    totals = spark.createDataFrame([(0, 6)], "cls int, npos int")
    assert average_precision(rows, totals, ["cls"], F.lit(1.0)).first()["ap"] == average_precision(rows, totals, ["cls"]).first()["ap"]
