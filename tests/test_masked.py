import numpy as np
import pytest

from spanforge.operators.matching import greedy_masked, iou_matrix
from spanforge.plans import metrics
from spanforge.plans.boxes import _masked, masked_matches

BOX = "image long, idx int, cls int, cx double, cy double, w double, h double"


def crowded(seed, images=6):
    """Labels on each other, several predictions a label, equal confidences."""
    r = np.random.default_rng(seed)
    gt, pred = [], []
    for image in range(images):
        for i in range(r.integers(0, 9)):
            gt.append((image, i, int(r.integers(0, 2)), *(float(x) for x in (r.integers(0, 4) / 20 + 0.4, r.integers(0, 4) / 20 + 0.4, 0.3, 0.3))))
        for i in range(r.integers(0, 12)):
            pred.append((image, i, int(r.integers(0, 2)), *(float(x) for x in (r.random() * 0.15 + 0.4, r.random() * 0.15 + 0.4, 0.3, 0.3)), float(r.integers(1, 6) / 6)))
    return gt, pred


def test_like_the_masked_loop(spark):
    thresholds = (0.5, 0.7, 0.9)
    gt, pred = crowded(3)
    got = masked_matches(spark.createDataFrame(pred, BOX + ", conf double"), spark.createDataFrame(gt, BOX), thresholds)
    found = {(r["image"], r["idx"]): tuple(r["tp"]) for r in got.collect()}
    wanted = {}
    for image, cls in {(p[0], p[2]) for p in pred}:
        g = [x for x in gt if x[0] == image and x[2] == cls]
        p = [x for x in pred if x[0] == image and x[2] == cls]
        iou, conf = iou_matrix(np.array([x[3:7] for x in g]).reshape(-1, 4), np.array([x[3:7] for x in p])), np.array([x[7] for x in p])
        hits = [greedy_masked(iou, conf, t) >= 0 for t in thresholds]
        wanted |= {(image, x[1]): tuple(int(h[k]) for h in hits) for k, x in enumerate(p)}
    assert found == wanted


def test_a_second_prediction_falls_to_the_next_label(spark):
    gt = [(1, 0, 0, 0.5, 0.5, 0.4, 0.4), (1, 1, 0, 0.55, 0.5, 0.4, 0.4)]
    pred = [(1, 0, 0, 0.5, 0.5, 0.4, 0.4, 0.9), (1, 1, 0, 0.51, 0.5, 0.4, 0.4, 0.8)]
    got = masked_matches(spark.createDataFrame(pred, BOX + ", conf double"), spark.createDataFrame(gt, BOX))
    assert sorted((r["idx"], r["tp"][0]) for r in got.collect()) == [(0, 1), (1, 1)]


def test_profile_over_ten_thresholds(spark, sf_dir):
    got = {r["cls"]: r for r in metrics.strict_profile(spark, sf_dir).collect()}
    each = {t: {r["cls"]: r["ap"] for r in metrics.average_precision(_masked(spark, sf_dir, t / 100), metrics._totals(spark, sf_dir), ["cls"]).collect()} for t in range(50, 100, 5)}
    assert len(got) == 6
    for c, r in got.items():
        mean = np.mean([each[t][c] for t in each])
        assert [r["ap50"], r["ap50_95"], r["gap"], r["ap75"], r["ap90"], r["ap95"]] == pytest.approx([each[50][c], mean, each[50][c] - mean, each[75][c], each[90][c], each[95][c]], abs=2e-6)
