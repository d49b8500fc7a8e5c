import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.operators import matching as m


def boxes(n, seed):
    r = np.random.default_rng(seed)
    return np.c_[r.random((n, 2)), 0.1 + 0.3 * r.random((n, 2))]


def slow_iou(a, b):
    w = min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2)
    h = min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2)
    i = max(w, 0) * max(h, 0)
    return i / max(a[2] * a[3] + b[2] * b[3] - i, 1e-9)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 6), st.integers(0, 6), st.integers(0, 999))
def test_iou_and_ioa(n, k, seed):
    a, b = boxes(n, seed), boxes(k, seed + 1)
    got = m.iou_matrix(a, b)
    assert np.allclose(got, [[slow_iou(x, y) for y in b] for x in a] if n and k else got)
    for i, j in itertools.product(range(n), range(k)):
        union = a[i, 2] * a[i, 3] + b[j, 2] * b[j, 3]
        inter = slow_iou(a[i], b[j]) * union / (1 + slow_iou(a[i], b[j]))
        assert m.ioa_matrix(a, b)[i, j] == pytest.approx(inter / (a[i, 2] * a[i, 3]))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 999))
def test_assignment_is_least(n, k, seed):
    cost = np.random.default_rng(seed).random((n, k))
    pairs = m.assignment(cost)
    small, large = min(n, k), max(n, k)
    best = min(sum(cost[i, p[i]] if n <= k else cost[p[i], i] for i in range(small)) for p in itertools.permutations(range(large), small))
    assert len(pairs) == small and sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_ties_and_thresholds():
    two = np.array([[0.5, 0.5, 0.2, 0.2]] * 2)
    iou = m.iou_matrix(two, two[:1])
    same = np.ones((2, 1), bool)
    assert m.greedy_by_confidence(iou, same, np.array([0.9])).tolist() == [1]  # the larger index
    assert m.greedy_by_confidence(iou, same, np.array([0.2])).tolist() == [-1]
    assert m.greedy_masked(iou, np.array([0.9])).tolist() == [0]  # the first
    assert m.greedy_by_score(iou, same) == [(0, 0)] and m.greedy_by_score(iou, same, True) == [(1, 0)]


def test_masked_and_unmasked_differ():
    gt = np.array([[0.5, 0.5, 0.2, 0.2]])
    pred = np.array([[0.5, 0.5, 0.2, 0.2], [0.51, 0.5, 0.2, 0.2]])
    assert m.greedy_masked(m.iou_matrix(gt, pred), np.array([0.8, 0.9])).tolist() == [-1, 0]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 7), st.integers(0, 999))
def test_suppression_and_fusion(n, seed):
    b, conf = boxes(n, seed), np.random.default_rng(seed).random(n)
    kept = m.nms(b, conf, 0.3)
    iou = m.iou_matrix(b, b)
    for i, j in itertools.combinations(kept, 2):
        assert iou[i, j] <= 0.3
    for i in set(range(n)) - set(kept):
        assert any(iou[i, k] > 0.3 and conf[k] >= conf[i] for k in kept)
    assert sum(k for _, _, k in m.weighted_fusion(b, conf, 2)) == n


def test_fusion_of_equal_boxes():
    b = np.array([[0.5, 0.5, 0.2, 0.2]] * 2)
    (box, conf, n), = m.weighted_fusion(b, np.array([0.8, 0.4]), 2)
    assert np.allclose(box, b[0]) and conf == pytest.approx(0.6) and n == 2


def test_sequential_acceptance():
    old = np.array([[0.5, 0.5, 0.2, 0.2]])
    new = np.array([[0.5, 0.5, 0.2, 0.2], [0.1, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.1]])
    assert m.keep_additions(old, new).tolist() == [False, True, False]
    assert m.merge_sources(old, np.array([0]), new, np.array([2, 3, 3])) == ["conflict", "accepted", "duplicate"]
    assert m.merge_sources(old, np.array([0]), new[:1], np.array([1])) == ["accepted"]  # classes 0 and 1 may overlap
    assert m.duplicates_keep_first(new, np.array([0, 1, 1])).tolist() == [False, False, True]
    assert m.reconcile(np.vstack([old, old]), np.array([0, 1]), np.array([0, 1]))[0] == "conflict"
    status, kept = m.reconcile(np.vstack([old, old]), np.array([0, 0]), np.array([1, 0]))
    assert status == "merged" and kept.tolist() == [1]


def test_cascades():
    gt = np.array([[0.3, 0.3, 0.2, 0.2], [0.7, 0.7, 0.2, 0.2]])
    gc = np.array([0, 3])
    assert {k for k, *_ in m.error_cascade(gt, gc, gt, gc, np.array([0.9, 0.8]), lambda a, b: True, 0.5, False)} == {"hit"}
    kinds = [k for k, *_ in m.error_cascade(gt, gc, gt[:1], np.array([1]), np.array([0.9]), lambda a, b: {a, b} == {0, 1}, 0.3, True)]
    assert kinds == ["confusion", "miss"]
    assert [k for k, *_ in m.residual_kinds(gt, gt)] == ["GOOD75", "GOOD75"]
    assert m.residual_kinds(gt, gt[:0]) == [("DETECTION_MISS", 0, -1, 0.0), ("DETECTION_MISS", 1, -1, 0.0)]
    assert [k for k, *_ in m.decomposition_kinds(gt, gt, np.array([0.9, 0.9]))] == ["GOOD_075", "GOOD_075"]
    assert m.label_issues(gt, gc, gt, gc, np.array([0.9, 0.9])) == []
    assert [k for k, *_ in m.false_kinds(gt, gc, gt[:0], gc[:0], np.zeros(0))] == ["missed", "missed"]


def test_fold_crosses_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(i % 5, i, i % 5) for i in range(41)], "k long, i long, v long")
        rows = m.fold(df, "k", ["i"], lambda g: [(len(g["i"]), bool((np.diff(g["i"]) > 0).all()))], "k long, n long, sorted boolean").collect()
        assert sorted(map(tuple, rows)) == [(0, 9, True), (1, 8, True), (2, 8, True), (3, 8, True), (4, 8, True)]
        assert m.fold(df.limit(0), "k", ["i"], lambda g: [(1, True)], "k long, n long, sorted boolean").collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fold_keeps_null_and_large_keys(spark):
    big = 2**53 + 1
    rows = [(None, 1, 1.0), (big, 2, None), (None, 3, 2.0), (big - 1, 4, 4.0), (0, 5, 5.0), (big, 6, 6.0)]
    df = spark.createDataFrame(rows, "k long, i int, v double")
    out = m.fold(df, "k", ["i"], lambda r: [(len(r["i"]), int(r["i"].sum()))], "k bigint, n int, s int")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, 2, 4), (big, 2, 8), (big - 1, 1, 4), (0, 1, 5)], key=str)
    named = spark.createDataFrame([(None, 1), ("", 2), ("a", 3), (None, 4)], "k string, i int")
    assert sorted(map(tuple, m.fold(named, "k", ["i"], lambda r: [(len(r["i"]),)], "k string, n int").collect()), key=str) == [("", 1), ("a", 1), (None, 2)]
    assert m.fold(df.limit(0), "k", ["i"], lambda r: [(1, 1)], "k bigint, n int, s int").collect() == []
