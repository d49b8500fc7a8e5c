"""Queries of the order-dependent folds: matching policies, error cascades, suppression and merging."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import geometry as g
from spanforge.operators import matching as m
from spanforge.plans.boxes import _sql_pairs, sql_masked
from spanforge.sources.fixtures import SQL_GT, gt_boxes, pred_boxes, sql_pred

_BOX = ("cx", "cy", "w", "h")


def _both(spark: SparkSession, sf_dir: str, model: int = 0) -> DataFrame:
    """Labels (kind 0) and predictions (kind 1) of all images in one table: one shuffle for both."""
    gt = gt_boxes(spark, sf_dir).withColumn("conf", F.lit(1.0)).withColumn("kind", F.lit(0))
    return gt.unionByName(pred_boxes(spark, sf_dir, model).withColumn("kind", F.lit(1)))


def _sides(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    boxes = np.stack([rows[c] for c in _BOX], 1)
    g, p = rows["kind"] == 0, rows["kind"] == 1
    return boxes[g], rows["cls"][g], rows["idx"][g], boxes[p], rows["cls"][p], rows["idx"][p], rows["conf"][p]


def _events(of: Callable) -> Callable:
    """Events with the indices of the boxes in their table."""

    def kernel(rows: dict[str, np.ndarray]) -> list[tuple]:
        gt, gc, gi, pred, pc, pi, conf = _sides(rows)
        return [(kind, int(gi[g]) if g >= 0 else None, int(pi[p]) if p >= 0 else None, x) for kind, g, p, x in of(gt, gc, pred, pc, conf)]

    return kernel


_EVENT = "image bigint, kind string, g_idx double, p_idx double, iou double"


def _fold(spark: SparkSession, sf_dir: str, of: Callable, model: int = 0) -> DataFrame:
    rows = m.fold(_both(spark, sf_dir, model), "image", ["kind", "idx"], _events(of), _EVENT)
    return rows.select("image", "kind", F.col("g_idx").cast("int").alias("g_idx"), F.col("p_idx").cast("int").alias("p_idx"), F.round("iou", 6).alias("iou"))


def _pairs_of(match: Callable) -> Callable:
    def of(gt, gc, pred, pc, conf):
        iou = m.iou_matrix(gt, pred)
        return [("match", g, p, float(iou[g, p])) for g, p in match(gt, gc, pred, pc, conf)]

    return of


def match_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    def match(gt, gc, pred, pc, conf):
        out = m.greedy_by_confidence(m.iou_matrix(gt, pred, 1e-12), gc[:, None] == pc[None], conf)
        return [(int(g), p) for p, g in enumerate(out) if g >= 0]

    return _fold(spark, sf_dir, _pairs_of(match))


def match_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    def match(gt, gc, pred, pc, conf):
        out, iou = [], m.iou_matrix(gt, pred)
        for c in np.unique(pc):
            g, p = np.flatnonzero(gc == c), np.flatnonzero(pc == c)
            out += [(int(g[x]), int(p[k])) for k, x in enumerate(m.greedy_masked(iou[np.ix_(g, p)], conf[p])) if x >= 0]
        return out

    return _fold(spark, sf_dir, _pairs_of(match))


def match_by_iou_larger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, _pairs_of(lambda gt, gc, pred, pc, conf: m.greedy_by_score(i := m.iou_matrix(gt, pred), (gc[:, None] == pc[None]) & (i >= 0.5), True)))


def match_by_iou_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, _pairs_of(lambda gt, gc, pred, pc, conf: m.greedy_by_score(i := m.iou_matrix(gt, pred), (gc[:, None] == pc[None]) & (i >= 0.5))))


def match_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, _pairs_of(lambda gt, gc, pred, pc, conf: m.hungarian(gt, pred, conf)))


def label_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, m.label_issues)


def targeted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cascade in which only classes 0 and 1 are confused, at a lower overlap; of equal pairs the larger first."""
    return _fold(spark, sf_dir, lambda gt, gc, pred, pc, conf: m.error_cascade(gt, gc, pred, pc, conf, lambda a, b: {a, b} == {0, 1}, 0.3, True))


def targeted_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images with the gravest errors."""
    weight = F.when(F.col("kind") == "miss", 2.0).when(F.col("kind") == "confusion", 1.5).when(F.col("kind") == "false_alarm", 1.0).when(F.col("kind") == "localisation", 0.5).otherwise(0.0)
    scores = targeted_errors(spark, sf_dir).groupBy("image").agg(F.sum(weight).alias("severity"))
    return scores.orderBy(F.desc("severity"), "image").limit(100)


def diagnosis_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, lambda gt, gc, pred, pc, conf: m.error_cascade(gt, gc, pred, pc, conf, lambda a, b: True, 0.5, False))


def diagnosis_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["hit", "confusion", "localisation", "miss", "false_alarm"]
    return diagnosis_errors(spark, sf_dir).withColumn("part", F.col("image") % 4).groupBy("part").pivot("kind", kinds).count().na.fill(0)


def residual_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, lambda gt, gc, pred, pc, conf: m.residual_kinds(gt, pred))


def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, lambda gt, gc, pred, pc, conf: m.decomposition_kinds(gt, pred, conf))


def hard_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, m.false_kinds)


def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that non-maximum suppression keeps, per class."""

    def kernel(rows):
        boxes, out = np.stack([rows[c] for c in _BOX], 1), []
        for c in np.unique(rows["cls"]):
            at = np.flatnonzero(rows["cls"] == c)
            out += [(int(rows["idx"][at[k]]), int(c), float(rows["conf"][at[k]])) for k in m.nms(boxes[at], rows["conf"][at])]
        return out

    return m.fold(pred_boxes(spark, sf_dir), "image", ["idx"], kernel, "image bigint, idx int, cls int, conf double")


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of three models fused per class."""
    rows = None
    for k in range(3):
        one = pred_boxes(spark, sf_dir, k).withColumn("model", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)

    def kernel(rows):
        boxes, out = np.stack([rows[c] for c in _BOX], 1), []
        for c in np.unique(rows["cls"]):
            at = np.flatnonzero(rows["cls"] == c)
            out += [(int(c), *(round(float(x), 6) for x in box), round(conf, 6), n) for box, conf, n in m.weighted_fusion(boxes[at], rows["conf"][at], 3)]
        return out

    return m.fold(rows, "image", ["model", "idx"], kernel, "image bigint, cls int, cx double, cy double, w double, h double, conf double, n_members int")


def additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of class 0 to add, in order of their index."""

    def of(gt, gc, pred, pc, conf):
        new = np.flatnonzero((pc == 0) & (conf >= 0.5))
        ok = m.keep_additions(gt[gc == 0], pred[new])
        return [("accepted" if a else "duplicate", -1, int(p), 0.0) for p, a in zip(new, ok, strict=True)]

    return _fold(spark, sf_dir, of)


def cross_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of another source merged into the labels."""
    return _fold(spark, sf_dir, lambda gt, gc, pred, pc, conf: [(k, -1, p, 0.0) for p, k in enumerate(m.merge_sources(gt, gc, pred, pc))], 2)


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that one sure prediction covers together."""
    return _fold(spark, sf_dir, lambda gt, gc, pred, pc, conf: [("fragment", g, p, 0.0) for p, parts in m.merge_fragments(gt, gc, pred, conf, (0, 1, 2, 3, 4, 5)) for g in parts], 1)


def detector_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of class 0 that another detector or their confidence confirms."""

    def of(gt, gc, pred, pc, conf):
        at = np.flatnonzero(pc == 0)
        kept = m.fuse_detectors(pred[at], conf[at], gt[gc == 0], gt[gc != 0])
        return [("kept", -1, int(at[k]), 0.0) for k in kept]

    return _fold(spark, sf_dir, of)


def copies_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels dropped as copies of an earlier one of their class that stays."""
    return _fold(spark, sf_dir, lambda gt, gc, pred, pc, conf: [("dropped", int(g), -1, 0.0) for g in np.flatnonzero(m.duplicates_keep_first(gt, gc, 0.5))])


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of an image and of its copy brought together, or put aside as a conflict."""

    def of(gt, gc, pred, pc, conf):
        status, kept = m.reconcile(np.vstack([gt, pred]), np.r_[gc, pc], np.r_[np.zeros(len(gt)), np.ones(len(pred))])
        return [(status, -1, -1, float(len(kept)))]

    return _fold(spark, sf_dir, of).select("image", F.col("kind").alias("status"), F.col("iou").cast("int").alias("n_boxes"))


QUERIES = {
    f.__name__: f
    for f in (
        match_by_confidence, match_masked, match_by_iou_larger, match_by_iou_smaller, match_assignment, label_issues, targeted_errors, targeted_severity, diagnosis_errors, diagnosis_counts,
        residual_errors, decomposition, hard_cases, suppressed, fused, additions, cross_merge, fragments, detector_fusion, copies_dropped, reconciled,
    )
}


def _sql_taken(hits: str, rule: str) -> str:
    """Hits (image, idx, hit) with the overlap of the pair."""
    both = _sql_pairs(SQL_GT, sql_pred(0), "g_", "p_")
    return f"SELECT b.image, 'match' AS kind, b.g_idx, b.p_idx, round({g.iou('g_', 'p_', rule)}, 6) AS iou FROM (SELECT * FROM {both}) b JOIN {hits} h ON h.image = b.image AND h.idx = b.p_idx AND h.hit = b.g_idx"


def _sql_kept(items: str, over: str) -> str:
    """Items (image, cls, k, idx, conf) in the order k, each dropped if it lies on one that stays (``over``: image, idx, other); the state is the list of those that stay."""
    return f"""(WITH RECURSIVE it AS MATERIALIZED ({items}), ov AS MATERIALIZED (SELECT image, idx, list(other) AS others FROM ({over}) GROUP BY image, idx),
      cc AS MATERIALIZED (SELECT it.*, coalesce(others, []) AS others FROM it LEFT JOIN ov USING (image, idx)),
      ww(image, cls, k, idx, conf, kept, stays) AS (
        SELECT DISTINCT image, cls, CAST(0 AS BIGINT), CAST(-1 AS INTEGER), CAST(0 AS DOUBLE), CAST([] AS INTEGER[]), false FROM it
        UNION ALL
        SELECT w.image, w.cls, c.k, c.idx, c.conf, CASE WHEN list_has_any(w.kept, c.others) THEN w.kept ELSE list_append(w.kept, c.idx) END, NOT list_has_any(w.kept, c.others)
        FROM ww w JOIN cc c ON c.image = w.image AND c.cls = w.cls AND c.k = w.k + 1)
      SELECT * FROM ww WHERE k > 0)"""


_SURE = f"(SELECT * FROM {sql_pred(0)} WHERE conf >= 0.25)"
# Sure predictions choose first; of equal overlaps the label with the larger number.
_BY_CONFIDENCE = f"""(WITH RECURSIVE pp AS MATERIALIZED (SELECT image, idx, cls, row_number() OVER (PARTITION BY image, cls ORDER BY conf DESC, idx) AS k FROM {_SURE}),
  nn AS MATERIALIZED (SELECT image, p_idx, list(g_idx ORDER BY iou DESC, g_idx DESC) AS near FROM (SELECT *, {g.iou('g_', 'p_')} AS iou FROM {_sql_pairs(SQL_GT, _SURE, 'g_', 'p_')} WHERE g_cls = p_cls) WHERE iou >= 0.5 GROUP BY image, p_idx),
  cc AS MATERIALIZED (SELECT pp.*, coalesce(near, []) AS near FROM pp LEFT JOIN nn ON nn.image = pp.image AND nn.p_idx = pp.idx),
  ww(image, cls, k, idx, used, hit) AS (
    SELECT DISTINCT image, cls, CAST(0 AS BIGINT), CAST(-1 AS INTEGER), CAST([] AS INTEGER[]), CAST(NULL AS INTEGER) FROM pp
    UNION ALL
    SELECT image, cls, k, idx, CASE WHEN h IS NULL THEN used ELSE list_append(used, h) END, h
    FROM (SELECT w.image, w.cls, c.k, c.idx, w.used, list_filter(c.near, lambda x: NOT list_contains(w.used, x))[1] AS h FROM ww w JOIN cc c ON c.image = w.image AND c.cls = w.cls AND c.k = w.k + 1))
  SELECT image, idx, hit FROM ww WHERE hit IS NOT NULL)"""
_NMS = _sql_kept(
    f"SELECT image, cls, row_number() OVER (PARTITION BY image, cls ORDER BY conf DESC, idx) AS k, idx, conf FROM {sql_pred(0)}",
    f"SELECT image, a_idx AS idx, b_idx AS other FROM {_sql_pairs(sql_pred(0), sql_pred(0), 'a_', 'b_')} WHERE a_cls = b_cls AND a_idx <> b_idx AND {g.iou('a_', 'b_', 'clip9')} > 0.5",
)
_COPIES = _sql_kept(
    f"SELECT image, cls, row_number() OVER (PARTITION BY image, cls ORDER BY idx) AS k, idx, 1.0 AS conf FROM {SQL_GT}",
    f"SELECT image, a_idx AS idx, b_idx AS other FROM {_sql_pairs(SQL_GT, SQL_GT, 'a_', 'b_', right_cols='idx cls cx cy w h')} WHERE a_cls = b_cls AND b_idx < a_idx AND {g.iou('a_', 'b_', 'clip9')} >= 0.5",
)

SQL: dict[str, str] = {
    "match_masked": _sql_taken(f"(SELECT * FROM {sql_masked()} WHERE hit IS NOT NULL)", "clip9"),
    "match_by_confidence": _sql_taken(_BY_CONFIDENCE, "plain"),
    "suppressed": f"SELECT image, idx, cls, conf FROM {_NMS} WHERE stays",
    "copies_dropped": f"SELECT image, 'dropped' AS kind, idx AS g_idx, CAST(NULL AS INTEGER) AS p_idx, CAST(0 AS DOUBLE) AS iou FROM {_COPIES} WHERE NOT stays",
}
