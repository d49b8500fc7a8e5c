"""One-to-one matching and error cascades inside an image: folds that depend on the order of events.

The kernels work on NumPy arrays of one image. ``fold`` runs them over a table, one sorted pass per
partition, without a Python call per image for grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Box = np.ndarray  # rows of cx, cy, w, h


def iou_matrix(a: Box, b: Box, eps: float = 1e-9) -> np.ndarray:
    """IoU of every pair; ``eps`` is the least union."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    low = np.maximum((a[:, :2] - a[:, 2:] / 2)[:, None], (b[:, :2] - b[:, 2:] / 2)[None])
    high = np.minimum((a[:, :2] + a[:, 2:] / 2)[:, None], (b[:, :2] + b[:, 2:] / 2)[None])
    inter = np.clip(high - low, 0, None).prod(2)
    return inter / np.maximum((a[:, 2] * a[:, 3])[:, None] + (b[:, 2] * b[:, 3])[None] - inter, eps)


def ioa_matrix(a: Box, b: Box) -> np.ndarray:
    """Share of each box of ``a`` that each of ``b`` covers."""
    areas = np.maximum(a[:, 2] * a[:, 3], 1e-12)[:, None]
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    union = (a[:, 2] * a[:, 3])[:, None] + (b[:, 2] * b[:, 3])[None]
    iou = iou_matrix(a, b, 1e-12)
    return iou * union / (1 + iou) / areas


def centre_distance(a: Box, b: Box) -> np.ndarray:
    """Distance of centres in diagonals of ``a``."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    return d / np.maximum(np.hypot(a[:, 2], a[:, 3]), 1e-9)[:, None]


def _by_confidence(conf: np.ndarray) -> np.ndarray:
    return np.lexsort((np.arange(len(conf)), -conf))


def greedy_by_confidence(iou: np.ndarray, same: np.ndarray, conf: np.ndarray, least_conf: float = 0.25, least_iou: float = 0.5) -> np.ndarray:
    """Label of each prediction or -1. Sure predictions choose first; of equal IoU the label with the larger index."""
    out, free = np.full(len(conf), -1), np.ones(len(iou), bool)
    for p in _by_confidence(conf):
        if conf[p] < least_conf:
            break
        score = np.where(free & same[:, p] & (iou[:, p] >= least_iou), iou[:, p], -1.0)
        if len(score) and score.max() >= 0:
            g = np.flatnonzero(score == score.max())[-1]
            out[p], free[g] = g, False
    return out


def greedy_masked(iou: np.ndarray, conf: np.ndarray, least_iou: float = 0.5) -> np.ndarray:
    """Within one class: used labels are masked, the first best label counts if it reaches ``least_iou``."""
    out, masked = np.full(len(conf), -1), iou.copy()
    for p in _by_confidence(conf):
        if len(masked):
            g = int(masked[:, p].argmax())
            if masked[g, p] >= least_iou:
                out[p] = g
                masked[g] = -1
    return out


def greedy_by_score(score: np.ndarray, allowed: np.ndarray, larger_first: bool = False) -> list[tuple[int, int]]:
    """Pairs (label, prediction) by descending score; ties by index, the larger or the smaller first."""
    g, p = np.nonzero(allowed)
    sign = -1 if larger_first else 1
    order = np.lexsort((sign * p, sign * g, -score[g, p]))
    used_g, used_p, out = set(), set(), []
    for k in order:
        a, b = int(g[k]), int(p[k])
        if a not in used_g and b not in used_p:
            used_g.add(a), used_p.add(b), out.append((a, b))
    return out


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment by shortest augmenting paths; each row gets a column if there are enough."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    of = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        of[0], j0 = i, 0
        least, way, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while of[j0]:
            seen[j0] = True
            row = of[j0]
            free = ~seen[1:]
            reduced = c[row - 1] - u[row] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = 1 + int(np.where(free, least[1:], np.inf).argmin())
            delta = least[j1]
            u[of[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            j0 = j1
        while j0:
            of[j0], j0 = of[way[j0]], way[j0]
    pairs = [(of[j] - 1, j - 1) for j in range(1, m + 1) if of[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def hungarian(gt: Box, pred: Box, conf: np.ndarray, most_distance: float = 1.5, least_iou: float = 0.1) -> list[tuple[int, int]]:
    """Pairs of least total cost in distance, overlap and confidence; pairs that are far apart and hardly overlap are given up."""
    if not len(gt) or not len(pred):
        return []
    iou, far = iou_matrix(gt, pred), centre_distance(gt, pred)
    cost = 0.75 * np.minimum(far, 3) / 3 + 0.20 * (1 - iou) + 0.05 * (1 - conf)[None]
    return [(g, p) for g, p in assignment(cost) if far[g, p] <= most_distance or iou[g, p] >= least_iou]


def nms(boxes: Box, conf: np.ndarray, most_iou: float = 0.5) -> np.ndarray:
    """Indices that stay, surest first: each drops later boxes that overlap it by more than ``most_iou``."""
    iou, dead, kept = iou_matrix(boxes, boxes), np.zeros(len(boxes), bool), []
    for i in _by_confidence(conf):
        if not dead[i]:
            kept.append(int(i))
            dead |= iou[i] > most_iou
    return np.array(kept, int)


def weighted_fusion(boxes: Box, conf: np.ndarray, models: int, least_iou: float = 0.55) -> list[tuple[np.ndarray, float, int]]:
    """Weighted boxes fusion: (box, confidence, members) of each cluster.

    Boxes join, surest first, the cluster whose fused box they overlap most by more than ``least_iou``; the fused box is the
    mean weighted by confidence, and its confidence the mean, scaled down where fewer than ``models`` agree.
    """
    members: list[list[int]] = []
    fused: list[np.ndarray] = []
    for i in _by_confidence(conf):
        overlap = iou_matrix(np.array(fused).reshape(-1, 4), boxes[i : i + 1])[:, 0] if fused else np.zeros(0)
        k = int(overlap.argmax()) if len(overlap) else -1
        if k >= 0 and overlap[k] > least_iou:
            members[k].append(int(i))
        else:
            members.append([int(i)])
            fused.append(boxes[i])
            k = len(members) - 1
        w = conf[members[k]]
        fused[k] = (boxes[members[k]] * w[:, None]).sum(0) / max(w.sum(), 1e-12)
    return [(fused[k], float(conf[m].mean() * min(len(m), models) / models), len(m)) for k, m in enumerate(members)]


def keep_additions(existing: Box, new: Box, least_iou: float = 0.5) -> np.ndarray:
    """Which boxes are accepted, one after another: not those that repeat an existing or an already accepted one."""
    have, out = existing, np.zeros(len(new), bool)
    for i in range(len(new)):
        if not (iou_matrix(new[i : i + 1], have) >= least_iou).any():
            out[i] = True
            have = np.vstack([have, new[i : i + 1]])
    return out


def merge_sources(old: Box, old_cls: np.ndarray, new: Box, new_cls: np.ndarray, same_iou: float = 0.3, other_iou: float = 0.5, friends: frozenset = frozenset({0, 1})) -> list[str]:
    """Per new box: duplicate (of its class), conflict (with another class, but for the ``friends``) or accepted; accepted ones count for later ones."""
    have, cls, out = old, old_cls, []
    for i in range(len(new)):
        iou = iou_matrix(new[i : i + 1], have)[0] if len(have) else np.zeros(0)
        same = cls == new_cls[i]
        friendly = np.array([{int(c), int(new_cls[i])} == set(friends) for c in cls], bool)
        if (iou[same] >= same_iou).any():
            out.append("duplicate")
        elif (iou[~same & ~friendly] >= other_iou).any():
            out.append("conflict")
        else:
            out.append("accepted")
            have, cls = np.vstack([have, new[i : i + 1]]), np.append(cls, new_cls[i])
    return out


def merge_fragments(gt: Box, cls: np.ndarray, pred: Box, conf: np.ndarray, classes: Sequence[int] = (1, 2), least_ioa: float = 0.8, least_conf: float = 0.6) -> list[tuple[int, list[int]]]:
    """Predictions, surest first, that cover two or more labels of the same of ``classes``: (prediction, labels it replaces)."""
    inside, used, out = ioa_matrix(gt, pred), np.zeros(len(gt), bool), []
    for p in _by_confidence(conf):
        if conf[p] < least_conf:
            break
        for c in classes:
            parts = np.flatnonzero(~used & (cls == c) & (inside[:, p] >= least_ioa))
            if len(parts) >= 2:
                used[parts] = True
                out.append((int(p), parts.tolist()))
    return out


def fuse_detectors(a: Box, a_conf: np.ndarray, b: Box, others: Box, least_conf: float = 0.3, sure: float = 0.6, most_iou: float = 0.6, most_area: float = 0.85, other_iou: float = 0.5) -> np.ndarray:
    """Boxes of detector ``a`` that stay: after suppression, without groups (around two others), huge boxes, boxes on
    other classes, and unconfirmed ones (neither sure nor met by detector ``b``); wrappers of a kept box go last."""
    live = np.flatnonzero(a_conf >= least_conf)
    live = live[nms(a[live], a_conf[live], most_iou)] if len(live) else live
    inside = ioa_matrix(a[live], a[live]) >= 0.9
    np.fill_diagonal(inside, False)
    keep = inside.sum(0) < 2
    keep &= a[live, 2] * a[live, 3] <= most_area
    if len(others):
        keep &= ~(iou_matrix(a[live], others) >= other_iou).any(1)
    met = (iou_matrix(a[live], b) >= 0.5).any(1) if len(b) else np.zeros(len(live), bool)
    keep &= met | (a_conf[live] >= sure)
    live = live[keep]
    wraps = ioa_matrix(a[live], a[live]) >= 0.9
    np.fill_diagonal(wraps, False)
    return live[~wraps.any(0)]


def duplicates_keep_first(boxes: Box, cls: np.ndarray, least_iou: float = 0.95) -> np.ndarray:
    """Which boxes are dropped as copies of an earlier one of their class that stays."""
    iou, dropped = iou_matrix(boxes, boxes), np.zeros(len(boxes), bool)
    for i in range(len(boxes)):
        dropped[i] = (~dropped[:i] & (cls[:i] == cls[i]) & (iou[:i, i] >= least_iou)).any()
    return dropped


def reconcile(boxes: Box, cls: np.ndarray, origin: np.ndarray, conflict: float = 0.7, merge: float = 0.8) -> tuple[str, np.ndarray]:
    """Labels of copies of one image: 'conflict' if different classes overlap, else the boxes that are left, lower origin first."""
    iou = iou_matrix(boxes, boxes)
    if ((cls[:, None] != cls[None]) & (iou >= conflict)).any():
        return "conflict", np.zeros(0, int)
    kept: list[int] = []
    for i in np.lexsort((np.arange(len(cls)), origin)):
        if not any(cls[k] == cls[i] and iou[k, i] >= merge for k in kept):
            kept.append(int(i))
    return ("same" if len(kept) == len(cls) else "merged"), np.array(kept, int)


# Error cascades: each gives (kind, label or -1, prediction or -1, IoU).
Event = tuple[str, int, int, float]


def label_issues(gt: Box, gc: np.ndarray, pred: Box, pc: np.ndarray, conf: np.ndarray) -> list[Event]:
    """dup_gt, loose_box, missing, class_flip and unseen_gt of an audit."""
    out: list[Event] = []
    own = iou_matrix(gt, gt, 1e-12)
    for i, j in zip(*np.nonzero(np.triu(own >= 0.8, 1)), strict=True):
        if gc[i] == gc[j]:
            out.append(("dup_gt", int(i), -1, float(own[i, j])))
    iou = iou_matrix(gt, pred, 1e-12)
    match = greedy_by_confidence(iou, gc[:, None] == pc[None], conf)
    taken = set(match[match >= 0].tolist())
    for p in _by_confidence(conf):
        if match[p] >= 0:
            if conf[p] >= 0.6 and iou[match[p], p] < 0.75:
                out.append(("loose_box", int(match[p]), int(p), float(iou[match[p], p])))
        elif conf[p] >= 0.5:
            best = int(iou[:, p].argmax()) if len(gt) else -1
            top = float(iou[best, p]) if best >= 0 else 0.0
            if top < 0.3:
                out.append(("missing", -1, int(p), top))
            elif top >= 0.5 and best not in taken and gc[best] != pc[p]:
                out.append(("class_flip", best, int(p), top))
    for i in range(len(gt)):
        top = float(iou[i].max()) if len(pred) else 0.0
        if top < 0.3:
            out.append(("unseen_gt", i, -1, top))
    return out


def error_cascade(gt: Box, gc: np.ndarray, pred: Box, pc: np.ndarray, conf: np.ndarray, confusion: Callable[[int, int], bool], confusion_iou: float, larger_first: bool, localisation_iou: float = 0.1) -> list[Event]:
    """Hits at IoU 0.5 of the class; then confusions of classes, then badly placed boxes, then misses, then false alarms."""
    iou = iou_matrix(gt, pred)
    same = gc[:, None] == pc[None]
    free_g, free_p, out = np.ones(len(gt), bool), np.ones(len(pred), bool), []

    def take(kind: str, allowed: np.ndarray) -> None:
        for g, p in greedy_by_score(iou, allowed & free_g[:, None] & free_p[None], larger_first):
            free_g[g] = free_p[p] = False
            out.append((kind, g, p, float(iou[g, p])))

    take("hit", same & (iou >= 0.5))
    mixed = np.array([[confusion(int(a), int(b)) for b in pc] for a in gc], bool).reshape(iou.shape)
    take("confusion", mixed & ~same & (iou >= confusion_iou))
    take("localisation", same & (iou >= localisation_iou))
    out += [("miss", int(g), -1, 0.0) for g in np.flatnonzero(free_g)]
    out += [("false_alarm", -1, int(p), 0.0) for p in np.flatnonzero(free_p)]
    return out


def residual_kinds(gt: Box, pred: Box, far: float = 0.25) -> list[Event]:
    """Of each label, by the best-scored pairing: good, centre error, shape error or miss."""
    iou, distance = iou_matrix(gt, pred), centre_distance(gt, pred)
    score = iou - 0.25 * distance
    pairs = dict(greedy_by_score(score, (distance <= 1.5) | (iou >= 0.05)))
    out: list[Event] = []
    for g in range(len(gt)):
        p = pairs.get(g)
        if p is None:
            out.append(("DETECTION_MISS", g, -1, 0.0))
            continue
        kind = "GOOD75" if iou[g, p] >= 0.75 else "CENTER_ERROR" if distance[g, p] > far else "EXTENT_SHAPE_ERROR"
        out.append((kind, g, p, float(iou[g, p])))
    return out


def decomposition_kinds(gt: Box, pred: Box, conf: np.ndarray) -> list[Event]:
    """Of each label that the assignment matches: good, acceptable, or wrong in centre or extent."""
    iou, distance = iou_matrix(gt, pred), centre_distance(gt, pred)
    out: list[Event] = []
    for g, p in hungarian(gt, pred, conf):
        x, d = iou[g, p], distance[g, p]
        kind = "GOOD_075" if x >= 0.75 else "OK_050_075" if x >= 0.5 else "CENTER_GOOD_EXTENT_BAD" if d <= 0.1 else "CENTER_OK_EXTENT_BAD" if d <= 0.25 else "CENTER_BAD"
        out.append((kind, g, p, float(x)))
    return out


def false_kinds(gt: Box, gc: np.ndarray, pred: Box, pc: np.ndarray, conf: np.ndarray) -> list[Event]:
    """Missed labels, and what false alarms are: confused, shifted or background."""
    out: list[Event] = []
    iou = iou_matrix(gt, pred)
    hit_g, hit_p = set(), set()
    for c in np.union1d(gc, pc):
        g, p = np.flatnonzero(gc == c), np.flatnonzero((pc == c) & (conf >= 0.25))
        for k, m in enumerate(greedy_masked(iou[np.ix_(g, p)], conf[p])):
            if m >= 0:
                hit_g.add(int(g[m])), hit_p.add(int(p[k]))
    out += [("missed", int(i), -1, 0.0) for i in range(len(gt)) if i not in hit_g]
    for p in range(len(pred)):
        if p not in hit_p and conf[p] >= 0.5:
            top = int(iou[:, p].argmax()) if len(gt) else -1
            x = float(iou[top, p]) if top >= 0 else 0.0
            kind = "confused" if x >= 0.5 and gc[top] != pc[p] else "shifted" if x >= 0.1 else "background"
            out.append((kind, top if x >= 0.1 else -1, p, x))
    return out


def fold(rows: DataFrame, key: str, order: Sequence[str], kernel: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """``kernel`` over the rows of each ``key``, in ``order``; its tuples follow the key in ``schema``.

    Keys are images, whose boxes are few. A null key is a key; whole numbers keep all their digits beside it. An empty table gives an empty result.
    """
    names = rows.columns
    none = F.lit("") if dict(rows.dtypes)[key] == "string" else F.lit(0)
    # A null would turn a column of whole numbers into one of doubles.
    keyed = rows.withColumn("_null", F.col(key).isNull()).withColumn(key, F.coalesce(F.col(key), none.cast(rows.schema[key].dataType)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        columns = [part.strip().split()[0] for part in schema.split(",")]

        def close(frame: pd.DataFrame) -> pd.DataFrame:
            keys, null = frame[key].to_numpy(), frame["_null"].to_numpy()
            arrays = {c: frame[c].to_numpy() for c in names}
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])])
            out = []
            for a, b in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
                k = None if null[a] else keys[a]
                out += [(k, *t) for t in kernel({c: v[a:b] for c, v in arrays.items()})]
            made = pd.DataFrame(out, columns=columns)
            made[columns[0]] = pd.Series([t[0] for t in out], dtype=object)
            return made

        for batch in batches:
            if not len(batch):
                continue
            same = ((batch[key] == batch[key].iloc[-1]) & (batch["_null"] == batch["_null"].iloc[-1])).to_numpy()
            cut = len(batch) - int(same[::-1].argmin() if not same.all() else len(batch))
            if cut:
                yield close(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
                held = []
            held.append(batch.iloc[cut:])
        if held:
            yield close(pd.concat(held, ignore_index=True))

    return keyed.repartition(F.col(key)).sortWithinPartitions("_null", key, *order).mapInPandas(run, schema)
