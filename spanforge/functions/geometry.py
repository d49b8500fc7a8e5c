"""Boxes as column expressions. A box is named by the prefix of its columns cx, cy, w, h.

Every function gives text that Spark and DuckDB read alike; ``col`` makes it a column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(text: str) -> Column:
    return F.expr(text)


def corners(p: str = "") -> dict[str, str]:
    """Corners of a box, not clipped."""
    return {"x1": f"({p}cx - {p}w / 2)", "y1": f"({p}cy - {p}h / 2)", "x2": f"({p}cx + {p}w / 2)", "y2": f"({p}cy + {p}h / 2)"}


def clipped(x1: str, y1: str, x2: str, y2: str) -> dict[str, str]:
    """Centre and size of a box with corners, each clipped to the unit square first."""
    a, b, c, d = (f"least(greatest({v}, 0.0D), 1.0D)" for v in (x1, y1, x2, y2))
    return {"cx": f"(({a} + {c}) / 2)", "cy": f"(({b} + {d}) / 2)", "w": f"greatest({c} - {a}, 0.0D)", "h": f"greatest({d} - {b}, 0.0D)"}


def area(p: str = "") -> str:
    return f"({p}w * {p}h)"


def overlap(a: str, b: str) -> str:
    """Area that two boxes share."""
    p, q = corners(a), corners(b)
    return f"(greatest(least({p['x2']}, {q['x2']}) - greatest({p['x1']}, {q['x1']}), 0) * greatest(least({p['y2']}, {q['y2']}) - greatest({p['y1']}, {q['y1']}), 0))"


def iou(a: str, b: str, rule: str = "plain") -> str:
    """Intersection over union. ``rule`` says how an empty union is met.

    plain: 0; add12 and add9: 1e-12 or 1e-9 is added to the union; clip9: the union is 1e-9 at least.
    """
    inter = overlap(a, b)
    union = f"({area(a)} + {area(b)} - {inter})"
    if rule == "plain":
        return f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0 END)"
    if rule == "clip9":
        return f"({inter} / greatest({union}, 1e-9))"
    return f"({inter} / ({union} + {'1e-12' if rule == 'add12' else '1e-9'}))"


def ioa(a: str, b: str) -> str:
    """Share of box ``a`` that ``b`` covers; 0 for an empty box."""
    return f"(CASE WHEN {area(a)} > 0 THEN {overlap(a, b)} / {area(a)} ELSE 0 END)"


def centre_inside(a: str, b: str) -> str:
    """Whether the centre of ``a`` lies in ``b``, edges included."""
    q = corners(b)
    return f"({a}cx >= {q['x1']} AND {a}cx <= {q['x2']} AND {a}cy >= {q['y1']} AND {a}cy <= {q['y2']})"


def centre_distance(a: str, b: str) -> str:
    """Distance of the centres in diagonals of ``a``."""
    return f"(sqrt(({a}cx - {b}cx) * ({a}cx - {b}cx) + ({a}cy - {b}cy) * ({a}cy - {b}cy)) / greatest(sqrt({a}w * {a}w + {a}h * {a}h), 1e-9))"


def aligned_iou(a: str, b: str) -> str:
    """IoU with the centres laid on each other: of the extents alone."""
    inter = f"(least({a}w, {b}w) * least({a}h, {b}h))"
    return f"({inter} / greatest({area(a)} + {area(b)} - {inter}, 1e-9))"


def letterbox_side(w: str = "w", h: str = "h", width: str = "width", height: str = "height", size: int = 640) -> str:
    """Shorter side in pixels after the image was scaled to ``size``."""
    return f"(least({w} * {width}, {h} * {height}) * {size} / greatest({width}, {height}))"


def size_bin(p: str = "", size: int = 640) -> str:
    """small, medium or large at ``size`` pixels: limits of 32 and 96 pixels squared."""
    a = f"({area(p)} * {size * size})"
    return f"(CASE WHEN {a} < 1024 THEN 'small' WHEN {a} < 9216 THEN 'medium' ELSE 'large' END)"


def scale_bin(p: str = "") -> str:
    a = area(p)
    return f"(CASE WHEN {a} < 0.001 THEN 'tiny' WHEN {a} < 0.005 THEN 'small' WHEN {a} < 0.02 THEN 'medium' ELSE 'large' END)"


def touches_edge(p: str = "", margin: float = 0.002) -> str:
    q = corners(p)
    return f"({q['x1']} <= {margin} OR {q['y1']} <= {margin} OR {q['x2']} >= {1 - margin} OR {q['y2']} >= {1 - margin})"


#: Transforms of a box: none, mirrored in x, in y, in both.
FLIPS = {"none": ("cx", "cy"), "hflip": ("1 - cx", "cy"), "vflip": ("cx", "1 - cy"), "hvflip": ("1 - cx", "1 - cy")}
