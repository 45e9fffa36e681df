"""Plane geometry of pages: convex regions, and areas of polygons inside clips."""

from __future__ import annotations

import numpy as np

#: Steps into which a curve of a clip is cut.
CURVE_STEPS = 8


def convex(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of a region in order around its middle, so that any order of a quadrilateral's corners will do."""
    p = np.array(points, float)
    away = p - p.mean(axis=0)
    return [tuple(map(float, q)) for q in p[np.argsort(np.arctan2(away[:, 1], away[:, 0]), kind="stable")]]


def inside_convex(region: np.ndarray, points: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Which of ``points`` (n, 2) lie in a convex region (corners in turn), or at most ``slack`` (n) outside each of its edges.

    The cross product of an edge with the way to a point has the sign of its side; over the edge's length it is the distance."""
    edge = np.roll(region, -1, axis=0) - region
    long = np.hypot(edge[:, 0], edge[:, 1])
    edge, corner, long = edge[long > 0], region[long > 0], long[long > 0]
    if not len(edge):
        return np.zeros(len(points), bool)
    away = points[:, None, :] - corner
    cross = (edge[:, 0] * away[..., 1] - edge[:, 1] * away[..., 0]) / long
    turn = np.sign((region[:, 0] * np.roll(region[:, 1], -1) - np.roll(region[:, 0], -1) * region[:, 1]).sum()) or 1.0
    return (turn * cross >= -slack[:, None]).all(axis=1)


def flattened(path: list[list]) -> list[list[tuple[float, float]]]:
    """The polygons of a path of (operator, points): curves as ``CURVE_STEPS`` straight pieces, open ends closed."""
    t = (np.arange(1, CURVE_STEPS + 1) / CURVE_STEPS)[:, None]
    out = []
    for part in path:
        corners: list[tuple[float, float]] = []
        for kind, p in part:
            if kind == "C" and corners:
                a, (b, c, d) = np.array(corners[-1]), map(np.array, p[-3:])
                corners += map(tuple, ((1 - t) ** 3 * a + 3 * (1 - t) ** 2 * t * b + 3 * (1 - t) * t**2 * c + t**3 * d).tolist())
            elif kind != "Z":
                corners.append(p[-1])
        out.append(corners)
    return out


def _edges(shape: list[list[tuple[float, float]]]) -> np.ndarray:
    """x0, y0, x1, y1 of each edge of a shape's polygons."""
    rows = [(*a, *b) for p in shape for a, b in zip(p, [*p[1:], *p[:1]], strict=True)]
    return np.array(rows, float).reshape(-1, 4)


def _crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which two edges cross."""
    d = e[:, 2:] - e[:, :2]
    det = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    away = e[None, :, :2] - e[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (away[..., 0] * d[None, :, 1] - away[..., 1] * d[None, :, 0]) / det
        t = (away[..., 0] * d[:, None, 1] - away[..., 1] * d[:, None, 0]) / det
    i, j = np.nonzero((det != 0) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1))
    return e[i, 1] + s[i, j] * d[i, 1]


def common_area(shapes: list[tuple[list[list[tuple[float, float]]], bool]]) -> float:
    """The area that all shapes (polygons, whether even-odd) have in common.

    Between two neighbouring heights of corners and crossings every border is straight and none cross, so a strip's
    area is its height times the common width in its middle."""
    edges = [_edges(s) for s, _ in shapes]
    if any(not len(e) for e in edges):
        return 0.0
    every = np.concatenate(edges)
    heights = np.unique(np.concatenate([every[:, 1], every[:, 3], _crossings(every)]))
    area = 0.0
    for low, high in zip(heights[:-1].tolist(), heights[1:].tolist(), strict=True):
        y = (low + high) / 2
        marks: list[tuple[float, int, int]] = []  # where, which shape, by how much its winding changes
        for k, e in enumerate(edges):
            e = e[(np.minimum(e[:, 1], e[:, 3]) < y) & (np.maximum(e[:, 1], e[:, 3]) > y)]
            x = e[:, 0] + (y - e[:, 1]) / (e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0])
            marks += zip(x.tolist(), [k] * len(x), np.where(e[:, 3] > e[:, 1], 1, -1).tolist(), strict=True)
        wind, width, before = [0] * len(shapes), 0.0, 0.0
        for x, k, turn in sorted(marks):
            if all(w & 1 if odd else w for w, (_, odd) in zip(wind, shapes, strict=True)):
                width += x - before
            wind[k] += turn
            before = x
        area += width * (high - low)
    return area
