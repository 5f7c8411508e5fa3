"""Plane geometry on plain rings, vectorised with numpy: containment, clipped area, boxes, simplification, transverse Mercator.

A polygon is a list of rings of (x, y); the even-odd rule decides what is inside, so holes are further rings.
"""

from __future__ import annotations

import math

import numpy as np

Ring = list[tuple[float, float]]
Polygon = list[Ring]


def _edges(poly: Polygon) -> np.ndarray:
    return np.array([(*a, *b) for ring in poly for a, b in zip(ring, [*ring[1:], ring[0]]) if a != b], dtype=float).reshape(-1, 4)


def contains(poly: Polygon, x, y, boundary: bool = False) -> np.ndarray:
    """Points inside; those on the boundary are not, unless asked for."""
    x, y = np.atleast_1d(np.asarray(x, float)), np.atleast_1d(np.asarray(y, float))
    inside, on = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for x1, y1, x2, y2 in _edges(poly):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        on |= (cross == 0) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))
        if y1 != y2:
            hit = (y1 > y) != (y2 > y)
            inside ^= hit & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return (inside | on) if boundary else (inside & ~on)


def area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]])) / 2


def clip(ring: Ring, box: tuple[float, float, float, float]) -> Ring:
    """The part of a ring in a rectangle, half-plane by half-plane."""
    for axis, bound, keep_above in ((0, box[0], True), (0, box[2], False), (1, box[1], True), (1, box[3], False)):
        out: Ring = []
        for a, b in zip([ring[-1], *ring[:-1]] if ring else [], ring):
            va, vb = (a[axis] - bound, b[axis] - bound) if keep_above else (bound - a[axis], bound - b[axis])
            if (va >= 0) != (vb >= 0):
                t = va / (va - vb)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if vb >= 0:
                out.append(b)
        ring = out
    return ring


def clipped_area(poly: Polygon, box: tuple[float, float, float, float]) -> float:
    """Area of a polygon (outer ring first, holes after it) in a rectangle."""
    parts = [abs(area(clip(ring, box))) for ring in poly]
    return parts[0] - sum(parts[1:]) if parts else 0.0


def _overlap(a: tuple[float, ...], b: tuple[float, ...]) -> bool:
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def union_area(polys: list[Polygon], box: tuple[float, float, float, float]) -> float:
    """Area in a rectangle of what any of the polygons covers, overlaps counted once."""
    cut = ([clip(ring, box) for ring in poly] for poly in polys)
    parts = [p for p in ([r for r in rings if len(r) > 2] for rings in cut) if p]
    boxes = [bounds([p]) for p in parts]
    if not any(_overlap(a, b) for i, a in enumerate(boxes) for b in boxes[:i]):
        return sum(clipped_area(p, box) for p in parts)
    edges = [(i, *e) for i, p in enumerate(parts) for e in _edges(p) if e[1] != e[3]]
    heights = {y for _, _, y1, _, y2 in edges for y in (y1, y2)}
    for k, (_, ax, ay, bx, by) in enumerate(edges):  # where edges cross, slabs end, too
        for _, cx, cy, dx, dy in edges[:k]:
            turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if turn:
                t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / turn, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / turn
                if 0 < t < 1 and 0 < u < 1:
                    heights.add(ay + t * (by - ay))
    total, levels = 0.0, sorted(heights)
    for low, high in zip(levels, levels[1:]):
        middle, at = (low + high) / 2, {}
        for i, ax, ay, bx, by in edges:
            if min(ay, by) <= low and max(ay, by) >= high:
                at.setdefault(i, []).append(ax + (middle - ay) * (bx - ax) / (by - ay))
        spans = sorted(pair for xs in at.values() for pair in zip(*[iter(sorted(xs))] * 2))
        reach = -math.inf
        for x1, x2 in spans:  # edges don't cross within a slab, so widths at its middle are means
            total += max(0.0, x2 - max(x1, reach)) * (high - low)
            reach = max(reach, x2)
    return total


def bounds(polys: list[Polygon]) -> tuple[float, float, float, float]:
    pts = np.array([p for poly in polys for ring in poly for p in ring], dtype=float)
    return (*pts.min(axis=0).tolist(), *pts.max(axis=0).tolist())


def simplify(ring: Ring, tolerance: float) -> Ring:
    """Drop points that are off their neighbours' line by the tolerance at most (farthest-point splitting); four points stay at least."""
    if tolerance <= 0 or len(ring) <= 4:
        return ring
    pts, keep, todo = np.array(ring), {0, len(ring) - 1}, [(0, len(ring) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d = pts[i], pts[j] - pts[i]
        rel, n = pts[i + 1 : j] - a, np.hypot(*d)
        off = np.hypot(*rel.T) if n == 0 else np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / n
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    out = [ring[i] for i in sorted(keep)]
    return out if len(out) >= 4 else ring


def classify_tile(polys: list[Polygon], box: tuple[float, float, float, float], threshold: float) -> tuple[str, float]:
    """inside (all corners within), outside, edge (covered less than the threshold) or partial, and the covered share."""
    x, y = [box[0], box[2], box[2], box[0]], [box[1], box[1], box[3], box[3]]
    corners = np.any([contains(p, x, y) for p in polys], axis=0)
    if corners.all():
        return "inside", 1.0
    share = min(1.0, union_area(polys, box) / ((box[2] - box[0]) * (box[3] - box[1])))
    if share == 0 and not corners.any():
        return "outside", 0.0
    return ("edge", share) if share < threshold else ("partial", share)


def meets(polys: list[Polygon], minx, miny, maxx, maxy) -> np.ndarray:
    """Which rectangles share a point with any of the polygons, borders included."""
    box = [np.atleast_1d(np.asarray(v, float)) for v in (minx, miny, maxx, maxy)]
    found = np.zeros(len(box[0]), bool)
    for poly in polys:
        found |= contains(poly, box[0], box[1], boundary=True)  # a rectangle within the polygon; all others meet an edge
        for x1, y1, x2, y2 in _edges(poly):
            enter, leave = np.zeros(len(found)), np.ones(len(found))
            for start, step, low, high in ((x1, x2 - x1, box[0], box[2]), (y1, y2 - y1, box[1], box[3])):
                if step:
                    a, b = (low - start) / step, (high - start) / step
                    enter, leave = np.maximum(enter, np.minimum(a, b)), np.minimum(leave, np.maximum(a, b))
                else:
                    leave = np.where((low <= start) & (start <= high), leave, -1.0)
            found |= enter <= leave
    return found


# The WGS 84 ellipsoid and the UTM scale on the central meridian.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996


def to_utm(lon, lat, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing by the third-order series in the third flattening (millimetres within a zone)."""
    lon, lat = np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float))
    n = FLATTENING / (2 - FLATTENING)
    a = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(lat)) - e * np.arctanh(e * np.sin(lat)))
    d = lon - math.radians((epsg % 100) * 6 - 183)
    xi, eta = np.arctan2(t, np.cos(d)), np.arctanh(np.sin(d) / np.sqrt(1 + t**2))
    east = 500_000 + UTM_SCALE * a * (eta + sum(k * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, k in enumerate(alpha, 1)))
    north = UTM_SCALE * a * (xi + sum(k * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, k in enumerate(alpha, 1)))
    return east, north + (10_000_000 if 32700 < epsg <= 32760 else 0)


def from_utm(east, north, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude; the inverse of to_utm."""
    n = FLATTENING / (2 - FLATTENING)
    a = UTM_SCALE * SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (np.asarray(north, float) - (10_000_000 if 32700 < epsg <= 32760 else 0)) / a
    eta = (np.asarray(east, float) - 500_000) / a
    x = xi - sum(k * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, k in enumerate(beta, 1))
    y = eta - sum(k * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, k in enumerate(beta, 1))
    chi = np.arcsin(np.sin(x) / np.cosh(y))
    lat = chi + sum(k * np.sin(2 * j * chi) for j, k in enumerate(delta, 1))
    return np.degrees(np.arctan2(np.sinh(y), np.cos(x))) + (epsg % 100) * 6 - 183, np.degrees(lat)


def footprint(box: tuple[float, float, float, float], epsg: int) -> Ring:
    """A rectangle's closed ring in degrees; its plane system is UTM, or degrees already."""
    x, y = [box[0], box[2], box[2], box[0], box[0]], [box[1], box[1], box[3], box[3], box[1]]
    if epsg != 4326:
        x, y = (v.tolist() for v in from_utm(x, y, epsg))
    return [(a, b) for a, b in zip(x, y)]
