"""Outlines of what a boundary leaves of each cell: parts with their holes, overlaps united.

Ring pieces of one cell are cut at each other's corners and crossings.  Of the short
edges, those stay that have covered ground on one side only, where covered means a
winding number above zero.  They are chained into closed rings, each corner taken at
its sharpest left turn, so that parts that touch in a corner are parts of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Coordinates nearer than this, in the boundary's unit, are one; corners that bend less are none.
TOLERANCE = 1e-6

RING_TYPE = "array<struct<x: double, y: double>>"
PARTS_SCHEMA = f"i long, j long, part int, rings array<{RING_TYPE}>, area double, mx double, my double"


def signed_area(ring: np.ndarray) -> float:
    """Of a closed ring: positive if it runs counter-clockwise."""
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2


def _snapped(values: np.ndarray) -> np.ndarray:
    """Values that follow each other within the tolerance, made equal."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.append(True, np.diff(ordered) > TOLERANCE)
    out = np.empty_like(values)
    out[order] = ordered[new][np.cumsum(new) - 1]
    return out


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Points where edges a[i]-b[i] cross each other inside both."""
    points = []
    low, high = np.minimum(a, b), np.maximum(a, b)
    for k in range(len(a) - 1):
        near = np.flatnonzero(((low[k + 1 :] <= high[k] + TOLERANCE) & (high[k + 1 :] >= low[k] - TOLERANCE)).all(axis=1)) + k + 1
        if not len(near):
            continue
        d, e, f = b[k] - a[k], b[near] - a[near], a[near] - a[k]
        cross = d[0] * e[:, 1] - d[1] * e[:, 0]
        steep = np.abs(cross) > 1e-12 * np.hypot(*d) * np.hypot(e[:, 0], e[:, 1])
        cross = np.where(steep, cross, 1.0)
        t = (f[:, 0] * e[:, 1] - f[:, 1] * e[:, 0]) / cross
        s = (f[:, 0] * d[1] - f[:, 1] * d[0]) / cross
        inside = steep & (t > 0) & (t < 1) & (s > 0) & (s < 1)
        points.append(a[k] + t[inside, None] * d)
    return np.concatenate(points) if points else np.zeros((0, 2))


def _pieces(a: np.ndarray, b: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges a[i]-b[i], cut at all points that lie on them."""
    heads, tails = [], []
    for p, q in zip(a, b, strict=True):
        d = q - p
        size = float(np.hypot(*d))
        f = points - p
        along = (f @ d) / size
        near = (np.abs(f[:, 0] * d[1] - f[:, 1] * d[0]) <= 2 * TOLERANCE * size) & (along > 0) & (along < size)
        on = points[near][np.argsort(along[near], kind="stable")]
        chain = np.concatenate([[p], on, [q]])
        heads.append(chain[:-1])
        tails.append(chain[1:])
    heads, tails = np.concatenate(heads), np.concatenate(tails)
    real = (heads != tails).any(axis=1)
    return heads[real], tails[real]


def _covered_sides(a: np.ndarray, b: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winding numbers left and right of each edge a-b, which counts ``net`` times from a to b.

    A steep edge looks east from its middle, a flat one north, and counts what it meets.
    """
    left, right = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
    d = b - a
    for k in range(len(a)):
        along = 1 if abs(d[k, 1]) >= abs(d[k, 0]) else 0
        across = 1 - along
        middle = (a[k] + b[k]) / 2
        meets = (a[:, along] > middle[along]) != (b[:, along] > middle[along])
        meets[k] = False
        at = np.flatnonzero(meets)
        where = a[at, across] + (middle[along] - a[at, along]) / d[at, along] * d[at, across]
        beyond = at[where > middle[across]]
        # To the east, edges going up enclose; to the north, edges going west do.
        turn = np.sign(d[beyond, along]).astype(np.int64) * (1 if along else -1)
        far = int((turn * net[beyond]).sum())
        own = int(np.sign(d[k, along])) * (1 if along else -1)
        if own > 0:
            right[k], left[k] = far, far + net[k]
        else:
            left[k], right[k] = far, far - net[k]
    return left, right


def _simple(ring: np.ndarray) -> np.ndarray:
    """The closed ring without corners on straight lines, from its least corner on."""
    open_ring = ring[:-1]
    while len(open_ring) > 3:
        d = open_ring - np.roll(open_ring, 1, axis=0)
        e = np.roll(open_ring, -1, axis=0) - open_ring
        bend = np.abs(d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]) > TOLERANCE * np.hypot(d[:, 0] + e[:, 0], d[:, 1] + e[:, 1])
        if bend.all():
            break
        open_ring = open_ring[bend]
    first = np.lexsort((open_ring[:, 1], open_ring[:, 0]))[0] if len(open_ring) else 0
    open_ring = np.roll(open_ring, -first, axis=0)
    return np.concatenate([open_ring, open_ring[:1]])


def _loops(points: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> list[np.ndarray]:
    """Closed rings made of the directed edges heads[i]-tails[i] (numbers of ``points``)."""
    d = points[tails] - points[heads]
    angle = np.arctan2(d[:, 1], d[:, 0])
    leaving: dict[int, list[int]] = {}
    for e, h in enumerate(heads.tolist()):
        leaving.setdefault(h, []).append(e)
    used = np.zeros(len(heads), dtype=bool)
    loops = []
    for start in range(len(heads)):
        if used[start]:
            continue
        walk, place, e = [int(heads[start])], {int(heads[start]): 0}, start
        while True:
            used[e] = True
            at = int(tails[e])
            if at in place:
                # The walk is back at a corner: what lies between is a ring of its own.
                begin = place[at]
                loops.append(points[[*walk[begin:], at]])
                for gone in walk[begin + 1 :]:
                    del place[gone]
                walk = walk[: begin + 1]
            else:
                place[at] = len(walk)
                walk.append(at)
            free = [x for x in leaving.get(at, ()) if not used[x]]
            if not free:
                break
            back = angle[e] + np.pi
            # Clockwise from where the walk came from, the first edge that leaves.
            e = min(free, key=lambda x: (back - angle[x]) % (2 * np.pi) or 2 * np.pi)
    return loops


def _encloses(ring: np.ndarray, point: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]
    meets = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    a, b = a[meets], b[meets]
    return bool((a[:, 0] + (point[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]) > point[0]).sum() % 2)


def united_parts(rings: list[np.ndarray], holes: list[bool]) -> list[list[np.ndarray]]:
    """Disjoint parts of the ground that closed rings cover, each as its outer ring (counter-clockwise) and its holes (clockwise).

    Rings may overlap, touch, repeat each other or run along themselves; a hole takes
    one cover away.  Parts are sorted by their least corner, and so are holes.
    """
    turned = [r if (signed_area(r) < 0) == h else r[::-1] for r, h in zip(rings, holes, strict=True) if len(r) > 3]
    if not turned:
        return []
    a, b = np.concatenate([r[:-1] for r in turned]), np.concatenate([r[1:] for r in turned])
    origin = a.min(axis=0)
    a, b = a - origin, b - origin

    def aligned(points: np.ndarray) -> np.ndarray:
        return np.stack([_snapped(points[:, 0]), _snapped(points[:, 1])], axis=1)

    found = _crossings(a, b)
    points = aligned(np.concatenate([a, b, found]))
    a, b = points[: len(a)], points[len(a) : 2 * len(a)]
    real = (a != b).any(axis=1)
    if not real.any():
        return []
    corners = np.unique(points, axis=0)
    a, b = _pieces(a[real], b[real], corners)
    if not len(a):
        return []

    # Edges that lie on each other are one, counted with their directions.
    corners, number = np.unique(np.concatenate([a, b]), axis=0, return_inverse=True)
    head, tail = number.ravel()[: len(a)], number.ravel()[len(a) :]
    forward = head < tail
    pair, which = np.unique(np.stack([np.minimum(head, tail), np.maximum(head, tail)], axis=1), axis=0, return_inverse=True)
    net = np.zeros(len(pair), dtype=np.int64)
    np.add.at(net, which.ravel(), np.where(forward, 1, -1))
    pair, net = pair[net != 0], net[net != 0]
    if not len(pair):
        return []
    left, right = _covered_sides(corners[pair[:, 0]], corners[pair[:, 1]], net)
    edge = (left > 0) != (right > 0)
    along = left[edge] > 0
    pair = pair[edge]
    heads, tails = np.where(along, pair[:, 0], pair[:, 1]), np.where(along, pair[:, 1], pair[:, 0])

    outer, inner = [], []
    for loop in _loops(corners, heads, tails):
        ring = _simple(loop)
        area = signed_area(ring) if len(ring) > 3 else 0.0
        if abs(area) > TOLERANCE:
            (outer if area > 0 else inner).append(ring)
    outer.sort(key=lambda r: (r[0].tolist(), signed_area(r)))
    parts = [[ring] for ring in outer]
    for ring in sorted(inner, key=lambda r: r[0].tolist()):
        middle = (ring[0] + ring[1]) / 2
        around = [k for k, part in enumerate(parts) if _encloses(part[0], middle)]
        if around:
            parts[min(around, key=lambda k: signed_area(parts[k][0]))].append(ring)
    return [[ring + origin for ring in part] for part in parts]


def part_moments(part: list[np.ndarray]) -> tuple[float, float, float]:
    """Area and first moments of an outer ring less its holes."""
    area = mx = my = 0.0
    for ring in part:
        first = ring[0]
        x, y = (ring - first).T
        cross = x[:-1] * y[1:] - x[1:] * y[:-1]
        size = float(cross.sum()) / 2
        area += size
        mx += float((cross * (x[:-1] + x[1:])).sum()) / 6 + size * float(first[0])
        my += float((cross * (y[:-1] + y[1:])).sum()) / 6 + size * float(first[1])
    return area, mx, my


_ARROW_RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_ARROW_PARTS = pa.schema(
    [("i", pa.int64()), ("j", pa.int64()), ("part", pa.int32()), ("rings", pa.list_(_ARROW_RING)), ("area", pa.float64()), ("mx", pa.float64()), ("my", pa.float64())]
)


def cells_to_parts(batches):
    """(i, j, pieces) rows into one row per part; ``pieces`` are (hole, ring) of one cell."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _ARROW_PARTS}
        for i, j, pieces in zip(*(batch.column(n).to_pylist() for n in ("i", "j", "pieces")), strict=True):
            rings = [np.array([(v["x"], v["y"]) for v in p["ring"]], dtype=np.float64).reshape(-1, 2) for p in pieces]
            for number, part in enumerate(united_parts(rings, [p["hole"] for p in pieces])):
                row = (i, j, number, [[{"x": x, "y": y} for x, y in ring.tolist()] for ring in part], *part_moments(part))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=_ARROW_PARTS)
