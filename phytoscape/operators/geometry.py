"""Planar polygons: WKT rings, ear clipping, bounding-volume hierarchy over triangles.

Signs of orientations are exact: a floating-point filter decides nearly all of
them and rational arithmetic the rest, so no point falls between two triangles.
"""

from __future__ import annotations

import re
from fractions import Fraction

import numpy as np

_FILTER = 4.0 * np.finfo(float).eps
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def orient(ax, ay, bx, by, cx, cy) -> int:
    """Sign of the turn a-b-c: 1 left, -1 right, 0 straight; exact."""
    l, r = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    d = l - r
    if abs(d) > _FILTER * (abs(l) + abs(r)):
        return 1 if d > 0 else -1
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


def orient_many(ax, ay, bx, by, cx, cy) -> np.ndarray:
    """``orient`` for arrays."""
    l, r = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    d = l - r
    s = np.sign(d).astype(np.int8)
    for i in np.flatnonzero(np.abs(d) <= _FILTER * (np.abs(l) + np.abs(r))):
        s[i] = orient(*(float(v[i]) for v in (ax, ay, bx, by, cx, cy)))
    return s


def parse_wkt(text: str | None) -> list[list[list[tuple[float, float]]]]:
    """Parts of a POLYGON or MULTIPOLYGON, each a list of rings (outer first).

    NULL, empty and malformed texts, and rings of fewer than three different
    corners, give no part.
    """
    head = re.match(r"\s*(MULTI)?POLYGON\s*(?:Z\s*)?(?=\()", text or "", re.I)
    if not head:
        return []
    body = text[head.end():].strip()
    if head[1]:
        body = body[1:-1]
    parts, depth, start = [], 0, None
    for i, ch in enumerate(body):
        if ch == "(":
            depth += 1
            if depth == 1:
                start = i
        elif ch == ")":
            depth -= 1
            if depth == 0 and start is not None:
                rings = []
                for ring in re.findall(r"\(([^()]*)\)", body[start + 1:i]):
                    points = []
                    for pair in ring.split(","):
                        n = re.findall(_NUMBER, pair)
                        if len(n) >= 2:
                            p = (float(n[0]), float(n[1]))
                            if not points or p != points[-1]:
                                points.append(p)
                    if len(points) > 1 and points[0] == points[-1]:
                        points.pop()
                    rings.append(points if len(points) >= 3 else [])
                if rings and rings[0]:
                    parts.append([r for r in rings if r])
    return parts


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple]:
    """Triangles of a simple ring as (ax, ay, bx, by, cx, cy, edge flags).

    Bit 0, 1, 2 of the flags tell that a-b, b-c, c-a is an edge of the ring.
    """
    n = len(ring)
    area = sum(ring[i - 1][0] * ring[i][1] - ring[i][0] * ring[i - 1][1] for i in range(n))
    pts = ring if area > 0 else ring[::-1]
    left, out, last, stuck = list(range(n)), [], -1, 0
    joined = lambda i, j: (i + 1) % n == j or (j + 1) % n == i

    def emit(i, j, k):
        a, b, c = pts[i], pts[j], pts[k]
        if orient(*a, *b, *c) > 0:
            out.append((*a, *b, *c, joined(i, j) | joined(j, k) << 1 | joined(k, i) << 2))

    at = 0
    while len(left) > 3:
        m = len(left)
        i, j, k = left[at - 1], left[at % m], left[(at + 1) % m]
        a, b, c = pts[i], pts[j], pts[k]
        turn = orient(*a, *b, *c)
        ear = turn > 0 and not any(
            p not in (a, b, c) and orient(*a, *b, *p) >= 0 and orient(*b, *c, *p) >= 0 and orient(*c, *a, *p) >= 0
            for q in left if q not in (i, j, k) for p in (pts[q],)
        )
        if ear or turn == 0 and stuck >= m or stuck >= 2 * m:  # straight corners, then rings that cross themselves
            emit(i, j, k)
            left.pop(at % m)
            at, stuck = (at - 1) % len(left), 0
        else:
            at, stuck = (at + 1) % m, stuck + 1
    emit(*left)
    return out


def triangulate(text: str | None) -> list[tuple[int, bool, tuple]]:
    """(part, whether of a hole, triangle) for all triangles of a boundary."""
    return [(k, r > 0, t) for k, part in enumerate(parse_wkt(text)) for r, ring in enumerate(part) for t in ear_clip(ring)]


class TriangleTree:
    """Bounding-volume hierarchy over triangles, held in flat arrays.

    tri: (n, 6) corners counter-clockwise; owner: index of the polygon part;
    hole and edge flags per triangle. Nodes are split at the median of the
    longer side of their centres' box until ``leaf`` triangles are left.
    """

    def __init__(self, tri, owner, hole, edges, leaf: int = 8):
        self.tri, self.owner, self.hole, self.edges = (np.asarray(a) for a in (tri, owner, hole, edges))
        self.tri = self.tri.reshape(-1, 6).astype(float)
        xs, ys = self.tri[:, 0::2], self.tri[:, 1::2]
        box = np.stack([xs.min(1), ys.min(1), xs.max(1), ys.max(1)], 1) if len(xs) else np.zeros((0, 4))
        order, nodes, todo = np.arange(len(xs)), [], [(0, len(xs))]
        self.first, self.count, self.child, boxes = [], [], [], []
        while todo:
            lo, hi = todo.pop(0)
            own = order[lo:hi]
            b = box[own]
            boxes.append(np.r_[b[:, :2].min(0), b[:, 2:].max(0)] if hi > lo else np.array([1.0, 1.0, 0.0, 0.0]))
            self.first.append(lo), self.count.append(hi - lo)
            if hi - lo > leaf:
                mid = (b[:, :2] + b[:, 2:]) / 2
                axis = int(np.ptp(mid[:, 1]) > np.ptp(mid[:, 0]))
                half = (hi - lo) // 2
                order[lo:hi] = own[np.argpartition(mid[:, axis], half)]
                self.child.append(len(nodes) + len(todo) + 1)
                todo += [(lo, lo + half), (lo + half, hi)]
            else:
                self.child.append(-1)
            nodes.append(None)
        self.order, self.boxes, self.box = order, np.array(boxes), box

    def hits(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point index, owner) of every part that contains the point, its border included; each once."""
        found, stack = [], [(0, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            b = self.boxes[node]
            px, py = x[at], y[at]
            at = at[(px >= b[0]) & (px <= b[2]) & (py >= b[1]) & (py <= b[3])]
            if not len(at):
                continue
            if self.child[node] >= 0:
                stack += [(self.child[node], at), (self.child[node] + 1, at)]
                continue
            for t in self.order[self.first[node]:self.first[node] + self.count[node]]:
                bx = self.box[t]
                own = at[(x[at] >= bx[0]) & (x[at] <= bx[2]) & (y[at] >= bx[1]) & (y[at] <= bx[3])]
                if not len(own):
                    continue
                px, py = x[own], y[own]
                a = [np.full(len(own), v) for v in self.tri[t]]
                s = [orient_many(a[2 * i], a[2 * i + 1], a[(2 * i + 2) % 6], a[(2 * i + 3) % 6], px, py) for i in range(3)]
                inside = (s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)
                rim = np.zeros(len(own), bool)
                for i in range(3):
                    rim |= (s[i] == 0) & bool(self.edges[t] >> i & 1)
                if self.hole[t]:  # a hole's border belongs to the part
                    inside &= ~rim
                if inside.any():
                    found.append((own[inside], np.full(int(inside.sum()), self.owner[t] * 2 + int(self.hole[t]))))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        p, o = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        code = np.unique(p.astype(np.int64) * (2 * (int(self.owner.max()) + 1)) + o)
        p, o = np.divmod(code, 2 * (int(self.owner.max()) + 1))
        holes = set(zip(p[o % 2 == 1].tolist(), (o[o % 2 == 1] // 2).tolist()))
        p, o = p[o % 2 == 0], o[o % 2 == 0] // 2
        if holes:
            keep = np.array([(i, j) not in holes for i, j in zip(p.tolist(), o.tolist())], bool)
            p, o = p[keep], o[keep]
        return p, o
