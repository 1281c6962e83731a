"""Pairs of points with no third one inside the circle over them (Gabriel edges), a tile of the plane at a time, in numpy.

A point c hides from a all that lies beyond the line through c across the way
from a to c. So from each point the search goes outwards in rings over a quadtree;
the nearest point in each of 16 directions hides whole cells, and the search of a
point ends once it is hidden all around or at the longest edge. What is left over,
a few pairs a point, is tested exactly. Neither step goes through all pairs.
"""

from __future__ import annotations

import numpy as np

#: Points in a leaf at most (but at the last depth), bits of a coordinate in the quadtree, directions, points searched from at once.
LEAF, BITS, SECTORS, CHUNK = 8, 24, 16, 4096
#: Squares are compared after rounding to 12 digits; a difference beyond this survives it.
SURE = 2e-12


def rounded(squares: np.ndarray) -> np.ndarray:
    """Squares in units of 1e-12, halves away from zero."""
    return np.floor(squares * 1e12 + 0.5)


def _spread(v: np.ndarray) -> np.ndarray:
    """Bits of v, one place apart."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | v << np.uint64(shift)) & np.uint64(mask)
    return v


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (n[0] of them), lo[1], ..."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Tree:
    """A quadtree over distinct points: ``order`` sorts them, a node has the points lo .. hi, a tight box, and kids from ``kid`` on (none in a leaf)."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        side = max(float(np.ptp(x)), float(np.ptp(y)), 1e-300)
        grid = lambda v: np.minimum((v - v.min()) / side * (1 << BITS), (1 << BITS) - 1).astype(np.uint64)
        code = _spread(grid(x)) | _spread(grid(y)) << np.uint64(1)
        self.order = np.argsort(code, kind="stable")
        code, self.x, self.y = code[self.order], x[self.order], y[self.order]
        self.leaf_side = np.empty(len(x))  # of each point's leaf
        lo, hi = np.array([0]), np.array([len(x)])
        los, his, kids, counts, total = [lo], [hi], [], [], 1
        for depth in range(BITS + 1):
            split = (hi - lo > LEAF) & (depth < BITS)
            leaf = ~split
            self.leaf_side[_ranges(lo[leaf], (hi - lo)[leaf])] = side / (1 << depth)
            n = np.zeros(len(lo), np.int64)
            if split.any():
                shift = np.uint64(2 * (BITS - depth - 1))
                first = (code[lo[split]] >> (shift + np.uint64(2))) << np.uint64(2)
                at = [np.searchsorted(code, (first + np.uint64(k)) << shift) for k in range(1, 4)]
                edge = np.stack([lo[split], *at, hi[split]], axis=1)
                used = edge[:, 1:] > edge[:, :-1]
                n[split] = used.sum(axis=1)
                lo, hi = edge[:, :-1][used], edge[:, 1:][used]
            kids.append(total + np.cumsum(n) - n)
            counts.append(n)
            if not n.any():
                break
            total += len(lo)
            los.append(lo)
            his.append(hi)
        self.lo, self.hi, self.kid, self.kids = (np.concatenate(v) for v in (los, his, kids, counts))
        ends = [np.stack([a, b], axis=1).ravel() for a, b in zip(los, his, strict=True)]
        box = lambda f, v: np.concatenate([f.reduceat(np.append(v, v[-1]), e)[::2] for e in ends])
        self.x0, self.x1, self.y0, self.y1 = box(np.minimum, self.x), box(np.maximum, self.x), box(np.minimum, self.y), box(np.maximum, self.y)

    def down(self, who: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of (who, node) one step down: (who, point) of the leaves, (who, kid) of the others."""
        leaf = self.kids[node] == 0
        a, b = node[leaf], node[~leaf]
        n = self.hi[a] - self.lo[a]
        return np.repeat(who[leaf], n), _ranges(self.lo[a], n), np.repeat(who[~leaf], self.kids[b]), _ranges(self.kid[b], self.kids[b])


class _Stars:
    """What some points of a tree see: places of the nearest found so far in each direction (0, 0: none)."""

    def __init__(self, tree: Tree, own: np.ndarray):
        self.tree, self.own, self.px, self.py = tree, own, tree.x[own], tree.y[own]
        self.cx, self.cy = np.zeros((len(own), SECTORS)), np.zeros((len(own), SECTORS))
        self.cd = np.full((len(own), SECTORS), np.inf)
        who = np.arange(len(own))
        for step in (*range(-LEAF, 0), *range(1, LEAF + 1)):  # neighbours in the tree's order, to begin with
            at = own + step
            ok = (at >= 0) & (at < len(tree.x))
            self.learn(who[ok], tree.x[at[ok]] - self.px[ok], tree.y[at[ok]] - self.py[ok])

    def learn(self, who: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> None:
        d = dx * dx + dy * dy
        sector = ((np.arctan2(dy, dx) + np.pi) * (SECTORS / (2 * np.pi))).astype(np.int64) % SECTORS
        place = who * SECTORS + sector
        near = d < self.cd.ravel()[place]
        who, dx, dy, d, place = who[near], dx[near], dy[near], d[near], place[near]
        by = np.lexsort((d, place))
        by = by[np.unique(place[by], return_index=True)[1]]
        self.cx.ravel()[place[by]], self.cy.ravel()[place[by]], self.cd.ravel()[place[by]] = dx[by], dy[by], d[by]

    def hidden(self, who: np.ndarray, dx: np.ndarray, dy: np.ndarray, hx: np.ndarray | float = 0.0, hy: np.ndarray | float = 0.0) -> np.ndarray:
        """Whether all of the box around (dx, dy) from the point, half hx by hy wide, is surely hidden by one known point."""
        out = np.zeros(len(who), bool)
        for s in range(SECTORS):
            cx, cy = self.cx[who, s], self.cy[who, s]
            least = dx * cx + dy * cy - hx * np.abs(cx) - hy * np.abs(cy)
            out |= 2 * (least - cx * cx - cy * cy) > SURE
        return out

    def closed(self, who: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Whether all beyond r is hidden: each direction has a point near enough."""
        d = np.sqrt(self.cd[who])
        return (d + SURE / d < (r * np.cos(2 * np.pi / SECTORS) * (1 - 1e-9))[:, None]).all(axis=1)

    def seen(self, longest: float) -> tuple[np.ndarray, np.ndarray]:
        """(who, point) of all that may be free, in rings of doubling width around each point."""
        t, found = self.tree, []
        r = np.minimum(t.leaf_side[self.own], longest)
        before = np.zeros(len(r))
        act = np.arange(len(r))
        while len(act):
            who, node = act, np.zeros(len(act), np.int64)
            far, past = r * r * (1 + 1e-9), before * before * (1 - 1e-9)
            while len(who):
                px, py = self.px[who], self.py[who]
                ax, bx, ay, by = t.x0[node] - px, t.x1[node] - px, t.y0[node] - py, t.y1[node] - py
                gx, gy = np.maximum(0, np.maximum(ax, -bx)), np.maximum(0, np.maximum(ay, -by))
                fx, fy = np.maximum(-ax, bx), np.maximum(-ay, by)
                on = (gx * gx + gy * gy <= far[who]) & (fx * fx + fy * fy >= past[who])
                who, node, ax, bx, ay, by = who[on], node[on], ax[on], bx[on], ay[on], by[on]
                on = ~self.hidden(who, (ax + bx) / 2, (ay + by) / 2, (bx - ax) / 2, (by - ay) / 2)
                w, p, who, node = t.down(who[on], node[on])
                dx, dy = t.x[p] - self.px[w], t.y[p] - self.py[w]
                d = np.sqrt(dx * dx + dy * dy)
                on = (p != self.own[w]) & (d <= r[w]) & ((d > before[w]) | (before[w] == 0))
                w, p, dx, dy = w[on], p[on], dx[on], dy[on]
                on = ~self.hidden(w, dx, dy)
                w, p, dx, dy = w[on], p[on], dx[on], dy[on]
                self.learn(w, dx, dy)
                found.append((w, p))
            act = act[(r[act] < longest) & ~self.closed(act, r[act])]
            before = r.copy()
            r = np.minimum(r * 2, longest)
        who, p = (np.concatenate(v) for v in zip(*found, strict=True))
        on = ~self.hidden(who, t.x[p] - self.px[who], t.y[p] - self.py[who])
        return who[on], p[on]


def free(tree: Tree, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether no third point c has round(|ac|^2 + |bc|^2, 12) < round(|ab|^2, 12); exactly."""
    ax, ay, bx, by = tree.x[a], tree.y[a], tree.x[b], tree.y[b]
    mx, my, ww = (bx - ax) / 2, (by - ay) / 2, (ax - bx) ** 2 + (ay - by) ** 2  # the middle, seen from a
    least, quarter = rounded(ww), ww / 4
    out = np.ones(len(a), bool)
    who, node = np.arange(len(a)), np.zeros(len(a), np.int64)
    while len(who):
        px, py = ax[who], ay[who]
        x0, x1, y0, y1 = tree.x0[node] - px - mx[who], tree.x1[node] - px - mx[who], tree.y0[node] - py - my[who], tree.y1[node] - py - my[who]
        gx, gy = np.maximum(0, np.maximum(x0, -x1)), np.maximum(0, np.maximum(y0, -y1))
        fx, fy = np.maximum(-x0, x1), np.maximum(-y0, y1)
        out[who[2 * (fx * fx + fy * fy - quarter[who]) < -SURE]] = False  # wholly inside; neither end is
        on = out[who] & (gx * gx + gy * gy <= quarter[who] * (1 + 1e-9) + 1e-15)
        w, c, who, node = tree.down(who[on], node[on])
        cx, cy = tree.x[c], tree.y[c]
        both = (ax[w] - cx) ** 2 + (ay[w] - cy) ** 2 + (bx[w] - cx) ** 2 + (by[w] - cy) ** 2
        out[w[(c != a[w]) & (c != b[w]) & (rounded(both) < least[w])]] = False
    return out


def edges(x: np.ndarray, y: np.ndarray, own: np.ndarray, first: np.ndarray, last: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w) of the free pairs with a among ``own`` (boolean) and first[a] < last[b], at most ``longest`` apart; the points are distinct."""
    tree, out = Tree(x, y), []
    mine = np.flatnonzero(own[tree.order])
    first, last = first[tree.order], last[tree.order]
    for at in range(0, len(mine), CHUNK):
        part = mine[at : at + CHUNK]
        who, b = _Stars(tree, part).seen(longest)
        a = part[who]
        w = np.sqrt((tree.x[a] - tree.x[b]) ** 2 + (tree.y[a] - tree.y[b]) ** 2)
        on = (first[a] < last[b]) & (w <= longest)
        a, b, w = a[on], b[on], w[on]
        on = free(tree, a, b)
        out.append((tree.order[a[on]], tree.order[b[on]], w[on]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))
