"""Signature trees over sets, and links found by traversing two of them together.

A node holds the OR of its sets' bitmaps, the range of their sizes, and the most elements that a set has beyond its
bits.  No two sets below two nodes share more elements than the bits both nodes have plus those extra ones; a pair of
nodes for which that is too little, or whose sizes differ too much, is dropped with all below it.  So is a pair whose
sets are all connected already: only what connects is wanted, not every link.
"""

from __future__ import annotations

import numpy as np

LEAF, FANOUT = 32, 8


def may_link(overlap, n, m):
    """100 * overlap >= 80 * union, as whole numbers."""
    return 9 * overlap >= 4 * (n + m)


class Node:
    __slots__ = ("at", "bits", "children", "extra", "most", "least")

    def __init__(self, at: np.ndarray, bits: np.ndarray, n: np.ndarray, own: np.ndarray, children: list[Node]):
        self.at, self.children = at, children
        self.bits = np.bitwise_or.reduce(bits, axis=0)
        self.least, self.most = int(n.min()), int(n.max())
        self.extra = int((n - own).max())


class Forest:
    """Sets of one group: sizes, bitmaps (64-bit words), and if links have to be verified, the sets in ascending order."""

    def __init__(self, n: np.ndarray, bitmaps: list[np.ndarray], sets: list[np.ndarray] | None = None, labels: np.ndarray | None = None):
        self.n, self.sets = n.astype(np.int64), sets
        self.label = np.arange(len(n)) if labels is None else np.unique(labels, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []
        self.lengths = np.array([len(b) for b in bitmaps])
        self.maps = {int(w): np.zeros((len(n), int(w)), np.uint64) for w in np.unique(self.lengths)}
        for i, b in enumerate(bitmaps):
            self.maps[len(b)][i] = b
        for w in sorted(self.maps):  # and folded onto half, for sets of the next smaller length
            if w // 2 in self.maps:
                some = np.flatnonzero(self.lengths == w)
                self.maps[w // 2][some] = self.maps[w][some][:, :w // 2] | self.maps[w][some][:, w // 2:]

    def tree(self, at: np.ndarray, width: int) -> Node:
        maps = self.maps[width]
        at = at[np.lexsort(maps[at].T[::-1][-4:])]  # alike sets beside each other
        own = np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        level = [Node(x, maps[x], self.n[x], own[x], []) for x in np.split(at, range(LEAF, len(at), LEAF))]
        while len(level) > 1:
            groups = [level[i:i + FANOUT] for i in range(0, len(level), FANOUT)]
            level = [Node(x := np.concatenate([c.at for c in g]), maps[x], self.n[x], own[x], g) for g in groups]
        return level[0]

    def connect(self, i: int, j: int) -> None:
        if self.sets is not None:
            a, b = self.sets[i], self.sets[j]
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            if not may_link(int((b[at] == a).sum()), len(a), len(b)):
                return
        self.links.append((i, j))
        self.label[self.label == self.label[j]] = self.label[i]

    def join(self, x: Node, y: Node, width: int) -> None:
        if 5 * x.most < 4 * y.least or 5 * y.most < 4 * x.least:
            return
        shared = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.extra, y.extra)
        if not may_link(min(shared, x.most, y.most), x.least, y.least):
            return
        a, b = self.label[x.at], self.label[y.at]
        if a[0] == b[0] and (a == a[0]).all() and (b == b[0]).all():
            return
        if x is y and x.children:
            for i, c in enumerate(x.children):
                self.join(c, c, width)
                for d in x.children[:i]:
                    self.join(d, c, width)
        elif not x.children and not y.children:
            self.compare(x.at, y.at, width)
        elif len(x.at) >= len(y.at) and x.children:
            for c in x.children:
                self.join(c, y, width)
        else:
            for c in y.children:
                self.join(x, c, width)

    def compare(self, xs: np.ndarray, ys: np.ndarray, width: int) -> None:
        a, b = self.maps[width][xs][:, None, :], self.maps[width][ys][None, :, :]
        n, m = self.n[xs][:, None], self.n[ys][None, :]
        most = np.minimum(n - np.bitwise_count(a & ~b).sum(axis=2), m - np.bitwise_count(b & ~a).sum(axis=2))
        near = may_link(np.minimum(most, np.minimum(n, m)), n, m) & (self.label[xs][:, None] != self.label[ys][None, :])
        for i, j in zip(*(p.tolist() for p in np.nonzero(near)), strict=True):
            if self.label[xs[i]] != self.label[ys[j]]:
                self.connect(int(xs[i]), int(ys[j]))

    def link(self, xs: np.ndarray | None = None, ys: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that connect what is connected: of all pairs, or of those between ``xs`` and ``ys``."""
        every = np.arange(len(self.n))
        xs, ys = (every, every) if xs is None else (xs, ys)
        same = xs is ys
        for w in sorted(self.maps):
            for u, v in ((w, w), (w, 2 * w), (2 * w, w)):
                if (same and u > v) or not {u, v} <= set(self.maps):
                    continue
                x, y = xs[self.lengths[xs] == u], ys[self.lengths[ys] == v]
                if not len(x) or not len(y):
                    continue
                if len(x) <= LEAF and len(y) <= LEAF:
                    self.compare(x, y, w)
                else:
                    left = self.tree(x, w)
                    self.join(left, left if same and u == v else self.tree(y, w), w)
        return self.links
