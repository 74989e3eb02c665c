"""Exact Jaccard links among token sets, by dual traversal of a signature tree.

A node holds the OR of its sets' token bitmaps, its range of set sizes, and the most tokens of one set that its bits do not
show. Of a pair of nodes no two sets can share more tokens than the common bits and that slack allow; pairs that cannot
reach the threshold are pruned, level by level, with arrays of node pairs."""

from __future__ import annotations

import numpy as np

_FAN, _BLOCK = 16, 1 << 22


class _Level:
    def __init__(self, bits: np.ndarray, low: np.ndarray, high: np.ndarray, slack: np.ndarray):
        self.bits, self.low, self.high, self.slack = bits, low, high, slack

    def above(self) -> _Level:
        at = np.arange(0, len(self.low), _FAN)
        return _Level(np.bitwise_or.reduceat(self.bits, at), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.slack, at))

    def possible(self, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether two sets below nodes a and b may have num/den of their union in common."""
        keep = np.flatnonzero((den * self.high[a] >= num * self.low[b]) & (den * self.high[b] >= num * self.low[a]))
        step = max(1, _BLOCK // (self.bits.shape[1] * 8))
        found = np.zeros(len(a), bool)
        for at in range(0, len(keep), step):
            k = keep[at : at + step]
            x, y = a[k], b[k]
            common = np.bitwise_count(self.bits[x] & self.bits[y]).sum(axis=1, dtype=np.int64)
            most = common + np.minimum(self.slack[x], self.slack[y])
            found[k] = (num + den) * np.minimum(most, np.minimum(self.high[x], self.high[y])) >= num * (self.low[x] + self.low[y])
        return found


class Links:
    """Union-find over positions; ``pairs`` are the verified links that joined two components."""

    def __init__(self, n: int):
        self.parent, self.pairs = list(range(n)), []

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def roots(self) -> np.ndarray:
        p = np.array(self.parent)
        while (q := p[p]).tolist() != p.tolist():
            p = q
        return p

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.pairs.append((x, y))


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if den * len(a) < num * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return den * shared >= num * (len(a) + len(b) - shared)


def link(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links between sorted token sets that join all that are connected: pairs of positions."""
    n = len(sets)
    links = Links(n)
    if n <= 3:
        for i in range(n):
            for j in range(i):
                if links.root(i) != links.root(j) and similar(sets[i], sets[j], num, den):
                    links.join(i, j)
        return links.pairs
    order = sorted(range(n), key=lambda i: (len(sets[i]), sets[i][:1].tolist()))
    own = [sets[i] for i in order]
    size = np.array([len(s) for s in own], np.int64)
    width = 1 << int(np.clip(np.ceil(np.log2(size.max() * 8 + 1)), 9, 17))
    words = width // 64
    bits = np.zeros((n, words), np.uint64)
    doc, tokens = np.repeat(np.arange(n), size), np.concatenate(own)
    spot = (tokens >> np.uint64(20)) & np.uint64(width - 1)
    np.bitwise_or.at(bits.reshape(-1), doc * words + (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
    levels = [_Level(bits, size, size, size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))]
    while len(levels[-1].low) > _FAN:
        levels.append(levels[-1].above())
    top = len(levels[-1].low)
    a, b = np.triu_indices(top)
    for depth in range(len(levels) - 1, 0, -1):
        ok = levels[depth].possible(a, b, num, den)
        a, b = a[ok], b[ok]
        if depth > 1:
            a, b = _children(a, b, len(levels[depth - 1].low))
    # pairs of lowest nodes, in parts; what is connected already is not compared again
    step = 64
    near = np.argsort(b - a, kind="stable")
    a, b = a[near], b[near]
    for at in range(0, len(a), step) if len(levels) > 1 else [0]:
        x, y = _children(a[at : at + step], b[at : at + step], n) if len(levels) > 1 else (a, b)
        apart = x < y
        r = links.roots()
        apart &= r[x] != r[y]
        x, y = x[apart], y[apart]
        if not len(x):
            continue
        ok = levels[0].possible(x, y, num, den)
        for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
            if links.root(i) != links.root(j) and similar(own[i], own[j], num, den):
                links.join(i, j)
    return [(order[i], order[j]) for i, j in links.pairs]


def _children(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of node pairs, each unordered pair once."""
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(_FAN), np.arange(_FAN), indexing="ij"))
    x, y = (a[:, None] * _FAN + i).reshape(-1), (b[:, None] * _FAN + j).reshape(-1)
    ok = (x < n) & (y < n) & ((x <= y) | np.repeat(a != b, _FAN * _FAN))
    return x[ok], y[ok]
