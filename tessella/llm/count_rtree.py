"""Sets of hashed shingles, their count vectors, and an R-tree over these.

The elements of a set are dealt to ``GROUPS`` groups by their hash; the numbers per group are a point. Two sets share
at most sum(min(a_g, b_g)) elements, and a box of points at most that of its upper corner, which is what the tree
prunes by: boxes and a first look at points go by ``COARSE`` sums of groups, a second look by all groups. A link asks
for 100 * |A & B| >= L * |A | B|, that is |A & B| >= L / (100 + L) * (|A| + |B|).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

GROUPS, COARSE = 256, 32
#: Counts are bytes; 255 stands for 255 or more, and two of them bound nothing.
FULL = 255
LEAF, FAN = 32, 16
#: Words whose hash a worker remembers; beyond that it forgets all and starts again.
REMEMBERED = 120_000

_M = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_NONE = np.zeros(0, dtype=np.int64)
_FREE = 1 << 40


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M[1]
    h = (h ^ (h >> np.uint64(27))) * _M[2]
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words of the whole text, A-Z in lower case; of all words
    where there are fewer; nothing for an empty or null text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    width = min(size, n)
    h = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        h = _mix(h * _M[3] + w[i : n - width + 1 + i] * _M[0])
    return np.unique(h)


def name(h: np.ndarray, seed: int = 0) -> int:
    """A set's name: a signed 64-bit hash of its elements."""
    x = xxhash.xxh3_64_intdigest(h.tobytes(), seed)
    return x - (1 << 64) if x >> 63 else x


def check(h: np.ndarray) -> int:
    """A second, independent hash, to see whether two sets have one name."""
    x = xxhash.xxh64_intdigest(h.tobytes(), 1)
    return x - (1 << 64) if x >> 63 else x


def counts(h: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((h >> np.uint64(7)).astype(np.int64) % GROUPS, minlength=GROUPS), FULL).astype(np.uint8)


def coarse(points: np.ndarray) -> np.ndarray:
    """Sums of neighbouring groups; a sum with a full count is full."""
    parts = points.reshape(*points.shape[:-1], COARSE, GROUPS // COARSE)
    return np.where((parts == FULL).any(axis=-1), FULL, np.minimum(parts.sum(axis=-1, dtype=np.int64), FULL)).astype(np.uint8)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most elements that sets at these points can share."""
    least = np.minimum(a, b)
    return least.sum(axis=-1, dtype=np.int64) + (least == FULL).any(axis=-1) * _FREE


@dataclass(frozen=True)
class Rule:
    """Shingles of ``size`` words; a link from ``least`` percent on."""

    size: int = 4
    least: int = 85

    def counted(self) -> np.uint64:
        """Elements below this hash are counted over the corpus: half as many again as a set's first elements are."""
        return np.uint64(min(2**64 - 1, int(2**64 * 1.5 * (100 - self.least) / 100)))

    def first(self, n: int, level: np.ndarray) -> np.ndarray:
        """Places, in a sorted set of ``n`` elements, of those of which two linked sets share at least one: the first
        n - ceil(L n / 100) + 1 in an order that all sets have in common, by level and then by hash."""
        most = n - -(-self.least * n // 100) + 1 if n else 0
        if not level.any():
            return np.arange(most)
        order = np.flatnonzero(level == 0)[:most]
        if len(order) < most:
            rest = np.flatnonzero(level)
            order = np.concatenate([order, rest[np.argsort(level[rest], kind="stable")]])[:most]
        return order

    def prefix(self, h: np.ndarray, common: np.ndarray) -> np.ndarray:
        """The first elements of a set in the order by hash with the elements in ``common`` (sorted) last."""
        level = np.zeros(len(h), dtype=np.uint8)
        if len(common) and len(h):
            level[common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h] = 1
        return h[self.first(len(h), level)]

    def sizes(self, na, nb):
        return 100 * np.minimum(na, nb) >= self.least * np.maximum(na, nb)

    def enough(self, most, n):
        """Whether ``most`` shared elements suffice for sets of ``n`` elements together."""
        return (100 + self.least) * most >= self.least * n

    def may_link(self, na, a: np.ndarray, nb, b: np.ndarray) -> np.ndarray:
        return self.sizes(na, nb) & self.enough(shared(a, b), na + nb)

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        """The exact check, on two sorted sets."""
        return self.enough_shared(len(a), len(b), _equal(a, b))

    def enough_shared(self, na: int, nb: int, shared: int) -> bool:
        return bool(na and nb) and 100 * shared >= self.least * (na + nb - shared)

    def links_by_half(self, a: np.ndarray, b: np.ndarray) -> bool | None:
        """The check on the sorted lower halves of two sets' hashes: False and True are certain, None is not.

        Halves agree wherever elements do, so too few equal halves are no link. Of the others a few may agree by chance;
        more than ``by_chance`` of them don't."""
        na, nb = len(a), len(b)
        if not na or not nb or not self.sizes(na, nb):
            return False
        shared = _equal(a, b)
        if not self.enough_shared(na, nb, shared):
            return False
        return True if self.enough_shared(na, nb, shared - by_chance(na + nb)) else None


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def by_chance(n: int) -> int:
    """So many agreements by chance among ``n`` values of 32 bits that more have a probability below 1e-15."""
    mean, k, tail = n * n / 2 / 2**32, 1, n * n / 2 / 2**32
    while tail > 1e-15 or k < mean:
        k += 1
        tail *= mean / k
    return k


class Tree:
    """An R-tree of points that are added in order of size, so leaves are close in size; a leaf's box is its sizes
    and the upper corner of its coarse counts, and inner nodes join ``FAN`` leaves."""

    def __init__(self, rule: Rule, most: int):
        leaves = -(-most // LEAF)
        self.rule, self.used = rule, 0
        self.n, self.at = np.zeros(most, dtype=np.int64), np.zeros(most, dtype=np.int64)
        self.fine, self.coarse = np.zeros((most, GROUPS), dtype=np.uint8), np.zeros((most, COARSE), dtype=np.uint8)
        self.low = [np.zeros(leaves, dtype=np.int64), np.zeros(-(-leaves // FAN), dtype=np.int64)]
        self.high = [x.copy() for x in self.low]
        self.corner = [np.zeros((len(x), COARSE), dtype=np.uint8) for x in self.low]

    def add(self, at: int, n: int, fine: np.ndarray, rough: np.ndarray) -> None:
        i = self.used
        self.n[i], self.fine[i], self.coarse[i], self.at[i] = n, fine, rough, at
        for level, width in enumerate((LEAF, LEAF * FAN)):
            k = i // width
            self.low[level][k] = n if i % width == 0 else min(n, self.low[level][k])
            self.high[level][k] = max(n, self.high[level][k])
            np.maximum(self.corner[level][k], rough, out=self.corner[level][k])
        self.used += 1

    def search(self, n: int, fine: np.ndarray, rough: np.ndarray) -> np.ndarray:
        """Places in the tree of the points that may link to this one."""
        rule, used = self.rule, self.used
        at = np.arange(used)
        if used > LEAF:
            at = np.arange(-(-used // (LEAF * FAN)))
            for level, width in ((1, FAN), (0, LEAF)):
                low, high = self.low[level][at], self.high[level][at]
                near = (100 * np.minimum(high, n) >= rule.least * n) & (100 * n >= rule.least * low)
                at = at[near & rule.enough(shared(self.corner[level][at], rough), n + low)]
                at = (at[:, None] * width + np.arange(width)).ravel()
                at = at[at < (-(-used // LEAF) if level else used)]
        for points, point in ((self.coarse, rough), (self.fine, fine)):
            if len(at):
                at = at[rule.may_link(self.n[at], points[at], n, point)]
        return at


def _by_size(n: np.ndarray, rough: np.ndarray) -> np.ndarray:
    return np.lexsort((*rough.T[:4], n))


def star(rule: Rule, n: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (places) that tie each point to one it may link to, not all to all: points come by size; one
    that may link to a leader goes to the leader with the most room, and becomes a leader otherwise."""
    tree, rough, a, b = Tree(rule, len(n)), coarse(fine), [], []
    for i in _by_size(n, rough):
        found = tree.search(n[i], fine[i], rough[i])
        if len(found):
            room = shared(tree.fine[found], fine[i]) / (tree.n[found] + n[i])
            a.append(tree.at[found[room.argmax()]])
            b.append(i)
        else:
            tree.add(i, n[i], fine[i], rough[i])
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def across(rule: Rule, n: np.ndarray, fine: np.ndarray, label: np.ndarray, side: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All candidate pairs (places) of different labels, and of different sides if there are two, that have no bit of
    ``earlier`` in common: those meet elsewhere. Points of the label that most have are the tree to begin with; only
    the others are searched for."""
    tree, rough, a, b = Tree(rule, len(n)), coarse(fine), [], []
    two = len(np.unique(side)) > 1
    _, back, times = np.unique(label, return_inverse=True, return_counts=True)
    most = back == times.argmax()
    order = _by_size(n, rough)
    for i in order[most[order]]:
        tree.add(i, n[i], fine[i], rough[i])
    for i in order[~most[order]]:
        found = tree.at[tree.search(n[i], fine[i], rough[i])]
        stays = label[found] != label[i]
        if two:
            stays &= side[found] != side[i]
        found = found[stays]
        found = found[~(earlier[found] & earlier[i]).any(axis=1)]
        a.append(found)
        b.append(np.full(len(found), i))
        tree.add(i, n[i], fine[i], rough[i])
    return (np.concatenate(a), np.concatenate(b)) if a else (_NONE, _NONE)


def within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within runs of rows, for runs that are small."""
    a, b = [], []
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size]
        a.append((at[:, None] + i).ravel())
        b.append((at[:, None] + j).ravel())
    return (np.concatenate(a), np.concatenate(b)) if a else (_NONE, _NONE)
