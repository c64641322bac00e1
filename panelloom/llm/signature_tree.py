"""Signature tree over token sets: nodes hold OR-ed token bitmaps and size ranges; a dual traversal joins.

Pure numpy over one bounded block of sets; Spark deals out the blocks.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
LEAF = 16


def _bits(sets: list[np.ndarray]) -> int:
    """Bitmap width: a power of two of at least twice the median size, 256 to 16,384."""
    half = float(np.median([len(s) for s in sets])) * 2
    return int(min(16384, max(256, 1 << int(np.ceil(np.log2(max(half, 1)))))))


class SignatureTree:
    """Sets in order of size, then of their least token, so that likely partners are neighbours."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]) // 8, int(sets[i][0]), len(sets[i])))
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets], dtype=np.int64)
        width = _bits(self.sets)
        flags = np.zeros((len(self.sets), width), dtype=bool)
        for row, s in zip(flags, self.sets, strict=True):
            row[(s & np.uint64(width - 1)).astype(np.int64)] = True
        self.map = np.packbits(flags, axis=1).view(np.uint64)
        #: Tokens of a set that fall on a bit which another of its tokens has set.
        self.extra = self.size - np.bitwise_count(self.map).sum(axis=1, dtype=np.int64)
        self.levels: list[dict[str, np.ndarray]] = []
        lo = np.arange(0, len(self.sets), LEAF)
        hi = np.minimum(lo + LEAF, len(self.sets))
        while True:
            self.levels.append(
                {
                    "lo": lo, "hi": hi,
                    "map": np.bitwise_or.reduceat(self.map, lo, axis=0),
                    "min": np.minimum.reduceat(self.size, lo), "max": np.maximum.reduceat(self.size, lo),
                    "extra": np.maximum.reduceat(self.extra, lo),
                }
            )
            if len(lo) == 1:
                break
            step = np.arange(0, len(lo), FANOUT)
            lo, hi = lo[step], hi[np.minimum(step + FANOUT, len(hi)) - 1]


def _may_link(a: dict, i: int, b: dict, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Node i against nodes j: can any pair of sets in them reach the similarity num/den?

    Two sets share at most the bits common to both bitmaps and, besides, the tokens that one of them has
    piled on its own bits. They need num/(num+den) of their summed sizes.
    """
    fits = (den * a["max"][i] >= num * b["min"][j]) & (den * b["max"][j] >= num * a["min"][i])
    most = np.bitwise_count(a["map"][i] & b["map"][j]).sum(axis=1, dtype=np.int64) + np.minimum(a["extra"][i], b["extra"][j])
    most = np.minimum(most, np.minimum(a["max"][i], b["max"][j]))
    return fits & ((num + den) * most >= num * (a["min"][i] + b["min"][j]))


def linked(sets: list[np.ndarray], num: int = 4, den: int = 5, labels: np.ndarray | None = None) -> np.ndarray:
    """A class number for each set: sets joined by chains of links share it.

    Sets are sorted arrays of distinct uint64 tokens, none empty. Two sets link when
    intersection/union >= num/den. ``labels`` are classes known to be joined before. A pair of nodes
    whose sets are all in one class already is skipped, as it can't change the answer.
    """
    n = len(sets)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    tree = SignatureTree(sets)
    label = (np.arange(n) if labels is None else np.asarray(labels, dtype=np.int64))[tree.order].copy()

    def leaves(x: int, y: int) -> None:
        leaf = tree.levels[0]
        for i in range(leaf["lo"][x], leaf["hi"][x]):
            j = np.arange(max(leaf["lo"][y], i + 1) if x == y else leaf["lo"][y], leaf["hi"][y])
            j = j[label[j] != label[i]]
            if not len(j):
                continue
            a, b = tree.size[i], tree.size[j]
            most = np.bitwise_count(tree.map[i] & tree.map[j]).sum(axis=1, dtype=np.int64) + np.minimum(tree.extra[i], tree.extra[j])
            need = (num * (a + b) + num + den - 1) // (num + den)
            for k, least in zip(j[np.minimum(most, np.minimum(a, b)) >= need], need[np.minimum(most, np.minimum(a, b)) >= need], strict=True):
                if label[i] != label[k]:
                    small, large = (tree.sets[i], tree.sets[k]) if len(tree.sets[i]) <= len(tree.sets[k]) else (tree.sets[k], tree.sets[i])
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    if int((large[at] == small).sum()) >= least:
                        label[label == label[k]] = label[i]

    top = len(tree.levels) - 1
    stack = [(top, 0, 0)]
    while stack:
        level, x, y = stack.pop()
        here = tree.levels[level]
        own, other = label[here["lo"][x] : here["hi"][x]], label[here["lo"][y] : here["hi"][y]]
        if own.min() == own.max() == other.min() == other.max():
            continue
        if level == 0:
            leaves(x, y)
            continue
        below = tree.levels[level - 1]
        kids = lambda k: range(k * FANOUT, min((k + 1) * FANOUT, len(below["lo"])))  # noqa: E731, B023
        far, near = [], []
        for i in kids(x):
            j = np.array([k for k in kids(y) if x != y or k >= i])
            if len(j):
                for k in j[_may_link(below, i, below, j, num, den)]:
                    (near if i == k else far).append((level - 1, i, int(k)))
        stack += far + near  # a node against itself first: it joins most, which spares the rest
    out = np.empty(n, dtype=np.int64)
    out[tree.order] = label
    return out
