"""What the encoders with binary search trees find at each place of many files, without encoding once for each variant.

A tree encoder inserts and removes a string for each byte, whatever tokens it chooses, so its trees follow from the data alone; how it breaks ties and ends
only decides which node on an insertion's way it takes. Each way is therefore walked once, and the variants' tokens are read off it:

* Strings of LONGEST bytes don't change while they are in a tree, so they are compared by their ranks.
* There is a tree for each first byte, and the dummies begin with the fill. So only the fill's tree depends on the dummies.
"""

from __future__ import annotations

from array import array
from collections import deque
from functools import cached_property
from itertools import repeat

import numpy as np

from ringloom.sources import batch
from ringloom.sources.lzss import FILL, LONGEST, RING, START

#: Places that are inserted, and nodes on their ways, before they are turned into matches, about.
PLACES, NODES = 1 << 14, 1 << 20
#: Dummies by kind: positions before the data, in the order in which they are inserted.
DUMMIES = {"none": (), "classic": range(-1, -LONGEST - 1, -1), "dropped": range(-1, -LONGEST - 1, -1), "reversed": range(-LONGEST, 0), "one": (-LONGEST,)}
TIES = ("first", "last", "near", "far")


class _Trees:
    """The trees of one file, by slots of the ring."""

    def __init__(self):
        self.left, self.right, self.up, self.rank = [-1] * RING, [-1] * (RING + 256), [-1] * RING, [0] * RING
        self.live: deque[int] = deque()

    def remove(self, p: int) -> None:
        left, right, up = self.left, self.right, self.up
        parent = up[p]
        if parent < 0:
            return
        if right[p] < 0:
            q = left[p]
        elif left[p] < 0:
            q = right[p]
        else:
            q = left[p]
            if right[q] >= 0:
                while right[q] >= 0:
                    q = right[q]
                above, low = up[q], left[q]
                right[above] = low
                if low >= 0:
                    up[low] = above
                left[q] = left[p]
                up[left[p]] = q
            right[q] = right[p]
            up[right[p]] = q
        if q >= 0:
            up[q] = parent
        if right[parent] == p:
            right[parent] = q
        else:
            left[parent] = q
        up[p] = -1

    def insert(self, places: list[int], ranks: list[int], roots, nodes: array, ends: array) -> None:
        """Insert strings in ascending order of their places, after those that have left the ring are removed; their ways go to ``nodes``."""
        left, right, up, rank, live, add, remove = self.left, self.right, self.up, self.rank, self.live, nodes.append, self.remove
        for s, r, root in zip(places, ranks, roots, strict=False):
            while live and live[0] < s - START:
                remove((START + live.popleft()) % RING)
            live.append(s)
            slot = (START + s) % RING
            rank[slot] = r
            left[slot] = right[slot] = -1
            at = right[root]
            if at < 0:
                right[root], up[slot] = slot, root
                ends.append(len(nodes))
                continue
            while True:
                add(at)
                x = rank[at]
                if r > x:
                    below = right[at]
                    if below < 0:
                        right[at], up[slot] = slot, at
                        break
                elif r < x:
                    below = left[at]
                    if below < 0:
                        left[at], up[slot] = slot, at
                        break
                else:  # an equal string takes the place of the old one
                    parent = up[slot] = up[at]
                    a = left[slot] = left[at]
                    if a >= 0:
                        up[a] = slot
                    a = right[slot] = right[at]
                    if a >= 0:
                        up[a] = slot
                    if right[parent] == at:
                        right[parent] = slot
                    else:
                        left[parent] = slot
                    up[at] = -1
                    break
                at = below
            ends.append(len(nodes))


class Forest:
    """Distances and lengths that tree encoders find at each place of files that lie one behind the other, by dummies and tie."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.tables = data, bounds, {}
        self.common: dict[str, tuple[np.ndarray, np.ndarray]] | None = None
        self.tokens: dict[str, batch.Tokens] = {}  # of variants that others choose from

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """File, place in it and bytes left, LONGEST at most, at each place."""
        size = np.diff(self.bounds)
        file, at = np.repeat(np.arange(len(size)), size), np.arange(len(self.data))
        return file, at - self.bounds[:-1][file], np.minimum(self.bounds[1:][file] - at, LONGEST)

    def _prepare(self) -> None:
        data, bounds = self.data, self.bounds
        sizes = np.diff(bounds)
        # a file has its dummies before it, and behind it what the ring held a round ago
        self.shift = LONGEST * (1 + 2 * np.arange(len(sizes)))
        v = np.full(len(data) + 2 * LONGEST * len(sizes), FILL, np.uint8)
        begin = bounds[:-1] + self.shift
        v[batch.ranges(begin, sizes)] = data
        back = np.repeat(sizes, LONGEST) + np.tile(np.arange(LONGEST), len(sizes)) - RING
        old, to = back >= 0, np.repeat(begin + sizes, LONGEST) + np.tile(np.arange(LONGEST), len(sizes))
        v[to[old]] = v[np.repeat(begin, LONGEST)[old] + back[old]]
        self.v, self.w = v, batch.words(np.append(v, np.zeros(LONGEST, np.uint8)))
        high = self.w.byteswap()
        keys = (high[LONGEST - 2 : LONGEST - 2 + len(v)] >> np.uint64(48), high[8 : 8 + len(v)], high[: len(v)])
        order = np.lexsort(keys)
        new = np.zeros(len(v), bool)
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        self.rank = np.empty(len(v), np.int32)
        self.rank[order] = np.cumsum(new)

    def found(self, dummies: str, tie: str) -> tuple[np.ndarray, np.ndarray]:
        """Distance and length at each place; lengths aren't cut at the file's end."""
        if self.common is None:
            self._prepare()
            self.common = self._walk(self.data != FILL, "none")
        if dummies not in self.tables:
            blank = self.data == FILL
            own = self._walk(blank, dummies)
            self.tables[dummies] = {t: tuple(np.where(blank, x, y) for x, y in zip(own[t], self.common[t], strict=True)) for t in TIES}
        return self.tables[dummies][tie]

    def _walk(self, which: np.ndarray, dummies: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        size = len(self.data)
        out = {t: (np.zeros(size, np.int16), np.zeros(size, np.int8)) for t in TIES}
        nodes, ends, done = array("i"), array("q"), []
        for f, (s, e) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)):
            if s == e:
                continue
            trees, zero = _Trees(), s + int(self.shift[f])
            extra = list(DUMMIES[dummies])
            if extra:
                trees.insert(extra, self.rank[[zero + p for p in extra]].tolist(), repeat(RING + FILL), array("i"), array("q"))
                trees.live = deque(sorted(extra))
            for low in range(s, e, PLACES):
                at = low + np.flatnonzero(which[low : min(e, low + PLACES)])
                places, ranks, roots = (at - s).tolist(), self.rank[at + (zero - s)].tolist(), (self.data[at].astype(np.int32) + RING).tolist()
                first = 0
                if dummies == "dropped" and low == s:  # they go once the first token is found
                    first = int(places[:1] == [0])
                    trees.insert(places[:first], ranks[:first], roots[:first], nodes, ends)
                    for p in extra:
                        trees.remove((START + p) % RING)
                trees.insert(places[first:], ranks[first:], roots[first:], nodes, ends)
                done.append((at, np.full(len(at), zero - s)))
                if len(nodes) >= NODES:
                    self._settle(out, nodes, ends, done)
                    nodes, ends, done = array("i"), array("q"), []
        self._settle(out, nodes, ends, done)
        return out

    def _settle(self, out: dict, nodes: array, ends: array, done: list) -> None:
        """The best match of each way, by tie."""
        if not len(nodes):
            return
        at, shift = (np.concatenate([x[i] for x in done]) for i in (0, 1))
        count = np.diff(np.frombuffer(ends, np.int64), prepend=0)
        at, shift, count = at[count > 0], shift[count > 0], count[count > 0]
        file = np.searchsorted(self.bounds, at, "right") - 1
        slot = (START + at - self.bounds[file]) % RING
        back = (np.repeat(slot, count) - np.frombuffer(nodes, np.int32)) % RING
        here = np.repeat(at + shift, count)
        there, w = here - back, self.w
        n = batch.equal_bytes(w[here + 1] ^ w[there + 1])
        more = np.flatnonzero(n == 8)
        n[more] += batch.equal_bytes(w[here[more] + 9] ^ w[there[more] + 9])
        more = more[n[more] == 16]
        n[more] += self.v[here[more] + 17] == self.v[there[more] + 17]
        n += np.int8(1)
        heads = np.cumsum(count) - count
        top = np.maximum.reduceat(n, heads)
        tied, number = n == np.repeat(top, count), np.arange(len(n))
        best = {
            "first": back[np.minimum.reduceat(np.where(tied, number, len(n)), heads)], "last": back[np.maximum.reduceat(np.where(tied, number, -1), heads)],
            "near": np.minimum.reduceat(np.where(tied, back, RING), heads), "far": np.maximum.reduceat(np.where(tied, back, -1), heads),
        }
        for t in TIES:
            out[t][0][at], out[t][1][at] = best[t], top
