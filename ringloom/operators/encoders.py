"""A family of LZSS encoders, told apart by parameters, and their outputs as rows.

An encoder is a hypothesis about how a file was once packed, not a codec: some of them refer to slots that a decoder hasn't written yet.
So outputs carry a ``decodable`` flag instead of a promise.

Encoding is sequential within a file (each choice moves the cursor); files and variants are independent, so that is what Spark spreads.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringloom.sources import batch
from ringloom.sources.forest import TIES, Forest
from ringloom.sources.lzss import LONGEST, RING, Token, expand, frame, literal, match

_NIL = -1


@dataclass(frozen=True)
class Variant:
    """search: tree, brute, chain, backward, forward, circular or hash. The other fields say how it inserts, breaks ties and ends."""

    search: str = "tree"
    tie: str = "first"  # first, last, near, far, short_last (last up to length 3, else first)
    order: str = "standard"  # standard, left_first, no_swap
    root: str = "byte"  # byte, xor, add
    dummies: str = "classic"  # classic, none, one, reversed, dropped
    tail: str = ""  # tail1, tail1_full
    uncapped: bool = False
    stop_on_input: bool = False
    phantom: int = 0  # literals appended; -8 pads the tokens to a multiple of eight
    fill: int = 0x20
    lazy: str = ""  # strict, equal
    shortest: int = 3
    rescan: str = ""  # near, far, or a length: far up to it, near beyond; only18 near at length 18 only
    unwritten: str = ""  # permissive, strict: matches at slots that nothing was written to
    blank_literal: bool = False
    early_literals: int = 0
    depth: int = 0
    key: int = 2
    oldest: bool = False


def _variants() -> dict[str, Variant]:
    base, plain = Variant(), Variant(dummies="none")
    out = {"basic": base, "no_dummy": plain, "dummy_reversed": replace(base, dummies="reversed"), "one_dummy": replace(base, dummies="one"), "dummy_dropped": replace(base, dummies="dropped"), "dummy_dropped_tail1": replace(base, dummies="dropped", tail="tail1")}
    for name, v in (("basic", base), ("no_dummy", plain)):
        out |= {f"{name}_{x}": replace(v, tie=t) for x, t in (("eq", "last"), ("near", "near"), ("far", "far"), ("dyntie", "short_last"))}
        out |= {f"{name}_left_first": replace(v, order="left_first"), f"{name}_no_swap": replace(v, order="no_swap"), f"{name}_lazy": replace(v, lazy="strict"), f"{name}_lazy_eq": replace(v, lazy="equal"), f"{name}_min4": replace(v, shortest=4)}
        out |= {f"{name}_left_first_{x}": replace(v, order="left_first", **kw) for x, kw in (("eq", {"tie": "last"}), ("lazy", {"lazy": "strict"}), ("lazy_eq", {"lazy": "equal"}), ("lazy_eq_tie_eq", {"lazy": "equal", "tie": "last"}), ("tail1", {"tail": "tail1"}))}
        out |= {f"{name}_no_swap_lazy_eq": replace(v, order="no_swap", lazy="equal"), f"{name}_no_swap_tail1": replace(v, order="no_swap", tail="tail1"), f"{name}_literal_blank": replace(v, blank_literal=True)}
        t = replace(v, tail="tail1")
        out |= {f"{name}_tail1": t, f"{name}_tail1_full": replace(v, tail="tail1_full"), f"{name}_tail1_xor": replace(t, root="xor"), f"{name}_tail1_add": replace(t, root="add"), f"{name}_tail1_stop": replace(t, stop_on_input=True), f"{name}_tail1_uncapped": replace(t, uncapped=True)}
        out |= {f"{name}_tail1_phantom{n}": replace(t, phantom=n) for n in (1, 2)} | {f"{name}_tail1_pad8": replace(t, phantom=-8)}
        out |= {f"{name}_tail1_fill{f:02x}": replace(t, fill=f) for f in (0x00, 0xFF)}
        out |= {f"{name}_no_init": replace(v, unwritten="permissive"), f"{name}_no_init_tail1": replace(t, unwritten="permissive"), f"{name}_no_init_strict_tail1": replace(t, unwritten="strict")}
        out |= {f"{name}_rescan_{r}_tail1": replace(t, rescan=r) for r in ("near", "far", "only18", "8", "13", "14", "15", "16")}
    out |= {f"brute_{t}": Variant("brute", tie=t) for t in ("near", "far")}
    out |= {f"chain{d}_{n}": Variant("chain", tie=t, depth=d) for d in (4, 8, 16, 32, 64) for n, t in (("first", "first"), ("last", "last"))}
    out |= {f"chain3_{d}_{n}": Variant("chain", tie=t, depth=d, key=3) for d in (8, 32) for n, t in (("first", "first"), ("last", "last"))}
    out |= {f"chain_oldest{d}": Variant("chain", depth=d, oldest=True) for d in (8, 32)}
    out |= {f"{s}_{n}": Variant(s, tie=t) for s in ("backward", "forward", "circular") for n, t in (("strict", "first"), ("equal", "last"))}
    out |= {"forward_any": Variant("forward", tie="any"), "circular_any": Variant("circular", tie="any"), "hash_any": Variant("hash", tie="any", depth=RING), "hash_best": Variant("hash", depth=RING)}
    return out


VARIANTS = _variants()

#: The rivals of the report on hopeless tokens and those of the union of all rivals. Basic with a strict tie, which both have beside basic, is the same encoder.
HOPELESS = [
    "basic", "no_dummy", "dummy_dropped", "no_dummy_left_first", "no_dummy_tail1", "basic_tail1", "dummy_dropped_tail1", "basic_tail1_full", "no_dummy_tail1_full", "basic_no_init",
    "basic_no_init_tail1", "no_dummy_no_init_tail1", "dummy_reversed", "uniform_head", "min_bytes_strict", "combo", "no_dummy_literal_blank", "basic_tail1_phantom1", "basic_far", "basic_near",
]
UNION = [
    "basic", "no_dummy", "dummy_dropped", "no_dummy_left_first", "no_dummy_tail1", "basic_tail1", "dummy_dropped_tail1", "basic_tail1_full", "no_dummy_tail1_full", "basic_no_init",
    "basic_no_init_tail1", "basic_no_init_strict_tail1", "no_dummy_no_init_tail1", "dummy_reversed", "uniform_head", "min_bytes_strict", "combo", "no_dummy_literal_blank",
]
#: Basic or no_dummy, by a rule that looks at the data or at both outputs.
CHOOSERS = ("uniform_head", "min_bytes_strict", "combo")


class _Ring:
    """The window that an encoder looks at: the ring with LONGEST - 1 bytes of overlap, and the look-ahead already written at the head."""

    def __init__(self, data: bytes, v: Variant):
        self.data, self.v = data, v
        self.head, self.tail = RING - LONGEST, 0
        self.buf = bytearray([v.fill]) * (RING + LONGEST - 1)
        self.ahead = min(LONGEST, len(data))
        self.next = self.ahead
        self.buf[self.head : self.head + self.ahead] = data[: self.ahead]
        self.written = bytearray(RING)
        for i in range(LONGEST):
            self.written[(self.head + i) % RING] = 1

    def step(self) -> bool:
        """Move the head by a byte; whether input came in."""
        more = self.next < len(self.data)
        if more:
            c = self.data[self.next]
            self.buf[self.tail] = c
            self.written[self.tail] = 1
            if self.tail < LONGEST - 1:
                self.buf[RING + self.tail] = c
            self.next += 1
        else:
            self.ahead -= 1
        self.tail, self.head = (self.tail + 1) % RING, (self.head + 1) % RING
        return more

    def common(self, a: int, b: int, start: int = 0) -> int:
        """Length of the common prefix at two slots, LONGEST at most."""
        x = int.from_bytes(self.buf[a + start : a + LONGEST]) ^ int.from_bytes(self.buf[b + start : b + LONGEST])
        return LONGEST - (x.bit_length() + 7) // 8


class _Tree(_Ring):
    """256 binary search trees by first byte, over the strings at the ring's slots. The longest match is what an insertion meets on its way."""

    def __init__(self, data: bytes, v: Variant):
        super().__init__(data, v)
        n = RING + 1 + 256
        self.kids = ([_NIL] * n, [_NIL] * n)
        self.up = [_NIL] * RING
        self.pos = self.len = 0
        h, order = self.head, {"classic": range(1, LONGEST + 1), "reversed": range(LONGEST, 0, -1), "one": [LONGEST], "dropped": range(1, LONGEST + 1), "none": []}[v.dummies]
        self.extra = [h - i for i in order]
        for slot in self.extra:
            self.insert(slot)
        self.insert(h)

    def _better(self, slot: int, n: int, r: int) -> bool:
        if n != self.len:
            return n > self.len
        tie = self.v.tie
        if tie in ("near", "far"):
            here, best = (r - slot) % RING, (r - self.pos) % RING
            return here > best if tie == "far" else 0 < here and (best == 0 or here < best)
        return tie == "last" or tie == "short_last" and n <= 3

    def insert(self, r: int) -> None:
        buf, left_first = self.buf, self.v.order == "left_first"
        first = {"byte": buf[r], "xor": buf[r] ^ buf[r + 1], "add": (buf[r] + buf[r + 1]) & 0xFF}[self.v.root]
        self.kids[0][r] = self.kids[1][r] = _NIL
        self.len, at, side = 0, RING + 1 + first, 0 if left_first else 1
        while True:
            below = self.kids[side][at]
            if below == _NIL:
                self.kids[side][at], self.up[r] = r, at
                return
            at = below
            n = self.common(r, at, 1)
            if n < LONGEST:
                more = buf[r + n] > buf[at + n]
                side = int(more)
            else:
                side = 0 if left_first else 1
            if self._better(at, n, r):
                self.pos, self.len = at, n
                if n >= LONGEST:
                    break
        if self.v.order == "no_swap":
            self.up[r] = _NIL
            return
        parent = self.up[at]
        self.up[r] = parent
        for s in (0, 1):
            self.kids[s][r] = self.kids[s][at]
            if self.kids[s][at] != _NIL:
                self.up[self.kids[s][at]] = r
        self.kids[1 if self.kids[1][parent] == at else 0][parent] = r
        self.up[at] = _NIL

    def remove(self, p: int) -> None:
        parent = self.up[p]
        if parent == _NIL:
            return
        left, right = self.kids[0][p], self.kids[1][p]
        if right == _NIL:
            q = left
        elif left == _NIL:
            q = right
        else:
            q = left
            if self.kids[1][q] != _NIL:
                while self.kids[1][q] != _NIL:
                    q = self.kids[1][q]
                above, low = self.up[q], self.kids[0][q]
                self.kids[1][above] = low
                if low != _NIL:
                    self.up[low] = above
                self.kids[0][q] = left
                self.up[left] = q
            self.kids[1][q] = right
            self.up[right] = q
        if q != _NIL:
            self.up[q] = parent
        self.kids[1 if self.kids[1][parent] == p else 0][parent] = q
        self.up[p] = _NIL

    def advance(self) -> bool:
        self.remove(self.tail)
        more = self.step()
        if self.ahead:
            self.insert(self.head)
        return more

    def found(self) -> tuple[int, int]:
        pos, n = self.pos, self.len
        r, rescan = self.head, self.v.rescan
        if n >= 3 and rescan and (rescan != "only18" or n == LONGEST):
            near = rescan in ("near", "only18") or rescan.isdigit() and n > int(rescan)
            slots = ((r - d) % RING for d in (range(1, RING) if near else range(RING - 1, 0, -1)))
            pos = next((s for s in slots if self.common(r, s) >= n), pos)
        return pos, n


class _Scan(_Ring):
    """Searches without a tree: all slots in some order, or the slots of a hash chain."""

    def __init__(self, data: bytes, v: Variant):
        super().__init__(data, v)
        self.chains: dict[bytes, list[int]] = {}
        self.out = 0  # bytes before the head

    def advance(self) -> bool:
        v = self.v
        if v.search in ("chain", "hash"):
            width = 3 if v.search == "hash" else v.key
            # a slot is known once its key is complete, so one byte late for a key of two
            key = self.data[self.out : self.out + width]
            if len(key) == width:
                chain = self.chains.setdefault(bytes(key), [])
                chain.append(self.out)
                if len(chain) > 2 * RING:
                    del chain[:RING]
        self.out += 1
        return self.step()

    def _length(self, back: int) -> int:
        """Common prefix with the history ``back`` bytes ago; what lies before the data is fill, and a match may run into itself."""
        data, s = self.data, self.out
        n, most = 0, min(LONGEST, len(data) - s)
        while n < most:
            at = s - back + n
            if (data[at] if at >= 0 else self.v.fill) != data[s + n]:
                break
            n += 1
        return n

    def found(self) -> tuple[int, int]:
        v, r = self.v, self.head
        best = (0, 0)
        if v.search == "brute":
            order = range(1, RING - LONGEST + 1) if v.tie == "near" else range(RING - LONGEST, 0, -1)
            for d in order:
                n = self._length(d)
                if n > best[1]:
                    best = ((r - d) % RING, n)
                    if n >= LONGEST:
                        break
            return best
        if v.search in ("chain", "hash"):
            key = bytes(self.data[self.out : self.out + (3 if v.search == "hash" else v.key)])
            chain, first = self.chains.get(key, []), self.out - (RING - LONGEST)
            if v.oldest:
                at = bisect.bisect_left(chain, first)
                places = chain[at : at + v.depth]
            else:
                places = [p for p in chain[: -v.depth - 1 : -1] if p >= first]
            for p in places:
                n = self._length(self.out - p)
                if n > best[1] or n == best[1] and v.tie == "last":
                    best = ((r - (self.out - p)) % RING, n)
                if v.tie == "any" and n >= v.shortest:
                    break
            return best
        if v.search == "backward":
            slots = ((r - d) % RING for d in range(1, RING))
        elif v.search == "forward":
            slots = (s for s in range(RING) if s != r)
        else:
            slots = ((r + d) % RING for d in range(1, RING))
        for s in slots:
            n = self.common(r, s)
            if n > best[1] or n == best[1] and v.tie == "last":
                best = (s, n)
                if n >= LONGEST and v.tie != "last":
                    break
            if v.tie == "any" and n >= v.shortest:
                break
        return best


def _chosen(data: bytes, rule: str) -> list[Token]:
    uniform = len(data) >= LONGEST and len(set(data[:LONGEST])) == 1
    if rule == "uniform_head" or rule == "combo" and uniform:
        return encode(data, "basic" if uniform else "no_dummy")
    a, b = encode(data, "basic"), encode(data, "no_dummy")
    return a if size_in_bytes(a) < size_in_bytes(b) else b


def encode(data: bytes, v: Variant | str = "basic") -> list[Token]:
    """Tokens of a variant or of a chooser. Empty input gives none."""
    if v in CHOOSERS:
        return _chosen(data, v)
    v = VARIANTS[v] if isinstance(v, str) else v
    if not data:
        return []
    w = _Tree(data, v) if v.search == "tree" else _Scan(data, v)
    out: list[Token] = []
    done = 0
    while w.ahead > 0:
        pos, n = w.found()
        here, left = w.buf[w.head], w.ahead
        cap = min(left + 1, LONGEST) if v.tail == "tail1_full" or v.tail == "tail1" and pos == (w.head - 1) % RING else left
        if not v.uncapped:
            n = min(n, cap)
        plain = n < v.shortest or done < v.early_literals or v.blank_literal and here == 0x20
        if v.unwritten and not plain and not w.written[pos] and (v.unwritten == "strict" or here == 0x20):
            plain = True
        moves = 1
        if plain:
            out.append(literal(here))
        elif v.lazy and n < left:
            w.advance()
            done += 1
            later = min(w.found()[1], w.ahead)
            if later > n or v.lazy == "equal" and later == n:
                out.append(literal(here))
                continue
            out.append(match(pos, n))
            moves = n - 1
        else:
            out.append(match(pos, n))
            moves = n
        if v.dummies == "dropped" and len(out) == 1 and isinstance(w, _Tree):
            for slot in w.extra:
                w.remove(slot)
        more = True
        for _ in range(moves):
            if not w.ahead:
                break
            more = w.advance()
            done += 1
        if v.stop_on_input and not more:
            break
    last = literal(data[-1])
    out += [last] * (v.phantom if v.phantom >= 0 else -len(out) % -v.phantom)
    return out


def size_in_bytes(tokens: list[Token]) -> int:
    return -(-len(tokens) // 8) + sum(1 + t.is_match for t in tokens)


def roundtrips(data: bytes, tokens: list[Token]) -> bool:
    """A decoder makes the input of the tokens."""
    return expand(tokens, len(data)) == data


def _searched_at_once(v: Variant) -> bool:
    return v == Variant("chain", tie=v.tie, depth=v.depth, key=v.key, oldest=v.oldest, shortest=v.shortest) and v.tie in ("first", "last") and v.shortest >= 3


def _read_off_trees(v: Variant) -> bool:
    """Tree encoders whose tokens follow from what a forest finds at each place."""
    return v.tie in TIES and v == Variant(tie=v.tie, order=v.order, dummies=v.dummies, tail=v.tail, uncapped=v.uncapped, phantom=v.phantom, shortest=v.shortest, unwritten=v.unwritten, blank_literal=v.blank_literal) and v.order != "no_swap"


def _off_trees(trees: Forest, v: Variant) -> batch.Tokens:
    data, bounds = trees.data, trees.bounds
    # the sides of a tree's root (order) are not told apart by what is found
    dist, length = trees.found(v.dummies, v.tie)
    file_at, place, left = trees.places
    n = length.astype(np.int64)
    if not v.uncapped:
        cap = np.minimum(left + ((dist == 1) if v.tail == "tail1" else v.tail == "tail1_full"), LONGEST)
        n = np.minimum(n, cap)
    plain = n < v.shortest
    if v.blank_literal:
        plain |= data == 0x20
    if v.unwritten:
        plain |= (place < dist) & ((data == 0x20) | (v.unwritten == "strict"))
    n[plain] = 1
    step, s, at, e = np.minimum(n, left).astype(np.uint8).tobytes(), 0, [], len(data)
    add = at.append
    while s < e:
        add(s)
        s += step[s]
    at = np.array(at, np.int64)
    file, m = file_at[at], ~plain[at]
    columns = [file, m, np.where(m, 0, data[at]), np.where(m, RING - LONGEST + place[at] - dist[at] & RING - 1, 0), n[at]]
    if v.phantom:
        count = np.bincount(file, minlength=len(bounds) - 1)
        count = np.where(count > 0, v.phantom if v.phantom > 0 else -count % -v.phantom, 0)
        ends = np.repeat(np.searchsorted(file, np.arange(len(count)), "right"), count)
        of = np.repeat(np.arange(len(count)), count)
        columns = [np.insert(x, ends, y) for x, y in zip(columns, (of, False, data[bounds[1:][of] - 1], 0, 1), strict=True)]
    file, m, lit, pos, size = columns
    return _tokens(file, len(bounds) - 1, m, lit, pos, size)


def _tokens(file: np.ndarray, files: int, m: np.ndarray, lit: np.ndarray, pos: np.ndarray, size: np.ndarray) -> batch.Tokens:
    first = np.searchsorted(file, np.arange(files + 1))
    ahead = np.append(0, np.cumsum(size, dtype=np.int64))
    return batch.Tokens(first, file, ahead[:-1] - ahead[first[:-1]][file], m, lit.astype(np.int32), pos.astype(np.int32), size.astype(np.int32))


def _chosen_off_trees(trees: Forest, rule: str) -> batch.Tokens:
    a, b = (tokens_of(trees.data, trees.bounds, n, trees) for n in ("basic", "no_dummy"))
    sizes, first = np.diff(trees.bounds), np.append(trees.data, 0)[trees.bounds[:-1]]
    same = trees.data == first[np.repeat(np.arange(len(sizes)), sizes)]
    run = np.append(0, np.cumsum(same))
    uniform = (sizes >= LONGEST) & (run[np.minimum(trees.bounds[:-1] + LONGEST, len(same))] - run[trees.bounds[:-1]] == LONGEST)
    smaller = batch.framed_sizes(a) < batch.framed_sizes(b)
    take = {"uniform_head": uniform, "min_bytes_strict": smaller, "combo": uniform | smaller}[rule]
    a, b = a.kept(take[a.file]), b.kept(~take[b.file])
    order = np.argsort(np.concatenate([a.file, b.file]), kind="stable")
    file, m, lit, pos, size = (np.concatenate([getattr(a, c), getattr(b, c)])[order] for c in ("file", "is_match", "lit", "pos", "len"))
    return _tokens(file, len(sizes), m, lit, pos, size)


def tokens_of(data: np.ndarray, bounds: np.ndarray, name: str, trees: Forest | None = None) -> batch.Tokens:
    """Tokens of many files that lie one behind the other. Hash chains are searched at all places together, and tree encoders are read off ``trees``, the
    forest of the same files, which callers with many variants share; any other encoder goes file by file."""
    v = VARIANTS.get(name)
    if v and _searched_at_once(v):
        return batch.encode(data, bounds, v.key, v.depth, v.tie == "last", v.oldest, v.shortest)
    if not v and name in CHOOSERS:
        return _chosen_off_trees(trees or Forest(data, bounds), name)
    if v and _read_off_trees(v):
        trees = trees or Forest(data, bounds)
        if name not in ("basic", "no_dummy"):
            return _off_trees(trees, v)
        if name not in trees.tokens:
            trees.tokens[name] = _off_trees(trees, v)
        return trees.tokens[name]
    found = [encode(data[s:e].tobytes(), name) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    is_match, lit, pos, size = np.array([t for x in found for t in x], np.int32).reshape(-1, 4).T
    return _tokens(np.repeat(np.arange(len(found)), [len(x) for x in found]), len(found), is_match.astype(bool), lit, pos, size)


#: Bytes of input, as its files have them, that one task encodes, about.
TASK = 8 << 20


def spread(files: DataFrame) -> DataFrame:
    """The rows dealt out evenly to tasks whose number follows the input's size: encoding is slow, and a split of the input may be a large file's one
    row group."""
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(files.sparkSession.sparkContext.defaultParallelism, min(-(-size // TASK), 1 << 15))
    return files.withColumn("_row", F.monotonically_increasing_id()).repartition(parts, "_row").drop("_row")


ENCODED = "file string, variant string, token_idx int, is_match boolean, lit int, pos int, len int"


def _per_variant(files: DataFrame, names: list[str], schema: str, make: Callable[[Forest, str, pa.Array], list]) -> DataFrame:
    """Columns after the variant's name for each stretch of files and each variant."""
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch.passes(batches, "content"):
            trees = Forest(*batch.bytes_column(b.column("content")))
            for name in names:
                file, *rest = make(trees, name, b.column("file").cast(pa.string()))
                yield pa.RecordBatch.from_arrays([file, pa.array([name] * len(file), pa.string()), *rest], columns)

    return files.select(F.col("file").cast("string").alias("file"), "content").mapInArrow(run, schema)


def encoded_tokens(files: DataFrame, names: list[str]) -> DataFrame:
    """files(file, content) x variants -> a row for each token."""

    def make(trees: Forest, name: str, file: pa.Array) -> list:
        t = tokens_of(trees.data, trees.bounds, name, trees)
        return [file.take(pa.array(t.file)), pa.array(t.idx, pa.int32()), pa.array(t.is_match), *(pa.array(x, pa.int32()) for x in (t.lit, t.pos, t.len))]

    return _per_variant(files, names, ENCODED, make)


def encoded_files(files: DataFrame, names: list[str]) -> DataFrame:
    """files(file, content) x variants -> file, variant, tokens, bytes, payload, decodable."""

    def make(trees: Forest, name: str, file: pa.Array) -> list:
        data, bounds = trees.data, trees.bounds
        sizes = np.diff(bounds)
        t = tokens_of(data, bounds, name, trees)
        payload, at = batch.frame(t)
        seen = t.kept(t.start < sizes[t.file])  # a decoder stops at the file's size
        back, told = batch.expand(seen, sizes)
        good = np.diff(told) == sizes
        if good.all():
            good = np.bincount(np.repeat(np.arange(len(sizes)), sizes), back != data, len(sizes)) == 0
        else:
            good = np.array([back[p:q].tobytes() == data[s:e].tobytes() for p, q, s, e in zip(told[:-1], told[1:], bounds[:-1], bounds[1:], strict=True)], bool)
        return [file, pa.array(np.diff(t.first), pa.int64()), pa.array(np.diff(at), pa.int64()), batch.binary_column(payload, at), pa.array(good)]

    return _per_variant(files, names, "file string, variant string, tokens long, bytes long, payload binary, decodable boolean", make)


def choose(outputs: DataFrame, first: str, second: str, rule: str, target: Column | None = None, head: Column | None = None) -> DataFrame:
    """Pick one of two variants' outputs for each file. ``min_tokens`` and ``min_bytes`` prefer the first on a tie, ``min_bytes_strict`` the second;
    ``closest`` is nearest to ``target`` bytes; ``uniform_head`` takes the first where ``head`` holds; ``combo`` is uniform_head, then min_bytes_strict."""
    a = outputs.where(F.col("variant") == first).select("file", F.struct("variant", "tokens", "bytes", "payload", "decodable").alias("a"))
    b = outputs.where(F.col("variant") == second).select("file", F.struct("variant", "tokens", "bytes", "payload", "decodable").alias("b"))
    rules = {
        "min_tokens": F.col("a.tokens") <= F.col("b.tokens"),
        "min_bytes": F.col("a.bytes") <= F.col("b.bytes"),
        "min_bytes_strict": F.col("a.bytes") < F.col("b.bytes"),
        "closest": None if target is None else F.abs(F.col("a.bytes") - target) <= F.abs(F.col("b.bytes") - target),
        "uniform_head": head,
        "combo": None if head is None else head | (F.col("a.bytes") < F.col("b.bytes")),
    }
    if rules[rule] is None:
        raise ValueError(f"{rule} needs a target or a head")
    return a.join(b, "file").select("file", F.when(rules[rule], F.col("a")).otherwise(F.col("b")).alias("r")).select("file", "r.*")


def coverage(matches: DataFrame) -> DataFrame:
    """matches(file, variant, exact) -> a row for each variant: files it reproduces, and those that it alone does."""
    good = matches.where("exact").select("file", "variant").distinct()
    alone = good.groupBy("file").agg(F.count("*").alias("k"))
    return good.join(alone, "file").groupBy("variant").agg(F.count("*").alias("files"), F.count_if(F.col("k") == 1).alias("alone"))


def uncovered(matches: DataFrame) -> DataFrame:
    """matches(file, variant, exact) -> the files that no variant reproduces."""
    return matches.groupBy("file").agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("any")).where("not any").select("file")
