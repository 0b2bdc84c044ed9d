"""The LZSS kernels over many files at once: the same tokens and bytes as the plain loops of ``lzss`` and ``encoders``, in arrays.

Files lie one behind the other in one array of bytes with their bounds. What a hash-chain encoder finds at a place depends on the data alone, so
all places are searched together in the order of their keys; only the walk from token to token, and from flag byte to flag byte, is a loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ringloom.sources.lzss import FILL, LONGEST, RING, SHORTEST, START

#: Bytes that one pass takes, which bounds its memory; a longer file is a pass of its own (its search goes on in stretches).
PASS = 1 << 20
#: Places that are searched at once, so that their arrays stay in a core's cache.
PLACES = 1 << 16
_SHIFT = np.uint64(36)


@dataclass
class Tokens:
    """Tokens of many files: ``first`` has their bounds, ``file`` the number of the file, ``start`` the cursor in it; the rest is as in ``lzss.Token``."""

    first: np.ndarray
    file: np.ndarray
    start: np.ndarray
    is_match: np.ndarray
    lit: np.ndarray
    pos: np.ndarray
    len: np.ndarray

    @property
    def idx(self) -> np.ndarray:
        """Number of the token in its file."""
        return np.arange(len(self.file)) - self.first[self.file]

    def kept(self, rows: np.ndarray) -> Tokens:
        file = self.file[rows]
        return Tokens(np.searchsorted(file, np.arange(len(self.first))), file, *(x[rows] for x in (self.start, self.is_match, self.lit, self.pos, self.len)))


def bounds_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each count, one behind the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(LONGEST + 8, np.uint8)])
    return np.ndarray(len(data) + LONGEST, "<u8", padded.tobytes(), strides=(1,)).copy()


def equal_bytes(x: np.ndarray) -> np.ndarray:
    """How many low bytes of a difference (exclusive or) are zero."""
    return (np.bitwise_count(~x & (x - np.uint64(1))) >> 3).astype(np.int8)


def common_prefix(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix at places that share two bytes at least, LONGEST at most."""
    n = equal_bytes(w[a + 2] ^ w[b + 2])
    more = np.flatnonzero(n == 8)
    n[more] += equal_bytes(w[a[more] + 10] ^ w[b[more] + 10])
    return n + np.int8(2)


def search(data: np.ndarray, bounds: np.ndarray, low: int, high: int, key: int, depth: int, last: bool, oldest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distance and length of the match that a hash chain finds at each place of ``low``..``high``; 0 where it finds none."""
    reach = RING - LONGEST
    a, b = max(0, low - reach), min(len(data), high + LONGEST)
    d = data[a:b]
    size = high - low
    dist, length = np.zeros(size, np.int16), np.zeros(size, np.int8)
    if len(d) < key:
        return dist, length
    i, j = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b)
    near = np.clip(bounds[i : j + 1], a, b)
    begin, end = (np.repeat(x - a, np.diff(near)) for x in (near[:-1], near[1:]))
    n = len(d) - key + 1
    codes = d[:n].astype(np.uint64)
    for k in range(1, key):
        codes |= d[k : n + k].astype(np.uint64) << np.uint64(8 * k)
    at = np.arange(n)
    at = at[(at + key <= end[:n]) & (at < high - a)]  # keys that are complete
    packed = np.sort(codes[at] << _SHIFT | at.astype(np.uint64))
    order = (packed & np.uint64((1 << 36) - 1)).astype(np.int64)
    floor = (packed >> _SHIFT) << _SHIFT | np.maximum(order - reach, begin[order]).astype(np.uint64)
    w = words(d)
    w2, w10 = w[order + 2], w[order + 10]
    most = np.minimum(LONGEST, end[order] - order).astype(np.int8)
    best, back = np.zeros(len(order), np.int8), np.zeros(len(order), np.int16)
    alive = np.flatnonzero(order >= low - a)
    place = np.searchsorted(packed, floor[alive]) if oldest else alive - 1
    for _ in range(depth):
        ok = place < alive if oldest else (place >= 0) & (packed[place] >= floor[alive])
        alive, place = alive[ok], place[ok]
        if not len(alive):
            break
        m = equal_bytes(w2[alive] ^ w2[place])
        more = np.flatnonzero(m == 8)
        m[more] += equal_bytes(w10[alive[more]] ^ w10[place[more]])
        m = np.minimum(m + np.int8(2), most[alive])
        better = m >= best[alive] if last else m > best[alive]
        won = alive[better]
        best[won], back[won] = m[better], order[won] - order[place[better]]
        if not last:
            going = best[alive] < most[alive]
            alive, place = alive[going], place[going]
        place = place + (1 if oldest else -1)
    keep = np.flatnonzero(order >= low - a)
    where = order[keep] - (low - a)
    dist[where], length[where] = back[keep], best[keep]
    return dist, length


def encode(data: np.ndarray, bounds: np.ndarray, key: int, depth: int, last: bool = False, oldest: bool = False, shortest: int = SHORTEST) -> Tokens:
    """Tokens of a hash-chain variant for each file."""
    dist, length = np.zeros(len(data), np.int16), np.zeros(len(data), np.int8)
    for low in range(0, len(data), PLACES):
        high = min(low + PLACES, len(data))
        dist[low:high], length[low:high] = search(data, bounds, low, high, key, depth, last, oldest)
    matched = length >= shortest
    step, s, at, e = np.where(matched, length, 1).astype(np.uint8).tobytes(), 0, [], len(data)
    add = at.append
    while s < e:
        add(s)
        s += step[s]
    at = np.array(at, np.int64)
    first = np.searchsorted(at, bounds)
    file = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    start, m = at - bounds[file], matched[at]
    return Tokens(first, file, start, m, np.where(m, 0, data[at]).astype(np.int32), np.where(m, START + start - dist[at] & RING - 1, 0).astype(np.int32), np.where(m, length[at], 1).astype(np.int32))


def framed_sizes(t: Tokens) -> np.ndarray:
    """Bytes of each file's payload."""
    n = np.diff(t.first)
    return -(-n // 8) + n + np.bincount(t.file[t.is_match], minlength=len(n))


def token_offsets(t: Tokens) -> np.ndarray:
    """Offset of each token's own bytes in its file's payload; the flag byte of a group lies before its first token."""
    size = 1 + t.is_match.astype(np.int64)
    ahead = np.cumsum(size) - size
    low = np.append(ahead, 0)[t.first[:-1]]
    return ahead - low[t.file] + t.idx // 8 + 1


def frame(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Payloads of all files, as ``lzss.frame`` makes them, and their bounds."""
    bounds = bounds_of(framed_sizes(t))
    out = np.zeros(bounds[-1], np.uint8)
    at, k = token_offsets(t) + bounds[t.file], t.idx
    heads = np.flatnonzero(k % 8 == 0)
    if len(heads):
        out[at[heads] - 1] = np.add.reduceat(np.where(t.is_match, 0, 0x80 >> k % 8), heads)
    m = t.is_match
    out[at[~m]] = t.lit[~m]
    out[at[m]] = t.len[m] - SHORTEST & 15 | (t.pos[m] & 15) << 4
    out[at[m] + 1] = t.pos[m] >> 4 & 0xFF
    return out ^ np.uint8(0xFF), bounds


def _groups(data: bytes, bounds: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the flag bytes of each file, and their bounds; ``sizes`` has the bytes of a group by its flags."""
    at, first = [], [0]
    add = at.append
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        while s < e:
            add(s)
            s += sizes[data[s]]
        first.append(len(at))
    return np.array(at, np.int64), np.array(first, np.int64)


def _placed(data: np.ndarray, bounds: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """file, place and is_match of each token that the data hold whole, and whether the bytes hold it; a set flag is a literal of ``unit`` bytes."""
    ones = [bin(f).count("1") for f in range(256)]
    heads, first = _groups(data.tobytes(), bounds, [1 + unit * k + 2 * (8 - k) for k in ones])
    file = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    literal = (data[heads][:, None] >> np.arange(7, -1, -1) & 1).astype(bool)
    size = np.where(literal, unit, 2)
    at = heads[:, None] + 1 + np.cumsum(size, 1) - size
    whole = at + size <= bounds[1:][file][:, None]
    file = np.broadcast_to(file[:, None], at.shape)
    return file[whole], at[whole], ~literal[whole]


def _until(file: np.ndarray, size: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cursor before each token, and whether the file's total isn't reached before it."""
    ahead = np.cumsum(size) - size
    low = np.append(ahead, 0)[np.searchsorted(file, np.arange(len(totals)))]
    start = ahead - low[file]
    return start, start < totals[file]


def read(payload: np.ndarray, bounds: np.ndarray, totals: np.ndarray) -> Tokens:
    """Tokens of all files, as ``lzss.read_tokens`` reads them where it isn't strict."""
    data = payload ^ np.uint8(0xFF)
    file, at, m = _placed(data, bounds, 1)
    a, b = data[at].astype(np.int32), np.append(data, 0)[at + 1].astype(np.int32)
    n = np.where(m, (a & 15) + SHORTEST, 1)
    start, ok = _until(file, n, totals)
    file, a, b, m, n, start = file[ok], a[ok], b[ok], m[ok], n[ok], start[ok]
    return Tokens(np.searchsorted(file, np.arange(len(totals) + 1)), file, start, m, np.where(m, 0, a), np.where(m, a >> 4 | b << 4, 0), n)


def told(t: Tokens, totals: np.ndarray) -> np.ndarray:
    """Bytes of each file that its tokens stand for, ``totals`` at most."""
    n = np.bincount(t.file, t.len, minlength=len(totals)).astype(np.int64)
    return np.minimum(n, totals)


def _copied(literals: np.ndarray, literal_at: np.ndarray, start: np.ndarray, n: np.ndarray, back: np.ndarray, low: np.ndarray, size: int, unit: int, fill: int) -> np.ndarray:
    """Units of all files: each match copies unit by unit from ``back`` behind; what lies before ``low``, its file's start, is fill."""
    out = np.full((size + 1, unit), fill, np.uint8)
    out[literal_at] = literals
    number = np.int32 if size < 1 << 30 else np.int64  # half the memory to go through
    which, ends = np.repeat(np.arange(len(n), dtype=number), n), np.cumsum(n)
    places = np.arange(len(which), dtype=number) + (start - (ends - n)).astype(number)[which]
    here = places - back.astype(number)[which]
    here[here < low.astype(number)[which]] = size  # the last unit stands for the fill
    del which
    to = np.arange(size + 1, dtype=number)
    to[places], left = here, places
    while len(left):  # each turn doubles the way
        further = to[here]
        moved = further != here
        left, here = left[moved], further[moved]
        to[left] = here
    out[places] = out[to[places]]
    return out[:size].reshape(-1)


def expand(t: Tokens, totals: np.ndarray, fill: int = FILL) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all files, as ``lzss.expand`` makes them, and their bounds."""
    bounds = bounds_of(told(t, totals))
    at, m = bounds[t.file] + t.start, t.is_match
    n = np.minimum(t.len, totals[t.file] - t.start)
    back = (START + t.start - t.pos) % RING
    back[back == 0] = RING
    return _copied(t.lit[~m, None].astype(np.uint8), at[~m], at[m], n[m], back[m], bounds[t.file[m]], int(bounds[-1]), 1, fill), bounds


def inflate_units(data: np.ndarray, bounds: np.ndarray, totals: np.ndarray, unit: int, length_mask: int, shortest: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all files of the other family, as ``lzss.inflate_units`` makes them, and their bounds."""
    file, at, m = _placed(data, bounds, unit)
    padded = np.append(data, np.zeros(unit + 1, np.uint8))
    word = padded[at].astype(np.int64) | padded[at + 1].astype(np.int64) << 8
    n = np.where(m, (word & length_mask) + shortest, 1)
    start, ok = _until(file, n, totals)
    file, at, m, word, n, start = file[ok], at[ok], m[ok], word[ok], n[ok], start[ok]
    n = np.minimum(n, totals[file] - start)
    out = bounds_of(np.bincount(file, n, minlength=len(totals)))
    to = out[file] + start
    literals = padded[at[~m][:, None] + np.arange(unit)]
    return _copied(literals, to[~m], to[m], n[m], (word[m] >> shift & 0xFFF) + 1, out[file[m]], int(out[-1]), unit, 0), out * unit


# --- columns of Arrow ---------------------------------------------------------------------------------------------


def bytes_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary or text column one behind the other, and their bounds; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def binary_column(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def passes(batches: Iterator[pa.RecordBatch], content: str, most: int = PASS) -> Iterator[pa.RecordBatch]:
    """The rows in stretches of about ``most`` bytes of content."""
    for b in batches:
        _, bounds = bytes_column(b.column(content))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def in_passes(make: Callable[[pa.RecordBatch], pa.RecordBatch], content: str = "content", most: int = PASS) -> Callable:
    """A function for ``mapInArrow`` that works on stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in passes(batches, content, most):
            yield make(b)

    return run


def filled(data: np.ndarray, bounds: np.ndarray, width: int, fill: int = FILL) -> tuple[np.ndarray, np.ndarray]:
    """Each file filled up to a multiple of ``width``."""
    sizes = np.diff(bounds)
    out = bounds_of(-(-sizes // width) * width)
    made = np.full(out[-1], fill, np.uint8)
    made[ranges(out[:-1], sizes)] = data
    return made, out


def flipped(data: np.ndarray, bounds: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Rows of each file in reverse order."""
    out = data.copy()
    for s, e, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), widths.tolist(), strict=True):
        if w and e > s:
            out[s:e] = data[s:e].reshape(-1, w)[::-1].reshape(-1)
    return out
