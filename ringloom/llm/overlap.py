"""Exact completion of near-duplicate groups: a prefix join on word shingles.

Two sets of shingles with Jaccard similarity t or more share one of the first n - ceil(t n) + 1 shingles of each, in whatever order all sets
are sorted. Shingles that a sample of the texts shows often come last, so that the shared ones are rare. Rows that meet at a shingle
are candidates, if the shingles after it can still make up the overlap that is needed; a candidate is compared on the whole sets.

Equal word sequences are one point. Where many points meet, each is first compared with the next few; then only points that are still in
different components are, a few for each at first and in the end all, so a group of near copies needs no comparison of all its pairs. A
parity bitmap of the whole set goes along: bitmaps differ in no more bits than the sets differ in shingles, so pairs that cannot be
similar are told apart where they meet, without a row for them. Texts are read again for candidates only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.llm._common import KEY, attach, n_parts, saved
from ringloom.llm.graph import components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Texts that are looked at for frequent shingles, about; how often one must occur there, and how many are told to all tasks.
SAMPLE, OFTEN, FREQUENT = 10_000, 4, 1 << 16
#: Rows of a group that a row is compared with before components are known.
NEXT = 4
#: Candidates that a row of a group has at most in the first look at what is still apart; the last look has no bound.
FIRST = 2
#: Rows of a table of keys that is broadcast (about 40 bytes each); a larger one is joined by a shuffle.
TOLD = 1 << 16
#: Words whose hashes a task remembers.
CACHE = 1 << 16
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, SEED)
        if len(self) < CACHE:
            self[word] = h
        return h


_HASHES = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and the six ASCII spaces


def point(words: list[bytes]) -> int:
    """Node of a word sequence, signed."""
    h = xxhash.xxh3_64_intdigest(b" ".join(words), SEED)
    return h - (1 << 64) if h >> 63 else h


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """A hash for each shingle, repeats included; a shorter text is one shingle, and no words give none."""
    n = len(words)
    each = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    m = min(n, shingle)
    if not m:
        return each
    out = np.full(n - m + 1, m, np.uint64)
    for k in range(m):
        out += each[k : n - m + 1 + k] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return out ^ (out >> np.uint64(29))


def shingle_set(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    h = np.sort(shingle_hashes(words, shingle).view(np.int64))
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of the shingles' counts by their last bits, in 64 bits times a power of two; twice as many bits as shingles at least."""
    bits = 64
    while bits < 2 * len(shingles):
        bits *= 2
    return np.packbits(np.bincount((shingles & (bits - 1)), minlength=bits) & 1).astype(np.uint8).tobytes()


class Bitmaps:
    """The bitmaps of rows, as matrices by length; the longer of two is folded onto the shorter."""

    def __init__(self, maps: list[bytes]):
        self.length = np.array([len(m) for m in maps])
        self.at = np.zeros(len(maps), np.int64)
        self.own, self.folded = {}, {}
        for n in np.unique(self.length):
            rows = np.nonzero(self.length == n)[0]
            self.at[rows] = np.arange(len(rows))
            m = np.frombuffer(b"".join(maps[i] for i in rows), np.uint64).reshape(len(rows), n // 8)
            self.own[n] = m
            while n > 8:
                n, m = n // 2, m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
                self.folded[len(maps[rows[0]]), n] = m
                if n * 4 < len(maps[rows[0]]):  # sets of sizes further apart are not similar
                    break

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits that differ, for each pair; at most the number of shingles that only one of the two sets has."""
        out = np.zeros(len(i), np.int64)
        which = self.length[i] << 32 | self.length[j]
        for code in np.unique(which):
            k, a, b = np.nonzero(which == code)[0], int(code) >> 32, int(code) & 0xFFFFFFFF
            n = min(a, b)
            left = self.own[a] if a == n else self.folded.get((a, n))
            right = self.own[b] if b == n else self.folded.get((b, n))
            if left is not None and right is not None:
                out[k] = np.bitwise_count(left[self.at[i[k]]] ^ right[self.at[j[k]]]).sum(axis=1)
        return out


def enough(a, b, similarity: float):
    """Overlap that sets of these sizes need; the slack keeps rounding from asking for one more."""
    return np.ceil(similarity / (1 + similarity) * (np.asarray(a) + b) - 1e-6).astype(np.int64)


def _chunks(rows: Iterator[tuple[np.ndarray, ...]], limit: int = 1 << 16) -> Iterator[list[pa.Array]]:
    """Columns of about ``limit`` values from tuples of arrays."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[0])
        if n >= limit:
            yield [pa.array(np.concatenate(x)) for x in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [pa.array(np.concatenate(x)) for x in zip(*held, strict=True)]


def frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample, sorted by hash, and their counts. They choose an order, so results don't depend on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks((shingle_set(words_of(t.as_py()), shingle),) for b in batches for t in b.column(0)):
            yield pa.RecordBatch.from_arrays(part, names=["s"])

    n = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64("_key", "_id", F.lit("overlap")), F.lit(1 << 30)) < min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    top = drawn.select("text").mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "s").limit(FREQUENT).toPandas()
    top = top.sort_values("s")
    return top["s"].to_numpy(np.int64), top["count"].to_numpy(np.int64)


def prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """s, node, size, at: the shingles that a point may share with a similar one, and their places in the common order. A task gives
    the rows of a point once."""
    often, counts = frequent(docs, shingle)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        seen: set[int] = set()
        for b in batches:
            for text in b.column(0):
                words = words_of(text.as_py())
                node = point(words)
                if node in seen:
                    continue
                seen.add(node)
                s = shingle_set(words, shingle)
                n = len(s)
                if not n:
                    continue
                if len(often):
                    k = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    s = s[np.argsort(np.where(often[k] == s, counts[k], 0), kind="stable")]
                k = n - math.ceil(similarity * n - 1e-6) + 1
                yield s[:k], np.full(k, node), np.full(k, n, np.int32), np.arange(k, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(rows(batches)):
            yield pa.RecordBatch.from_arrays(part, names=["s", "node", "size", "at"])

    return docs.select("text").mapInArrow(run, "s long, node long, size int, at int")


def _fits(size: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows i and j of a group can be similar if this is the first shingle that they share."""
    return np.minimum(size[i] - at[i], size[j] - at[j]) >= enough(size[i], size[j], similarity)


def _batches_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows that are sorted by the first column, cut between groups."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on in the next batch
        if cut:
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in rows], strict=True)]
            held = []
        held.append([x[cut:] for x in rows])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _first_look(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: candidates among neighbours; and s, node, size, at of all groups of two or more points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _batches_of_groups(batches):
            once = np.append(True, (group[0][1:] != group[0][:-1]) | (group[1][1:] != group[1][:-1]))  # tasks may give a point again
            s, node, size, at = (x[once] for x in group)
            found = []
            for k in range(1, NEXT + 1):
                i = np.nonzero(s[k:] == s[:-k])[0]
                i = i[_fits(size, at, i, i + k, similarity)]
                found.append((node[i], node[i + k]))
            pairs = np.unique(np.concatenate([np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1) for a, b in found]), axis=0)
            _, which, n = np.unique(s, return_inverse=True, return_counts=True)
            more = n[which] > 1
            m, c = int(more.sum()), len(pairs)
            col = lambda x, y, t: pa.concat_arrays([pa.array(x, t) if x is not None else pa.nulls(c, t), pa.array(y, t) if y is not None else pa.nulls(m, t)])
            yield pa.RecordBatch.from_arrays([col(pairs[:, 0], node[more], pa.int64()), col(pairs[:, 1], None, pa.int64()), col(None, s[more], pa.int64()), col(None, size[more], pa.int32()), col(None, at[more], pa.int32())], names=["a", "b", "s", "size", "at"])

    # all groups have the same order, so that near copies have the same neighbours in each
    rows = rows.repartition(n_parts(rows.sparkSession), "s").sortWithinPartitions("s", "node")
    return rows.mapInArrow(run, "a long, b long, s long, size int, at int")


def _second_look(rows: DataFrame, similarity: float, most: int | None) -> DataFrame:
    """``rows(s, node, size, at, bits, component)`` -> a, b: candidates whose components differ, ``most`` for each row of a group (None: all).

    A pair has a row where the shingle can be the first that it shares; the others would repeat it.
    """

    def meet(group: list[np.ndarray], maps: list[bytes]) -> np.ndarray:
        s, node, size, at, component = group
        n, bits = len(s), Bitmaps(maps)
        start = np.nonzero(np.append(True, s[1:] != s[:-1]))[0]
        end = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
        given, found = np.zeros(n, np.int64), []

        def look(i: np.ndarray, j: np.ndarray) -> None:
            keep = (component[i] != component[j]) & _fits(size, at, i, j, similarity)
            i, j = i[keep], j[keep]
            need = enough(size[i], size[j], similarity)
            keep = bits.differ(i, j) <= size[i].astype(np.int64) + size[j] - 2 * need
            i, j = i[keep], j[keep]
            given[:] += np.bincount(i, minlength=n)
            found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))

        going, k = np.arange(n), 1
        while len(going):  # rows whose group has a row k places further
            going = going[going + k < end[going]]
            if most is not None:
                going = going[given[going] < most]
            for part in range(0, len(going), 1 << 16):
                look(going[part : part + (1 << 16)], going[part : part + (1 << 16)] + k)
            k += 1
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, node, size, at, component, maps in _batches_of_groups(batches):
            start = np.append(True, s[1:] != s[:-1])
            group = np.cumsum(start) - 1
            mixed = np.bincount(group, weights=component != component[np.nonzero(start)[0]][group]) > 0  # groups of several components
            rows = np.nonzero(mixed[group])[0]
            pairs = meet([x[rows] for x in (s, node, size, at, component)], [maps[i] for i in rows])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    rows = rows.select("s", "node", "size", "at", "component", "bits").repartition(n_parts(rows.sparkSession), "s").sortWithinPartitions("s", "node")
    return rows.mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, text of the points in ``pairs``."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = saved(points.join(nodes, "node").select("node", "least.*"), "needed")
    few = needed.count() <= TOLD
    return saved(docs.join(F.broadcast(needed) if few else needed, KEY).groupBy("node").agg(F.first("text").alias("text")), "texts")


def _similar(pairs: DataFrame, docs: DataFrame, points: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The candidates whose whole sets are similar enough, as a saved table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, last, left = [], None, None
            for a, x, y in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if a != last:
                    last, left = a, shingle_set(words_of(x.as_py()), shingle)
                right = shingle_set(words_of(y.as_py()), shingle)
                both = np.sort(np.concatenate([left, right]))
                keep.append(int((both[1:] == both[:-1]).sum()) >= enough(len(left), len(right), similarity))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "pairs")
    texts = _texts(docs, points, pairs)
    of = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return saved(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")


def groups(docs: DataFrame, points: DataFrame, near: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (KEY, text), ``points`` (node, bits: its bitmap, least: the KEY of a row) and ``near`` (a, b: candidates from elsewhere) -> node,
    component.

    A row for each point that has a similar one; component is the least node that links reach. All links are found, whatever ``near`` has;
    what it has joined is not compared again where many points meet.
    """
    seen = saved(_first_look(prefixes(docs, shingle, similarity), similarity), "candidates")
    links = _similar(seen.where("b is not null").select("a", "b").union(near.select("a", "b")), docs, points, shingle, similarity)
    group = saved(components(links), "components")
    rest = seen.where("b is null").select("s", F.col("a").alias("node"), "size", "at")
    counts = saved(rest.groupBy("node").agg(F.count("*").alias("n")).join(points.select("node", "bits"), "node"), "counts")
    tried = None
    for most in (FIRST, None):
        sides = saved(counts.join(group, "node", "left").withColumn("component", F.coalesce("component", "node")), "sides")
        met = _second_look(attach(rest, sides, ["node"], "n", "s"), similarity, most).distinct()
        met = saved(met if tried is None else met.join(tried, ["a", "b"], "left_anti"), "candidates")
        if met.isEmpty():
            break
        tried = met
        links = saved(links.union(_similar(met, docs, points, shingle, similarity)), "links")
        group = saved(components(links), "components")
    return group
