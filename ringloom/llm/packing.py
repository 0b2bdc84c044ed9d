"""Best-fit packing of token pieces into sequences of a fixed capacity.

Only the length histogram (at most ``capacity`` rows) reaches the driver. The configuration linear program over classes of the
longer lengths is solved by multiplicative weights: a class that earlier configurations cover too little has a higher price,
and a knapsack by dynamic programming finds the configuration of the highest price. The solution is rounded down; its slots take actual
lengths, the last one those that fill the sequence best; what is left, with most short lengths, goes by best fit, in descending order,
into the gaps and then into new sequences. All of this works on counts of equal sequences, so that its cost doesn't grow with the corpus.

The plan is a list of runs (length, first rank, count, first sequence, offset): the piece with that rank among the pieces of its
length goes to the sequence of that rank. Ranks are counted in salted groups, so a length that a third of all pieces share is
no task's burden.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm._common import grouped_rank, saved
from ringloom.llm.tokens import default_tokenizer, task_encoder

CAPACITY = 4096
#: Classes of the linear program, its rounds, and how fast its weights move.
CLASSES, ROUNDS, RATE = 48, 1500, 0.12
#: Lengths up to this share of the capacity are left for the gaps.
SHORT = 1 / 16


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int | None = 1, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and cut those longer than ``capacity``: id, piece, start, length, ids_crc32 (and the ids in bytes).

    A null or empty text is its end id alone; without an end id it gives no piece.
    """
    tokenizer = tokenizer or default_tokenizer()
    tail = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(tokenizer) as code:
            for b in batches:
                rows, held = [], 0
                for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                    ids = code.encode(text.as_py()) + tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id.as_py(), k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                        held += len(part) * with_ids
                    if held > 1 << 24:
                        yield _batch(rows, id_col, with_ids)
                        rows, held = [], 0
                yield _batch(rows, id_col, with_ids)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(cut, schema)


def _batch(rows: list, id_col: str, with_ids: bool) -> pa.RecordBatch:
    fields = [(id_col, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def knapsack(sizes: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size for the highest price within the capacity, by dynamic programming over bundles of 1, 2, 4, ..."""
    best, taken = np.zeros(capacity + 1), []
    for k, (size, price) in enumerate(zip(sizes, prices, strict=True)):
        left, bundle = int(min(most[k], capacity // size)), 1
        while left > 0:
            n = min(bundle, left)
            if (w := n * int(size)) <= capacity:
                new = best[:-w] + n * price
                won = np.zeros(capacity + 1, bool)
                won[w:] = new > best[w:]
                best[w:] = np.maximum(best[w:], new)
                taken.append((k, n, w, won))
            left -= n
            bundle *= 2
    out, at = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    for k, n, w, won in reversed(taken):
        if won[at]:
            out[k] += n
            at -= w
    return out


def solve_lp(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> dict[tuple, float]:
    """Configurations and how many sequences of each, so that on average each class is covered."""
    weights, cover = np.ones(len(sizes)), np.zeros(len(sizes))
    solution: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        config = knapsack(sizes, weights / counts, counts, capacity)
        gain = config / counts
        step = 1 / gain.max()
        solution[tuple(config)] += step
        cover += step * gain
        weights *= np.exp(-rate * step * gain)
        weights /= weights.max()
    held = sizes * counts
    scale = held.sum() / (held * cover).sum()
    return {c: x * scale for c, x in solution.items()}


class _Open:
    """Groups of equal sequences, by the gap that they have."""

    def __init__(self, capacity: int):
        self.capacity, self.gaps = capacity, defaultdict(list)

    def add(self, count: int, items: tuple) -> None:
        gap = self.capacity - sum(size * n for size, n in items)
        if gap < 0:
            raise AssertionError("over capacity")
        self.gaps[gap].append((count, items))

    def best_fit(self, size: int, n: int) -> None:
        """Put ``n`` pieces of ``size`` into the smallest gaps that hold one, then into new sequences."""
        for gap in sorted(g for g in self.gaps if g >= size):
            fit = gap // size
            while n and self.gaps[gap]:
                count, items = self.gaps[gap].pop()
                full = min(count, n // fit)
                if full:
                    self.add(full, (*items, (size, fit)))
                    n -= full * fit
                    count -= full
                if count and n:  # fewer than fit are left
                    self.add(1, (*items, (size, n)))
                    n, count = 0, count - 1
                if count:
                    self.gaps[gap].append((count, items))
            if not n:
                return
        fit = self.capacity // size
        if full := n // fit:
            self.add(full, ((size, fit),))
        if n % fit:
            self.add(1, ((size, n % fit),))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple]]:
    """Length histogram -> [(how many sequences, ((length, how often), ...))], longest first within a sequence."""
    left = {int(k): int(n) for k, n in histogram.items() if n}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    done = _Open(capacity)
    if n := left.pop(capacity, 0):
        done.add(n, ((capacity, 1),))
    long = np.array(sorted(k for k in left if k > capacity * SHORT), np.int64)
    if len(long):
        n = np.array([left[k] for k in long], np.int64)
        share = (np.cumsum(n) - 1) * CLASSES // n.sum()
        groups = [long[share == s] for s in np.unique(share)]
        sizes, counts = np.array([g[-1] for g in groups]), np.array([sum(left[k] for k in g) for g in groups])
        alive = sorted(left)
        for config, x in sorted(solve_lp(sizes, counts, capacity).items(), key=lambda c: -c[1]):
            wanted = [(groups[k], int(config[k])) for k in np.nonzero(config)[0][::-1]]
            wanted[-1] = (wanted[-1][0], wanted[-1][1] - 1)  # the last slot takes what fills the sequence best
            m = int(x)
            while m:  # sequences with the same actual lengths at a time
                items = _fill(wanted, left, alive, capacity)
                if items is None:
                    break
                same = min(m, *(left[size] // often for size, often in items.items()))
                for size, often in items.items():
                    left[size] -= same * often
                    if not left[size]:
                        alive.remove(size)
                done.add(same, tuple(sorted(items.items(), reverse=True)))
                m -= same
    for size in sorted(left, reverse=True):
        if left[size]:
            done.best_fit(size, left[size])
    return [x for gap in sorted(done.gaps) for x in done.gaps[gap]]


def _fill(wanted: list, left: dict[int, int], alive: list[int], capacity: int) -> dict[int, int] | None:
    """Actual lengths for one sequence: the longest of each wanted class, then the longest that still fits; None if a class is used up."""
    items: dict[int, int] = defaultdict(int)
    gap = capacity
    for group, need in wanted:
        for size in group[::-1].tolist():
            take = min(need, left[size])
            if take:
                items[size] += take
                need -= take
                gap -= take * size
            if not need:
                break
        if need:
            return None
    while at := bisect.bisect_right(alive, gap):
        while at and left[alive[at - 1]] <= items.get(alive[at - 1], 0):
            at -= 1
        if not at:
            break
        size = alive[at - 1]
        take = min(gap // size, left[size] - items.get(size, 0))
        items[size] += take
        gap -= take * size
    return items or None


def runs_of(groups: list[tuple[int, tuple]]) -> np.ndarray:
    """The plan as rows (length, first rank, count, first sequence, offset), sorted by length and rank."""
    rank: dict[int, int] = defaultdict(int)
    sequence, rows = 0, []
    for count, items in groups:
        offset = 0
        for size, often in items:
            for _ in range(often):
                rows.append((size, rank[size], count, sequence, offset))
                rank[size] += count
                offset += size
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def assign(parts: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to a saved table of pieces."""
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = runs_of(plan(histogram, capacity))
    ranked = grouped_rank(parts, ["length"], [id_col, "piece", "ids_crc32"], "rank")
    key = runs[:, 0] << 48 | runs[:, 1]
    fields = [*ranked.drop("rank").schema.fieldNames(), "sequence_id", "offset"]
    schema = ranked.drop("rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            run = runs[np.searchsorted(key, length << 48 | rank, side="right") - 1] if b.num_rows else runs[:0]
            sequence, offset = run[:, 3] + rank - run[:, 1], run[:, 4]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in fields[:-2]), pa.array(sequence), pa.array(offset)], names=fields)

    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Equal ids and equal texts are pieces of their own; null ids too. Other columns are not read; no rows give no rows.
    """
    return assign(saved(pieces(docs, capacity, id_col=id_col, **options), "pieces"), capacity, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
