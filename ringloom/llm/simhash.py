"""SimHash near-duplicates by a grid range-join of segment popcounts.

A fingerprint of 64 bits is cut into 32 segments of two bits, and each segment is reduced to its count of ones. The
Manhattan distance of two count vectors never exceeds the Hamming distance of the fingerprints. Three units over two
halves of 16 segments leave at most one in one half, so every link shares, in one half, its grid cell (the count vector) or
a cell one step away. A fingerprint is placed in its own cell of each half and looks into the cells one step up; what
meets in a cell is verified on all 64 bits.

Equal fingerprints are one point before the join. A cell of near copies is not compared pair by pair: pivots cover it,
and only points that no pivot has joined yet are compared, so a cell gives fewer links than it has points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm import overlap
from ringloom.llm._common import KEY, attach, keyed, n_parts, saved
from ringloom.llm.graph import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Cells up to this size are compared by shifting the sorted rows against themselves.
SMALL_CELL = 16
_ONES = np.uint64(0x55555555)


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text, unsigned; 0 for null, empty or white text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 64):
        part = h[at : at + 255 * 64]
        ones += _ones(part)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _ones(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(h) // 255 * 255
    out = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        out += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp: the fingerprint as a signed bigint."""
    schema = docs.select(F.col(id_col), F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def cell_codes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index of the fingerprint, cell, home) of both halves: the own cell, and the cells one step up."""
    index, cells, homes = [], [], []
    for half in (0, 1):
        bits = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        code = (bits & _ONES) + ((bits >> np.uint64(1)) & _ONES)  # sixteen two-bit counts
        tag = np.uint64(half) << np.uint64(32)
        index.append(np.arange(len(fp)))
        cells.append(code | tag)
        homes.append(np.ones(len(fp), bool))
        for s in range(16):
            free = np.nonzero(((code >> np.uint64(2 * s)) & np.uint64(3)) < 2)[0]
            index.append(free)
            cells.append((code[free] + (np.uint64(1) << np.uint64(2 * s))) | tag)
            homes.append(np.zeros(len(free), bool))
    return np.concatenate(index), np.concatenate(cells).astype(np.int64), np.concatenate(homes)


def cover_links(fp: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of one cell, as index pairs, that join exactly what the links between homes and all rows join.

    First pass: a home that no pivot reaches becomes a pivot and is linked to every row in reach. Second pass: a link that
    is still missing has a home of some pivot's ward at one end, so the other end is within twice the radius of the pivot.
    """
    n = len(fp)
    label = np.arange(n)
    links: list[tuple[int, int]] = []

    def join(i: int, others: np.ndarray) -> None:
        for k, j in zip(*np.unique(label[others], return_index=True), strict=True):
            if label[i] != k:
                links.append((i, int(others[j])))
        merged = np.unique(np.append(label[others], label[i]))
        if len(merged) > 1:
            label[np.isin(label, merged)] = merged[0]

    waiting, wards = home.copy(), []
    while waiting.any():
        p = int(np.argmax(waiting))
        near = np.bitwise_count(fp ^ fp[p]) <= radius
        wards.append((p, np.nonzero(near & waiting)[0]))
        join(p, np.nonzero(near)[0])
        waiting &= ~near
    for p, ward in wards:
        rest = np.nonzero((np.bitwise_count(fp ^ fp[p]) <= 2 * radius) & (label != label[p]))[0]
        if not len(rest) or len(ward) < 2:
            continue
        step = max(1, (1 << 21) // len(rest))
        for at in range(0, len(ward), step):
            rows = ward[at : at + step]
            near = np.bitwise_count(fp[rows][:, None] ^ fp[rest][None, :]) <= radius
            for r in np.nonzero(near.any(axis=1))[0]:
                join(int(rows[r]), rest[near[r]])
    return links


def _cell_links(cell: np.ndarray, fp: np.ndarray, node: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (as nodes) of rows that are sorted by cell and hold whole cells."""
    starts = np.nonzero(np.append(True, cell[1:] != cell[:-1]))[0]
    lengths = np.diff(np.append(starts, len(cell)))
    run = np.repeat(lengths, lengths)
    a, b = [], []
    small = np.nonzero((run > 1) & (run <= SMALL_CELL))[0]
    c, f, v, h = cell[small], fp[small], node[small], home[small]
    for k in range(1, SMALL_CELL):
        if k >= len(c):
            break
        hit = np.nonzero((c[k:] == c[:-k]) & (h[k:] | h[:-k]))[0]
        hit = hit[np.bitwise_count(f[hit] ^ f[hit + k]) <= RADIUS]
        a.append(v[hit])
        b.append(v[hit + k])
    for s, n in zip(starts[lengths > SMALL_CELL], lengths[lengths > SMALL_CELL], strict=True):
        at = slice(s, s + n)
        found = np.array(cover_links(fp[at], home[at]), np.int64).reshape(-1, 2)
        a.append(node[at][found[:, 0]])
        b.append(node[at][found[:, 1]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(points: DataFrame) -> DataFrame:
    """``points(fp, node)``, distinct fingerprints -> ``a, b``: links with the components of all links."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, len(fp), 4096):
                i, cell, home = cell_codes(fp[at : at + 4096].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[at : at + 4096][i]), pa.array(node[at : at + 4096][i]), pa.array(home)], names=["cell", "fp", "node", "home"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cell, fp, node, home = (np.concatenate(x) for x in zip(*rows, strict=True))
            a, b = _cell_links(cell, fp.view(np.uint64), node, home)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last cell may go on in the next batch
            if cut:
                yield out([*held, tuple(x[:cut] for x in rows)])
                held = []
            held.append(tuple(x[cut:] for x in rows))
        if held:
            yield out(held)

    cells = points.select("fp", "node").mapInArrow(place, "cell long, fp long, node long, home boolean")
    cells = cells.repartition(n_parts(points.sparkSession), "cell").sortWithinPartitions("cell")
    return cells.mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the least id that links reach), for every input row.

    Null, empty and white texts have fingerprint zero and link with each other and with what is near zero. Rows with equal
    ids or equal texts are rows of their own. A row with a null id links as any other; where a component
    has no other id, component_id is null. Other columns are not read; no rows give no rows.
    """
    prints = saved(fingerprints(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), id_col, text_col), "simhash")
    points = saved(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")).withColumn("node", F.col("fp")), "points")  # ids may repeat, fingerprints don't
    points = points.join(components(links(points)), "node", "left")
    points = saved(points.select("fp", "n", "least", F.coalesce("component", "node").alias("root")), "points")
    roots = saved(points.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("points")), "roots")
    points = saved(attach(points, roots, ["root"], "points", "fp").select("fp", "n", "component_id"), "points")
    return attach(prints, points, ["fp"], "n", id_col).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprint(words: list[bytes], shingle: int) -> int:
    """SimHash of a word sequence by its shingles of any width, repeats included; signed, 0 for no words."""
    h = overlap.shingle_hashes(words, shingle)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 64):
        ones += _ones(h[at : at + 255 * 64])
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates: that of the least id, and of rows that share it the one whose text hashes least.

    Texts are near-duplicates if the Jaccard similarity of their word shingles is ``similarity`` or more, and so are those that such texts
    link. The grid range-join of the fingerprints of these shingles finds candidates, which are verified on the whole sets. A similarity
    of 0.8 leaves about ten of 64 bits different, more than any grid can bridge, so ``overlap`` adds the links that the grid doesn't see.
    Null, empty and white texts are equal to each other and similar to nothing else. A null id comes after all others. Rows with equal
    ids are rows of their own. Other columns go with the row; no rows give no rows.
    """
    texts, key = keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, bits = [], [], []
            for t in b.column(3):  # the words of one text at a time
                words = overlap.words_of(t.as_py())
                node.append(overlap.point(words))
                fp.append(wide_fingerprint(words, shingle))
                bits.append(overlap.bitmap(overlap.shingle_set(words, shingle)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(bits, pa.binary())], names=[*KEY, "node", "fp", "bits"])

    rows = texts.mapInArrow(run, "_none boolean, _id long, _key long, node long, fp long, bits binary")
    points = saved(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.first("bits").alias("bits"), F.min(F.struct(*KEY)).alias("least")), "points")
    near = saved(links(points), "near")
    group = overlap.groups(texts, points, near, shingle, similarity)
    least = points.join(group, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("least"))
    least = saved(least.select("least.*").distinct(), "kept")
    return docs.withColumns(key).join(least, KEY, "left_semi").dropDuplicates(KEY).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
