"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph is hashed into a wide vector: 16 lanes of 32 bits, which are the 64 bytes of its BLAKE2b digest, and 256 lanes of 16 bits that
sum +1 or -1 for each of its five-word shingles. A document's fingerprint is the sum of the vectors of its paragraphs (the
non-empty lines), each lane modulo its power of two. So the order of paragraphs doesn't matter, and a paragraph is put in or taken
out by adding or subtracting its vector. The narrow lanes are also a random projection of the counts of shingles, so the cosine
of two documents' lanes estimates that of their shingle counts, with a standard error of 1/16 at most.

Neighbours in ascending order of ids meet without a global sort: rows go to ranges of ids, and the first rows of a range are
also sent to the range before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm._common import bucket_of, key_ranges, n_parts

SHINGLE, WIDE, NARROW = 5, 16, 256
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(SHINGLE)]
#: A null id sorts before all others.
_NULL_KEY = -(1 << 63)


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    """n further 64-bit words from each hash, by splitmix64."""
    with np.errstate(over="ignore"):
        z = h[:, None] + _MIX[0] * np.arange(1, n + 1, dtype=np.uint64)
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    return z ^ (z >> np.uint64(31))


class Fingerprint:
    """Two vectors; + and - are those of multisets of paragraphs."""

    __slots__ = ("narrow", "wide")

    def __init__(self, wide: np.ndarray, narrow: np.ndarray):
        self.wide, self.narrow = wide, narrow

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        paragraphs = [p for p in text.encode("utf-8", "surrogatepass").split(b"\n") if p]
        if not paragraphs:
            return cls(np.zeros(WIDE, np.uint32), np.zeros(NARROW, np.int16))
        digest = xxhash.xxh64_intdigest
        # every lane has bits of its own, so paragraphs that clash in one lane don't in the others
        lanes = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=4 * WIDE).digest() for p in paragraphs), "<u4").reshape(-1, WIDE)
        wide = lanes.sum(axis=0, dtype=np.uint64).astype(np.uint32)
        whole = lanes[:, 0].astype(np.uint64) << np.uint64(32) | lanes[:, 1]
        words = [p.split() for p in paragraphs]
        lengths = np.array(list(map(len, words)))
        each = np.fromiter((digest(w) for p in words for w in p), np.uint64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        n = max(0, len(each) - SHINGLE + 1)
        with np.errstate(over="ignore"):
            shingles = np.zeros(n, np.uint64)
            for i, p in enumerate(_POWERS):
                shingles += each[i : i + n] * p
        shingles = shingles[owner[:n] == owner[SHINGLE - 1 :]] if n else shingles
        shingles = np.concatenate([shingles, whole[lengths < SHINGLE]])
        narrow = np.zeros(NARROW, np.int64)
        for at in range(0, len(shingles), 4096):
            bits = np.unpackbits(_spread(shingles[at : at + 4096], NARROW // 64).view(np.uint8).reshape(-1, NARROW // 8), axis=1)
            for k in range(0, len(bits), 255):
                narrow += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
        return cls(wide, (2 * narrow - len(shingles)).astype(np.int16))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide + other.wide, self.narrow + other.narrow)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide - other.wide, self.narrow - other.narrow)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.hex() == other.hex()

    def __hash__(self) -> int:
        return hash(self.hex())

    def hex(self) -> str:
        return (self.wide.astype("<u4").tobytes() + self.narrow.astype("<i2").tobytes()).hex()

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints; else the cosine of the narrow lanes, 0 at least."""
        if np.array_equal(self.wide, other.wide) and np.array_equal(self.narrow, other.narrow):
            return 1.0
        a, b = self.narrow.astype(np.float64), other.narrow.astype(np.float64)
        size = np.sqrt((a @ a) * (b @ b))
        return float(min(1.0, max(0.0, a @ b / size))) if size else 0.0


def edited(text: str, following: str) -> tuple[str, str, str]:
    """The text whose last quarter is replaced by the head of the following one, and the lines that go and come."""
    k = len(text) // 4
    kept = text[: len(text) - k]
    new, line = kept + following[:k], kept.rfind("\n") + 1
    return new, text[line:], new[line:]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The order is that of (id, text), a null id first; after the last row comes the first. A null text is empty; an empty document's
    fingerprint is zero in all lanes. A lone document follows itself. Rows with equal ids are rows of their own. Other columns are not
    read; no rows give no rows. Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_KEY)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = key_ranges(rows, "k", n_parts(spark))
    rows = rows.withColumn("b", bucket_of("k", cuts))
    firsts = sorted((r["b"], r["k"]) for r in rows.groupBy("b").agg(F.min("k").alias("k")).collect())  # a row for each range
    back = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}
    sent = F.array(F.struct("b", F.lit(0).alias("ahead")))
    if back:
        to = F.create_map(*[F.lit(x) for pair in back.items() for x in pair])[F.col("k")]
        sent = F.when(F.col("k").isin(*back), F.array(F.struct("b", F.lit(0).alias("ahead")), F.struct(to.alias("b"), F.lit(1).alias("ahead")))).otherwise(sent)
    rows = rows.select("k", "text", F.explode(sent).alias("s")).select("s.b", "s.ahead", "k", "text")
    rows = rows.repartitionById(len(cuts) + 1, F.col("b")).sortWithinPartitions("ahead", "k", "text")
    fields = pa.schema([(id_col, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, text, fingerprint
        for b in batches:
            out = []
            for ahead, k, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if last is None and ahead:
                    break
                text = text.as_py()
                now = (k, text, Fingerprint.of(text))
                if last:
                    out.append(_row(last, now))
                last = None if ahead else now
                if ahead:
                    break
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(fields), fields.types, strict=True)], schema=fields)
            if out and last is None:
                return

    return rows.mapInArrow(run, f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _row(one: tuple, following: tuple) -> tuple:
    k, text, mark = one
    new, gone, come = edited(text, following[1])
    changed = mark - Fingerprint.of(gone) + Fingerprint.of(come)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return None if k == _NULL_KEY else k, len(text), digest, mark.hex(), changed.hex(), mark.likeness(changed), mark.likeness(following[2])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
