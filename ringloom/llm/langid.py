"""Language identification by n-gram filters that hold a bit for each language.

The filter is a Bloom filter whose cells are bitmasks of languages (bit-sliced: one look-up at the same places serves all
languages). The AND of an n-gram's cells has a bit for each language that has the n-gram, and perhaps for some that don't. A text's counts of
bits by language are put right for each language's rate of false positives; the language with the most wins.

An n-gram is four characters of a word in lower case, where a word has a blank before and after it. Learning uses a bounded sample of the
labelled rows (``sample`` a language, drawn by a hash of the id) and keeps the n-grams that make up ``rarest`` or more of their
language, so that stray foreign lines teach nothing; prediction reads whole texts of all rows and shuffles nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm._common import saved, text_chunks

#: Labelled documents a language that learning uses, about; least share of a language's n-grams, so 1 / RAREST n-grams a language at most.
SAMPLE, RAREST = 2000, 1e-4
HASHES, CELLS_PER_NGRAM = 3, 16
UNKNOWN = "und"
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> that of its small letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(low) if len(low := c.lower()) == 1 else i
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, the index of each one's text, and whether each text has a letter."""
    points = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    s = _letters()[np.minimum(points, 0x10FFFF)]
    has = np.bincount(owner[s > 0], minlength=len(texts)) > 0
    keep = s > 0
    keep[1:] |= s[:-1] > 0  # one blank after a word,
    keep[:-1] |= s[1:] > 0  # and one before it
    s, owner = s[keep].astype(np.uint64), owner[keep]
    if len(s) < 4:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    at = np.nonzero((s[1:-2] > 0) & (s[2:-1] > 0))[0]
    with np.errstate(over="ignore"):
        h = s[at] * _P[0] + s[at + 1] * _P[1] + s[at + 2] * _P[2] + s[at + 3] * _P[3]
        h = (h ^ (h >> np.uint64(29))) * _P[1]
    return h ^ (h >> np.uint64(32)), owner[at + 1], has


class Filter:
    """``cells[place]`` is a bitmask of languages, in as many words as their number needs."""

    def __init__(self, languages: list[str], shares: list[float], grams: list[np.ndarray]):
        self.languages, self.shares = languages, shares
        self.bits = max(10, int(np.ceil(np.log2(max([1, *map(len, grams)]) * CELLS_PER_NGRAM))))
        word = np.uint8 if len(languages) <= 8 else np.uint64
        self.per_word = 8 * np.dtype(word).itemsize
        self.cells = np.zeros((-(-len(languages) // self.per_word), 1 << self.bits), word)
        for i, g in enumerate(grams):
            for place in self.places(g):
                self.cells[i // self.per_word, place] |= word(1 << i % self.per_word)
        # chance that an n-gram that a language doesn't have finds its bit in all cells
        full = np.array([((self.cells[i // self.per_word] >> word(i % self.per_word)) & word(1)).mean() for i in range(len(languages))])
        self.false = full**HASHES

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(HASHES):
            yield ((h >> np.uint64(k * (64 - self.bits) // (HASHES - 1))) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits by text and language, n-grams by text, and whether each text has a letter."""
        h, owner, has = ngrams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        places = list(self.places(h))
        for w, cells in enumerate(self.cells):
            mask = cells[places[0]]
            for p in places[1:]:
                mask &= cells[p]
            for i in range(w * self.per_word, min(len(self.languages), (w + 1) * self.per_word)):
                out[:, i] = np.bincount(owner, (mask >> mask.dtype.type(i % self.per_word)) & mask.dtype.type(1), len(texts))
        return out, np.bincount(owner, minlength=len(texts)), has

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        counts, n, has = self.counts(texts)
        right = np.maximum(0, counts - n[:, None] * self.false) / (1 - np.minimum(self.false, 0.999))
        best, total = right.argmax(axis=1), right.sum(axis=1)  # ties: the language with more labelled rows
        score = np.where(total > 0, right.max(axis=1) / np.maximum(total, 1e-300), self.shares[0])
        return [(self.languages[b], float(s)) if h else (UNKNOWN, 0.0) for b, s, h in zip(best, score, has, strict=True)]


def learn(rows: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE, rarest: float = RAREST) -> Filter:
    """A filter from labelled rows. The driver gets 1 / ``rarest`` n-grams a language at most."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = [(r[lang_col], r["count"]) for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).collect()]
    if not sizes:
        return Filter([], [0.0], [])
    total = sum(n for _, n in sizes)
    share = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, min(1.0, sample / n))])[F.col(lang_col)]
    drawn = rows.where(F.pmod(F.xxhash64(id_col, F.lit("langid")), F.lit(1 << 30)) < share * (1 << 30))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                for _, texts in text_chunks(part["text"]):
                    h, n = np.unique(ngrams(texts)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": h.view(np.int64), "n": n})

    grams = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = saved(grams, "ngrams")
    of = {r["lang"]: r["of"] for r in grams.groupBy("lang").agg(F.sum("n").alias("of")).collect()}
    if of:
        least = F.create_map(*[F.lit(x) for lang, n in of.items() for x in (lang, n * rarest)])[F.col("lang")]
        grams = grams.where(F.col("n") >= least)
    found = grams.select("lang", "gram").toPandas()
    by = {lang: g.to_numpy(np.int64).view(np.uint64) for lang, g in found.groupby("lang")["gram"]}
    return Filter([lang for lang, _ in sizes], [n / total for _, n in sizes], [by.get(lang, np.zeros(0, np.uint64)) for lang, _ in sizes])


def predict(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score for each row. A text that is null or has no letter is ``und`` with score 0; a text whose words are
    all of one letter has the most frequent language, with its share as score. Ties go to the language with more labelled rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x for _, part in text_chunks(b.column(1).to_pylist()) for x in shared.value.predict(part)]
            ids = b.column(0).to_pylist()
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"{id_col} long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Learn from the labelled rows that are not held out (crc32 of the id as text is not divisible by five; a null id learns) and predict all
    rows. Without a labelled row every prediction is ``und``. Other columns are not read; no rows give no rows."""
    text_id = F.encode(F.col(id_col).cast("string"), "UTF-8")
    known = docs.where(F.coalesce(F.crc32(text_id) % 5 != 0, F.lit(True)))
    return predict(docs, learn(known, id_col, text_col, lang_col, **options), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
