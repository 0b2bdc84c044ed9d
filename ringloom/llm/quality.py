"""Document quality by hierarchical empirical Bayes.

A logistic classifier over surface features and the words of a text gives each document's evidence as a likelihood ratio. The words speak
through one feature, the mean of the log odds of the distinct words' hash buckets; the odds that a labelled row meets are counted on the
other half of the labelled rows, so that they are as good as on new texts. The prior that the evidence meets is not the global rate but the rate of the document's site: paths are shrunk toward their host and hosts toward all documents, each level
by as many pseudo-documents as the spread between its groups calls for (moment estimate of a beta prior). A site that has
few documents thus speaks with its parent's voice. A document's own score is left out of the rates that judge it.

Rates come from grouped sums of scores. The classifier is fitted on a bounded sample of labelled rows (``SAMPLE``, drawn by a hash
of the id); everything else covers all documents.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm._common import KEY, attach, keyed, saved

#: Labelled rows that the classifier is fitted on, about; buckets of words; rows of the average kind that are added to a bucket.
SAMPLE, BUCKETS, CALM = 20_000, 1 << 14, 4.0
FEATURES = ("words", "repeats", "variety", "upper", "marks", "digits", "word_length", "line_repeats", "sentence", "lexical")
_MARKS = [i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,'-"]
_UPPER, _LOWER, _DIGITS = slice(65, 91), slice(97, 123), slice(48, 58)
_STRIP = b".,;:!?#$%&*|()[]{}\"'"


class _Buckets(dict):
    """Bucket of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        k = xxhash.xxh3_64_intdigest(word.strip(_STRIP).lower()) % BUCKETS
        if len(self) < 1 << 16:
            self[word] = k
        return k


_BUCKET = _Buckets()


def buckets(words: Iterable[bytes]) -> np.ndarray:
    """Buckets of distinct words, sorted, each once."""
    return np.unique(np.fromiter(map(_BUCKET.__getitem__, words), np.int64))


def features(text: str | None, odds: np.ndarray) -> list[float]:
    """Features of a whole text, with the log odds of each bucket; all zero for null, empty and white text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = by[_UPPER].sum() + by[_LOWER].sum() + by[0xC3]  # most letters beyond ASCII here start so in UTF-8
    size = len(data) - by[32] - by[10]
    repeats = sum(map(operator.eq, words, words[1:])) / n
    distinct = set(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        math.log1p(n) / 10,
        min(1.0, 4 * repeats),
        len(distinct) / n * min(1.0, math.log1p(n) / 6),
        float(by[_UPPER].sum() / max(1, letters)),
        min(1.0, 2 * float(by[_MARKS].sum()) / n),
        min(1.0, 5 * float(by[_DIGITS].sum()) / max(1, size)),
        min(1.0, size / n / 20),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, 5 * float(by[46]) / n),
        float(odds[buckets(distinct)].mean()),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method with a ridge penalty."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x1.shape[1]), np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty + 1e-9), x1.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def log_odds(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``counts[label, bucket]`` of ``rows[label]`` rows -> how much likelier a good row has the bucket, as a logarithm."""
    share = (counts.sum(axis=0) + 1.0) / (rows.sum() + 2.0)
    rate = (counts + CALM * share) / (rows[:, None] + CALM)
    return np.log(rate[1] / rate[0])


class Model:
    """Log odds of buckets, weights and intercept, and the rate of good rows among those it was fitted on."""

    def __init__(self, odds: np.ndarray, weights: np.ndarray, intercept: float, rate: float):
        self.odds, self.weights, self.intercept, self.rate = odds, weights, intercept, rate

    def score(self, text: str | None) -> float:
        z = float(np.dot(features(text, self.odds), self.weights)) + self.intercept
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """With labels of one kind only, the weights are zero and the rate is smoothed."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30)) < min(1.0, sample / max(1, n)) * (1 << 30))
    drawn = drawn.withColumn("code", (2 * F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) + F.when(F.col("y") > 0.5, 1).otherwise(0)).cast("int"))
    drawn = F.broadcast(drawn.select("id", "code"))  # about ``sample`` rows
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(drawn, "id").select("code", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((4, BUCKETS + 1), np.int64)  # the last one counts rows
        for b in batches:
            for code, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen[code, buckets(set((text.as_py() or "").encode("utf-8", "surrogatepass").split()))] += 1
                seen[code, BUCKETS] += 1
        code, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(bucket), pa.array(seen[code, bucket])], names=["code", "bucket", "n"])

    counts = np.zeros((2, 2, BUCKETS + 1))  # half, label
    for code, bucket, k in rows.mapInArrow(count, "code long, bucket long, n long").groupBy("code", "bucket").agg(F.sum("n")).collect():  # 4 (BUCKETS + 1) rows at most
        counts[code // 2, code % 2, bucket] = k
    of = counts[:, :, BUCKETS].sum(axis=0)
    rate = (of[1] + 1) / (of.sum() + 2)
    if not of.min():
        return Model(np.zeros(BUCKETS), np.zeros(len(FEATURES)), math.log(rate / (1 - rate)), rate)
    halves = [log_odds(counts[h, :, :BUCKETS], counts[h, :, BUCKETS]) for h in (0, 1)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(0).to_pylist()
            x = [features(t.as_py(), halves[1 - c // 2]) for c, t in zip(codes, b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([float(c % 2) for c in codes], pa.float64()), *(pa.array(c, pa.float64()) for c in (zip(*x, strict=True) if x else [[]] * len(FEATURES)))], names=["y", *FEATURES])

    table = rows.mapInArrow(describe, ", ".join(f"{c} double" for c in ("y", *FEATURES))).toPandas()  # about ``sample`` rows
    w, b = fit_logistic(table[list(FEATURES)].to_numpy(), table["y"].to_numpy())
    whole = counts.sum(axis=0)
    return Model(log_odds(whole[:, :BUCKETS], whole[:, BUCKETS]), w, b, rate)


def score_table(docs: DataFrame, model: Model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, host, path (null: empty) and p, the classifier's score, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([model.score(t.as_py()) for t in b.column(4)], pa.float64())], names=["id", "text_key", "host", "path", "p"])

    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"), name(host).alias("host"), name(path).alias("path"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_key long, host string, path string, p double")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-documents of the prior: the less the groups differ beyond chance, the more. From sums over the groups."""
    gap = F.col("s") / F.col("n") - mean
    r = groups.where("n > 1").agg(F.sum(F.col("n") * gap * gap).alias("seen"), F.sum(mean * (1 - mean)).alias("chance"), F.sum("n").alias("n"), F.sum(F.col("n") * mean * (1 - mean)).alias("scale")).first()
    if not r["n"]:
        return 10.0
    between = (r["seen"] - r["chance"]) / r["n"]
    return min(1e6, max(1.0, r["scale"] / r["n"] / max(between, 1e-9) - 1))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """id, text_key (a hash of the text), score (the classifier's alone), host_rate, path_rate, posterior, kept, for each input row.

    Host and path default to ``source`` and ``lang`` (pages of a site lie in a section for each language). A null host or path is a site of
    its own. Null, empty and white texts have zero features and get what these imply. Rows with equal ids or texts are rows of
    their own; labels whose id is null or repeated add their rows as they are. Without labels every document scores alike and is kept.
    Other columns are not read; no rows give no rows. Texts are not shuffled.
    """
    model = learn(docs, labels, label_col, id_col, text_col)
    rate = model.rate
    scored = saved(score_table(docs, model, F.col("source") if host is None else host, F.col("lang") if path is None else path, id_col, text_col), "scores")
    paths = saved(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = saved(paths.groupBy("host").agg(F.count("*").alias("paths"), F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total["n"]:
        return scored.select(F.col("id").alias(id_col), "text_key", F.col("p").alias("score"), *[F.lit(0.0).alias(c) for c in ("host_rate", "path_rate", "posterior")], F.lit(True).alias("kept"))
    mean = total["s"] / total["n"]
    a = _strength(hosts, F.lit(mean))
    host_rate = (a * mean + F.col("host_s")) / (a + F.col("host_n"))
    paths = attach(paths, hosts.withColumnsRenamed({"n": "host_n", "s": "host_s"}), ["host"], "paths", "path")
    paths = saved(paths, "paths")
    c = _strength(paths, host_rate)
    rows = attach(scored, paths.withColumn("path_n", F.col("n")), ["host", "path"], "n", "id")
    own = F.col("p")
    # one's own score is taken out of both sums
    host_rate = (a * mean + F.greatest(F.col("host_s") - own, F.lit(0.0))) / (a + F.col("host_n") - 1)
    path_rate = (c * F.col("host_rate") + F.greatest(F.col("s") - own, F.lit(0.0))) / (c + F.col("path_n") - 1)
    evidence = _logit(own) - math.log(rate / (1 - rate))
    rows = rows.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate).withColumn("posterior", 1 / (1 + F.exp(-(evidence + _logit(F.col("path_rate"))))))
    return rows.select(F.col("id").alias(id_col), "text_key", own.alias("score"), "host_rate", "path_rate", "posterior", (F.col("posterior") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps. Rows with equal ids and texts stay if one of them is kept; a null id is an id."""
    kept = classify(docs, labels, id_col=id_col, text_col=text_col, **options).where("kept")
    kept = kept.select(F.col(id_col).isNull().alias("_none"), F.coalesce(F.col(id_col), F.lit(0).cast("long")).alias("_id"), F.col("text_key").alias("_key")).distinct()
    _, key = keyed(docs, id_col, text_col)
    return docs.withColumns(key).join(kept, KEY, "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
