"""Mixing documents to target weights of domains that each document belongs to softly.

A naive Bayes classifier, learned from a labelled table over the most telling words, gives each document's posterior
over the domains. Then nonnegative rates are fitted so that the expected tokens of each domain (the sum over documents of rate, tokens
and posterior) meet the targets with rates as near to 1 as can be. Newton's method on the dual does it: there is one unknown for each
domain, a step needs the sums of each domain and each pair of domains over all documents, and the driver holds these sums alone; a
document's rate is an expression of its posterior.

DataFrame functions only: no Python runs on the executors. Only the vocabulary (``WORDS`` rows) is broadcast.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm._common import saved

#: Labelled rows that the classifier learns from, about; words that it looks at, at most; in how many of these rows a word must be.
SAMPLE, WORDS, LEAST = 20_000, 256, 8
#: A term is telling if it makes some domain so many times likelier, after so many average rows are added to it.
LIFT, CALM = 2.5, 10
#: Newton steps at most (ten or so are needed), and the gap, relative to a domain's tokens, at which a target is met.
STEPS, CLOSE = 100, 1e-4
#: What rates away from 1 cost against gaps: where not all targets can be met, and where they can.
EASE, FIRM = 1e-4, 1e-8
#: Shares of tokens by domain: documents that pass, with a trace of toxic ones, and no junk.
TARGETS = {"clean": 0.98, "toxic": 0.02, "junk": 0.0}
_ALL, _MARKS = "#all", ".,;:?!#$%&*|\"'()\t\r"


def label_domain() -> Column:
    """Domain of a row of the labelled table."""
    return F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, tokens (words between spaces and line ends) and terms: the distinct words of the whole text without the marks around
    them, with a term for each surface trait, and one that all have.

    A text is cut once, at a single character, and lowered once: these passes are most of what the operator costs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ")
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text")).withColumn("words", words)
    out = out.withColumns({"tokens": F.size(F.array_remove("words", "")).cast("long"), "terms": F.array_remove(F.array_distinct("words"), ""), "loud": F.regexp_count("text", F.lit("[A-Z!#$%&*|]")), "long": F.length("text")})
    tenth = lambda part, whole: F.floor(10 * part / F.greatest(whole, F.lit(1))).cast("string")
    traits = [F.lit(_ALL), F.concat(F.lit("#variety"), tenth(F.size("terms"), F.col("tokens")), F.lit("/"), F.length(F.col("tokens").cast("string")).cast("string")), F.concat(F.lit("#loud"), tenth(F.col("loud"), F.col("long") / 2))]
    bare = F.transform("terms", lambda w: F.btrim(w, F.lit(_MARKS)))
    return out.select("id", "text_key", "tokens", F.concat(bare, F.array(*traits)).alias("terms"))


def learn(docs: DataFrame, labels: DataFrame, domain: Column, names: list[str], id_col: str, text_col: str, sample: int = SAMPLE) -> DataFrame:
    """term, w0, w1, ...: the logarithm of what a term's presence makes of each domain's share, WORDS + 1 rows at most. The term that all
    have carries the shares themselves and what the absence of every term says; a present term takes its own absence back."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), domain.alias("domain")).where(F.col("id").isNotNull() & F.col("domain").isin(names))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit("mixing")), F.lit(1 << 30)) < min(1.0, sample / max(1, n)) * (1 << 30))
    drawn = F.broadcast(drawn)  # about ``sample`` rows
    few = docs.join(drawn.select(F.col("id").alias(id_col)), id_col, "left_semi")  # only their texts are cut into words
    seen = _rows(few, id_col, text_col).join(drawn, "id").select("domain", F.explode_outer(F.array_distinct("terms")).alias("term"))
    counts = [F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(names)]
    terms = saved(seen.groupBy("term").agg(*counts), "terms")
    of = terms.where(F.col("term") == _ALL).first()
    size = [of[f"n{k}"] if of else 0 for k in range(len(names))]
    total = sum(size)
    n_all = sum((F.col(f"n{k}") for k in range(len(names))), F.lit(0))
    share = [(n + 1) / (total + len(names)) for n in size]
    # how much likelier a domain is with the term than without looking; CALM rows of the average kind hold rare terms back
    lift = [(F.col(f"n{k}") + CALM * share[k]) / ((n_all + CALM) * share[k]) for k in range(len(names))]
    tells = sum((F.col(f"n{k}") * F.log(lift[k]) for k in range(len(names))), F.lit(0.0))
    chosen = terms.where((F.col("term") != _ALL) & (n_all >= LEAST) & (F.greatest(*lift, F.lit(0.0)) >= LIFT)).orderBy(tells.desc(), "term").limit(WORDS)
    absent = [F.log(1 - (F.col(f"n{k}") + 0.5) / (n + 1.0)) for k, n in enumerate(size)]
    present = chosen.select("term", *[(F.log(x) - absent[k]).alias(f"w{k}") for k, x in enumerate(lift)])
    base = chosen.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"a{k}") for k, x in enumerate(absent)])
    base = base.select(F.lit(_ALL).alias("term"), *[(F.col(f"a{k}") + math.log(x)).alias(f"w{k}") for k, x in enumerate(share)])
    return saved(present.union(base), "vocabulary")


def posteriors(rows: DataFrame, vocabulary: DataFrame, k: int) -> DataFrame:
    """id, text_key, tokens, copies_in, p0, p1, ...: one row for all rows with the same id and text.

    Only telling terms become rows (``vocabulary`` has WORDS + 1 of them at most), and by ``explode_outer``: ``explode`` lets the optimizer put a
    filter on the size of its array below the projections, which would cut every text into words again.
    """
    telling = F.array_intersect("terms", F.array(*[F.lit(r["term"]) for r in vocabulary.select("term").collect()]))
    found = rows.select("id", "text_key", "tokens", F.explode_outer(telling).alias("term")).join(F.broadcast(vocabulary), "term")
    n = F.count_if(F.col("term") == _ALL)
    scores = found.groupBy("id", "text_key").agg(F.first("tokens").alias("tokens"), n.alias("copies_in"), *[(F.sum(f"w{i}") / n).alias(f"w{i}") for i in range(k)])
    top = F.greatest(*[f"w{i}" for i in range(k)]) if k > 1 else F.col("w0")
    e = [F.exp(F.col(f"w{i}") - top) for i in range(k)]
    whole = sum(e[1:], e[0])
    return scores.select("id", "text_key", "tokens", "copies_in", *[(x / whole).alias(f"p{i}") for i, x in enumerate(e)])


def fit_rates(table: DataFrame, targets: list[float], steps: int = STEPS) -> tuple[Column, list[float], list[float]]:
    """The rate as an expression, what each domain has before, and what it is to have.

    The largest domain by target keeps its tokens, which sets the total. The rates minimise ease * sum(tokens * (rate - 1)^2) + sum(gap^2 /
    scale); then the rate is 1 plus a combination of the posteriors, or zero. If not all targets are met so, the smallest ease is tried,
    which meets all that can be met together; where it doesn't, EASE holds back rates far from 1, and a warning tells the gaps.
    """
    ks = range(len(targets))
    pairs = [(k, m) for k in ks for m in ks if k <= m]
    weight = F.col("tokens") * F.col("copies_in")

    def rate(at: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), sum((F.lit(float(x)) * F.col(f"p{k}") for k, x in enumerate(at)), F.lit(1.0)))

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Of tokens: rate squared, by domain, by pair of domains among rows whose rate isn't zero."""
        live = weight * F.when(F.col("_rate") > 0, 1.0).otherwise(0.0)
        found = table.withColumn("_rate", rate(at)).agg(F.sum(weight * F.col("_rate") * F.col("_rate")), *[F.sum(weight * F.col("_rate") * F.col(f"p{k}")) for k in ks], *[F.sum(live * F.col(f"p{k}") * F.col(f"p{m}")) for k, m in pairs]).first()
        found = np.array([x or 0.0 for x in found], float)
        square = np.zeros((len(ks), len(ks)))
        for (k, m), x in zip(pairs, found[1 + len(ks) :], strict=True):
            square[k, m] = square[m, k] = x
        return float(found[0]), found[1 : 1 + len(ks)], square

    start = sums(np.zeros(len(ks)))
    before = start[1]
    lead = max(ks, key=lambda k: targets[k])
    wanted = before[lead] * np.array(targets, float) / targets[lead]
    scale = np.maximum(np.maximum(before, wanted), 1.0)

    def settle(at: np.ndarray, now: tuple, ease: float) -> tuple[np.ndarray, tuple] | None:
        cost = lambda at, now: now[0] / 2 - wanted @ at + ease / 2 * (scale * at) @ at
        for _ in range(steps):
            slope = now[1] - wanted + ease * scale * at
            if np.abs(slope / scale).max() < CLOSE / 100:
                return at, now
            step, size = -np.linalg.solve(now[2] + ease * np.diag(scale), slope), 1.0
            while True:
                then = sums(at + size * step)
                if cost(at + size * step, then) <= cost(at, now) + 1e-4 * size * (slope @ step) + 1e-12 * abs(cost(at, now)):
                    break
                size /= 2
                if size < 1e-9:
                    return None
            at, now = at + size * step, then
        return None

    gap = lambda now: float(np.abs((now[1] - wanted) / scale).max())
    found = settle(np.zeros(len(ks)), start, EASE)
    if found is None:
        raise RuntimeError(f"rates did not settle in {steps} steps")
    if gap(found[1]) > CLOSE:
        firm = settle(*found, FIRM)
        if firm is not None and gap(firm[1]) <= CLOSE:
            found = firm
        else:
            warnings.warn(f"targets can't all be met: tokens {found[1][1].tolist()}, wanted {wanted.tolist()}", stacklevel=2)
    return rate(found[0]), before.tolist(), wanted.tolist()


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, tokens, copies_in, a posterior p_<domain> for each domain, rate, copies.

    A row stands for all rows with the same id and text (copies_in of them); copies is how many of each to take: the rate, rounded up or
    down by a hash of id and text so that it holds on average. Null, empty and white texts have no tokens and are classed by the shares of
    the labelled rows and the traits of an empty text. A null id is an id. A domain without labelled rows hardly gets anything; without any labels all domains
    are alike. Targets that the corpus can't meet together are met as closely as EASE lets rates leave 1, with a warning. Other columns are not read; no rows give no rows.
    """
    names = list(targets)
    if not names or min(targets.values()) < 0 or max(targets.values()) <= 0:
        raise ValueError("targets must be shares, one of them positive")
    rows = _rows(docs, id_col, text_col)
    vocabulary = learn(docs, labels, label_domain() if domain is None else domain, names, id_col, text_col)
    table = saved(posteriors(rows, vocabulary, len(names)), "posteriors")
    rate, _, _ = fit_rates(table, [float(targets[d]) for d in names])
    draw = F.pmod(F.xxhash64("id", "text_key", F.lit("draw")), F.lit(1 << 30)) / (1 << 30)
    out = table.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))
    return out.select(F.col("id").alias(id_col), "text_key", "tokens", "copies_in", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(names)], "rate", "copies")


def mixed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each row as often as its rate says."""
    taken = mix(docs, labels, id_col=id_col, text_col=text_col, **options).where("copies > 0")
    taken = taken.select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), F.col("copies").alias("_copies"))
    same = (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("_key")) & docs[id_col].cast("long").eqNullSafe(F.col("_id"))
    return docs.join(taken, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
