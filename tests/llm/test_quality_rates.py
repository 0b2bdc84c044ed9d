"""Both rates of op1 and its posterior against plain numpy, held-out accuracy, and sites that change decisions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringloom.llm import quality
from tests.llm.conftest import messy_rows


def plain_rates(rows, rate, threshold=0.5):
    """rows: (host, path, score). Moment estimates and leave-one-out rates, level by level."""
    mean = sum(p for _, _, p in rows) / len(rows)

    def strength(groups):
        groups = [(n, s, m) for n, s, m in groups if n > 1]
        if not groups:
            return 10.0
        n = sum(g[0] for g in groups)
        seen = sum(k * (s / k - m) ** 2 for k, s, m in groups)
        between = (seen - sum(m * (1 - m) for _, _, m in groups)) / n
        return min(1e6, max(1.0, sum(k * m * (1 - m) for k, _, m in groups) / n / max(between, 1e-9) - 1))

    hosts, paths = defaultdict(list), defaultdict(list)
    for h, q, p in rows:
        hosts[h].append(p)
        paths[h, q].append(p)
    a = strength([(len(v), sum(v), mean) for v in hosts.values()])
    host_rate = {h: (a * mean + sum(v)) / (a + len(v)) for h, v in hosts.items()}
    c = strength([(len(v), sum(v), host_rate[h]) for (h, _), v in paths.items()])
    out = []
    for h, q, p in rows:
        hr = (a * mean + max(0, sum(hosts[h]) - p)) / (a + len(hosts[h]) - 1)
        pr = (c * hr + max(0, sum(paths[h, q]) - p)) / (c + len(paths[h, q]) - 1)
        logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
        post = 1 / (1 + math.exp(-(logit(p) - math.log(rate / (1 - rate)) + logit(pr))))
        out.append((hr, pr, post, post >= threshold))
    return out


@pytest.mark.parametrize("table", ["messy", "sf0.01"])
def test_rates_and_posterior_against_brute_force(spark, messy, labels, table):
    if table == "messy":
        docs = messy
    else:
        docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    got = quality.classify(docs, labels).collect()
    rows = [(r["source"] or "", r["lang"] or "", r["text"], r["doc_id"]) for r in docs.collect()]
    scores = [model.score(t) for _, _, t, _ in rows]
    want = plain_rates([(h, q, p) for (h, q, _, _), p in zip(rows, scores, strict=True)], model.rate)
    assert len(got) == len(rows)
    plain = sorted((str(i), p, *w) for (*_, i), p, w in zip(rows, scores, want, strict=True))
    seen = sorted((str(r["doc_id"]), r["score"], r["host_rate"], r["path_rate"], r["posterior"], r["kept"]) for r in got)
    for x, y in zip(seen, plain, strict=True):
        assert x[0] == y[0] and np.allclose(x[1:5], y[1:5], rtol=1e-6, atol=1e-9) and (x[5] == y[5] or abs(x[4] - 0.5) < 1e-6)


def test_held_out_labels(spark):
    """Fitted on three quarters of the labels of sf0.1, measured on the rest."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    kept = quality.classify(docs, labels.where(~held)).join(labels.where(held).select("doc_id", "quality"), "doc_id")
    rows = kept.select("kept", "quality").collect()
    good, bad = [r["kept"] for r in rows if r["quality"]], [r["kept"] for r in rows if not r["quality"]]
    print(f"held out: {sum(good)} of {len(good)} good kept, {len(bad) - sum(bad)} of {len(bad)} bad rejected")
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_sites_change_decisions(spark):
    """The same doubtful text is kept on a good site and rejected on a bad one, and a new path of a bad host follows its host."""
    r = random.Random(4)
    fine, poor, both = [[f"{k}{i}" for i in range(60)] for k in ("fine", "poor", "both")]
    rows, known = [], []

    def add(host, path, words, label=None):
        rows.append((len(rows), " ".join(words), path, host))
        if label is not None:
            known.append((len(rows) - 1, label))

    for host, share in (("good.example", 0.97), ("bad.example", 0.05)):
        for i in range(400):
            ok = r.random() < share
            add(host, "a", r.choices(fine if ok else poor, k=30) + r.choices(both, k=10), int(ok) if i % 2 else None)
    doubtful = fine[:6] + poor[:6] + both[:20]
    for host, path in (("good.example", "a"), ("bad.example", "a"), ("bad.example", "new")):
        add(host, path, doubtful)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.classify(docs, labels).where(f"doc_id >= {len(rows) - 3}").collect()}
    on_good, on_bad, on_new = (got[len(rows) - k] for k in (3, 2, 1))
    assert on_good["score"] == on_bad["score"] == on_new["score"]
    assert on_good["kept"] and not on_bad["kept"] and not on_new["kept"]
    assert on_good["path_rate"] > 0.9 and on_bad["path_rate"] < 0.15 and on_new["path_rate"] < 0.5


def test_words_alone_can_tell(spark):
    """Texts that differ in words only, by the same surface."""
    r = random.Random(6)
    rows = [(i, " ".join(r.choices([f"{'kqzvjx'[i % 2 :: 2][j % 3]}{chr(97 + j)}na" for j in range(26)], k=25))) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality.classify(docs, labels).where("doc_id >= 200").collect()
    assert sum(x["kept"] == bool(x["doc_id"] % 2) for x in got) >= 0.97 * len(got)


def test_rows_without_ids_are_judged(messy, labels):
    kept = quality.keep_good(messy, labels).collect()
    want = {(r["doc_id"], r["text_key"]) for r in quality.classify(messy, labels).where("kept").collect()}
    none = sum((None, k) in want for k in {r["text_key"] for r in quality.classify(messy, labels).where("doc_id is null").collect()})
    assert sum(r["doc_id"] is None for r in kept) == none and len(kept) <= len(messy_rows())
