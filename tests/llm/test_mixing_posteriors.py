"""The classifier of op4 against a plain one, and the reached sums of the real tables against the attainable optimum."""

import math
import re
import warnings
from collections import Counter, defaultdict

import numpy as np
import pytest

from ringloom.llm import mixing
from tests.llm.conftest import messy_rows

NAMES = ["clean", "toxic", "junk"]


def plain_terms(text):
    words = [w for w in text.lower().replace("\n", " ").split(" ") if w]
    terms = list(dict.fromkeys(words))
    loud = len(re.findall("[A-Z!#$%&*|]", text))
    tenth = lambda part, whole: math.floor(10 * part / max(whole, 1))
    traits = ["#all", f"#variety{tenth(len(terms), len(words))}/{len(str(len(words)))}", f"#loud{tenth(loud, len(text) / 2)}"]
    return len(words), {w.strip(mixing._MARKS) for w in terms} | set(traits)


def plain_vocabulary(docs, labels):
    """docs: (id, text); labels: (id, quality, toxic)."""
    by_id = defaultdict(list)
    for i, q, t in labels:
        d = "junk" if q == 0 else "toxic" if t == 1 else "clean" if q == 1 else None
        if i is not None and d:
            by_id[i].append(d)
    counts, size = defaultdict(Counter), Counter()
    for i, text in docs:
        for d in by_id.get(i, []):
            size[d] += 1
            for t in plain_terms(text or "")[1]:
                counts[t][d] += 1
    total = sum(size.values())
    share = {d: (size[d] + 1) / (total + len(NAMES)) for d in NAMES}
    rows = {}
    for t, n in counts.items():
        lift = {d: (n[d] + mixing.CALM * share[d]) / ((sum(n.values()) + mixing.CALM) * share[d]) for d in NAMES}
        if t != "#all" and sum(n.values()) >= mixing.LEAST and max(lift.values()) >= mixing.LIFT:
            rows[t] = (sum(n[d] * math.log(lift[d]) for d in NAMES), lift)
    chosen = sorted(rows, key=lambda t: (-rows[t][0], t))[: mixing.WORDS]
    absent = {t: {d: math.log(1 - (counts[t][d] + 0.5) / (size[d] + 1)) for d in NAMES} for t in chosen}
    out = {t: [math.log(rows[t][1][d]) - absent[t][d] for d in NAMES] for t in chosen}
    out["#all"] = [math.log(share[d]) + sum(absent[t][d] for t in chosen) for d in NAMES]
    return out


def test_posteriors_against_a_plain_classifier(spark):
    words = {"clean": "river stone garden, music. letter", "toxic": "vile! awful nasty garden", "junk": "BUY!!! CHEAP cheap now|now click"}
    docs, labels = [(r[0], r[1]) for r in messy_rows()], [(None, 1, 0), (3, None, None)]
    for i in range(120):
        d = NAMES[max(0, i % 8 - 5)]
        docs.append((1000 + i, " ".join([words[d], f"w{i % 7}\nend"] * (1 + i % 3))))
        labels += [(1000 + i, int(d != "junk"), int(d == "toxic"))] * (1 + (i == 7))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_vocabulary(docs, labels)
    vocabulary = mixing.learn(df, lab, mixing.label_domain(), NAMES, "doc_id", "text")
    got = {r[0]: list(r[1:]) for r in vocabulary.collect()}
    assert got.keys() == want.keys() and len(got) >= 8
    for t, w in want.items():
        assert got[t] == pytest.approx(w, rel=1e-9)
    rows = Counter((i, t or "") for i, t in docs)
    seen = mixing.posteriors(mixing._rows(df, "doc_id", "text"), vocabulary, 3).collect()
    assert len(seen) == len(rows)
    plain = Counter()
    for (i, t), n in rows.items():
        tokens, terms = plain_terms(t)
        w = np.sum([want[x] for x in terms if x in want], axis=0)
        p = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
        plain[i, tokens, n, *np.round(p, 9)] += 1
    assert Counter((r["id"], r["tokens"], r["copies_in"], *np.round([r["p0"], r["p1"], r["p2"]], 9)) for r in seen) == plain


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_real_tables_come_as_near_to_the_targets_as_rates_allow(spark, size):
    """The optimum by plain numpy: projected Newton steps over all documents, with the same cost for rates away from 1."""
    d = f"/root/testdata/{size}"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = mixing.mix(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).toPandas()
    p, tokens, rate = got[[f"p_{n}" for n in NAMES]].to_numpy(), (got["tokens"] * got["copies_in"]).to_numpy(float), got["rate"].to_numpy()
    target = np.array([mixing.TARGETS[n] for n in NAMES])
    before = tokens @ p
    wanted = before[0] * target / target[0]
    scale = np.maximum(np.maximum(before, wanted), 1)
    cost = lambda r: (((tokens * r) @ p - wanted) ** 2 / scale).sum() + mixing.EASE * (tokens * (r - 1) ** 2).sum()
    z = np.zeros(3)  # rate = max(0, 1 + p z), z = (wanted - sums) / (ease scale)
    for _ in range(200):
        r = np.maximum(0, 1 + p @ z)
        slope = (tokens * r) @ p - wanted + mixing.EASE * scale * z
        live = tokens * (r > 0)
        step = np.linalg.solve((p * live[:, None]).T @ p + mixing.EASE * np.diag(scale), slope)
        t = 1.0
        dual = lambda z: (tokens * np.maximum(0, 1 + p @ z) ** 2).sum() / 2 - wanted @ z + mixing.EASE / 2 * (scale * z) @ z
        while dual(z - t * step) > dual(z) and t > 1e-9:
            t /= 2
        z = z - t * step
    best = np.maximum(0, 1 + p @ z)
    assert cost(rate) <= 1.01 * cost(best)
    reached, optimum = (tokens * rate) @ p, (tokens * best) @ p
    assert np.abs(reached - optimum).max() <= 0.01 * optimum.max() and np.allclose(reached[1:], optimum[1:], rtol=0.01, atol=1)
