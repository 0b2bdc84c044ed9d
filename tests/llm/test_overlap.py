"""Near-duplicates of the pipeline against brute force over all pairs."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ringloom.llm import graph, overlap, simhash
from tests.llm.conftest import messy_rows
from tests.llm.test_text_operators import components


def plain_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else {b""}


def survivors(rows, similarity=0.8):
    """Ids that stay of (id, text) rows, by comparing all pairs of sets."""
    sets = [plain_set(t) for _, t in rows]
    group = components(len(rows), lambda i, j: len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]))
    least = {}
    for g, (i, t) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    return Counter(None if none else i for none, i in least.values())


def near_copies():
    """A chain of edits, a large group of copies with one to many edits each, and texts that share a long line only."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    out, text = [], r.choices(words, k=100)
    for _ in range(12):
        text = [*text]
        text[r.randrange(100)] = r.choice(words)
        out.append(" ".join(text))
    base = r.choices(words, k=90)
    for i in range(80):
        text = [*base]
        for _ in range(i % 5):
            text[r.randrange(90)] = r.choice(words)
        out.append(" ".join(text))
    line = r.choices(words, k=30)
    out += [" ".join(line + r.choices(words, k=n)) for n in range(1, 40)]
    r.shuffle(out)
    return list(enumerate(out))


def test_all_pairs_at_the_similarity_are_found(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity in (0.8, 0.5):
        got = Counter(r["doc_id"] for r in simhash.keep_one(docs, similarity=similarity).collect())
        assert got == survivors(rows, similarity)
    assert 12 < len(survivors(rows)) < len(rows)


def test_rows_without_ids_and_repeated_ids(messy, nothing):
    rows = [(r[0], r[1]) for r in messy_rows()]
    got = simhash.keep_one(messy)
    assert got.schema == messy.schema and Counter(r["doc_id"] for r in got.collect()) == survivors(rows)
    assert simhash.keep_one(nothing).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_stage_keeps_one_of_each_group(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = Counter(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert got == survivors(rows)


def test_bitmaps_differ_in_no_more_bits_than_sets():
    r = np.random.default_rng(11)
    sets, maps = [], []
    for _ in range(60):
        base = r.integers(-(2**62), 2**62, r.integers(1, 700))
        for keep in (1.0, 0.9, 0.5):
            more = r.integers(-(2**62), 2**62, int(len(base) * (1 - keep)))
            sets.append(np.unique(np.concatenate([base[: max(1, int(len(base) * keep))], more])))
            maps.append(overlap.bitmap(sets[-1]))
    i, j = np.triu_indices(len(sets), 1)
    differ = overlap.Bitmaps(maps).differ(i, j)
    real = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert (differ <= real).all()
    size = np.array([len(x) for x in sets])
    told = differ > size[i] + size[j] - 2 * overlap.enough(size[i], size[j], 0.8)
    alike = np.minimum(size[i], size[j]) >= overlap.enough(size[i], size[j], 0.8)
    assert told[alike & (size[i] > 64)].mean() > 0.9


def test_shingles_are_told_apart_by_words_and_order():
    for n in range(1, 8):
        words = [b"%d" % i for i in range(n)]
        seen = {overlap.shingle_hashes(list(p)).tobytes() for p in itertools.permutations(words)}
        assert len(seen) == len(list(itertools.permutations(words)))
        assert len(overlap.shingle_hashes(words)) == max(1, n - 4)
    again = [b"a", b"b", b"c", b"d", b"e"] * 3
    assert len(overlap.shingle_set(again)) == 5 and len(overlap.shingle_hashes(again)) == 11


def test_small_and_large_graphs_give_the_same(spark, monkeypatch):
    r = random.Random(2)
    edges = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(300)] + [(5, 5), (None, 3), (7, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = sorted(map(tuple, graph.components(df).collect()))
    monkeypatch.setattr(graph, "FEW", 10)
    assert few == sorted(map(tuple, graph.components(df).collect())) and len(few) > 200


def test_the_state_of_many_edges_does_not_overflow(spark):
    edges = spark.range(20_000_000).selectExpr("id + 1 as u", "id as v")
    assert graph._state(edges)[0] == 20_000_000 and graph._state(edges) == graph._state(edges.repartition(3))
    assert graph._state(edges) != graph._state(edges.where("v != 77").union(edges.where("v = 77").selectExpr("u + 1", "v")))
