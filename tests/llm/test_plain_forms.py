"""Operators against the plainest form of what they compute."""

import hashlib
import random

import numpy as np

from ringloom.llm import embeddings, langid, multiset, sharding


def plain_jump(key, buckets):
    """The published loop, one key at a time."""
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_scalar_loop():
    r = random.Random(1)
    keys = [0, 1, 2**64 - 1, *(r.getrandbits(64) for _ in range(3000))]
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(np.array(keys, np.uint64), n).tolist() == [plain_jump(k, n) for k in keys]


def test_lanes_are_the_sum_of_the_digests_of_paragraphs():
    text = "one line\n\ntwo lines here and some more words\none line\nü 日本"
    want = np.zeros(multiset.WIDE, np.uint64)
    for p in text.encode().split(b"\n"):
        if p:
            want += np.frombuffer(hashlib.blake2b(p, digest_size=64).digest(), "<u4")
    got = multiset.Fingerprint.of(text)
    assert got.wide.tolist() == (want % 2**32).tolist()
    parts = [multiset.Fingerprint.of(p) for p in ("ü 日本", "one line", "two lines here and some more words", "one line")]
    assert parts[0] + parts[1] + parts[2] + parts[3] == got and got - parts[1] == parts[0] + parts[2] + parts[3]
    # all lanes of two paragraphs differ, so a clash in one leaves the others
    a, b = multiset.Fingerprint.of("a").wide, multiset.Fingerprint.of("b").wide
    assert (a != b).all()


def test_tiny_and_huge_components(spark):
    rows = [(1, [1e-200, 0.0], 1), (2, [1e-200, 1e-205], 1), (3, [1e300, 0.0], 1), (4, [1e308, 1e308], 1), (5, [5e-324, 0.0], 1), (6, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6)}


def test_filter_against_plain_bloom_filters():
    """A set of places for each language and gram hash, popcounts, correction and decision, one gram at a time."""
    r = random.Random(5)
    words = {k: ["".join(r.choices(letters, k=6)) for _ in range(60)] for k, letters in (("x", "abcdef"), ("y", "defghi"), ("z", "uvwxyz"))}
    grams = [np.unique(langid.ngrams([" ".join(w)])[0]) for w in words.values()]
    f = langid.Filter(list(words), [1 / 3] * 3, grams)
    place = lambda h: [(h >> (k * (64 - f.bits) // (langid.HASHES - 1))) & ((1 << f.bits) - 1) for k in range(langid.HASHES)]
    bloom = [[{place(int(h))[k] for h in g} for k in range(langid.HASHES)] for g in grams]
    joint = [set().union(*b) for b in bloom]  # the hashes share one array of cells
    texts = [" ".join(r.choices(words[k], k=8) + r.choices(words["y"], k=r.randrange(4))) for k in words for _ in range(20)] + ["", "12 3", "q"]
    for text, (lang, score) in zip(texts, f.predict(texts), strict=True):
        own = [int(h) for h in langid.ngrams([text])[0]]
        hits = [sum(all(p in j for p in place(h)) for h in own) for j in joint]
        real = [sum(h in set(map(int, g)) for h in own) for g in grams]
        assert all(x >= y for x, y in zip(hits, real, strict=True))
        false = [(len(j) / 2**f.bits) ** langid.HASHES for j in joint]
        right = [max(0.0, h - len(own) * x) / (1 - x) for h, x in zip(hits, false, strict=True)]
        if not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
        elif sum(right):
            assert lang == list(words)[right.index(max(right))] and abs(score - max(right) / sum(right)) < 1e-9
