"""Operators that read texts, against brute force on messy rows."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from ringloom.llm import langid, mixing, multiset, packing, pii, quality, sharding, simhash, sstable, tokens
from tests.llm.conftest import messy_rows

DOCS = messy_rows()


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    label = list(range(n))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(n)]


def test_simhash(messy, nothing):
    fp = [plain_fingerprint(r[1]) for r in DOCS]
    group = components(len(DOCS), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    least = {}
    for g, r in zip(group, DOCS, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = Counter((r[0], f"{f:016x}", least.get(g)) for r, f, g in zip(DOCS, fp, group, strict=True))
    assert Counter(tuple(x) for x in simhash.near_duplicates(messy).collect()) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_cover_links_keep_components():
    r = random.Random(1)
    for n in (20, 60, 200):
        fp = np.array([r.choice([0, 2**64 - 1, 12345]) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(n)], np.uint64)
        home = np.array([r.random() < 0.6 for _ in range(n)])
        near = lambda i, j, fp=fp, home=home: (home[i] or home[j]) and int(fp[i] ^ fp[j]).bit_count() <= 3
        links = {(max(a, b), min(a, b)) for a, b in simhash.cover_links(fp, home)}
        assert all(near(a, b) for a, b in links) and len(links) < n
        assert components(n, near) == components(n, lambda i, j: (i, j) in links)


@pytest.mark.parametrize("flips", [0, 1, 2, 3])
def test_linked_fingerprints_share_a_cell(flips):
    r = random.Random(flips)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a ^ sum(1 << x for x in r.sample(range(64), flips))
        i, cell, home = simhash.cell_codes(np.array([a, b], np.uint64))
        mine, other = ({(int(c), bool(h)) for k, c, h in zip(i, cell, home, strict=True) if k == x} for x in (0, 1))
        assert any((c, True) in other or h and (c, False) in other for c, h in mine if h or (c, True) in other)


def test_multiset(messy, nothing):
    rows = sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    want = []
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        k = len(t) // 4
        new = t[: len(t) - k] + following[:k]
        a, b = multiset.Fingerprint.of(t), multiset.Fingerprint.of(new)
        want.append((rows[i][0], len(t), hashlib.sha256(new.encode()).hexdigest(), a.hex(), b.hex(), a.likeness(b), a.likeness(multiset.Fingerprint.of(following))))
    assert Counter(tuple(x) for x in multiset.fingerprints(messy).collect()) == Counter(want)
    assert multiset.fingerprints(nothing).count() == 0
    one = multiset.fingerprints(messy.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_multiset_is_a_homomorphism():
    of = multiset.Fingerprint.of
    a, b, c = "alpha beta gamma delta epsilon zeta", "one two three", "x"
    whole = of(f"{a}\n{b}\n{a}")
    assert whole == of(f"{a}\n\n{a}\n{b}") == of(a) + of(b) + of(a)
    assert whole - of(a) == of(f"{b}\n{a}") and whole != of(f"{a}\n{b}") and whole + of(c) != whole
    long = " ".join(str(i) for i in range(2000))
    assert 0.6 < of(long).likeness(of(long[: len(long) * 3 // 4])) < 1 and of(long).likeness(of(long[::-1])) < 0.3


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_tokenizer())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(tokenizer, monkeypatch):
    odd = ["it's we'll don't x\x1cy", "<|endoftext|> a<|startoftext|>b", "ÀÉ×÷ ªº µm İ é ́a ﬁ ½ x2", "\x85 a\x0bb\x0cc　d", "a\nb\r\n'\n`~^\\[]{}|\" #$%&", "THE!!  ÞÐßÿ... a_b"]
    monkeypatch.setattr(tokens, "WORDS", 50)  # caches that are emptied all the time change nothing
    monkeypatch.setattr(tokens, "RUNS", 20)
    code = tokens.WordEncoder(tokens.default_tokenizer())
    for text in [*odd, *[r[1] for r in DOCS]]:
        assert np.frombuffer(code.encode(text), "<u4").tolist() == ids_of(tokenizer, text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_sstable_round_trip(messy, nothing, tokenizer, tmp_path):
    got = sstable.token_shards(messy, str(tmp_path / "t")).collect()
    rows = sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for r in rows:
        ids = [*ids_of(tokenizer, r[1]), 2]
        want.append((r[0], start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(((x["start"], x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in got), key=lambda x: x[0]) == [(s, d, n, c) for d, s, n, c in want]
    assert sstable.token_shards(nothing).count() == 0
    found = Counter()
    for p in (tmp_path / "t").iterdir():
        reader = sstable.Reader(str(p))
        for d in {r[0] for r in DOCS}:
            for ids in reader.lookup(d):
                found[d, crc(ids)] += 1
        assert reader.lookup(777_777) == []
    assert found == Counter((d, c) for d, _, _, c in want)


def test_sstable_damage(tmp_path):
    w = sstable.Writer(str(tmp_path / "a.sst"))
    for i in range(5000):
        w.add(i, np.arange(i % 50, dtype=np.uint32))
    w.close()
    reader = sstable.Reader(str(tmp_path / "a.sst"))
    assert len(reader.index) > 1 and [len(x) for _, x in reader.scan()] == [i % 50 for i in range(5000)]
    data = bytearray((tmp_path / "a.sst").read_bytes())
    data[10] ^= 1
    (tmp_path / "b.sst").write_bytes(data)
    with pytest.raises(ValueError):
        sstable.Reader(str(tmp_path / "b.sst")).lookup(0)
    (tmp_path / "c.sst").write_bytes(data[:-1])
    with pytest.raises(ValueError):
        sstable.Reader(str(tmp_path / "c.sst"))


def test_packing(messy, nothing, tokenizer):
    got = packing.pack(messy).collect()
    want = Counter()
    for r in DOCS:
        ids = [*ids_of(tokenizer, r[1]), 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r[0], k, at, len(part), crc(part)] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == want
    by = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(x["length"] for x in got)
    assert len(by) <= -(-total // 4096) + 1
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece(seed):
    r = random.Random(seed)
    lengths = Counter(min(4096, int(r.lognormvariate(6.3, 1.2)) + 1) for _ in range(r.choice([3, 50, 4000])))
    groups = packing.plan(lengths)
    used = Counter()
    for count, items in groups:
        assert sum(a * n for a, n in items) <= 4096 and count > 0
        for a, n in items:
            used[a] += count * n
    assert used == lengths
    bound = -(-sum(a * n for a, n in lengths.items()) // 4096)
    large = sum(n for a, n in lengths.items() if a > 2048)
    assert sum(c for c, _ in groups) <= 1.02 * max(bound, large) + 1


def test_knapsack_against_brute_force():
    r = random.Random(2)
    for _ in range(30):
        sizes = np.array(sorted(r.sample(range(3, 30), 4)))
        prices = np.array([r.random() for _ in sizes])
        most = np.array([r.randint(0, 4) for _ in sizes])
        best = packing.knapsack(sizes, prices, most, 40)
        assert (best <= most).all() and best @ sizes <= 40
        top = max((np.array([a, b, c, d]) @ prices for a in range(most[0] + 1) for b in range(most[1] + 1) for c in range(most[2] + 1) for d in range(most[3] + 1) if np.array([a, b, c, d]) @ sizes <= 40), default=0)
        assert abs(best @ prices - top) < 1e-9


def test_sharding(messy, nothing, spark, tmp_path):
    got = sharding.assign_shards(messy).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in DOCS)
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == want
    by = {}
    for x in got:
        by.setdefault(x["shard"], []).append(x["slot"])
        assert x["grown_shard"] in (x["shard"], 8) and x["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({(x["doc_id"], x["shard"]) for x in got}) == len({r[0] for r in DOCS})
    assert sharding.assign_shards(nothing).count() == 0
    keys = np.arange(40_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 8, 100):
        now, grown = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert set(now) == set(range(n)) and ((grown == now) | (grown == n)).all()
        assert abs((grown == n).mean() - 1 / (n + 1)) < 0.02


def test_language_id(messy, nothing, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.query(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    got = langid.identify(messy).collect()
    assert len(got) == len(DOCS) and {r["lang_pred"] for r in got} <= {"en", "de", "fr", "und"}
    by = {r["doc_id"]: r for r in got}
    assert by[2]["lang_pred"] == by[4]["lang_pred"] == by[6]["lang_pred"] == "und"
    assert langid.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify(messy.where("lang is null and doc_id is not null")).collect()} == {"und"}


def test_language_filter_has_many_languages():
    grams = [langid.ngrams([f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(122 - i % 26)}qz"])[0] for i in range(150)]
    f = langid.Filter([f"l{i}" for i in range(150)], [1 / 150] * 150, grams)
    assert f.predict(["dbyqz"])[0][0] == f"l{3 * 26 + 1}" and f.predict(["", "12 3"]) == [("und", 0.0)] * 2


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = sum(int(c) for c in digits[::-1][::2]) + sum(sum(map(int, str(2 * int(c)))) for c in digits[::-1][1::2])
            fine = {"email": True, "ip": all(int(x) < 256 for x in re.findall("[0-9]+", m[0])), "card": 13 <= len(digits) <= 19 and odd % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, *m.span()))
    return out


PRIVATE = ["mail a.b+c@x-y.co.uk, or a@b@c.d e@f.g@h.i.j", "ips 1.2.3.4.5.6.7.8 300.1.1.1 010.0.0.1", "card 4111 1111-1111 1111 and 4111111111111112", "call +1 (988) 555-2485.. or +49 30 1234567890", "@ @a.b ..@..a.b a@-.- " + "9" * 400, "+1+2+3 ((((", "1" * 3000 + "@" + "2" * 3000]


def test_pii_base_spans():
    r = random.Random(3)
    texts = [*PRIVATE, *["".join(r.choices("ab12 .@+-()\n", k=80)) for _ in range(800)]]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_pii_field():
    test = pii.labelled_table(200, seed=1234)
    hit = miss = wrong = 0
    for text, spans in test:
        base, full = pii.find([text])[0]
        assert set(base) <= set(full)
        want = {s for s in spans if not plain_spans(text[s[1] : s[2]])}
        hit, miss, wrong = hit + len(want & set(full)), miss + len(want - set(full)), wrong + len(set(full) - set(spans) - set(base))
    assert hit / (hit + miss) > 0.9 and wrong <= 0.03 * hit


def test_viterbi_against_brute_force():
    import itertools

    field, r = pii.default_field(), np.random.default_rng(0)
    runs = [r.normal(size=(n, len(pii.LABELS))) * 3 for n in (1, 2, 3, 3, 2)]
    for e, path in zip(runs, field.decode(runs), strict=True):
        score = lambda p, e=e: field.start[p[0]] + sum(e[i, x] for i, x in enumerate(p)) + sum(field.moves[a, b] for a, b in itertools.pairwise(p))
        assert score(tuple(path)) == max(map(score, itertools.product(range(len(pii.LABELS)), repeat=len(e))))


def test_pii_rows(messy, nothing, spark):
    got = pii.find_pii(messy).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in DOCS)
    assert {r["base_sha256"] for r in got if r["doc_id"] == 2} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_pii(nothing).count() == 0 and pii.redacted(nothing).count() == 0
    d = spark.createDataFrame([(1, "x a@b.cd +1 (988) 555-2485 y", 5), (2, None, None)], "doc_id int, text string, n_chars long")
    r = {x["doc_id"]: x for x in pii.redacted(d).collect()}
    assert r[1]["text"] == "x <EMAIL> <PHONE> y" and r[1]["n_chars"] == 19 and r[2]["text"] is None and r[2]["n_chars"] is None
    assert pii.redacted(messy).schema == messy.schema and pii.redacted(messy).count() == len(DOCS)


def test_quality(messy, nothing, labels, spark, sf_dir):
    got = quality.classify(messy, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in DOCS) and all(0 <= r["posterior"] <= 1 for r in got)
    assert quality.classify(nothing, labels).count() == 0 and quality.keep_good(nothing, labels).count() == 0
    assert all(r["kept"] for r in quality.classify(messy, labels.limit(0)).collect())
    known = quality.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    good, bad = [r["kept"] for r in known if r["quality"]], [r["kept"] for r in known if not r["quality"]]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_sparse_sites_shrink_more(spark):
    from pyspark.sql import functions as F

    r = random.Random(8)
    rows = []
    for host, n, good in (("big", 300, 0.9), ("bad", 300, 0.1), ("tiny", 2, 0.0)):
        for _ in range(n):
            ok = r.random() < good
            rows.append((len(rows), ("Some words that go on. " if ok else "!!! ### $$$ ") * 9, "en", host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", F.when(F.col("text").startswith("Some"), 1).otherwise(0).alias("quality"))
    rate = {x["source"]: x["r"] for x in quality.classify(docs, labels).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("path_rate").alias("r")).collect()}
    assert rate["bad"] < 0.2 < rate["tiny"] < 0.6 < rate["big"]


def test_mixing(messy, nothing, labels, spark, sf_dir):
    got = mixing.mix(messy, labels).collect()
    assert sum(r["copies_in"] for r in got) == len(DOCS)
    assert all(abs(r["p_clean"] + r["p_toxic"] + r["p_junk"] - 1) < 1e-9 and r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in got)
    assert mixing.mix(nothing, labels).count() == 0 and mixing.mixed(nothing, labels).count() == 0
    assert mixing.mix(messy, labels.limit(0)).count() == len(got)
    with pytest.raises(ValueError):
        mixing.mix(messy, labels, {"clean": 0.0})
    expected = sum(r["copies"] * r["copies_in"] for r in got)
    assert mixing.mixed(messy, labels).count() == expected


def test_rates_meet_reachable_targets(spark):
    rows = [(i, 10 + i % 7, 1, 1.0, 0.0) for i in range(100)] + [(100 + i, 20, 1, 0.1, 0.9) for i in range(50)]
    table = spark.createDataFrame(rows, "id int, tokens long, copies_in long, p0 double, p1 double")
    rate, before, wanted = mixing.fit_rates(table, [0.6, 0.4], steps=200)
    t = table.withColumn("r", rate).collect()
    sums = [sum(x["r"] * x["tokens"] * x[f"p{k}"] for x in t) for k in (0, 1)]
    assert sums == pytest.approx(wanted, rel=0.01) and wanted[0] == pytest.approx(before[0])
    # the same as projected gradient descent in numpy
    tok, p = np.array([x["tokens"] for x in t], float), np.array([[x["p0"], x["p1"]] for x in t])
    scale, r = np.maximum(np.array(before), wanted), np.ones(len(t))
    for _ in range(200):
        r = np.maximum(0, r - p @ (((tok * r) @ p - np.array(wanted)) / scale))
    assert np.allclose(r, [x["r"] for x in t], atol=1e-2)


def test_queries_are_registered():
    from ringloom.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert json.dumps(sorted(registry.ORACLE_SQL)) == "[]"
