"""The kernels over many files at once against the plain loops, and queries by file against the relational forms on a table of tokens."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringloom.operators import by_file, compare, encoders, features, joins, trace
from ringloom.plans import registry  # before its parts
from ringloom.plans.codec_queries import image_files
from ringloom.sources import batch, files, lzss

R = random.Random(3)
DOCS = [b"", b"x", b"ab", b"abc", b"ab" * 50, b" " * 40, bytes(R.choice(b"ab ") for _ in range(900)), b"", bytes(R.randrange(256) for _ in range(200)), bytes(R.choice(b"abc") for _ in range(9000)), b"\0" * 5000, b""]


def together(docs):
    return np.frombuffer(b"".join(docs), np.uint8), batch.bounds_of([len(d) for d in docs])


@pytest.mark.parametrize("name", ["chain3_8_first", "chain3_8_last", "chain8_first", "chain_oldest8"])
@pytest.mark.parametrize("size", [700, 1 << 20])
def test_searched_at_once(monkeypatch, name, size):
    monkeypatch.setattr(batch, "PLACES", size)
    data, bounds = together(DOCS)
    t = encoders.tokens_of(data, bounds, name)
    payload, at = batch.frame(t)
    for i, d in enumerate(DOCS):
        a, b = t.first[i : i + 2]
        want = encoders.encode(d, name)
        assert list(zip(t.is_match[a:b].tolist(), t.lit[a:b].tolist(), t.pos[a:b].tolist(), t.len[a:b].tolist(), strict=True)) == [tuple(x) for x in want]
        assert payload[at[i] : at[i + 1]].tobytes() == lzss.frame(want)


def test_read_and_expand_cut_payloads():
    payloads = [lzss.frame(encoders.encode(d, "chain8_first")) for d in DOCS]
    cut = [p[: R.randrange(len(p) + 1)] for p in payloads] + [bytes(R.randrange(256) for _ in range(n)) for n in (1, 2, 5, 300)]
    totals = np.array([R.randrange(12000) for _ in cut])
    t = batch.read(*together(cut), totals)
    out, at = batch.expand(t, totals)
    for i, p in enumerate(cut):
        assert out[at[i] : at[i + 1]].tobytes() == lzss.expand(lzss.read_tokens(p, int(totals[i])), int(totals[i]))


@pytest.mark.parametrize("unit", [1, 3])
def test_inflate_units(unit):
    blobs = [b"", *[bytes(R.randrange(256) for _ in range(n)) for n in (1, 2, 3, 30, 500)], *[bytes(R.choice(b"\x80\x0f\0\x11") for _ in range(n)) for n in (9, 400)]]
    kind = (15, 1, 4) if unit == 3 else (0xFF, 2, 8)
    totals = np.array([R.randrange(900) for _ in blobs])
    out, at = batch.inflate_units(*together(blobs), totals, unit, *kind)
    for i, b in enumerate(blobs):
        assert out[at[i] : at[i + 1]].tobytes() == lzss.inflate_units(b, int(totals[i]), unit, *kind)


def test_other_encoders_give_the_same_columns(spark):
    names = ["basic_tail1_phantom1", "no_dummy", "chain8_last"]
    f = spark.createDataFrame([(str(i), bytearray(d[:400])) for i, d in enumerate(DOCS)], "file string, content binary")
    got = {(r["file"], r["variant"]): r for r in encoders.encoded_files(f, names).collect()}
    for i, d in enumerate(DOCS):
        for name in names:
            r, t = got[str(i), name], encoders.encode(d[:400], name)
            assert (r["tokens"], r["bytes"], bytes(r["payload"]), r["decodable"]) == (len(t), encoders.size_in_bytes(t), lzss.frame(t), encoders.roundtrips(d[:400], t))


def rows(df):
    return sorted(map(repr, (sorted(r.asDict().items()) for r in df.collect())))


@pytest.fixture(scope="module")
def lf2(spark, sf_dir):
    return image_files(spark, sf_dir).where("length(path) = 6").cache()


@pytest.fixture(scope="module")
def tokens(lf2):
    return files.tokens(lf2).where("_error is null").drop("_error").cache()


def test_steps(lf2, tokens):
    assert rows(by_file.steps(lf2)) == rows(trace.steps(tokens, 24 + 3 * 128, None))


def test_writers(lf2, tokens):
    back = F.pmod(F.col("input_pos") + 0x0FEE - F.col("pos"), F.lit(4096))
    source = tokens.where("is_match").select("file", "token_idx", (F.col("input_pos") - F.when(back == 0, 4096).otherwise(back)).cast("long").alias("source")).where("source >= 0")
    spans = tokens.select("file", F.col("token_idx").alias("writer"), F.col("is_match").alias("writer_is_match"), F.col("input_pos").cast("long").alias("start"), (F.col("input_pos") + F.col("len_eff")).cast("long").alias("stop"))
    want = joins.interval_join(source, spans, ["file"], "source", "start", "stop", 32).select("file", "token_idx", "source", "writer", "writer_is_match")
    assert rows(by_file.writers(lf2)) == rows(want)


def test_rivals_and_hopeless(lf2, tokens):
    names = ["chain3_8_last", "chain8_first", "chain3_8_first"]
    raw = lf2.select(F.col("path").alias("file"), F.udf(lambda c: files.ring_input(bytes(c)), "binary")("content").alias("content"))
    kind = F.struct("is_match", "lit", "pos", "len").alias("token")
    rival = encoders.encoded_tokens(raw, names).select("file", "variant", "token_idx", kind)
    truth = tokens.select("file", F.explode(F.array(*map(F.lit, names))).alias("variant"), "token_idx", kind)
    diff = compare.positional_diff(truth, rival, ["file", "variant"], "token_idx", "token").cache()
    want = compare.first_divergence(diff, ["file", "variant"], "token_idx").select("file", "variant", "length", "n_diff", "first_div")
    got = by_file.rivals(lf2, names)
    assert rows(got.select("file", "variant", "length", "n_diff", "first_div")) == rows(want)
    assert got.where("length != same + n_diff or variant = 'chain3_8_first' and (n_diff > 0 or left_kind != 'end')").count() == 0
    lost = diff.where("left_value is not null").groupBy("file", "token_idx").agg(F.bool_and("differs").alias("lost")).where("lost")
    few = diff.where("variant != 'chain3_8_first' and left_value is not null").groupBy("file", "token_idx").agg(F.bool_and("differs").alias("lost")).where("lost")
    assert lost.count() == by_file.hopeless(lf2, names).count() == 0
    want = few.groupBy("file").agg(F.count("*").alias("hopeless"), F.min("token_idx").alias("first_hopeless"), F.max("token_idx").alias("last_hopeless"))
    assert rows(by_file.hopeless(lf2, names[:2])) == rows(want)


def test_ties(lf2, tokens, monkeypatch):
    by = tokens.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("token_idx", "is_match", "pos", "input_pos"))).alias("tokens"))
    raw = lf2.select(F.col("path").alias("file"), F.udf(lambda c: files.ring_input(bytes(c)), "binary")("content").alias("data"))
    sizes = files.lf2_headers(lf2).select(F.col("path").alias("file"), F.col("width").alias("img_w"), F.col("height").alias("img_h"), F.col("color_count").alias("img_colors"))
    want = features.pairwise(features.tie_table(raw.join(by, "file")), features.history(tokens), sizes)
    assert rows(features.with_geometry(by_file.ties(lf2))) == rows(want)


@pytest.mark.parametrize("name", ["lzss_sizes", "token_trace", "pairwise_features", "variant_agreement", "hopeless_tokens", "variant_divergence", "last_writers", "lzss_roundtrip"])
def test_files_are_not_shuffled(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
