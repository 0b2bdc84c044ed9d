"""Token kernels, images, archives and encoders against hand-checked vectors and a replayed ring."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ringloom.operators import encoders, features
from ringloom.sources import archive, files, images
from ringloom.sources.lzss import Token, Truncated, expand, frame, literal, match, read_tokens

SMALL = st.binary(max_size=300) | st.lists(st.sampled_from(b"ab "), max_size=400).map(bytes)
DECODABLE = sorted(n for n, v in encoders.VARIANTS.items() if v.fill == 0x20 and not v.stop_on_input and not v.rescan and v.search in ("tree", "chain", "hash"))


def test_literal_payload():
    payload = bytes.fromhex("00efdfcfbf")
    assert list(read_tokens(payload, 4)) == [literal(b) for b in (0x10, 0x20, 0x30, 0x40)]
    assert expand(read_tokens(payload, 4), 4) == bytes.fromhex("10203040")


def test_truncation():
    payload = frame([literal(1), match(5, 4), literal(2)])
    assert expand(read_tokens(payload[:2], 9), 9) == bytes([1])
    for cut in (0, 1, 3, 4):
        with pytest.raises(Truncated):
            list(read_tokens(payload[:cut], 9, strict=True))


def test_match_beyond_the_image_is_cut():
    assert expand([match(0x123, 18)], 5) == b" " * 5


@given(SMALL, st.sampled_from(["basic", "no_dummy_tail1", "basic_lazy", "chain8_first"]))
@settings(max_examples=60, deadline=None)
def test_frame_and_read_are_inverse(data, name):
    tokens = encoders.encode(data, name)
    assert list(read_tokens(frame(tokens), len(data), strict=True)) == tokens


@pytest.mark.parametrize("name", DECODABLE)
def test_decodable_variants(name):
    r = random.Random(5)
    for data in (b"", b"x", b"ab" * 50, b" " * 40, bytes(r.choice(b"ab ") for _ in range(900)), bytes(r.randrange(256) for _ in range(200))):
        assert encoders.roundtrips(data, encoders.encode(data, name)), data[:20]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 18, 19, 4095, 4096, 4097, 9000])
def test_lengths_around_the_ring(n):
    data = bytes(random.Random(n).choice(b"abc") for _ in range(n))
    for name in ("basic", "no_dummy", "chain16_last"):
        assert encoders.roundtrips(data, encoders.encode(data, name))


def test_spaces_match_the_fill():
    first = encoders.encode(b" " * 30, "basic")[0]
    assert first.is_match and first.len == 18
    assert not encoders.encode(b" " * 30, "no_dummy")[0].is_match


def test_phantoms_and_sizes():
    plain, one, pad = (encoders.encode(b"abcabcabcq", f"basic_tail1{x}") for x in ("", "_phantom1", "_pad8"))
    assert one == [*plain, literal(ord("q"))] and len(pad) % 8 == 0
    assert encoders.size_in_bytes(plain) == len(frame(plain))


def test_closed_forms_equal_a_replayed_ring():
    data = bytes(random.Random(1).choice(b"abc ") for _ in range(5000))
    past, raw = features.History(data), np.frombuffer(data, np.uint8)
    ring, age, writes, head = bytearray([0x20]) * 4096, {}, {}, 0x0FEE
    for s, byte in enumerate(data):
        if s in (0, 1, 3, 17, 4000, 4096, 4097, 4990, 4999):
            found = dict(zip(*past.matches(s), strict=True))
            for d in [*range(1, 30), 4000, 4095, 4096]:
                copy, p, k = bytearray(ring), (head - d) % 4096, 0
                while k < 18 and s + k < len(data) and copy[(p + k) % 4096] == data[s + k]:
                    copy[(head + k) % 4096] = data[s + k]
                    k += 1
                assert found.get(d, 0) == (k if k >= 3 else 0)
                assert features._slot(raw, s, d) == ring[p]
                assert (d if d <= s else None) == (s - age[p] if p in age else None)
                assert ((s - d) // 4096 + 1 if d <= s else 0) == writes.get(p, 0)
        ring[head], age[head], writes[head] = byte, s, writes.get(head, 0) + 1
        head = (head + 1) % 4096


def lf2(width, height, pixels, palette, transparent=0):
    x = images.Image("lf2", width, height, b"", palette, transparent)
    return images.write_lf2(x, encoders.encode(images.flip(pixels, width)))


RGBY = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0)]


def test_lf2_and_its_outputs():
    pixels = bytes([0, 1, 2, 3, 3, 2, 1, 0, 9, 0, 0, 0])
    x = images.read_lf2(lf2(4, 3, pixels, RGBY, 2))
    assert (x.width, x.height, x.pixels, x.palette, x.transparent) == (4, 3, pixels, RGBY, 2)
    full = images.rgba(x)
    assert [full[4 * i + 3] for i in range(12)] == [0 if p in (2, 9) else 255 for p in pixels]
    assert images.rgb(x)[:12] == bytes([255, 0, 0, 0, 255, 0, 0, 0, 0, 255, 255, 0])
    b = images.bmp(x)
    assert b[:2] == b"BM" and len(b) == 54 + 1024 + 12 and b[54 + 1024 :][:4] == pixels[8:]
    p = images.png(x)
    assert zlib.decompress(p[p.index(b"IDAT") + 4 : -16])[1:17] == full[:16]
    assert images.encode_as(x, "unknown") == b


def test_cut_off_lf2_is_zero_filled():
    data = lf2(4, 4, bytes(range(16)), [(i, i, i) for i in range(16)])
    assert images.read_lf2(data[:-3]).pixels[:4] == b"\0" * 4


def test_many_colours_are_refused():
    with pytest.raises(ValueError):
        images.write_lf2(images.Image("lf2", 1, 1, b"", [(0, 0, 0)] * 256), [])


def pdt(width, height, rgb, alpha=None):
    def pack(units):
        return b"".join(bytes([0xFF]) + b"".join(units[i : i + 8]) for i in range(0, len(units), 8))

    body = pack([bytes(c[::-1]) for c in rgb])
    mask = 32 + len(body) if alpha is not None else 0
    return images.PDT_MAGIC + struct.pack("<3I", 0, width, height) + bytes(8) + struct.pack("<I", mask) + body + (pack([bytes([a]) for a in alpha]) if alpha is not None else b"")


def test_pdt():
    x = images.read_pdt(pdt(2, 2, RGBY, [1, 2, 3, 4]))
    assert x.pixels == bytes(v for c in RGBY for v in c) and x.alpha == bytes([1, 2, 3, 4])
    assert images.read_pdt(pdt(2, 2, RGBY)).alpha == b"\xff" * 4
    short = images.read_pdt(pdt(2, 2, RGBY, [1, 2, 3, 4])[:-2])
    assert short.alpha == bytes([1, 2]) and images.rgba(short)[11] == 255
    run = images.PDT_MAGIC + struct.pack("<3I", 0, 5, 1) + bytes(12) + bytes([0x80, 1, 2, 3]) + struct.pack("<H", 3)
    assert images.read_pdt(run).pixels == bytes([3, 2, 1]) * 5


def test_quantise():
    palette, pixels = images.quantise(bytes([0, 0, 0, 255, 255, 255, 10, 0, 0, 250, 255, 255]), 2)
    assert palette == [(0, 0, 0), (255, 255, 255)] and pixels == bytes([0, 1, 0, 1])


def test_archive(spark):
    key = bytes([7, 250, 3, 99, 200, 1, 0, 255, 128, 77, 5])
    items = [("ABC.LF2", b"hello"), ("LONGNAME.TXT", b""), ("X.A", bytes(range(40)))]
    f = spark.createDataFrame([("a.pak", bytearray(archive.build(items, key))), ("b.pak", bytearray(b"nothing here")), ("c.pak", bytearray(b""))], "path string, content binary")
    table = archive.entries(f)
    rows = table.orderBy("archive", "entry_idx").collect()
    assert [r["_error"] for r in rows if r["archive"] != "a.pak"] == ["invalid magic", "too small"]
    assert [(r["name"], r["position"], r["length"]) for r in rows if r["archive"] == "a.pak"] == [("ABC.LF2", 10, 5), ("LONGNAME.TXT", 15, 0), ("X.A", 15, 40)]
    assert rows[0]["key"] == list(key) and rows[0]["kind"] == "Unknown"
    data = {r["name"]: bytes(r["data"]) for r in archive.members(table).where("_error is null").collect()}
    assert data == dict(items)
    assert archive.find_member(table, "abc.lf2").count() == 1


def test_files_to_rows(spark, tmp_path):
    (tmp_path / "a.LF2").write_bytes(lf2(4, 1, bytes([0, 1, 2, 3]), RGBY, 1))
    (tmp_path / "b.pdt").write_bytes(pdt(2, 2, RGBY, [9, 9, 9, 9]))
    (tmp_path / "bad.lf2").write_bytes(b"LEAF256")
    (tmp_path / "c.g00").write_bytes(b"?")
    (tmp_path / "note.txt").write_bytes(b"?")
    f = files.scan(spark, str(tmp_path))
    assert f.count() == 4
    d = {r["path"].rsplit("/", 1)[1]: r for r in files.decode(f).collect()}
    assert d["a.LF2"]["_error"] is None and d["bad.lf2"]["_error"] and d["c.g00"]["_error"]
    assert {r["name"] for r in files.outputs(files.decode(f), "png").collect()} == {"a.png", "b.png"}
    files.write_outputs(files.outputs(files.decode(f), "rgba"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "b.rgba").read_bytes()[3] == 9
    t = files.tokens(f.where("format = 'LF2'")).collect()
    assert sum(r["len_eff"] or 0 for r in t) == 4 and sum(r["_error"] is not None for r in t) == 1
    r = {x["file"].rsplit("/", 1)[1]: x for x in files.report(f, files.decode(f)).collect()}
    assert r["a.LF2"]["transparent_pixels"] == 1
    h = {x["path"].rsplit("/", 1)[1]: x for x in files.lf2_headers(f).collect()}
    assert h["a.LF2"]["width"] == 4 and h["bad.lf2"]["_error"]


def test_trace_and_features(spark):
    from pyspark.sql import functions as F

    from ringloom.operators import trace

    data = bytes(random.Random(2).choice(b"ab ") for _ in range(640))
    raw, at = [], 0
    for i, t in enumerate(encoders.encode(data)):
        raw.append(("f", i, t.is_match, t.lit, t.pos, t.len, t.len, at))
        at += t.len
    t = spark.createDataFrame(raw, "file string, token_idx int, is_match boolean, lit int, pos int, len int, len_eff int, input_pos int")
    s = trace.steps(t, 0, None).orderBy("step_number").collect()
    payload = frame([Token(*x[2:6]) for x in raw])
    assert s[-1]["data_offset"] + s[-1]["data_length"] == len(payload) and s[-1]["pixels_decoded"] == 640
    assert trace.seek(trace.steps(t), "f", 3, 100_000).first()["step_number"] == min(500, len(s)) - 1
    f = spark.createDataFrame([("f", bytearray(data), [{"is_match": x[2], "pos": x[4], "input_pos": x[7]} for x in raw])], "file string, data binary, tokens array<struct<is_match:boolean,pos:int,input_pos:int>>")
    ties = features.tie_table(f)
    wide = features.pairwise(ties, features.history(t), spark.createDataFrame([("f", 32, 20, 48)], "file string, img_w int, img_h int, img_colors int"))
    assert len(wide.columns) == 84 and wide.count() == ties.count() > 0
    # the encoder's choice is always among the longest where a decoder sees it
    per = ties.groupBy("token_idx").agg(F.sum("is_leaf").alias("n")).agg(F.max("n")).first()[0]
    assert per == 1
    assert features.offset_heat(ties, spark.createDataFrame([("f", 32)], "file string, img_w int")).agg(F.sum("n")).first()[0] == ties.agg(F.sum("is_leaf")).first()[0]


def test_meta_selectors(spark):
    f = spark.createDataFrame([("a", bytearray(b" " * 60)), ("b", bytearray(b"abcabcabcabc"))], "file string, content binary")
    out = encoders.encoded_files(f, ["basic", "no_dummy"])
    picked = {r["file"]: r["variant"] for r in encoders.choose(out, "basic", "no_dummy", "min_bytes").collect()}
    assert picked == {"a": "basic", "b": "basic"}
    assert {r["variant"] for r in encoders.choose(out, "basic", "no_dummy", "min_bytes_strict").where("file = 'b'").collect()} == {"no_dummy"}
    exact = out.withColumn("exact", out["decodable"]).select("file", "variant", "exact")
    assert encoders.coverage(exact).count() == 2
