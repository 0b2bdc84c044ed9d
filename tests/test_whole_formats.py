"""Images, archives and comparisons that work on whole arrays, against plain forms; rows that a stretch or a task holds."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ringloom.operators import compare, joins
from ringloom.plans import registry
from ringloom.sources import archive, batch, files, images

R = random.Random(8)


def test_quantise_and_rgba():
    for n, most in ((0, 4), (1, 4), (60, 4), (400, 200), (1500, 256)):
        rgb = bytes(R.choice((0, 7, 200, 255)) if n < 100 else R.randrange(256) for _ in range(3 * n))
        colours = [tuple(rgb[i : i + 3]) for i in range(0, 3 * n, 3)]
        palette = list(dict.fromkeys(colours))[:most]
        want = bytes(palette.index(c) if c in palette else min(range(len(palette)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(c, palette[i], strict=True)), i)) for c in colours)  # noqa: B023
        assert images.quantise(rgb, most) == (palette, want)
        x = images.Image("lf2", n, 1, want, palette[:200], 3)
        table = [bytes([*(palette[i] if i < min(200, len(palette)) else (0, 0, 0)), 0 if i == 3 or i >= min(200, len(palette)) else 255]) for i in range(256)]
        assert images.rgba(x) == b"".join(table[p] for p in want)
        assert images.rgb(x) == b"".join(table[p][:3] if table[p][3] else b"\0\0\0" for p in want)
        y = images.Image("pdt", n, 1, rgb, alpha=bytes(range(n % 256)))
        assert images.rgba(y) == b"".join(rgb[3 * i : 3 * i + 3] + (bytes([i]) if i < n % 256 else b"\xff") for i in range(n))
        assert images.read_pdt(images.write_pdt(images.Image("pdt", n, 1, rgb, alpha=bytes(n)))).pixels == rgb
        if n:
            assert images.read_png(images.png(x)) == (n, 1, images.rgba(x))


def test_palettes_of_different_files(spark):
    made = [images.write_lf2(images.Image("lf2", 2, 1, b"", [(i, 1, 2), (3, i, 5)][: i % 3], 0), []) for i in range(6)]
    f = spark.createDataFrame([(f"{i}.lf2", bytearray(c), "LF2") for i, c in enumerate(made)] + [("x", bytearray(b"?"), "LF2")], "path string, content binary, format string").coalesce(1)
    d = files.decode(f)
    got = {r["path"]: r["palette"] for r in d.where("_error is null").collect()}
    assert got == {f"{i}.lf2": [(i, 1, 2), (3, i, 5)][: i % 3] for i in range(6)} and d.where("_error is not null").count() == 1
    out = {r["name"]: bytes(r["data"]) for r in files.outputs(d, "rgba").collect()}
    assert out == {f"{i}.rgba": images.rgba(images.read_lf2(c)) for i, c in enumerate(made)}


def test_stretches_are_bounded():
    rows = pa.RecordBatch.from_pydict({"content": pa.array([b"x" * n for n in (5, 5, 50, 0, 0, 3)])})
    assert [b.column("content").to_pylist() for b in batch.passes([rows], "content", 10)] == [[b"x" * 5] * 2, [b"x" * 50], [b"", b"", b"xxx"]]


def test_report_counts_whole_bytes(spark):
    d = spark.createDataFrame([("a", 2, 1, "LF2", p, bytearray(x), 1.0, None) for p, x in ((0x20, b"\x02\x00\x20\x52\x00"), (0, b"\0\0\x10"), (200, b"\xc8\x2c\x8c"))], "path string, width int, height int, format string, transparent int, pixels binary, decode_ms double, _error string")
    out = files.report(spark.createDataFrame([("a", 5)], "path string, length long"), d)
    assert sorted(r["transparent_pixels"] for r in out.collect()) == [1, 1, 2]
    assert "pixels" not in [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line][0]


def test_nearest_without_expanding_rows(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 15.0), (3, 29.0)], "k int, v double")
    palette = spark.createDataFrame([(2, 10.0), (1, 20.0), (0, 30.0)], "i int, at double")
    out = joins.nearest(df, palette, lambda p: F.abs(F.col("v") - p["at"]), "i", ["k"])
    assert {tuple(r) for r in out.collect()} == {(1, 2, 0.0), (2, None, None), (3, 0, 1.0)}
    with pytest.raises(ValueError):
        joins.nearest(df, spark.range(300).selectExpr("id as i", "id as at"), lambda p: F.abs(F.col("v") - p["at"]), "i", ["k"])


def test_array_divergence_against_rows(spark):
    pairs = [(i, [R.choice("ab") for _ in range(R.randrange(5))], [R.choice("ab") for _ in range(R.randrange(5))]) for i in range(80)]
    df = spark.createDataFrame(pairs, "k int, l array<string>, r array<string>")
    side = lambda c: df.select("k", F.posexplode(c).alias("pos", "w"))
    want = compare.first_divergence(compare.positional_diff(side("l"), side("r"), ["k"], "pos", "w"), ["k"], "pos")
    assert {tuple(r) for r in compare.array_divergence(df, ["k"], "l", "r").collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("name", ["first_divergence", "divergence_cluster", "first_diff_kinds", "positional_diff"])
def test_pairs_are_not_exploded(spark, sf_dir, name):
    assert "Generate" not in registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_archives_stream_in_order(spark, sf_dir):
    from ringloom.plans.format_queries import pak_files

    plan = pak_files(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
    key = bytes(range(11))
    assert archive.shifted(b"", key) == b"" and archive.shifted(bytes([250] * 13), key) == bytes((250 + i % 11) & 255 for i in range(13))
