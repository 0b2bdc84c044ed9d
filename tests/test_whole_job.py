"""Queries of round 3's findings do their whole job."""

import random

import duckdb
import numpy as np
import pytest
from ringloom.operators import by_file, encoders
from ringloom.plans import registry  # before its parts
from ringloom.sources import batch, files, forest, images, lzss

R = random.Random(11)


def test_all_ties_have_rows(spark):
    """tokens with more than 32 tied candidates too, and more rows than one stretch makes."""
    many = b"".join(b"abc" + bytes([128 + i]) for i in range(60)) + b"abc\xff" * 2
    head = images.lf2_head(images.Image("lf2", 4, 100, b"", [(i, i, i) for i in range(128)], 32))
    for data in (many + b"x" * (400 - len(many)), b" " * 400):
        tokens = encoders.encode(data, "chain3_8_first")
        table = spark.createDataFrame([("a.lf2", bytearray(head + lzss.frame(tokens)))], "path string, content binary")
        got = [(r["token_idx"], r["n_max"], r["max_len"], r["cand_dist"]) for r in by_file.ties(table).select("token_idx", "n_max", "max_len", "cand_dist").collect()]
        v, want, s = b" " * 4096 + data, [], 0
        for i, t in enumerate(tokens):
            length = {d: next((n for n in range(min(18, 400 - s)) if v[4096 + s - d + n] != v[4096 + s + n]), min(18, 400 - s)) for d in range(1, 4097)}
            top = max(length.values())
            tied = [d % 4096 for d, n in length.items() if n == top]
            if t.is_match and top >= 3 and len(tied) > 1:
                want += [(i, len(tied), top, d) for d in tied]
            s += t.len if t.is_match else 1
        assert sorted(got) == sorted(want)
        assert max(n for _, n, _, _ in want) > 32


def test_scan_lists_files_in_tasks(spark, tmp_path):
    """the driver holds no list of files, and paths, hidden names and levels are those of Spark's own reader."""
    for name in ("a b.LF2", "c%20d.pdt", "e.txt", "_f.lf2", ".g.lf2", "sub/h.scn", "sub/_i/j.lf2"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    for recursive in (False, True):
        own = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(str(tmp_path)).select("path", "length", "content").where("path not like '%.txt'")
        for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
            f = files.scan(spark, root, recursive=recursive)
            assert sorted(map(tuple, f.select("path", "length", "content").collect())) == sorted(map(tuple, own.collect()))
    assert files.scan(spark, f"{tmp_path}/a b.LF2").count() == 1
    assert files.scan(spark, str(tmp_path), f"{tmp_path}/sub").count() == 3
    plan = files.scan(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "a b.LF2" not in plan
    assert not files.scan(spark, str(tmp_path)).inputFiles()


def test_nearest_is_a_theta_join(spark, tmp_path):
    """rows are joined with those of the palette, be they none or many; null and repeated keys and ties are the SQL's."""
    customers = "(VALUES (1, 200.0), (1, 999.0), (2, NULL), (NULL, 1e4), (NULL, 40.5), (3, 600.0), (4, -5.0)) AS t(c_custkey, c_acctbal)"
    for n in (0, 1, 25, 300):
        con, at = duckdb.connect(), tmp_path / str(n)
        at.mkdir()
        con.sql(f"COPY (SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM {customers}) TO '{at}/customer.parquet'")
        con.sql(f"COPY (SELECT CAST(i AS INT) AS n_nationkey FROM range({n}) AS r(i)) TO '{at}/nation.parquet'")
        for t in ("customer", "nation"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
        df = registry.QUERIES["nearest_theta"](spark, str(at))
        assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, con.sql(registry.ORACLE_SQL["nearest_theta"]).fetchall()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


WORDS = [bytes(R.choices(b"etaoin shr", k=R.randrange(1, 8))) for _ in range(300)]
DOCS = [b"", b"x", b" ", b" " * 17, b" " * 40, bytes(R.choice(b"ab ") for _ in range(900)), b"", b" ".join(R.choices(WORDS, k=2500))[:9500], b" " * 4500 + b"abc" * 30, b"aaaa" * 6, bytes(R.randrange(256) for _ in range(700)) * 2, b""]


@pytest.mark.parametrize("places, nodes", [(forest.PLACES, forest.NODES), (1000, 5000)])
def test_tokens_off_trees(monkeypatch, places, nodes):
    """the tree encoders, read off shared trees, give the tokens of the plain loops."""
    monkeypatch.setattr(forest, "PLACES", places)
    monkeypatch.setattr(forest, "NODES", nodes)
    data, bounds = np.frombuffer(b"".join(DOCS), np.uint8), batch.bounds_of([len(d) for d in DOCS])
    trees = forest.Forest(data, bounds)
    names = dict.fromkeys([*encoders.HOPELESS, *encoders.UNION, *(["one_dummy", "no_dummy_eq", "basic_eq", "basic_tail1_pad8", "basic_tail1_uncapped", "basic_min4"] if places > 1000 else [])])
    for name in names:
        v = encoders.VARIANTS.get(name)
        assert v is None or encoders._read_off_trees(v)
        t = encoders.tokens_of(data, bounds, name, trees)
        got = list(zip(t.is_match.tolist(), t.lit.tolist(), t.pos.tolist(), t.len.tolist(), strict=True))
        for i, d in enumerate(DOCS):
            assert got[t.first[i] : t.first[i + 1]] == [tuple(x) for x in encoders.encode(d, name)], (name, i)
    assert encoders.tokens_of(data[:0], bounds[:2], "combo").first.tolist() == [0, 0]


def test_hopeless_takes_the_whole_list(spark, tmp_path):
    """as registered, tokens count as hopeless that none of all the listed encoders has."""
    texts = [" ".join(R.choices(["alpha", "beta", "gamma", "delta"], k=60)) for _ in range(6)] + ["", None, " " * 70]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, x in enumerate(texts):
        data = (x or "").encode()
        data += b" " * (-len(data) % 16)
        truth = encoders.encode(data, "chain3_8_first")
        rivals = [encoders.encode(data, n) for n in encoders.HOPELESS]
        lost = [k for k, t in enumerate(truth) if not any(k < len(r) and r[k] == t for r in rivals)]
        want += [(f"{i}.lf2", len(lost), lost[0], lost[-1])] if lost else []
    got = registry.QUERIES["hopeless_tokens"](spark, str(tmp_path)).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
