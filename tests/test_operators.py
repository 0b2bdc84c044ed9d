"""Operators whose cases the star schema doesn't have."""

import random

import pytest

from ringloom.operators import aggregates, candidates, compare, encoders, sampling, tree, windows
from ringloom.sources import datasets
from ringloom.streaming import resume


def test_candidates_against_brute_force(spark):
    r = random.Random(4)
    seqs = {0: [r.choice("ab") for _ in range(70)], 1: [r.choice("abcd") for _ in range(50)], 2: ["a"] * 30, 3: ["x", "y"]}
    rows = spark.createDataFrame([(k, i, c) for k, s in seqs.items() for i, c in enumerate(s)], "k int, pos long, c string")
    for window in (4, 16, 4096):
        want = set()
        for k, s in seqs.items():
            for i in range(len(s)):
                for j in range(max(0, i - window), i):
                    n = 0
                    while n < 18 and i + n < len(s) and s[j + n] == s[i + n]:
                        n += 1
                    if n >= 3:
                        want.add((k, i, j, i - j, n))
        got = {tuple(x) for x in candidates.match_candidates(rows, ["k"], "pos", "c", window).collect()}
        assert got == want


def test_diff_counts_the_tail(spark):
    a = spark.createDataFrame([("f", i, c) for i, c in enumerate("abcd")], "k string, pos int, c string")
    b = spark.createDataFrame([("f", i, c) for i, c in enumerate("abXd??")], "k string, pos int, c string")
    d = compare.positional_diff(a, b, ["k"], "pos", "c")
    r = compare.first_divergence(d, ["k"], "pos").first()
    assert (r["length"], r["n_diff"], r["first_div"]) == (6, 3, 2)


def test_runs_and_samples(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate("aabba")], "k int, i int, c string")
    assert [r["run"] for r in windows.runs(rows, ["k"], ["i"], "c").orderBy("i").collect()] == [0, 0, 1, 1, 2]
    many = spark.range(1000).selectExpr("id % 7 as g", "id")
    a, b = (sorted(r["id"] for r in sampling.k_per_group(many.repartition(n), ["g"], ["id"], 5, 1).collect()) for n in (1, 9))
    assert a == b and len(a) == 35


def test_parameter_table_is_bounded(spark):
    with pytest.raises(ValueError):
        aggregates.parameter_grid(spark.range(1), spark.range(200).withColumnRenamed("id", "p"), ["p"], spark.range(1)["id"] > 0)


def test_tree_training_and_case(spark):
    r = random.Random(0)
    data = [(x := r.randrange(20), y := r.randrange(20), int(x > 9) + int(y > 4 and x <= 9)) for _ in range(400)]
    df = spark.createDataFrame(data, "x int, y int, label int")
    node = tree.train(df, ["x", "y"], "label", 4)
    got = df.withColumn("p", node.column(df.columns)).collect()
    assert all(row["p"] == row["label"] == node.predict(row.asDict()) for row in got)
    again = tree.Node.from_table(node.table())
    assert again.rules() == node.rules() and len(node.rules(1)) == 1
    assert tree.Node(None, "absent", 1.0, tree.Node(5), tree.Node(6)).predict({}) == 5


def test_datasets(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("file\ttoken_idx\tkind\tlen\n" + "a\t3\tshort\t-\t1\n" + "b\t4\tfull\t5\t1\t2\t3\t4\t0x1f\t0x00\t0xff\t0x20\t1\t0\n")
    rows = datasets.with_hex(datasets.read(spark, "hopeless", str(tmp_path / "h.tsv")), "leaf_tail").orderBy("file").collect()
    assert rows[0]["tail_max"] is None and rows[1]["leaf_tail"] == 31
    (tmp_path / "g.csv").write_text("token_idx,input_pos,ring_r,leaf_kind,leaf_pos,leaf_len,n_legal,legal_pos\n0,0,0x0fee,M,1,3,2,1;2\n1,3,0x0ff1,L,0,1,0,\n")
    g = datasets.with_lists(datasets.read(spark, "gamma", str(tmp_path / "g.csv")), "legal_pos", ";").orderBy("token_idx").collect()
    assert g[0]["legal_pos"] == [1, 2] and not g[1]["legal_pos"]
    (tmp_path / "l.txt").write_text("a\n\n b \n")
    assert {r["file"] for r in datasets.file_list(spark, str(tmp_path / "l.txt")).collect()} == {"a", "b"}


def test_resume_batch_and_stream(spark, tmp_path):
    work = lambda df: df.selectExpr("file", "length(content) as n")
    todo = spark.createDataFrame([("a", "xx"), ("b", "yyy")], "file string, content string")
    out = str(tmp_path / "done")
    resume.run_remaining(todo.limit(1), work, out, ["file"])
    resume.run_remaining(todo, work, out, ["file"])
    resume.run_remaining(todo, work, out, ["file"])
    assert spark.read.parquet(out).count() == 2
    todo.union(spark.createDataFrame([("c", "z")], todo.schema)).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(todo.schema).json(str(tmp_path / "in"))
    q = resume.stream_remaining(stream, work, out, ["file"], str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r["file"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_empty_inputs(spark):
    f = spark.createDataFrame([], "file string, content binary")
    assert encoders.encoded_tokens(f, ["basic"]).count() == 0
