"""The stages by themselves, and the whole run against brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ringloom.llm import mixing, pii, quality
from ringloom.llm._common import saved
from tests.llm.test_overlap import survivors


def test_stages_keep_the_columns_of_documents(spark, sf_dir, nothing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"test{i}")
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_quality_goes_first(spark, sf_dir, stages):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r["doc_id"] for r in quality.classify(docs, labels).where("kept").collect()}
    assert set(texts(stages[0])) == kept and 0.7 * docs.count() < len(kept) < docs.count()


def test_one_of_each_group(stages):
    """Five-word shingles at a similarity of 0.8, over all pairs."""
    before = sorted(texts(stages[0]).items())
    assert sorted(texts(stages[1])) == sorted(survivors(before))


def test_no_personal_data_is_left(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert before.keys() == after.keys()
    for k, t in before.items():
        base, full = pii.find([t])[0]
        assert after[k] == pii.redact(t, full) and (full or after[k] == t)
        assert not pii.base_spans(after[k])


def test_mixing_takes_effect(spark, sf_dir, stages):
    rates = mixing.mix(stages[2], spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    want = Counter({r["doc_id"]: r["copies"] for r in rates if r["copies"]})
    assert Counter(r["doc_id"] for r in stages[3].select("doc_id").collect()) == want


def test_sequences_hold_the_mixed_texts(stages):
    from tokenizers import Tokenizer

    from ringloom.llm.tokens import default_tokenizer

    tk = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for r in stages[3].select("doc_id", "text").collect():
        ids = [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            want[r["doc_id"], at, np.array(ids[at : at + 4096], "<u4").tobytes()] += 1
    got = stages[4].collect()
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in got) == want
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["offset"] + r["length"] <= 4096 for r in got)
