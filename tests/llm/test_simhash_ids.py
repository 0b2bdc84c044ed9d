"""Fingerprints are the nodes of op2, whatever their ids are."""

from ringloom.llm import simhash


def test_a_fingerprint_without_an_id_is_a_bridge(spark, monkeypatch):
    prints = spark.createDataFrame([(5, 0b0), (None, 0b111), (3, 0b111111), (7, -1), (7, 1 << 40)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: prints)
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = sorted((r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(f"{0:016x}", 3), (f"{7:016x}", 3), (f"{63:016x}", 3), (f"{1 << 40:016x}", 3), ("f" * 16, 7)]
