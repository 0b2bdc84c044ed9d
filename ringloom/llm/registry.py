"""The queries of this folder by name, and SQL where SQL can express one."""

from __future__ import annotations

from ringloom.llm import embeddings, langid, mixing, multiset, packing, pii, quality, sharding, simhash, sstable

QUERIES = {
    "op1_bayes_quality": quality.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_multiset_fingerprints": multiset.query,
    "op4_soft_mixing": mixing.query,
    "op5_metric_range_join": embeddings.query,
    "op6_best_fit_packing": packing.query,
    "op7_jump_sharding": sharding.query,
    "op8_token_sstables": sstable.query,
    "op9_ngram_language_id": langid.query,
    "op10_crf_pii": pii.query,
}

ORACLE_SQL: dict[str, str] = {}
