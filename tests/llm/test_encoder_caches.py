"""A worker goes on to other stages; what it remembers of words must not stay with it."""

from ringloom.llm import packing, sstable, tokens


def test_caches_are_emptied_after_a_task():
    path = tokens.default_tokenizer()
    with tokens.task_encoder(path) as code:
        ids = code.encode("Some words, and some more words.")
        assert code.words and code.runs
    assert not code.words and not code.runs
    with tokens.task_encoder(path) as again:
        assert again is code and again.encode("Some words, and some more words.") == ids
    assert packing.task_encoder is sstable.task_encoder is tokens.task_encoder
