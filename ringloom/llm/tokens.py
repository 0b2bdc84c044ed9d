"""Whole texts to token ids with a public tokenizer, a word at a time.

The word tokenizer drops white space and never joins characters across it, so a text's ids are those of its words in turn.
A plain word (Latin letters, then perhaps punctuation) goes straight to the tokenizer's model, in the form that its normalizer
and byte map give it; any other word goes through the whole tokenizer. Ids are kept while a cache has room, and a full cache is
emptied, so that a worker's memory is bounded.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

#: Entries of the caches, for words as they stand and for their lower-case runs of letters or marks.
WORDS, RUNS = 500_000, 300_000
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_map() -> dict[int, int]:
    """Byte-level BPE writes a byte as a printable character: printable Latin-1 stands for itself, the others follow from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


class WordEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.bytes = self.tokenizer.model, _byte_map()
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8", "surrogatepass").split()  # at the six ASCII spaces; others stay inside a word
        get = self.words.__getitem__
        try:
            return b"".join(map(get, words))
        except KeyError:
            return b"".join(map(self._word, words))

    def _word(self, word: bytes) -> bytes:
        out = self.words.get(word)
        if out is not None:
            return out
        text = word.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text)
        out = b"".join(map(self._run, plain.groups())) if plain else self._whole(text)
        if len(self.words) >= WORDS:
            self.words.clear()
        if len(word) < 200:
            self.words[word] = out
        return out

    def _run(self, run: str) -> bytes:
        if not run:
            return b""
        run = run.lower()
        out = self.runs.get(run)
        if out is None:
            mapped = run if run.isascii() else run.encode().decode("latin-1").translate(self.bytes)
            out = _packed([t.id for t in self.model.tokenize(mapped)])
            if len(self.runs) >= RUNS:
                self.runs.clear()
            if len(run) < 200:
                self.runs[run] = out
        return out

    def forget(self) -> None:
        """Empty the caches, so that a worker that goes on to other work doesn't hold them."""
        self.words.clear()
        self.runs.clear()

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process; ``task_encoder`` has its caches emptied after each task."""
    return WordEncoder(path)


@contextmanager
def task_encoder(path: str) -> Iterator[WordEncoder]:
    code = encoder(path)
    try:
        yield code
    finally:
        code.forget()
