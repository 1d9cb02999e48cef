"""Token ids of whole texts with a public word-level BPE vocabulary, as little-endian unsigned 32-bit bytes.

The vocabulary's normaliser and pre-tokeniser never look across a space or a line
feed, so the ids of a text are the ids of its space-separated pieces, one after the
other.  Pieces repeat, so they are looked up; only unseen ones are encoded, and of
those the common form (Latin letters, then ASCII signs) is put together from its two
parts.  Both look-up tables are bounded and forget everything when they are full.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import claim, register

VOCABULARY = "word_bpe_49k.json"
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-@\[-`{-~]*)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TextIds:
    def __init__(self, path: str, words: int = 250_000, parts: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the public byte-to-character table of byte-level BPE
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.chars = [table[b] for b in range(256)]
        self.parts = _Memo(parts, self._encode)
        self.cores = _Memo(parts, self._core)
        self.words = _Memo(words, self._word)

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, letters: str) -> bytes:
        spelled = letters if letters.isascii() else "".join(map(self.chars.__getitem__, letters.encode()))
        return np.asarray([t.id for t in self.tokenizer.model.tokenize(spelled)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if m := _PLAIN.fullmatch(word):
            core, tail = m.groups()
            ids = self.cores[core.lower()]
            return ids + self.parts[tail] if tail else ids
        return self._encode(word)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


class _Memo(dict):
    def __init__(self, limit, make):
        self.limit, self.make = limit, make

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


_loaded: dict[str, TextIds] = {}
register("tokens", _loaded.clear)


def text_ids(path: str) -> TextIds:
    """One table per Python worker, kept between its tasks."""
    claim("tokens")
    if path not in _loaded:
        _loaded[path] = TextIds(path)
    return _loaded[path]
