"""Public tokenizers in Python workers, with memory for what a worker has met before."""

from __future__ import annotations

import os
import re
import struct
from functools import cache

#: Words, and parts of words, that a worker remembers at most; then it starts anew.
REMEMBERED, PARTS = 600_000, 1_000_000


def load(tokenizer: str):
    """A tokenizer by the name of a public file or by path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if "/" not in tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return Tokenizer.from_file(tokenizer)


#: A word of plain letters (ASCII and the letters of U+00C0 to U+00FF) with plain marks behind it, none an apostrophe.
#: Both are a pre-token each; the letters have no other form under NFC.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


class WordIds(dict):
    """Ids of a word (UTF-8 bytes without ASCII white space), packed as little-endian unsigned 32-bit numbers.

    For tokenizers that drop white space and never join what it separates, as "word_bpe_49k.json"
    does: the ids of a text are then those of its words, one after the other. Plain words are looked
    up once more by their letters in lower case and their marks, which are far fewer.
    """

    def __init__(self, tokenizer: str):
        super().__init__()
        self.model = load(tokenizer)
        self.parts: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        ids = self.model.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, text: str) -> bytes:
        packed = self.parts.get(text)
        if packed is None:
            packed = self._encode(text)
            if len(text) <= 64:
                if len(self.parts) >= PARTS:
                    self.parts.clear()
                self.parts[text] = packed
        return packed

    def __missing__(self, word: bytes) -> bytes:
        if plain := _PLAIN.fullmatch(word):
            letters, marks = plain.groups()
            packed = self._part(letters.decode("utf-8").lower())
            if marks:
                packed += self._part(marks.decode("ascii"))
        else:
            packed = self._encode(word.decode("utf-8"))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed

    def text(self, text: bytes | None) -> bytes:
        """The packed ids of a text."""
        return b"".join(map(self.__getitem__, text.split())) if text else b""


@cache
def word_ids(tokenizer: str) -> WordIds:
    """The worker's own WordIds: tasks that share a Python worker share what it remembers."""
    return WordIds(tokenizer)
