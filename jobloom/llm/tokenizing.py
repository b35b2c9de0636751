"""Token ids of whole texts through the tokenizers library, with a memo of words.

word_bpe vocabularies split a text into pieces and never merge across them or across white space, so
a text's ids are its words' ids in a row. In a text of ASCII and the letters of Latin-1, a new word is
split into pieces by one regular expression, and a new piece goes to the library's BPE model. In other
texts, a new word goes to the library's whole pipeline. A memo holds two generations of MEMO_WORDS
entries at most.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

END_ID = 1
MEMO_WORDS = 450_000
#: Longer words are rare, and are not kept.
MEMO_CHARS = 11

# How this vocabulary's pre-tokenizer splits lower-cased text (fixed values), for ASCII and the letters of Latin-1.
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]+")
# str.split() takes these for white space; the vocabulary's normalizer does not.
_NOT_WHITE = re.compile(r"[\x1c-\x1f]")


class Memo(dict):
    """find(key) by key; the generation before the present one is kept as well."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.find(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class TextEncoder:
    """Encodes texts with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_chars = _byte_chars()
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.plain, self.words = Memo(self._plain), Memo(self._word)

    def _packed(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _plain(self, word: str) -> bytes:
        pieces = [word] if word.isalpha() else _PIECES.findall(word)
        return self._piece(word) if len(pieces) == 1 else b"".join([self.plain[x] for x in pieces])

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.byte_chars)
        return self._packed([t.id for t in self.model.tokenize(text)])

    def _word(self, word: str) -> bytes:
        return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text; none for null."""
        if not text:
            return np.zeros(0, self.dtype)
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.frombuffer(b"".join(map(self.plain.__getitem__, text.lower().split())), self.dtype)
        if _NOT_WHITE.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), self.dtype)


def _byte_chars() -> dict[int, str]:
    """Byte -> character, as byte-level vocabularies write it: printable ones as they are, the others from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each vocabulary and Python worker; workers are used again from task to task."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
