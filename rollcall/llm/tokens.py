"""Byte-level BPE ids of whole texts.

The vocabulary is read from a ``tokenizers`` file; its ranks are handed to ``tiktoken``,
which merges several times faster. The ids are those that ``tokenizers`` gives by default, so a text is
cut at the strings of added tokens first, and each is one id (tests hold the two against each other).
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

#: How the vocabulary cuts texts into words (fixed value, part of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        byte_of = _byte_of()
        ranks = {
            bytes(byte_of[c] for c in word): i for word, i in tokenizer.get_vocab().items() if word not in self._added
        }
        self._encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self._added)
        #: Bytes of each id.
        self.n_bytes = np.zeros(max(*ranks.values(), *self._added.values()) + 1, dtype=np.int64)
        for word, i in [*ranks.items(), *((w.encode(), i) for w, i in self._added.items())]:
            self.n_bytes[i] = len(word)

    def ids(self, text: str) -> np.ndarray:
        """Ids of the whole text, as unsigned 32-bit numbers."""
        if any(word in text for word in self._added):
            ids = self._encoding.encode(text, allowed_special="all")
        else:
            ids = self._encoding.encode_ordinary(text)
        return np.frombuffer(array("I", ids), dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)
