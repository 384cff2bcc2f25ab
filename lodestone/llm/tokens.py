"""Token ids of a public tokenizer file, as the tokenizers library gives them.

The file is that of a byte-level BPE. Texts of common characters go through tiktoken with the ranks of the same file,
which gives the same ids several times as fast; texts with other characters or with a special token's string go through
tokenizers itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Characters for which both libraries' classes of letters, digits and spaces are known to agree.
_RARE = re.compile("[^\x00-\u017f\u2010-\u2026]")
#: Fixed value: the pre-tokenizer's pattern of byte-level BPE with use_regex.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The characters by which such files write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        self.special = [x["content"] for x in found["added_tokens"]]
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("from-file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids, without added special tokens; none for a null or empty text."""
        if not text:
            return np.empty(0, np.uint32)
        if _RARE.search(text) or any(x in text for x in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)

    def count(self, text: str | None) -> int:
        return len(self.ids(text))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)
