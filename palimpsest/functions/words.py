"""The words of a text, and Arrow helpers around them.

Compatibility forms are folded (NFKC), format characters (category Cf) removed, a hyphen
directly before a line break is removed with the break, letters are lower-cased; the words
are the runs of letters and digits that remain.  Null gives no words.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np
import xxhash

_RUN = re.compile(r"[^\W_]+")
_BROKEN = re.compile("[-‐](?:\r\n|[\n\r\x0b\x0c\x85  ])")


@cache
def _format_chars() -> dict[int, None]:
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"}


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_format_chars())
    if "-" in text or "‐" in text:
        text = _BROKEN.sub("", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    return _RUN.findall(fold(text)) if text else []


class WordHasher(dict):
    """Word -> signed 64-bit hash, remembered for the words of this task.

    The memory is emptied when it holds ``limit`` words, so that an endless vocabulary does
    not grow the worker; that changes no result.
    """

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        self[word] = h
        return h

    def array(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
