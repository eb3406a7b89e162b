"""Hashes of words and word shingles of many texts.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return (the same words as ``[^\\x20\\x09-\\x0D]+``). Its hash
is xxh3 of its UTF-8 bytes, so no pattern of letters makes two words collide. Long texts are
worked on in pieces of about ``PIECE`` bytes, cut at white space, so memory
follows the piece and the number of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from xxhash import xxh3_64_intdigest

PIECE = 1 << 18
_POINT = 0x9E3779B97F4A7C15
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit spread over all output bits (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _text_hashes(data: bytes) -> np.ndarray:
    out, at = [], 0
    while len(data) - at > PIECE:
        m = _SPACE.search(data, at + PIECE)
        if not m:
            break
        out.append(_hashed(data[at : m.start()].split()))
        at = m.start()
    out.append(_hashed(data[at:].split()))
    return np.concatenate(out) if len(out) > 1 else out[0]


def word_hashes(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes in order) of each text, in order; null is empty."""
    for i, text in enumerate(texts):
        yield i, _text_hashes((text or "").encode("utf-8", "surrogatepass"))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order; fewer words are one run, no word gives none."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out *= np.uint64(_POINT)
        out += words[j : len(words) - k + 1 + j]
    return mixed(out + np.uint64(k))
