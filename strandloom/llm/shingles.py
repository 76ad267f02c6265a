"""Word shingles as 64-bit hashes, for the operators that compare texts by shingle sets."""

from __future__ import annotations

import numpy as np
import xxhash

SPLIT = np.uint64(32)
#: Odd multipliers that tell a shingle's places apart; any odd constants serve.
PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())

#: A-Z lower-cased, and a space for every other character but digits, a-z and those beyond ASCII.
PLAIN = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256)).lower()


def plain(texts: list[str | None]) -> list[bytes]:
    """Texts in which only spaces separate words of digits, letters a-z and characters beyond ASCII."""
    return [(t or "").encode("utf-8", "surrogatepass").translate(PLAIN) for t in texts]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> SPLIT)) * PLACE[3]
    x = (x ^ (x >> SPLIT)) * PLACE[4]
    return x ^ (x >> SPLIT)


def words_of(text: str | None, punctuation: bool = True) -> list[bytes]:
    """Words between the six ASCII white-space characters with A-Z lower-cased; optionally without ASCII punctuation."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    return raw.split() if punctuation else raw.translate(None, PUNCTUATION).split()


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; fewer words count as one run, none as no run."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width_here = min(width, len(h))
    total = np.full(len(h) - width_here + 1, width_here, np.uint64)
    for i in range(width_here):
        total += mixed(h[i : len(h) - width_here + 1 + i] * PLACE[i % 8] + np.uint64(i))
    return np.unique(mixed(total))
