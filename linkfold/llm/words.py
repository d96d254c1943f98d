"""Words of a text as 64-bit hashes, and hashes of runs of words, for the tasks' numpy code.

A word is a run of bytes other than blank and \\x09-\\x0D, which is how ``bytes.split()`` cuts.
Two words or runs are held equal if their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_LIMIT = 100_000
_known: dict[bytes, bytes] = {}


def split_words(text: str | None) -> list[bytes]:
    """Words of a text, as UTF-8; none of a null text."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(text: str | None) -> list[bytes]:
    """As ``split_words``, with A-Z in lower case and other letters as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_EDGES = ".,;:!?\"'()[]{}<>*_~`|«»„“”‘’¿¡…–—-"
_folded: dict[str, bytes] = {}


def folded_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of a text, alike for words that differ by case or by marks at their ends.

    Words end at any white space; a word that is nothing but marks keeps them.
    """
    words = text.split() if text else []
    out = list(map(_folded.get, words))
    if None in out:
        room = len(_folded) < _LIMIT
        for i, h in enumerate(out):
            if h is None:
                plain = (words[i].strip(_EDGES) or words[i]).lower()
                out[i] = h = xxhash.xxh64_digest(plain.encode("utf-8", "surrogatepass"))
                if room:
                    _folded[words[i]] = h
    return np.frombuffer(b"".join(out), dtype=">u8").astype(np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word.  Common words are remembered by the Python worker."""
    known, digest = _known, xxhash.xxh64_digest
    out = list(map(known.get, words))
    if None in out:
        room = len(known) < _LIMIT
        for i, h in enumerate(out):
            if h is None:
                out[i] = h = digest(words[i])
                if room:
                    known[words[i]] = h
    return np.frombuffer(b"".join(out), dtype=">u8").astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RunHashes:
    """Hashes of any run of words of one text in constant time, from polynomial prefix sums modulo 2**64."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.n = n
        self.power = powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * self.power[:n][::-1] if n else hashes, out=self.sums[1:])
        # sums[i] = sum over j < i of h[j] * B**(n-1-j); a run's sum is scaled to the end of the text
        self.inverse = inverse_powers(n + 1)

    def runs(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Mixed hashes of the runs [start, start + length)."""
        end = start + length
        raw = (self.sums[end] - self.sums[start]) * self.inverse[self.n - end]
        return mix(raw)


_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = _series(_BASE, max(n, 2 * len(_powers)))
    return _powers[:n]


def inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        _inverses = _series(pow(_BASE, -1, 2**64), max(n, 2 * len(_inverses)))
    return _inverses[:n]


def _series(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)
