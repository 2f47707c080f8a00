"""Streams of the 32-bit Mersenne twister that any task can enter at any place.

The twister's words follow a linear recurrence over bits, so the words at place J are sums (XOR) of earlier
ones, and which ones t^J modulo the recurrence's characteristic polynomial tells. A task that needs the
words from J on computes that power by squaring, sums the state there and goes on from it with NumPy's
twister: the stream is that of one generator, however the work is dealt.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The twister's fixed values: words and reach of the state, the twist, the bits of the state.
WORDS, REACH, TWIST, BITS = 624, 397, 0x9908B0DF, 19937


def seeded(seed: int) -> np.ndarray:
    """The state that a seed of 32 bits gives."""
    return np.random.RandomState(seed & 0xFFFFFFFF).get_state()[1].astype(np.uint32)


def raw_words(state: np.ndarray, count: int) -> np.ndarray:
    """The state and what follows it, ``count`` words in all, not tempered."""
    out = np.empty(max(count, WORDS), np.uint32)
    out[:WORDS] = state
    step = WORDS - REACH  # so many new words depend on old ones alone
    for n in range(WORDS, len(out), step):
        end = min(n + step, len(out))
        low, high = n - WORDS, end - WORDS
        mixed = out[low:high] & np.uint32(0x80000000) | out[low + 1 : high + 1] & np.uint32(0x7FFFFFFF)
        out[n:end] = out[low + REACH : high + REACH] ^ mixed >> np.uint32(1) ^ (mixed & np.uint32(1)) * np.uint32(TWIST)
    return out[:count]


@lru_cache(maxsize=1)
def characteristic() -> int:
    """The polynomial, bit k for t^k: the shortest recurrence of one bit of the stream, by Berlekamp and Massey."""
    bits = (raw_words(seeded(1), 2 * BITS + 1)[1:] & np.uint32(1)).tolist()
    found, before, length, gap, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = seen << 1 | bit
        if not (found & seen).bit_count() & 1:
            gap += 1
        elif 2 * length > n:
            found ^= before << gap
            gap += 1
        else:
            found, before, length, gap = found ^ before << gap, found, n + 1 - length, 1
    return int(f"{found:b}".zfill(length + 1)[::-1], 2)


#: Each byte with a zero between its bits: a square over bits.
_SPREAD = np.array([sum((b >> k & 1) << 2 * k for k in range(8)) for b in range(256)], "<u2")


def power(exponent: int, modulus: int) -> int:
    """t to a power, modulo a polynomial."""
    degree, out = modulus.bit_length() - 1, 1
    for bit in f"{exponent:b}":
        held = np.frombuffer(out.to_bytes(degree // 8 + 1, "little"), np.uint8)
        out = int.from_bytes(_SPREAD[held].tobytes(), "little") << int(bit)
        while (n := out.bit_length()) > degree:
            out ^= modulus << (n - 1 - degree)
    return out


def state_at(seed: int, place: int, modulus: int) -> np.ndarray:
    """The state from which the stream's words from ``place`` on follow."""
    state = seeded(seed)
    if place == 0:
        return state
    terms = power(place, modulus)
    words = raw_words(state, BITS + WORDS)
    out = np.zeros(WORDS, np.uint32)
    for k in np.flatnonzero(np.unpackbits(np.frombuffer(terms.to_bytes(BITS // 8 + 1, "little"), np.uint8), bitorder="little")).tolist():
        out ^= words[k : k + WORDS]
    return out


class Stream:
    """The words of a seed from a place on."""

    def __init__(self, seed: int, place: int = 0, modulus: int | None = None):
        self._bits = np.random.MT19937()
        key = state_at(seed, place, characteristic() if modulus is None and place else modulus)
        self._bits.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": WORDS}}

    def words(self, count: int) -> np.ndarray:
        return self._bits.random_raw(count).astype(np.uint32)

    def values(self, count: int, kind: str) -> np.ndarray:
        """``double`` and ``float``: uniform in [0, 1), of two words (the low one first) and of one; ``int``:
        from 0 to the largest, of a word's high bits."""
        if kind == "double":
            low, high = self.words(2 * count).reshape(-1, 2).T.astype(np.float64)
            return np.minimum((low + high * 2.0**32) / 2.0**64, np.nextafter(1.0, 0.0))
        if kind == "float":
            return np.minimum(self.words(count).astype(np.float32) / np.float32(2.0**32), np.nextafter(np.float32(1), np.float32(0)))
        return (self.words(count) >> np.uint32(1)).astype(np.int32)
