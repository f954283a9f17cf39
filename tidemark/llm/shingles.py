"""Word shingles of a text as sorted distinct 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words, the same everywhere."""
    return mixed(np.arange(1, n + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTES, BASE = numbers(256, 11), 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse, as many as the longest text so far has bytes."""

    up = np.ones(1, "u8")
    down = np.ones(1, "u8")

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up), 1 << 16)
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(n, base, "u8")
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def identity(words: list[bytes]) -> bytes | None:
    """128 bits that stand for the sequence of words; None if there is none."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def shingle_set(words: list[bytes], k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence, if there are fewer words; empty without words.

    A hash is a polynomial over the bytes from the first word's first to the last word's last, modulo 2^64.
    """
    if not words:
        return np.zeros(0, "u8")
    k = min(k, len(words))
    data = np.frombuffer(b" ".join(words), "u1")
    Powers.upto(len(data) + 1)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(BYTES[data] * Powers.up[: len(data)], out=sums[1:])
    s, e = starts[: len(words) - k + 1], ends[k - 1 :]
    return np.unique(mixed((sums[e] - sums[s]) * Powers.down[s]))
