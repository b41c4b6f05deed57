"""Texts as arrays of numbers: word hashes, shingle sets and MinHash signatures (numpy, for use inside tasks).

A word is a run of bytes other than space and 0x09-0x0D in the UTF-8 text, with
A-Z lower-cased.  Words and shingles are 64-bit hashes; two different shingles
share one with a probability of about 2**-64.
"""

from __future__ import annotations

import numpy as np

GOLDEN = 0x9E3779B97F4A7C15
#: An odd base and its inverse modulo 2**64.
BASE = 0xD1342543DE82EF95
UNBASE = pow(BASE, -1, 1 << 64)
#: Bits of a signature value below its permutation step.
STEP_BITS = 25

_TABLES: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(seed)) | np.uint64(1)


def tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each byte, which bytes are white space, and n powers of BASE and UNBASE."""
    if len(_TABLES.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", UNBASE)):
            powers = np.empty(size, np.uint64)
            powers[0] = 1
            np.cumprod(np.full(size - 1, base, np.uint64), out=powers[1:])
            _TABLES[name] = powers
        number = constants(256, 1)
        number[65:91] = number[97:123]
        space = np.zeros(256, bool)
        space[[32, *range(9, 14)]] = True
        _TABLES["number"], _TABLES["space"] = number, space
    return _TABLES["number"], _TABLES["space"], _TABLES["up"], _TABLES["down"]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word."""
    a = np.frombuffer(data, np.uint8)
    number, space, up, down = tables(len(a) + 1)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~space[a]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(number[a] * up[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def word_hashes(text: str | None) -> np.ndarray:
    return word_spans((text or "").encode("utf-8", "surrogatepass"))[0]


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words in order; of all words together if there are fewer; empty without words."""
    if not len(words):
        return np.empty(0, np.uint64)
    m = min(n, len(words))
    k = constants(n + 1, 2)
    out = np.full(len(words) - m + 1, m * int(k[n]) % 2**64, np.uint64)
    for i in range(m):
        out += words[i : len(words) - m + 1 + i] * k[i]
    return mix(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(word_hashes(text), n))


def superminhash(elements: np.ndarray, k: int) -> np.ndarray:
    """SuperMinHash signature: k values of step << STEP_BITS | fraction.

    Each element walks through a random permutation of the k slots and offers
    slot p(j) the value j + r(j) with r(j) in [0, 1); a slot keeps the least.
    All elements take step j at once, and the walk stops as soon as every slot
    holds a value that step j cannot undercut.
    """
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    n = len(elements)
    slots = None
    every = np.arange(n)
    for j in range(k if n else 0):
        if int(out.max()) < j << STEP_BITS:
            break
        x = mix(elements + np.uint64((j + 1) * GOLDEN % 2**64))
        value = (x >> np.uint64(64 - STEP_BITS)).astype(np.uint32) | np.uint32(j << STEP_BITS)
        swap = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(k - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            first, slot = swap, swap
        else:
            if slots is None:
                slots = np.tile(np.arange(k, dtype=np.uint8 if k <= 256 else np.uint16), (n, 1))
                slots[every, first] = 0
            slot = slots[every, swap]
            slots[every, swap] = slots[:, j]
        np.minimum.at(out, slot, value)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    rows = signature.astype(np.uint64).reshape(bands, -1)
    k = constants(rows.shape[1] + 1, 3)
    return mix((rows * k[:-1]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * k[-1]).view(np.int64)
