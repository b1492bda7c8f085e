"""Reproducible noise: uniforms and normals from a hash of the row's own keys.

The value of a row depends on the seed and its keys only, so repartitioning, retries and lost
executors cannot change a simulation.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column | str, salt: str = "u") -> Column:
    """Uniform in (0, 1) from the first 32 bits of an MD5 over seed, salt and key parts."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[c.cast("string") for c in cols]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(seed: int, *parts: Column | str) -> Column:
    """Standard normal by the Box–Muller transform of two uniforms."""
    u, v = uniform(seed, *parts, salt="u"), uniform(seed, *parts, salt="v")
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


# --- the same noise on arrays ------------------------------------------------------------------

_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
#: messages hashed at a time, so that the state stays in a core's cache; the longest message of one block
_AT_ONCE, _LONGEST = 16_384, 55


def _first_words(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """First word of the MD5 of messages of one block: ``words[i]`` is the i-th little-endian word of all of them, the rest is empty."""
    message = [*words, *[np.uint32(0)] * (14 - len(words)), bits, np.uint32(0)]
    a, b, c, d = (np.full(len(bits), v, np.uint32) for v in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), (7 * i) % 16
        f += a
        f += message[g]
        f += np.uint32(_SINES[i])
        turned = f >> np.uint32(32 - _TURNS[i])
        f <<= np.uint32(_TURNS[i])
        f |= turned
        a, d, c, b = d, c, b, b + f
    return a + np.uint32(_START[0])


def _alike(values: np.ndarray) -> list[tuple[slice, np.ndarray]]:
    """Runs of ascending whole numbers with the same number of digits, and those digits as characters."""
    cuts = [0, *np.searchsorted(values, [10**k for k in range(1, 19) if len(values) and 10**k <= values[-1]]), len(values)]
    return [(slice(a, z), (values[a:z, None] // 10 ** np.arange(len(str(values[a])) - 1, -1, -1) % 10 + 48).astype(np.uint8)) for a, z in zip(cuts, cuts[1:]) if z > a]


def uniforms(head: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Matrix of ``uniform`` for messages ``head:first:second``: a row per second, a column per first number, both ascending and not negative."""
    head = f"{head}:".encode()
    longest = len(head) + len(str(first[-1])) + 1 + len(str(second[-1]))
    if longest > _LONGEST:
        digest = lambda i, j: int.from_bytes(hashlib.md5(head + f"{i}:{j}".encode()).digest()[:4], "big")
        return (np.array([[digest(i, j) for i in first] for j in second], dtype=float) + 0.5) / 4294967296.0
    text = np.zeros((len(second), len(first), 4 * (longest // 4 + 1)), dtype=np.uint8)
    bits = np.empty((len(second), len(first)), dtype=np.uint32)
    text[:, :, : len(head)] = np.frombuffer(head, dtype=np.uint8)
    for columns, left in _alike(first):
        for rows, right in _alike(second):
            block, at = text[rows, columns], len(head) + left.shape[1]
            block[:, :, len(head) : at] = left
            block[:, :, at] = ord(":")
            end = at + 1 + right.shape[1]
            block[:, :, at + 1 : end] = right[:, None]
            block[:, :, end] = 0x80
            bits[rows, columns] = 8 * end
    words = np.ascontiguousarray(text.view("<u4").reshape(bits.size, -1).T)
    bits, out = bits.reshape(-1), np.empty(bits.size, dtype=np.uint32)
    for lo in range(0, len(out), _AT_ONCE):
        out[lo : lo + _AT_ONCE] = _first_words(words[:, lo : lo + _AT_ONCE], bits[lo : lo + _AT_ONCE])
    return (out.byteswap().astype(float).reshape(len(second), len(first)) + 0.5) / 4294967296.0


def normals(seed: int, keys: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Matrix of ``normal(seed, key parts, first, second)``; ``keys`` are the key parts, each behind a colon."""
    u, v = (uniforms(f"{seed}:{salt}{keys}", first, second) for salt in "uv")
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * v)


def plain_uniform(seed: int, *parts, salt: str = "u") -> float:
    """``uniform`` of plain values."""
    digest = hashlib.md5(":".join([str(seed), salt, *map(str, parts)]).encode()).digest()
    return (int.from_bytes(digest[:4], "big") + 0.5) / 4294967296.0
