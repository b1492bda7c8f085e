"""Words of many texts at once, as 64-bit hashes, from the UTF-8 bytes of an Arrow array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

_U = np.uint64


def _table(separators) -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    return inside


#: byte → is part of a word
BLANK = _table([0x20, *range(0x09, 0x0E)])
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=_U)
_ODD = [_U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets per text); null is an empty text."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = pa.compute.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def hash_runs(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of every run of bytes, eight bytes at a time; equal runs have equal hashes wherever they lie."""
    lanes = np.zeros(len(raw) // 8 + 3, dtype=_U)
    lanes.view(np.uint8)[: len(raw)] = raw
    out = lengths.astype(_U) * _ODD[0]
    live, at, left = None, starts, lengths
    while len(at):
        cell, shift = at >> 3, ((at & 7) << 3).astype(_U)
        value = lanes[cell] >> shift
        high = lanes[cell + 1] << ((_U(64) - shift) & _U(63))
        value |= np.where(shift == 0, _U(0), high)
        value &= _MASKS[np.minimum(left, 8)]
        if live is None:
            out = mix(out ^ (value * _ODD[1]))
            live = np.flatnonzero(left > 8)
        else:
            out[live] = mix(out[live] ^ (value * _ODD[1]))
            live = live[left > 8]
        keep = left > 8
        at, left = at[keep] + 8, left[keep] - 8
    return out


def hashed_words(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash per word after lower-casing A-Z, offsets of each text's words). ``inside``: ``BLANK`` or ``ALNUM``."""
    return located_words(texts, inside)[:2]


def located_words(texts: pa.Array, inside: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple:
    """As ``hashed_words``, with the first byte of each word and the byte behind it, counted from the first text.

    Then, for each length in ``prefixes``, the hashes of the words' first so many bytes.
    """
    raw, offsets = text_bytes(texts)
    if not len(raw):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, _U) for _ in prefixes]
    raw = _LOWER[raw]
    word = inside[raw]
    first, last = np.empty(len(raw), bool), np.empty(len(raw), bool)
    first[0], first[1:] = True, ~word[:-1]
    last[-1], last[:-1] = True, ~word[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[full] = True
    last[full[1:] - 1] = True
    starts, ends = np.flatnonzero(word & first), np.flatnonzero(word & last) + 1
    heads = [hash_runs(raw, starts, np.minimum(ends - starts, n)) for n in prefixes]
    return hash_runs(raw, starts, ends - starts), np.searchsorted(starts, offsets), starts, ends, *heads


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` words; runs across texts are included and must be left out by the caller."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, _U(salt * 0x9E3779B9 + k), dtype=_U)
    for j in range(k):
        out = out * _ODD[2] + words[j : j + n] * _ODD[3]
        if j % 2:
            out ^= out >> _U(29)
    return mix(out)
