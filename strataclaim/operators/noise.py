"""Spark's ``xxhash64`` of whole arrays, and the normal numbers that ``graph.gaussian`` draws from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: The values that a uniform number may take.
LEVELS = 1_000_003


def _turn(h: np.ndarray, bits: int) -> np.ndarray:
    """``h`` rotated to the left, in place."""
    low = h >> (64 - bits)
    h <<= bits
    h |= low
    return h


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> 33
    h *= _P2
    h ^= h >> 29
    h *= _P3
    h ^= h >> 32
    return h


def hash_int(seeds: np.ndarray, value: int) -> np.ndarray:
    """``seeds`` after one more INT; a new array."""
    h = seeds + (_P5 + np.uint64(4))
    h ^= np.full(1, value & 0xFFFFFFFF, np.uint64) * _P1
    _turn(h, 23)
    h *= _P2
    h += _P3
    return _mix(h)


def by_length(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, parts) of all texts of as many UTF-8 bytes; null has length -1.

    ``parts`` are what ``hash_text`` takes: a column for each text, a row for each of its words of 8
    bytes, its word of 4 and its last bytes, multiplied as far as no seed is needed.
    """
    texts = pa.concat_arrays([texts.cast(pa.large_binary())])
    ends, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lengths = np.where(texts.is_null().to_numpy(zero_copy_only=False), -1, np.diff(ends))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        if n <= 0:
            yield n, at, np.empty((0, len(at)), np.uint64)
            continue
        raw = data[ends[at][:, None] + np.arange(n)]
        words = np.ascontiguousarray(raw[:, : n // 8 * 8]).view("<u8").T * _P2
        lanes = n // 32 * 4
        rest = _turn(words[lanes:], 31) * _P1
        four = np.ascontiguousarray(raw[:, n // 8 * 8 : n // 4 * 4]).view("<u4").T.astype(np.uint64) * _P1
        last = raw[:, n // 4 * 4 :].T.astype(np.uint64) * _P5
        yield n, at, np.concatenate([words[:lanes], rest, four, last])


def hash_text(h: np.ndarray, length: int, parts: np.ndarray) -> np.ndarray:
    """Seeds ``h`` (a column for each text) after texts of ``length`` bytes; ``h`` is overwritten."""
    if length < 0:
        return h
    k = 0
    if length >= 32:
        lanes = [h + _P1 + _P2, h + _P2, h.copy(), h - _P1]
        for _ in range(length // 32):
            for v in lanes:
                v += parts[k]
                _turn(v, 31)
                v *= _P1
                k += 1
        h = sum(_turn(v.copy(), bits) for v, bits in zip(lanes, (1, 7, 12, 18)))
        for v in lanes:
            v *= _P2
            _turn(v, 31)
            v *= _P1
            h ^= v
            h *= _P1
            h += _P4
    else:
        h += _P5
    h += np.uint64(length)
    for _ in range(length % 32 // 8):
        h ^= parts[k]
        _turn(h, 27)
        h *= _P1
        h += _P4
        k += 1
    if length % 8 >= 4:
        h ^= parts[k]
        _turn(h, 23)
        h *= _P2
        h += _P3
        k += 1
    for _ in range(length % 4):
        h ^= parts[k]
        _turn(h, 11)
        h *= _P1
        k += 1
    return _mix(h)


def seeds(*ints: int) -> np.ndarray:
    """The hash of INT columns of one row each, as ``xxhash64`` begins it."""
    h = np.full(1, 42, np.uint64)
    for x in ints:
        h = hash_int(h, x)
    return h


def normal(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Standard normal numbers of two hashes each."""

    def uniform(h: np.ndarray) -> np.ndarray:
        h = h.view(np.int64)
        return ((h - h // LEVELS * LEVELS) + 0.5) / LEVELS

    u = np.log(uniform(first))
    u *= -2.0
    np.sqrt(u, out=u)
    u *= np.cos(2.0 * np.pi * uniform(second))
    return u
