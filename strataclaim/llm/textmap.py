"""Arrow-batch helpers of the text operators: words, hashes, streaming maps."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

WORD = regex.compile(r"[\p{L}\p{N}]+")
#: ASCII texts take the quick way: all that is neither letter nor digit becomes a blank.
_BEYOND = re.compile(r"[^\x00-\x7F]")
_ASCII = {i: (chr(i).lower() if chr(i).isalnum() else " ") for i in range(128)}


def words(text: str | None) -> list[str]:
    """The words of a text: unbroken runs of letters and digits of any script, lower-cased."""
    if not text:
        return []
    if not text.isascii():
        # a few marks beyond ASCII become blanks; letters beyond it take the long way
        marks = set(_BEYOND.findall(text))
        if len(marks) > 8 or WORD.search("".join(marks)):
            return WORD.findall(text.lower())
        for c in marks:
            text = text.replace(c, " ")
    return text.translate(_ASCII).split()


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over every Arrow batch of ``df``; batches without result are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words, kept between batches up to a bound on their number."""

    BOUND = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (in place where it can)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


_BYTES = np.zeros(256, np.uint8)
for _i in range(256):
    _BYTES[_i] = ord(chr(_i).lower()) if _i < 128 and chr(_i).isalnum() else _i if _i >= 128 else 0
_FACTOR = 0x9DDFEA08EB382D69
_POWERS: dict[int, np.ndarray] = {}


def powers(factor: int, n: int) -> np.ndarray:
    """The powers 0 .. n - 1 of an odd factor modulo 2**64, kept for the next call."""
    if len(kept := _POWERS.get(factor, ())) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        kept = np.full(size, factor, np.uint64)
        kept[0] = 1
        _POWERS[factor] = kept = np.cumprod(kept, dtype=np.uint64)
        if n > 2**24:
            # one very long text shouldn't fill the worker's memory for good
            del _POWERS[factor]
    return kept


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, factor: int = _FACTOR) -> np.ndarray:
    """64-bit hashes of the runs ``values[start:end]``: polynomials in an odd factor, so that equal runs
    hash alike wherever they stand."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64, copy=False) * powers(factor, len(values))[: len(values)], out=sums[1:])
        inverse = pow(factor, -1, 2**64)
        return mix((sums[ends] - sums[starts]) * powers(inverse, len(values) + 1)[starts])


def joined_text(columns: list[pa.Array]) -> pa.Array:
    """The parts of each row with a blank between them; null parts count as nothing."""
    filled = [pc.fill_null(c, "") for c in columns]
    return filled[0] if len(filled) == 1 else pc.binary_join_element_wise(*filled, " ")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text one after the other, and the number of words by text.

    Words are those of ``words``. All texts are read at once as bytes; those beyond ASCII are first
    brought to their words, so that each of their bytes beyond ASCII belongs to a word.
    """
    n = len(texts)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    plain = pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
    if not plain.all():
        odd = pa.array([" ".join(words(t)) for t in texts.filter(pa.array(~plain)).to_pylist()], texts.type)
        texts = pc.replace_with_mask(texts, pa.array(~plain), odd)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    size = int(bounds[-1] - bounds[0])
    if not size:
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    low = _BYTES[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
    bounds -= bounds[0]
    inside = low != 0
    first = np.zeros(size + 1, bool)
    first[bounds] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    at = np.flatnonzero(starts)
    return span_hashes(low, at, np.flatnonzero(ends) + 1), np.diff(np.searchsorted(at, bounds))


def run_hashes(hashes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of each document, and the number of them by document.

    Runs never cross documents; a document of fewer than ``n`` words has none. Repeats stay.
    """
    total = len(hashes)
    counts = np.maximum(sizes - (n - 1), 0)
    if total < n:
        return np.empty(0, np.uint64), np.zeros(len(sizes), np.int64)
    h = np.zeros(total - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h *= np.uint64(0x100000001B3)
            h += hashes[k : total - n + 1 + k] * np.uint64(2 * k + 1)
    h = mix(h)
    starts = np.cumsum(sizes) - sizes
    # the last n-1 places of a document start no run
    keep = np.ones(total, bool)
    for k in range(1, n):
        at = starts + sizes - k
        at = at[(sizes >= k)]
        keep[at] = False
    return h[keep[: len(h)]], counts


def shingle_hashes(docs: list[list[str]], n: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """``run_hashes`` of documents that are lists of words already."""
    sizes = np.fromiter((len(w) for w in docs), np.int64, len(docs))
    return run_hashes(np.fromiter(map(cache.__getitem__, chain.from_iterable(docs)), np.uint64, int(sizes.sum())), sizes, n)
