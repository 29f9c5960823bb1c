"""Problem 8: passages of evaluation items inside the training text, by spaced-seed hashing.

A seed is a fixed mask over ``span`` consecutive words; the words at its ignored places may differ.
Windows of both sides are hashed under each mask and joined on the hash; around every hit the
overlap is extended both ways over substituted words, and measured. A run of ``min_run`` equal words
is hit by every mask of ``span <= min_run``, wherever the run lies, so none is missed.

Cost: one pass over the corpus. A bitmap of the items' hashes, of 128 bits a window as counted (16 bytes;
``MAX_BITS`` at most, which 16 million windows fill so far), lets only documents with a possible hit leave
the pass; these carry their text along, so the corpus itself is never shuffled. Items' hashes are then
joined, broadcast only if they are proven small. Repeated documents and items that share a passage each give their own rows. Null and empty
texts on either side give none. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataclaim.llm.textmap import mix, word_hashes, words
from strataclaim.session import broadcast_checked, cut

#: Fixed masks over 14 words; 0 is an ignored place.
MASKS = ("11101100101111", "11011110110011")
MIN_RUN = 14
#: The bitmap has 128 bits a window of the items, of which ``PROBES`` are set, and 2**31 (256 MB) at most.
MAX_BITS, PROBES = 31, 3


def seed_hashes(hashes: np.ndarray, masks: tuple[str, ...]) -> list[np.ndarray]:
    """Hashes of all windows of word hashes under each mask."""
    out = []
    for number, mask in enumerate(masks):
        n = len(hashes) - len(mask) + 1
        if n < 1:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.full(n, number + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k, bit in enumerate(mask):
                if bit == "1":
                    h *= np.uint64(0x100000001B3)
                    h ^= hashes[k : k + n] + np.uint64(k)
        out.append(mix(h))
    return out


def _windows(texts: pa.Array, masks: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, place of the first word, hash) of all windows under each mask, none across texts."""
    flat, sizes = word_hashes(texts)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for mask, h in zip(masks, seed_hashes(flat, masks)):
        inside = np.flatnonzero(owner[: len(h)] == owner[len(mask) - 1 :][: len(h)])
        yield owner[inside], (inside - starts[owner[inside]]).astype(np.int32), h[inside]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low in range(0, b.num_rows, rows):
            yield b.slice(low, rows)


def _seeds_of(masks: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            for owner, at, h in _windows(b.column(1), masks):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(h.view(np.int64)), pa.array(at)], names=["item_id", "hash", "item_at"])

    return run


def _place(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bit of a bitmap that stands for a hash in one probe."""
    with np.errstate(over="ignore"):
        return (mix(h + np.uint64(probe)) if probe else h) >> np.uint64(64 - bits)


def bitmap_of(seeds: DataFrame, bits: int) -> bytes:
    """A bitmap of hashes; its parts are filled on the executors, each by one task."""
    part = min(bits, 19)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate([_place(b.column(0).to_numpy().view(np.uint64), k, bits) for k in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(part)).astype(np.int32)), pa.array((at & np.uint64(2**part - 1)).astype(np.int32))], names=["part", "at"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            number, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(number).tolist():
                own = at[number == k]
                np.bitwise_or.at(parts.setdefault(k, np.zeros(2**part // 8, np.uint8)), own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "bytes"])

    whole = np.zeros((2 ** (bits - part), 2**part // 8), np.uint8)
    filled = seeds.select("hash").mapInArrow(place, "part int, at int").repartition("part").mapInArrow(fill, "part int, bytes binary")
    for r in filled.toLocalIterator():
        whole[r.part] = np.frombuffer(r.bytes, np.uint8)
    return whole.tobytes()


def _in_bitmap(h: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes that may be in a bitmap."""
    left = np.arange(len(h))
    for k in range(PROBES):
        at = _place(h[left], k, bits)
        left = left[np.flatnonzero((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)]
    return left


def _hits_of(masks: tuple[str, ...], bitmap, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap_ = np.frombuffer(bitmap.value, np.uint8)
        for b in _slices(batches):
            found = []
            for owner, at, h in _windows(b.column(1), masks):
                hit = _in_bitmap(h, bitmap_, bits)
                found.append((owner[hit], at[hit], h[hit]))
            owner, at, h = (np.concatenate(x) for x in zip(*found))
            if not len(owner):
                continue
            order = np.argsort(owner, kind="stable")
            rows, sizes = np.unique(owner, return_counts=True)
            hits = pa.StructArray.from_arrays([pa.array(h[order].view(np.int64)), pa.array(at[order])], ["hash", "doc_at"])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take).cast(pa.string()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), hits)], names=["doc_id", "text", "hits"]
            )

    return run


def overlaps(doc: list[str], item: list[str], at: list[tuple[int, int]], gap: int) -> tuple[int, int, int]:
    """(longest run of equal words, words of the longest overlap, equal words in it) around hits.

    On each hit's diagonal, runs of equal words join over up to ``gap`` substituted words.
    """
    best_run = best_span = best_same = 0
    for d in sorted({a - b for a, b in at}):
        low, high = max(0, d), min(len(doc), len(item) + d)
        same = np.fromiter((doc[k] == item[k - d] for k in range(low, high)), bool, high - low)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
        start = end = total = None
        for s, e in edges.reshape(-1, 2):
            best_run = max(best_run, int(e - s))
            if end is not None and s - end <= gap:
                end, total = e, total + e - s
            else:
                start, end, total = s, e, e - s
            if total > best_same:
                best_span, best_same = int(end - start), int(total)
    return best_run, best_span, best_same


def leaked_items(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, min_run: int = MIN_RUN, masks: tuple[str, ...] = MASKS, gap: int = 2) -> DataFrame:
    """``(doc_id, item_id, run, span, same)`` of documents that share at least one seed with an item.

    ``run`` is the longest run of equal words, ``span`` and ``same`` the words and the equal words of
    the longest overlap that tolerates up to ``gap`` substituted words in a row.
    """
    if any(len(m) > min_run for m in masks):
        raise ValueError("a mask longer than min_run can miss a run")
    spark = docs.sparkSession
    test = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    item_type, doc_type = (df.schema[c].dataType.simpleString() for df, c in ((items, item_id), (docs, doc_id)))
    seeds = cut(test.where("text is not null").mapInArrow(_seeds_of(masks), f"item_id {item_type}, hash bigint, item_at int"))
    # three bits of 128 are set at most, so about one window of 80,000 leaves by chance
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(128 * max(1, seeds.count())))))
    shared = spark.sparkContext.broadcast(bitmap_of(seeds, bits))
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).where("text is not null")
    near = cut(src.mapInArrow(_hits_of(masks, shared, bits), f"doc_id {doc_type}, text string, hits array<struct<hash:bigint,doc_at:int>>"))
    side, _ = broadcast_checked(seeds)
    pairs = (
        near.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.hash", "h.doc_at").join(side, "hash")
        .groupBy("doc_id", "item_id").agg(F.collect_set(F.col("doc_at") - F.col("item_at")).alias("diagonals"))
    )
    texts, _ = broadcast_checked(test.select("item_id", F.col("text").alias("item_text")), 10_000)
    both = pairs.join(near.select("doc_id", "text").dropDuplicates(["doc_id", "text"]), "doc_id").join(texts, "item_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [overlaps(words(t), words(x), [(d, 0) for d in ds], gap) for t, x, ds in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int32()) for c in zip(*out))], names=["doc_id", "item_id", "run", "span", "same"])

    found = both.select("doc_id", "item_id", "text", "item_text", "diagonals").mapInArrow(measure, f"doc_id {doc_type}, item_id {item_type}, run int, span int, same int")
    return found.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "run", "span", "same")
