"""Problem 2: near-duplicate records across a collection too large for pairwise comparison.

Improved consistent weighted sampling over TF-IDF weighted shingles, banded, verified:

1. *Counts.* One pass hashes the word shingles of every record and counts records by hash bucket. The
   counts of all records form a sketch of a fixed size (2**20 counters), summed across partitions; a
   bucket's count, less the mean load of all buckets (what collisions add, however long texts are), gives
   the inverse document frequency. What is in fewer than exp(-``RARE``) of all records gets the highest
   weight alike. The k-th occurrence of a shingle in a record is an element of its own, so a shingle
   weighs its frequency in the record times its inverse document frequency. The same pass gives each
   record a key of its words and a signature: the least hash in each of ``BINS`` bins, four bits each.
2. *Exact copies* share a key; only one representative of each goes on, all are given back at the end.
3. *Samples.* Improved consistent weighted sampling keeps, for each sample number, the element of the
   record with the least a, a being drawn from a hash of the element. As an element has the same weight
   wherever it occurs, its r, c, beta and t are the same everywhere too and only a matters, which is
   exponential at the rate of the weight; so a hash is read as a's quantile, and two records share a
   sample with the probability of their weighted Jaccard similarity. A passage that many records hold weighs little
   in these, so a record of which such shingles make up over ``LOW_SHARE`` also draws samples in which all
   shingles weigh the same: of a pair at a similarity of 0.5 or more whose common part is mostly common
   to many, both records are such.
4. *Bands.* ``rows`` samples make one band hash; (band hash, key) rows are shuffled once and sorted,
   and equal hashes are paired as they stream by. A task sends a key once, however many copies of the
   record it meets. A run over ``BLOCK`` keys isn't held or paired by one task: its keys leave in blocks as
   they come, and pairs of blocks are joined by (band, block, block), so no case is dropped.
5. *Sifting.* Candidates whose signatures lie over ``SIGMAS`` standard deviations under the least
   similarity that can pass are let go (about 3 of a million of those just at the threshold).
6. *Verification.* Each pair left is fetched once, and the weighted Jaccard similarity and that
   of the plain shingle sets are computed from the whole texts.

A record with fewer words than a shingle has no shingles; it is in no pair and under no representative. Null parts of a record count as nothing. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataclaim.llm.textmap import joined_text, mix, run_hashes, span_hashes, word_hashes
from strataclaim.session import write_cut

BANDS, ROWS = 36, 3
#: Bands and rows of the samples of equal weights: of pairs at a set similarity of 0.5, 0.99 share a band.
FLAT_BANDS, FLAT_ROWS = 72, 4
SKETCH_BITS = 20
BLOCK = 1_000
LEVELS = 8
#: A shingle in a share of records over exp(-COMMON) weighs the least; one under exp(-RARE), the most.
COMMON, RARE = 3.0, 5.5
#: The least weight as a share of the highest.
LEAST = 0.2
#: A record draws samples of equal weights too if shingles of the lowest level are over this share of its own.
LOW_SHARE = 0.3
SLICES = 64
#: Bins of a signature (four bits each, in whole 64-bit words), and how far under its threshold a pair may look.
BINS, SIGMAS = 128, 4.5
_WORDS = BINS // 16
#: Keys that a task remembers having sent.
SEEN = 1_000_000


def level_weights(levels: int = LEVELS) -> np.ndarray:
    """Weights of the levels of inverse document frequency: equal steps from the least to the highest."""
    return np.linspace(LEAST, 1, levels)


def sampling_table(levels: int = LEVELS) -> np.ndarray:
    """Rate of a by level: in consistent weighted sampling a of an element of weight w is exponential at rate w."""
    return level_weights(levels)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in slices whose shingles stay in the processor's cache, so little is held at a time."""
    for b in batches:
        for low in range(0, b.num_rows, rows):
            yield b.slice(low, rows)


_HASH = np.uint64(2**40 - 1)


def _sorted_elements(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(elements, those that are first occurrences): 40-bit hashes under the record's number, sorted.

    Records of a slice fit 24 bits above the hash. The k-th occurrence of a shingle has a hash of its own.
    """
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    k = np.sort((doc << np.uint64(40)) | (h >> np.uint64(24)))
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    again = np.flatnonzero(~first)
    if not len(again):
        return k, k
    start = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
    number = (again - start[again]).astype(np.uint64)
    own = k[first]
    k[again] = (k[again] & ~_HASH) | (mix((k[again] & _HASH) + (number << np.uint64(40))) >> np.uint64(24))
    return np.sort(k), own


def _signatures(k: np.ndarray, records: int) -> np.ndarray:
    """Signatures (records x words of 64 bits) of sorted elements: of each bin of hashes four bits of the least."""
    cell = (k >> np.uint64(41 - BINS.bit_length())).astype(np.int64)
    head = np.ones(len(cell), bool)
    head[1:] = cell[1:] != cell[:-1]
    marks = np.zeros(records * BINS, np.uint64)
    # 0 is an empty bin
    marks[cell[head]] = mix((k[head] & _HASH) + np.uint64(3)) % np.uint64(15) + np.uint64(1)
    return np.bitwise_or.reduce(marks.reshape(records, _WORDS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)


def _count(n: int, bits: int, step: int, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(2**bits, np.int64)
        names = ["id", "key", "key2", *(f"s{j}" for j in range(_WORDS)), "slice", "counts"]
        b = None
        for b in _slices(batches):
            flat, sizes = word_hashes(joined_text(b.columns[1:]))
            h, counts = run_hashes(flat, sizes, n)
            k, own = _sorted_elements(h, counts)
            np.add.at(sketch, ((own & _HASH) >> np.uint64(40 - bits)).astype(np.int64), 1)
            keys, bare, nothing = _keys(flat, sizes), counts == 0, pa.nulls(b.num_rows)
            signs = _signatures(own if plain else k, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, mask=bare) for x in keys), *(pa.array(np.ascontiguousarray(signs[:, j]), mask=bare) for j in range(_WORDS)), nothing.cast(pa.int32()), nothing.cast(pa.binary())], names=names
            )
        part = TaskContext.get().partitionId()
        used = [k for k in range(SLICES) if sketch[k * step : (k + 1) * step].any()]
        if used:
            empty = pa.nulls(len(used))
            data = [sketch[k * step : (k + 1) * step].astype("<i4").tobytes() for k in used]
            yield pa.RecordBatch.from_arrays([empty.cast(b.schema.field(0).type), pa.array([part] * len(used), pa.int64()), *[empty.cast(pa.int64())] * (_WORDS + 1), pa.array(used, pa.int32()), pa.array(data, pa.binary())], names=names)

    return run


def _keys(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each record's words in their order."""
    ends = np.cumsum(sizes)
    return tuple(span_hashes(flat, ends - sizes, ends, f).view(np.int64) for f in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _sum_slices(step: int):
    """Sums slices as they stream by; a partition holds whole slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1)):
                add = np.frombuffer(c.as_buffer(), "<i4").astype(np.int64) if len(c.as_buffer()) == 4 * step else np.frombuffer(c.as_buffer(), "<i8")
                sums[k] = sums[k] + add if k in sums else add.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["slice", "counts"])

    return run


def sketch_levels(counted: DataFrame, records: int, bits: int, step: int) -> np.ndarray:
    """The level of every bucket, from the sketches of all partitions.

    Slices are summed in two rounds on the executors; what comes to the driver is the sum, of a
    fixed size (8 MB).
    """
    schema = "slice int, counts binary"
    part = counted.where("slice is not null").select("slice", "counts", F.pmod("key", F.lit(16)).alias("salt"))
    once = part.repartition("slice", "salt").select("slice", "counts").mapInArrow(_sum_slices(step), schema)
    sums = once.repartition("slice").mapInArrow(_sum_slices(step), schema).collect()
    total = np.zeros(2**bits, np.int64)
    for r in sums:
        total[r.slice * step : (r.slice + 1) * step] += np.frombuffer(r.counts, "<i8")
    idf = np.log(max(records, 1) / np.maximum(total - total.mean(), 1))
    return np.clip(np.rint((idf - COMMON) / (RARE - COMMON) * (LEVELS - 1)), 0, LEVELS - 1).astype(np.uint8)


def _draws(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, np.uint32)


def band_hashes(h: np.ndarray, counts: np.ndarray, levels: np.ndarray, table: np.ndarray, bits: int, bands: int, rows: int) -> np.ndarray:
    """Band hashes (records x bands) of records that have shingles.

    ``h`` has 40-bit hashes by record, ``table`` the rates by level. An element's draw is its quantile;
    within a level the least draw has the least a, so a is worked out once a level of a record.
    """
    has = np.flatnonzero(counts)
    level = levels[(h >> np.uint64(40 - bits)).astype(np.int64)]
    owner = np.repeat(np.arange(len(has), dtype=np.uint64) * np.uint64(len(table)), counts[has])
    k = np.sort(((owner + level) << np.uint64(32)) | (mix(h + np.uint64(1)) >> np.uint64(32)))
    seed, cell = k.astype(np.uint32), (k >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, np.int64)
    cells = cell[starts]
    rate = table[cells % len(table)]
    owners = cells // len(table)
    first = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1]))) if len(owners) else owners
    scale, both = (1 / rate).astype(np.float32), np.empty(2 * len(starts), np.uint32)
    drawn, out = np.empty_like(seed), np.zeros((len(has), bands), np.uint64)
    mul, add = _draws(bands * rows, 11)
    with np.errstate(over="ignore"):
        for n in range(bands * rows):
            np.multiply(seed, mul[n], out=drawn)
            np.add(drawn, add[n], out=drawn)
            least = np.minimum.reduceat(drawn, starts)
            # -log(1 - x) to the third order, over the rate; its bits stand above the draw's, as the least of both is wanted
            x = least.astype(np.float32) * np.float32(2.0**-32)
            both[1::2] = (x * (1 + x * (np.float32(1 / 2) + x * np.float32(1 / 3))) * scale).view(np.uint32)
            both[::2] = least
            best = np.minimum.reduceat(both.view(np.uint64), first)
            b = n // rows
            out[:, b] = (out[:, b] * np.uint64(0x100000001B3)) ^ mix((best & np.uint64(2**32 - 1)) + np.uint64((b + 1) << 32))
        out = mix(out)
    return out


def flat_hashes(h: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (records x bands) of samples in which all shingles of a record weigh the same."""
    has = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[has]
    seed = (mix(h + np.uint64(2)) >> np.uint64(32)).astype(np.uint32)
    drawn, out = np.empty_like(seed), np.zeros((len(has), bands), np.uint64)
    mul, add = _draws(bands * rows, 13)
    with np.errstate(over="ignore"):
        for n in range(bands * rows):
            np.multiply(seed, mul[n], out=drawn)
            np.add(drawn, add[n], out=drawn)
            best = np.minimum.reduceat(drawn, starts).astype(np.uint64)
            b = n // rows
            # numbered apart from the weighted bands
            out[:, b] = (out[:, b] * np.uint64(0x100000001B3)) ^ mix(best + np.uint64((2**20 + b) << 32))
        out = mix(out)
    return out


def _bands(n: int, levels, bits: int, bands: int, rows: int, flat_bands: int, flat_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = sampling_table(), set()
        level = np.frombuffer(levels.value, np.uint8)
        for b in _slices(batches):
            flat, sizes = word_hashes(joined_text(b.columns[1:]))
            keys = _keys(flat, sizes)[0]
            # copies of a record that this task has sent already add nothing
            fresh = np.zeros(b.num_rows, bool)
            for k in np.flatnonzero(sizes >= n).tolist():
                if (x := int(keys[k])) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(x)
                    fresh[k] = True
            if not fresh.any():
                continue
            flat, sizes, keys = flat[np.repeat(fresh, sizes)], sizes[fresh], keys[fresh]
            h, counts = run_hashes(flat, sizes, n)
            h = _sorted_elements(h, counts)[0] & _HASH
            hs = band_hashes(h, counts, level, table, bits, bands, rows)
            low = np.add.reduceat(level[(h >> np.uint64(40 - bits)).astype(np.int64)] == 0, np.cumsum(counts) - counts, dtype=np.int64) > LOW_SHARE * counts
            out, owner = [hs.ravel()], [np.repeat(keys, hs.shape[1])]
            if low.any():
                hs = flat_hashes(h[np.repeat(low, counts)], counts[low], flat_bands, flat_rows)
                out.append(hs.ravel())
                owner.append(np.repeat(keys[low], hs.shape[1]))
            # 48 bits keep rows small; bands that share a hash by chance only add candidates
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(out) >> np.uint64(16)).view(np.int64)), pa.array(np.concatenate(owner))], names=["band", "key"])

    return run


def _pair_runs(block: int):
    """Pairs of different keys within runs of one band hash, from rows sorted by band.

    A run over ``block`` keys leaves as it comes, with the number of its block beside each key.
    """
    names = ["kind", "a", "b", "at"]

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        zero = np.zeros(len(a), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(zero), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(zero)], names=names)

    def blocks(band: int, keys: np.ndarray, sent: int) -> pa.RecordBatch:
        at = (sent + np.arange(len(keys))) // block
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), pa.array(np.full(len(keys), band)), pa.array(keys), pa.array(at.astype(np.int32))], names=names)

    def flush(band: int, keys: np.ndarray, sent: int) -> Iterator[pa.RecordBatch]:
        if sent or len(keys) > block:
            yield blocks(band, keys, sent)
            return
        i, j = np.triu_indices(len(keys), 1)
        if len(i):
            yield pairs(keys[i], keys[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, held, sent = None, [], 0
        for b in batches:
            bands, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(bands[1:] != bands[:-1]) + 1, [len(bands)]))
            sizes = np.diff(edges)
            # runs of two, the usual case, all at once; the first and last may go on in other batches
            two = np.flatnonzero(sizes[1:-1] == 2) + 1 if len(sizes) > 2 else np.empty(0, np.int64)
            a, c = keys[edges[two]], keys[edges[two] + 1]
            keep = a != c
            if keep.any():
                yield pairs(a[keep], c[keep])
            for k in sorted({0, len(sizes) - 1} | set(np.flatnonzero(sizes > 2).tolist())):
                run_keys = keys[edges[k] : edges[k + 1]]
                if bands[edges[k]] != band:
                    if held:
                        yield from flush(band, np.unique(np.concatenate(held)), sent)
                    band, held, sent = bands[edges[k]], [], 0
                held.append(run_keys)
                if sum(map(len, held)) > block and (sent or len(np.unique(np.concatenate(held))) > block):
                    rest = np.unique(np.concatenate(held))
                    yield blocks(band, rest, sent)
                    sent, held = sent + len(rest), []
        if held:
            yield from flush(band, np.unique(np.concatenate(held)), sent)

    return run


def _verify(n: int, parts: int, levels, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, weight = np.frombuffer(levels.value, np.uint8), level_weights()
        for b in _slices(batches):
            sides = [_sorted_elements(*run_hashes(*word_hashes(joined_text(b.columns[low : low + parts])), n)) for low in (2, 2 + parts)]
            elements, sets = zip(*sides)
            measures = []
            for kinds, weighted in ((sets, False), (elements, True)):
                sums = []
                for k in (*kinds, np.intersect1d(*kinds, assume_unique=True)):
                    pair = (k >> np.uint64(40)).astype(np.int64)
                    w = weight[level[((k & _HASH) >> np.uint64(40 - bits)).astype(np.int64)]] if weighted else None
                    sums.append(np.bincount(pair, w, b.num_rows))
                measures.append(sums[2] / np.maximum(sums[0] + sums[1] - sums[2], 1e-12))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, measures)], names=["rep_a", "rep_b", "jaccard", "weighted_jaccard"])

    return run


def _looks_alike(least: float) -> Column:
    """Whether two signatures (columns a0.., b0..) may be those of elements sharing ``least`` of their union."""
    ones = 0x1111111111111111
    fold = lambda x: f"(({x}) | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & {ones}L"
    used = " + ".join(f"bit_count({fold(f'(a{j} | b{j})')})" for j in range(_WORDS))
    apart = " + ".join(f"bit_count({fold(f'(a{j} ^ b{j})')})" for j in range(_WORDS))
    p = least + (1 - least) / 15
    return F.expr(f"({used}) - ({apart}) >= {p} * ({used}) - {SIGMAS} * sqrt({p * (1 - p)} * ({used}))")


def near_duplicates(df: DataFrame, id_col: str, text_cols: tuple[str, ...], shingle: int = 5, threshold: float = 0.8, measure: str = "weighted_jaccard", bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS, block: int = BLOCK, flat_bands: int = FLAT_BANDS, flat_rows: int = FLAT_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)`` of near-duplicate records.

    ``pairs`` has ``(rep_a, rep_b, jaccard, weighted_jaccard)``, rep_a < rep_b: representatives of
    different texts whose ``measure`` is at least ``threshold``. ``members`` has ``(rep, id)``: every
    record with at least one shingle under the smallest id of its exact copies, itself included.
    """
    spark, step = df.sparkSession, 2**bits // SLICES
    src = df.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"t{k}") for k, c in enumerate(text_cols)))
    id_type = src.schema["id"].dataType.simpleString()
    sign = [f"s{j}" for j in range(_WORDS)]
    counted = write_cut(src.mapInArrow(_count(shingle, bits, step, measure == "jaccard"), f"id {id_type}, key bigint, key2 bigint, {', '.join(f'{c} bigint' for c in sign)}, slice int, counts binary"))
    records = counted.where("slice is null")
    keyed = records.where("key is not null").select("id", "key", "key2", *sign)
    levels = spark.sparkContext.broadcast(sketch_levels(counted, records.count(), bits, step).tobytes())

    banded = src.mapInArrow(_bands(shingle, levels, bits, bands, rows, flat_bands, flat_rows), "band bigint, key bigint")
    runs = write_cut(banded.repartition("band").sortWithinPartitions("band").mapInArrow(_pair_runs(block), "kind int, a bigint, b bigint, at int"))
    plain = runs.where("kind = 0").select("a", "b")
    # runs over a block: (band, block) x (band, block), each pair of blocks a task's own small join
    over = runs.where("kind = 1").select(F.col("a").alias("band"), F.col("b").alias("key"), "at")
    most = over.groupBy("band").agg(F.max("at").alias("most"))
    left = over.join(most, "band").select("band", "key", "at", F.explode(F.sequence("at", "most")).alias("to"))
    right = over.select("band", F.col("key").alias("key2"), F.col("at").alias("to"), F.explode(F.sequence(F.lit(0), "at")).alias("at"))
    # within a block each pair is met twice, across blocks once
    hot = left.join(right, ["band", "at", "to"]).where("key < key2 or (at < to and key > key2)").select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b"))
    candidates = plain.unionByName(hot).distinct()

    # keys to representatives; two texts under one 64-bit key, should that ever be, both go on
    reps = keyed.groupBy("key", "key2").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in sign))
    members = keyed.select("id", "key", "key2").join(reps.select("key", "key2", "rep"), ["key", "key2"]).select("rep", "id")
    sides = [reps.select(F.col("key").alias(x), F.col("rep").alias(f"r{x}"), *(F.col(c).alias(f"{x}{j}") for j, c in enumerate(sign))) for x in "ab"]
    # by plain sets a pair must share the threshold; by weights it may share less, if what it shares weighs most
    least = threshold if measure == "jaccard" else threshold / (threshold + (1 - threshold) / LEAST)
    alike = candidates.join(sides[0], "a").join(sides[1], "b").where(_looks_alike(least))
    pairs = write_cut(alike.select(F.least("ra", "rb").alias("rep_a"), F.greatest("ra", "rb").alias("rep_b")))
    wanted = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
    texts = src.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    cols = [f"t{k}" for k in range(len(text_cols))]
    side_a = texts.select(F.col("id").alias("rep_a"), *(F.col(c).alias(f"a_{c}") for c in cols))
    side_b = texts.select(F.col("id").alias("rep_b"), *(F.col(c).alias(f"b_{c}") for c in cols))
    both = pairs.join(side_a, "rep_a").join(side_b, "rep_b").select("rep_a", "rep_b", *(f"a_{c}" for c in cols), *(f"b_{c}" for c in cols))
    rated = both.mapInArrow(_verify(shingle, len(cols), levels, bits), f"rep_a {id_type}, rep_b {id_type}, jaccard double, weighted_jaccard double")
    return rated.where(F.col(measure) >= threshold), members


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b, of all records: pairs of representatives and exact copies, expanded."""
    many = members.where("rep <> id")
    a = members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    b = members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    apart = pairs.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select("x", "y")
    own = many.select("rep", F.col("id").alias("y")).join(members.select("rep", F.col("id").alias("x")), "rep").where("x < y").select("x", "y")
    return apart.unionByName(own).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
