"""Problem 7: the corpus as token ids of a public byte-level BPE vocabulary.

Every distinct word is encoded once for the whole corpus:

1. *Cut.* Each Arrow batch of texts is cut into pre-tokens; the batch keeps, for each document, the
   positions as local numbers into the batch's own list of distinct pre-tokens. This is the explode
   by (word, position) with repeats inside a batch already combined, so a word such as `` the``
   gives one row a batch, not one an occurrence.
2. *Distinct words.* The (batch, number, word) rows are counted by word in one shuffle with
   map-side combination, and each distinct word is encoded once.
3. *Join back* by word, hot words (found exactly by their counts, so few) by a broadcast; gather each batch's
   ids by number, and reassemble every document by position.

Null and empty texts have an empty list of ids; a blank text has the ids of its blanks. Strings that
look like special tokens are ordinary text. Extra columns, whatever their names, are left out. Rows
repeated under one id give one result row each.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataclaim.session import broadcast_checked, write_cut

#: The published cutting pattern of the 50k byte-level vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of text that one batch of documents holds at most, unless a single text has more.
BATCH_CHARS = 1_000_000
#: A word is hot with more than a ``HOT_SHARE``-th of all (batch, word) rows.
HOT_SHARE = 1_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_ENCODERS: dict[str, object] = {}


def word_encoder(path: str):
    """An encoder of single pre-tokens: the merge table without any further cutting."""
    if path not in _ENCODERS:
        import tiktoken

        _ENCODERS[path] = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})
    return _ENCODERS[path]


def _cut_batches(id_type: pa.DataType, batch_chars: int):
    cut_re = regex.compile(PATTERN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), itertools.count()
        ids: list = []
        places: list[np.ndarray] = []
        known: dict[str, int] = {}
        chars = 0

        def flush() -> pa.RecordBatch:
            sizes = np.cumsum([0, *(len(p) for p in places)]).astype(np.int32)
            inner = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(places)))
            docs = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.StructArray.from_arrays([pa.array(ids, id_type), inner], ["id", "places"]))
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{next(number)}"]), docs, pa.array([list(known)], pa.list_(pa.string()))], names=["batch", "docs", "words"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                text = t.as_py()
                found = cut_re.findall(text) if text else []
                ids.append(i.as_py())
                places.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found)))
                chars += len(text or "")
                if chars >= batch_chars or len(ids) >= 5_000:
                    yield flush()
                    ids, places, known, chars = [], [], {}, 0
        if ids:
            yield flush()

    return run


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(path)
        for b in batches:
            ws = b.column(0)
            out = [enc.encode_ordinary(w) for w in ws.to_pylist()]
            yield pa.RecordBatch.from_arrays([ws.cast(pa.string()), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["word", "n", "word_ids"])

    return run


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY, batch_chars: int = BATCH_CHARS, hot_share: int = HOT_SHARE) -> DataFrame:
    """``(id_col, ids ARRAY<INT>)`` of every row of ``df``; see the module's text."""
    id_type = df.schema[id_col].dataType.simpleString()
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    batches = write_cut(src.mapInArrow(_cut_batches(arrow_id, batch_chars), f"batch string, docs array<struct<id:{id_type},places:array<int>>>, words array<string>"))
    words = batches.select("batch", F.posexplode("words").alias("number", "word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    encoded = write_cut(counted.mapInArrow(_encode_words(vocabulary), "word string, n bigint, word_ids array<int>"))
    # exact counts of rows: at most hot_share words can have over a hot_share-th of them
    bound = (encoded.agg(F.sum("n")).first()[0] or 0) / hot_share
    hot, _ = broadcast_checked(encoded.where(F.col("n") > bound).select("word", "word_ids"))
    cold = encoded.where(F.col("n") <= bound).select("word", "word_ids")
    met = words.join(hot, "word", "left")
    columns = ("batch", "number", "word_ids")
    lists = (
        met.where("word_ids is not null").select(*columns)
        .unionByName(met.where("word_ids is null").select("batch", "number", "word").join(cold, "word").select(*columns))
        .groupBy("batch")
        .agg(F.array_sort(F.collect_list(F.struct("number", "word_ids"))).alias("x"))
        .select("batch", F.col("x.word_ids").alias("table"))
    )
    # one row a batch on both sides, so a batch's table is not copied to its documents
    gathered = F.transform("docs", lambda d: F.struct(d["id"].alias("id"), F.flatten(F.transform(d["places"], lambda p: F.get(F.col("table"), p))).alias("ids")))
    docs = batches.select("batch", "docs").join(lists, "batch", "left").select(F.explode(gathered).alias("d"))
    return docs.select(F.col("d.id").alias(id_col), F.coalesce("d.ids", F.array().cast("array<int>")).alias("ids"))


def decode_corpus(df: DataFrame, id_col: str, ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id_col, text)`` from token ids, by a join with the token-byte table where the ids are.

    The table has one row a vocabulary entry (a size that doesn't grow with the data), so every task reads
    it, takes the bytes of a batch's ids from it in their order, and joins them by row; nothing is shuffled.
    An empty or null list gives an empty text, bytes that are no UTF-8 the replacement character. An id
    beyond the vocabulary is an error.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(vocabulary)
        table = pa.array(sorted(ranks, key=ranks.__getitem__), pa.binary())
        for b in batches:
            for low in range(0, b.num_rows, 1000):
                part = b.slice(low, 1000)
                lists = part.column(1)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                spelt = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), table.take(lists.flatten()))
                texts = [x.as_py().decode("utf-8", "replace") for x in pc.binary_join(spelt, b"")]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
