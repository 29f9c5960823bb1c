"""Retrieval: vector search in blocks, keyword ranking, reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are broadcast at a time; more are worked off in further blocks.
QUERY_BLOCK = 2_048


def vector_topk(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id: str, query_vec: str, k: int = 10, least: float | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, id, score, rank)``: the k rows of largest dot product for each query.

    Queries go to the executors in blocks of a fixed size; every partition of the corpus multiplies
    its batches with the block and keeps k candidates a query, so what is shuffled is bounded by
    queries x partitions x k. Ties go to the smaller id. Null vectors match nothing. ``least`` keeps
    scores over a threshold only; with ``k=None`` all of those.
    """
    spark = corpus.sparkSession
    src = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null")
    qs = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).cast("array<double>").alias("v")).where("v is not null")
    blocks = max(1, -(-qs.count() // block))
    parts = []
    for n in range(blocks):
        rows = qs.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), np.array([r.v for r in rows])))
        parts.append(src.mapInArrow(_scores(shared, k, least), "query_id long, id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    out = found.withColumn("rank", rank)
    return out if k is None else out.where(F.col("rank") <= k)


def _scores(shared, k: int | None, least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(0).to_numpy()
            vecs = np.array(b.column(1).to_pylist())
            s = matrix @ vecs.T
            if k is not None and s.shape[1] > k:
                # all that tie with the k-th stay, so ties are settled by id over all partitions
                edge = np.partition(s, -k, axis=1)[:, -k][:, None]
                keep = s >= edge - 1e-9
            else:
                keep = np.ones_like(s, bool)
            if least is not None:
                keep &= s >= least
            q, c = np.nonzero(keep)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[c]), pa.array(s[q, c])], names=["query_id", "id", "score"])

    return run
