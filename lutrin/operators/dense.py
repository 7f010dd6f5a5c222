"""Exact dense search: inner products of a stated query set with all vectors, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes of query vectors that one pass over the corpus carries to every worker; more take more passes.
QUERY_BYTES = 64 << 20
#: Products (chunks x queries) that a worker holds at once.
CELLS = 4_000_000


def normalized(v: Column) -> Column:
    """Vector of length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have `dim` values, their matrix), from the flat values of a list column."""
    lengths = np.diff(column.offsets.to_numpy())
    good = lengths == dim
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return good, (flat if good.all() else flat[np.repeat(good, lengths)]).reshape(-1, dim).astype(np.float64)


def top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_ord, dense_score, dense_rank): the k largest inner products of each query.

    vectors (chunk_ord, embedding) are multiplied batch by batch with the query vectors (query_id, embedding);
    each batch only passes on its own k best, so the shuffle holds k rows per query and batch instead of
    all products. Query vectors reach the driver and the workers in blocks of a bounded number of bytes.
    Equal scores are ordered by chunk_ord. Null vectors, and vectors of another length than the query, are
    in no result.
    """
    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, chunk_ord long, dense_score double"
    asked = queries.where("embedding IS NOT NULL AND query_id IS NOT NULL").select("query_id", "embedding")
    corpus = vectors.where("embedding IS NOT NULL").select(F.col("chunk_ord").cast("long").alias("chunk_ord"), "embedding")

    def block(ids: pa.Array, matrix: np.ndarray) -> DataFrame:
        dim = matrix.shape[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                good, rows = _matrix(whole.column(1), dim)
                of = whole.column(0).to_numpy()[good]
                step = max(1, CELLS // len(ids))
                for at in range(0, len(of), step):
                    s, ords = np.round(rows[at : at + step] @ matrix, 9), of[at : at + step]
                    best = np.lexsort((np.broadcast_to(ords[:, None], s.shape), -s), axis=0)[:k]
                    who = np.repeat(np.arange(len(ids)), len(best))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), pa.array(ords[best].T.ravel()), pa.array(np.take_along_axis(s, best, 0).T.ravel())], ["query_id", "chunk_ord", "dense_score"])

        return corpus.mapInArrow(run, schema)

    parts = []
    for dim, n in sorted((r[0], r[1]) for r in asked.groupBy(F.size("embedding")).count().collect()):  # a row a vector length
        mine, passes = asked.where(F.size("embedding") == dim), -(-n * dim * 8 // QUERY_BYTES)
        for i in range(max(passes, 1) if dim else 0):
            part = mine.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) if passes > 1 else mine
            got = part.toArrow().combine_chunks()
            if got.num_rows:
                parts.append(block(got.column(0).combine_chunks(), np.ascontiguousarray(_matrix(got.column(1).combine_chunks(), dim)[1].T)))
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema + ", dense_rank int")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("dense_score").desc(), "chunk_ord"))
    return reduce(DataFrame.unionByName, parts).withColumn("dense_rank", rank).where(F.col("dense_rank") <= k)
