"""Rank fusion of the dense and the lexical leg, and of two searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def reciprocal(dense: DataFrame, lexical: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, chunk_ord, rrf, dense_rank, bm25_rank, dense_score, bm25_score): sums of 1 / (k + rank).

    A full outer join expressed as one union and one aggregation. Ranks begin at 1.
    """
    nothing = lambda t: F.lit(None).cast(t)
    a = dense.select("query_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), "dense_rank", nothing("int").alias("bm25_rank"), "dense_score", nothing("double").alias("bm25_score"))
    b = lexical.select("query_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), nothing("int").alias("dense_rank"), "bm25_rank", nothing("double").alias("dense_score"), "bm25_score")
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = a.unionByName(b).groupBy("query_id", "chunk_ord").agg(*[F.max(c).alias(c) for c in ("dense_rank", "bm25_rank", "dense_score", "bm25_score")])
    return both.withColumn("rrf", part("dense_rank") + part("bm25_rank"))


def best(fused: DataFrame, score: str, k: int, ties: tuple[str, ...] = ("dense_rank", "bm25_rank")) -> DataFrame:
    """fused with `rank`, the best k of each query; ties by the given ranks (missing last), then chunk_ord."""
    order = [F.round(score, 12).desc(), *[F.col(t).asc_nulls_last() for t in ties], F.col("chunk_ord")]
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def weighted(first: DataFrame, second: DataFrame, alpha: float) -> DataFrame:
    """(query_id, chunk_ord, combined): alpha of the first search's rrf and 1 - alpha of the second's."""
    a = first.select("query_id", "chunk_ord", (F.lit(alpha) * F.col("rrf")).alias("p"))
    b = second.select("query_id", "chunk_ord", (F.lit(1 - alpha) * F.col("rrf")).alias("p"))
    return a.unionByName(b).groupBy("query_id", "chunk_ord").agg(F.sum("p").alias("combined"))


#: Queries whose lists a worker fuses at once.
FUSED_AT_ONCE = 2000


def runs(lists: DataFrame, weights: dict[str, float | None], top_k: int, k: int = 60) -> DataFrame:
    """(run, query_id, carried, rank, chunk_ord, shown): the best top_k of each query in several runs at once.

    lists (query_id, carried, first, second, dense): the chunks that the two texts of a query and its vector find,
    best first; a query with one text has no second. A run with no weight fuses the first text and the vector, as
    `reciprocal` and `best` do; else both texts' sums are weighted, as by `weighted`. shown: the score to three digits.
    """

    def fuse(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        each = []
        for name in ("first", "second", "dense"):
            column = b.column(name)
            times = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            each.append((np.repeat(np.arange(len(b)), times), column.flatten().to_numpy(), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1))
        known, code = np.unique(np.concatenate([ords for _, ords, _ in each]), return_inverse=True)
        keys, at = np.unique(np.concatenate([row for row, _, _ in each]) * len(known) + code, return_inverse=True)
        if not len(keys):
            return
        row, ords, ranks, done = keys // len(known), known[keys % len(known)], np.full((3, len(keys)), np.inf), 0
        for i, (_, mine, rank) in enumerate(each):
            ranks[i, at[done : done + len(mine)]] = rank
            done += len(mine)
        text, other, vector = ranks
        alone = b.column("second").is_null().to_numpy(zero_copy_only=False)[row]
        part = 1.0 / (k + ranks)
        one, two = part[2] + part[0], part[2] + part[1]
        for name, weight in weights.items():
            plain = alone if weight is not None else np.ones(len(keys), bool)
            score = one if weight is None else np.where(alone, one, weight * one + (1 - weight) * two)
            order = np.lexsort((ords, np.where(plain, text, 0), np.where(plain, vector, 0), -np.round(score, 12), row))
            order = order[np.isfinite(np.minimum(text, vector))[order]] if weight is None else order
            starts = np.searchsorted(row[order], np.arange(len(b)))
            rank = np.arange(len(order)) - starts[row[order]] + 1
            order, rank = order[rank <= top_k], rank[rank <= top_k]
            of = pa.array(row[order])
            shown = pa.array([f"{x:.3f}" for x in score[order].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(order), pa.string()), b.column("query_id").take(of), b.column("carried").take(of), pa.array(rank, pa.int32()), pa.array(ords[order], pa.int64()), shown], ["run", "query_id", "carried", "rank", "chunk_ord", "shown"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), FUSED_AT_ONCE):
                yield from fuse(whole.slice(at, FUSED_AT_ONCE))

    kinds = {c: lists.schema[c].dataType.simpleString() for c in ("query_id", "carried")}
    return lists.mapInArrow(run, f"run string, query_id {kinds['query_id']}, carried {kinds['carried']}, rank int, chunk_ord long, shown string")
