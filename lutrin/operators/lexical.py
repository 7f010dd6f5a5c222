"""BM25: index tables and scores of many queries at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lutrin.functions.text import term_counts, word_pattern
from lutrin.plans.scale import written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries carried by one pass over the index: with their terms they go to every worker. More take more passes.
QUERY_BLOCK = 4096
#: Scores (chunks x queries) that a worker holds at once.
CELLS = 2_000_000


@dataclass(frozen=True)
class LexicalIndex:
    """docs (chunk_ord, dl, terms, tfs), terms (term, df, idf), stats (n, avgdl): tables."""

    docs: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(term, chunk_ord, tf)."""
        each = F.explode(F.arrays_zip("terms", "tfs")).alias("t")
        return self.docs.select("chunk_ord", each).select(F.col("t.terms").alias("term"), "chunk_ord", F.col("t.tfs").alias("tf"))

    @property
    def lengths(self) -> DataFrame:
        return self.docs.select("chunk_ord", "dl")


def _counted(rows: DataFrame) -> DataFrame:
    """(chunk_ord, dl, terms, tfs): the words of each content, counted inside its row."""
    find = word_pattern().findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [Counter(find(t.lower())) if t else Counter() for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, bags)]).astype(np.int32)
            terms = pa.ListArray.from_arrays(ends, pa.array([w for c in bags for w in c], pa.string()))
            tfs = pa.ListArray.from_arrays(ends, pa.array([n for c in bags for n in c.values()], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sum(c.values()) for c in bags], pa.int64()), terms, tfs], ["chunk_ord", "dl", "terms", "tfs"])

    return rows.mapInArrow(run, "chunk_ord long, dl long, terms array<string>, tfs array<int>")


def index(chunks: DataFrame) -> LexicalIndex:
    """Index of chunks (chunk_ord, content); null contents are empty texts.

    Terms are counted inside each row, so only (term, count) pairs are shuffled, pre-aggregated. The idf of
    a term in more than half of the chunks, which would be negative, is a quarter of the mean idf.
    """
    # The counted rows are read several times by every search: one pass over the texts writes them.
    docs = written(_counted(chunks.select(F.col("chunk_ord").cast("long").alias("chunk_ord"), "content")), "docs")
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.crossJoin(F.broadcast(stats)).withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))  # stats: one row
    raw = written(raw.select("term", "df", "raw"), "idf")
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return LexicalIndex(docs, raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf")), stats)  # mean: one row


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a repeated word counts repeatedly."""
    return queries.select("query_id", F.explode(term_counts(F.coalesce("text", F.lit("")))).alias("t")).select("query_id", "t.term", F.col("t.tf").alias("qtf"))


def _blocks(ix: LexicalIndex, queries: DataFrame) -> Iterator[tuple[list, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, terms, and of each term its queries' numbers and weights, by offsets): at most QUERY_BLOCK
    queries of the stated set at a time reach the driver."""
    known = queries.select("query_id", "text").where("query_id IS NOT NULL")
    n = -(-known.count() // QUERY_BLOCK)
    for i in range(n):
        part = known.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) if n > 1 else known
        ids = sorted(r[0] for r in part.select("query_id").distinct().collect())
        at = {q: j for j, q in enumerate(ids)}
        rows = query_terms(part).join(ix.terms, "term").select("term", "query_id", (F.col("qtf") * F.col("idf")).alias("w")).orderBy("term", "query_id").collect()
        terms = sorted({r["term"] for r in rows})
        number = {t: j for j, t in enumerate(terms)}
        which = np.array([number[r["term"]] for r in rows], np.int64)
        offsets = np.searchsorted(which, np.arange(len(terms) + 1))
        yield ids, pa.array(terms, pa.string()), offsets, np.array([at[r["query_id"]] for r in rows], np.int64), np.array([r["w"] for r in rows], np.float64)


def _scored(ix: LexicalIndex, queries: DataFrame, k: int | None, docs: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_ord, bm25_score) of one pass over the counted rows for each block of queries: all chunks
    that share a term with the query, or (k given) the k best of each Arrow batch, chunks without a term too."""
    got = ix.stats.first()
    avgdl = float(got["avgdl"] or 0.0) or 1.0 if got else 1.0
    docs = ix.docs if docs is None else docs
    id_type = queries.schema["query_id"].dataType.simpleString()

    def one(block) -> DataFrame:
        ids, terms, offsets, of_query, weight = block
        names = pa.array(ids)

        def part(ords: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            # Each matched posting meets the queries that ask for its term.
            times = offsets[term + 1] - offsets[term]
            entry = np.repeat(offsets[term] - np.cumsum(times) + times, times) + np.arange(times.sum())
            cell = np.repeat(row, times) * len(ids) + of_query[entry]
            size = len(ords) * len(ids)
            score = np.bincount(cell, np.repeat(value, times) * weight[entry], size).astype(np.float64).reshape(len(ords), len(ids))
            if k is None:
                r, q = np.nonzero(np.bincount(cell, minlength=size).reshape(score.shape))
            else:
                order = np.lexsort((np.broadcast_to(-ords[:, None], score.shape), -np.round(score, 9)), axis=0)[:k]
                r, q = order.T.ravel(), np.repeat(np.arange(len(ids)), len(order))
            return pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(ords[r]), pa.array(score[r, q])], ["query_id", "chunk_ord", "bm25_score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, CELLS // len(ids))
            for whole in batches:
                for at in range(0, len(whole), step):
                    b = whole.slice(at, step)
                    ords, dl = b.column(0).to_numpy(), b.column(1).to_numpy()
                    lengths = np.diff(b.column(2).offsets.to_numpy())
                    term = pc.index_in(b.column(2).flatten(), value_set=terms)
                    hit = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
                    row, tf = np.repeat(np.arange(len(ords)), lengths)[hit], b.column(3).flatten().to_numpy()[hit]
                    value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl))
                    yield part(ords, row, term.take(pa.array(hit)).to_numpy().astype(np.int64), value)

        return docs.select("chunk_ord", "dl", "terms", "tfs").mapInArrow(run, f"query_id {id_type}, chunk_ord long, bm25_score double")

    parts = [one(b) for b in _blocks(ix, queries)]
    return reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], f"query_id {id_type}, chunk_ord long, bm25_score double")


def scores(ix: LexicalIndex, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_ord, bm25_score) of all chunks that share a term with the query."""
    return _scored(ix, queries, None)


def top(ix: LexicalIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_ord, bm25_score, bm25_rank): best k of all chunks, or of the allowed (chunk_ord).

    The words of the queries go to the counted rows, and each batch of them passes on its own k best for
    every query: what is shuffled does not grow with the matches. Chunks without a shared term have score 0
    and rank between positive and negative ones; equal scores are ordered by falling chunk_ord.
    """
    docs = ix.docs if allowed is None else ix.docs.join(allowed.select("chunk_ord"), "chunk_ord", "left_semi")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("bm25_score", 9).desc(), F.col("chunk_ord").desc()))
    return _scored(ix, queries, k, docs).withColumn("bm25_rank", rank).where(F.col("bm25_rank") <= k)
