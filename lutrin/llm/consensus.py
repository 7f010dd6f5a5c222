"""One ranking from several scores on unlike scales (problem 2).

Scores are replaced by their ranks inside a query, which no range, outlier or unit can distort. The
correlation matrix of the rank-transformed scores is one distributed aggregation over all rows; its
first principal component weighs the scores, turned so that it follows the declared directions.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lutrin.plans.scale import HOT_ROWS, hot_keys, rank_in_key

logger = logging.getLogger(__name__)
SCORES = {"faiss_score": 1, "bm25_score": 1, "score": 1}


def rank_scores(hits: DataFrame, scores: dict[str, int], query: str = "query_id", item: str = "chunk_ord", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per (query, item), as `_ranked` says."""
    return _ranked(hits, scores, query, item, hot_rows)[0]


def _ranked(hits: DataFrame, scores: dict[str, int], query: str, item: str, hot_rows: int) -> tuple[DataFrame, dict]:
    """One row per (query, item) with each score, its `<score>_rank` (1 is best) and `<score>_unit` in 0..1.

    Repeated rows of an item fold to one with its best value. Ties share the mean unit; a null score (and
    NaN, which is treated as null) has null rank and unit 0; a query of one item has unit 0.5. Rows
    with null query or item are dropped, other columns are not carried.
    """
    value = lambda s: F.when(~F.isnan(s), F.col(s) * F.lit(scores[s]))
    narrow = hits.where(F.col(query).isNotNull() & F.col(item).isNotNull()).select(query, item, *[value(s).alias(s) for s in scores])
    hot = hot_keys(narrow, query, hot_rows)
    if not hot:
        # One exchange: rows of a query together serve the fold by (query, item) and every window.
        narrow = narrow.repartition(F.col(query))
    rows = narrow.groupBy(query, item).agg(*[F.max(s).alias(s) for s in scores])
    for s in scores:
        rows = rank_in_key(rows, query, s, f"{s}_rank", "__ties", hot)
        if hot:
            sizes = rows.groupBy(query).agg(F.count(s).alias("__n"))
            rows = rows.join(sizes, query)
        else:
            rows = rows.withColumn("__n", F.count(s).over(W.partitionBy(query)))
        mean_rank = F.col(f"{s}_rank") + (F.col("__ties") - 1) / 2
        unit = F.when(F.col("__n") > 1, 1 - (mean_rank - 1) / (F.col("__n") - 1)).otherwise(F.lit(0.5))
        rows = rows.withColumn(f"{s}_unit", F.when(F.col(s).isNull(), F.lit(0.0)).otherwise(unit)).drop("__ties", "__n")
    return rows, hot


def loadings(ranked: DataFrame, scores: dict[str, int]) -> list[float]:
    """First principal component of the units' correlation matrix: one row of sums reaches the driver.

    A component has no sign of its own: the whole vector is turned so that its loadings add up to a positive
    number, as every score was flipped to its declared direction before ranking. A single loading that stays
    negative says that its score runs against the others; it is kept and logged, for without it this would
    be no principal component. A matrix without variance gives equal loadings.
    """
    u = [F.col(f"{s}_unit") for s in scores]
    sums = [F.count(F.lit(1))] + [F.sum(a) for a in u] + [F.sum(a * b) for a in u for b in u]
    n, *rest = ranked.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()
    k = len(u)
    if not n:
        return [k**-0.5] * k
    mean, cross = np.array(rest[:k]) / n, np.array(rest[k:]).reshape(k, k) / n
    cov = cross - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    if not (sd > 1e-12).any():
        return [k**-0.5] * k
    scale = np.where(sd > 1e-12, sd, 1)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    first = vectors[:, int(np.argmax(values))]
    # Opposite loadings may cancel out: then the largest one, the first of equals, points the way.
    turn = first.sum() if abs(first.sum()) > 1e-9 else first[int(np.argmax(np.round(np.abs(first), 9)))]
    out = [round(float(x), 9) for x in (first if turn >= 0 else -first)]
    for name, x in zip(scores, out):
        if x < -1e-9:
            logger.warning("score %s runs against the component of the others (loading %s)", name, x)
    return out


def fuse(hits: DataFrame, scores: dict[str, int] = SCORES, query: str = "query_id", item: str = "chunk_ord", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of rank_scores with `projection` on the first component: the fused score."""
    return _fused(hits, scores, query, item, hot_rows)[0]


def _fused(hits: DataFrame, scores: dict[str, int], query: str, item: str, hot_rows: int) -> tuple[DataFrame, list[float], dict]:
    ranked, hot = _ranked(hits, scores, query, item, hot_rows)
    weights = loadings(ranked, scores)
    total = sum((F.lit(w) * F.col(f"{s}_unit") for w, s in zip(weights, scores)), F.lit(0.0))
    return ranked.withColumn("projection", F.round(total, 9)), weights, hot


def leaders(hits: DataFrame, scores: dict[str, int] = SCORES, depth: int = 3, query: str = "query_id", item: str = "chunk_ord", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of `fuse` for items that are among the best `depth` of their query on every score.

    They are taken from the fused ranking: no item can lead on every score whose projection is below the
    one of an item that is last of the best `depth` everywhere (for a negative loading: best). The ranks of
    what is left are then checked.
    """
    fused, weights, hot = _fused(hits, scores, query, item, hot_rows)
    bounds = [(F.min if w >= 0 else F.max)(F.when(F.col(f"{s}_rank") <= depth, F.col(f"{s}_unit"))) for w, s in zip(weights, scores)]
    if hot:
        least = fused.groupBy(query).agg(*[b.alias(f"__b{i}") for i, b in enumerate(bounds)])
        fused = fused.join(least, query)
    else:
        fused = fused.select("*", *[b.over(W.partitionBy(query)).alias(f"__b{i}") for i, b in enumerate(bounds)])
    floor = sum((F.lit(w) * F.col(f"__b{i}") for i, w in enumerate(weights)), F.lit(0.0))
    near = fused.where(F.col("projection") >= floor - 1e-8).drop(*[f"__b{i}" for i in range(len(weights))])
    for s in scores:
        near = near.where(F.col(f"{s}_rank") <= depth)
    return near


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that lead their query on all scores at once, taken from the fused ranking."""
    return leaders(spark.read.parquet(f"{sf}/hits.parquet")).select("query_id", "chunk_ord")


def p2_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk of every query with its place in the fused ranking (ties by chunk_ord)."""
    fused = fuse(spark.read.parquet(f"{sf}/hits.parquet"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("projection").desc(), "chunk_ord"))
    return fused.select("query_id", "chunk_ord", "projection", place.alias("place"))


QUERIES = {"p2_found": p2_found, "p2_ranking": p2_ranking}
ORACLE = {
    "p2_found": """
WITH one AS (SELECT query_id, chunk_ord, max(faiss_score) f, max(bm25_score) b, max(score) s FROM hits
             WHERE query_id IS NOT NULL AND chunk_ord IS NOT NULL GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY f DESC NULLS LAST) rf,
             rank() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST) rb,
             rank() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST) rs FROM one)
SELECT query_id, chunk_ord FROM r
WHERE f IS NOT NULL AND b IS NOT NULL AND s IS NOT NULL AND rf <= 3 AND rb <= 3 AND rs <= 3""",
    # The component by power iteration on the SQL's own correlations.
    "p2_ranking": """
WITH RECURSIVE one AS (SELECT query_id, chunk_ord, max(faiss_score) f, max(bm25_score) b, max(score) s FROM hits
             WHERE query_id IS NOT NULL AND chunk_ord IS NOT NULL GROUP BY ALL),
long AS (UNPIVOT one ON f, b, s INTO NAME k VALUE v),
r AS (SELECT query_id, chunk_ord, k, rank() OVER (PARTITION BY query_id, k ORDER BY v DESC) + (count(*) OVER (PARTITION BY query_id, k, v) - 1) / 2 AS m, count(*) OVER (PARTITION BY query_id, k) AS n FROM long),
u AS (SELECT query_id, chunk_ord, k, CASE WHEN n > 1 THEN 1 - (m - 1) / (n - 1) ELSE 0.5 END AS u FROM r),
x AS (SELECT one.query_id, one.chunk_ord, coalesce(max(u) FILTER (k = 'f'), 0.0) f, coalesce(max(u) FILTER (k = 'b'), 0.0) b, coalesce(max(u) FILTER (k = 's'), 0.0) s
  FROM one LEFT JOIN u USING (query_id, chunk_ord) GROUP BY ALL),
c AS (SELECT corr(f, b) fb, corr(f, s) fs, corr(b, s) bs FROM x),
it AS (SELECT 0 AS i, 0.5::DOUBLE AS wf, 0.6::DOUBLE AS wb, 0.7::DOUBLE AS ws
  UNION ALL SELECT i + 1, yf / len, yb / len, ys / len FROM (SELECT *, sqrt(yf * yf + yb * yb + ys * ys) AS len FROM
    (SELECT i, wf + fb * wb + fs * ws AS yf, fb * wf + wb + bs * ws AS yb, fs * wf + bs * wb + ws AS ys FROM it, c WHERE i < 400))),
w AS (SELECT round(wf * sign(wf + wb + ws), 9) wf, round(wb * sign(wf + wb + ws), 9) wb, round(ws * sign(wf + wb + ws), 9) ws FROM it WHERE i = 400),
p AS (SELECT query_id, chunk_ord, round(wf * f + wb * b + ws * s, 9) AS projection FROM x, w)
SELECT query_id, chunk_ord, projection, row_number() OVER (PARTITION BY query_id ORDER BY projection DESC, chunk_ord)::INT AS place FROM p""",
}
