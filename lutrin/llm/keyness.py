"""How distinctive a term is for a record (problem 3): log-likelihood ratio against the remaining collection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lutrin.plans.scale import written

#: A term is a maximal run of letters; shorter ones carry no subject.
LEAST_LETTERS = 5


def bags(rows: DataFrame, record: str, text: str, least: int = LEAST_LETTERS) -> DataFrame:
    """(record, here, terms, tfs): the terms of each text in lower case with their counts, and their sum."""
    find = regex.compile(r"\p{L}{%d,}" % least).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [Counter(w.lower() for w in find(t)) if t else Counter() for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
            terms = pa.ListArray.from_arrays(ends, pa.array([w for c in counts for w in c], pa.string()))
            tfs = pa.ListArray.from_arrays(ends, pa.array([n for c in counts for n in c.values()], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sum(c.values()) for c in counts], pa.int64()), terms, tfs], ["id", "here", "terms", "tfs"])

    kind = rows.schema[record].dataType.simpleString()
    return rows.select(record, text).mapInArrow(run, f"id {kind}, here long, terms array<string>, tfs array<int>").withColumnRenamed("id", record)


def collection(counted: DataFrame) -> DataFrame:
    """term, df (records that hold it), cf (occurrences): counts over every record, combined before the shuffle."""
    each = counted.select(F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    return each.groupBy(F.col("t.terms").alias("term")).agg(F.count(F.lit(1)).alias("df"), F.sum("t.tfs").alias("cf"))


def _part(k: Column, total: Column, share: Column) -> Column:
    return F.when(k > 0, k * F.ln(k / (total * share))).otherwise(F.lit(0.0))


def keyness(rows: DataFrame, record: str = "chunk_ord", text: str = "content", least_tf: int = 1, df_range: tuple[int, int] | None = None) -> DataFrame:
    """(record, term, tf, df, cf, weight): signed log-likelihood ratio of each term in each record.

    The table is [term here, term elsewhere; other words here, other words elsewhere]; the weight is
    negative where the term is rarer here than elsewhere, so everyday words come out low. least_tf and
    df_range choose which scored rows are returned; counts always cover the whole collection. Null and
    empty texts have no terms; records sharing an id each give their rows; other columns are not carried.
    """
    # Texts are read once: their counted terms are written, and read for the collection and for the records.
    counted = written(bags(rows, record, text), "bags")
    stats = written(collection(counted), "terms")
    n = stats.agg(F.sum("cf")).first()[0] or 0  # one number
    each = counted.select(record, "here", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    terms = each.select(record, "here", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf")).where(F.col("tf") >= least_tf)
    if df_range:
        stats = stats.where(F.col("df").between(*df_range))
    a, b = F.col("tf").cast("double"), (F.col("cf") - F.col("tf")).cast("double")
    mine, rest = F.col("here").cast("double"), F.lit(float(n)) - F.col("here")
    share = F.col("cf") / F.lit(float(max(n, 1)))
    ratio = 2 * (_part(a, mine, share) + _part(b, rest, share) + _part(mine - a, mine, 1 - share) + _part(rest - b, rest, 1 - share))
    over = a * rest >= b * mine
    return terms.join(stats, "term").select(record, "term", "tf", "df", "cf", F.round(F.when(over, ratio).otherwise(-ratio), 6).alias("weight"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that occur at least three times in a chunk and in 2 to 8 chunks at all, of the terms that have a
    likelihood ratio. What a case is is said in counts, so the ratio's size, and its sign, exclude none."""
    scored = keyness(spark.read.parquet(f"{sf}/chunks.parquet"), least_tf=3, df_range=(2, 8))
    return scored.where(~F.isnan("weight")).select("chunk_ord", "term")


def p3_top_terms(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """The five most distinctive terms of each chunk (a top-k report)."""
    scored = keyness(spark.read.parquet(f"{sf}/chunks.parquet"))
    place = F.row_number().over(W.partitionBy("chunk_ord").orderBy(F.col("weight").desc(), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select("chunk_ord", "place", "term", "tf", "df", F.round("weight", 3).alias("weight"))


QUERIES = {"p3_found": p3_found, "p3_top_terms": p3_top_terms}
ORACLE = {
    "p3_found": r"""
WITH t AS (SELECT chunk_ord, unnest(regexp_extract_all(content, '\p{L}+')) w FROM chunks WHERE content IS NOT NULL),
c AS (SELECT chunk_ord, lower(w) term, count(*) tf FROM t WHERE length(w) >= 5 GROUP BY ALL),
d AS (SELECT term, count(*) df FROM c GROUP BY ALL)
SELECT chunk_ord, term FROM c JOIN d USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 8""",
    "p3_top_terms": r"""
WITH t AS (SELECT chunk_ord, unnest(regexp_extract_all(content, '\p{L}+')) w FROM chunks WHERE content IS NOT NULL),
c AS (SELECT chunk_ord, lower(w) term, count(*)::DOUBLE a FROM t WHERE length(w) >= 5 GROUP BY ALL),
d AS (SELECT term, count(*) df, sum(a) cf FROM c GROUP BY ALL),
h AS (SELECT chunk_ord, sum(a) mine FROM c GROUP BY ALL),
n AS (SELECT sum(a) n FROM c),
x AS (SELECT chunk_ord, term, a, df, mine, cf - a b, n - mine rest, cf / n p FROM c JOIN d USING (term) JOIN h USING (chunk_ord), n),
y AS (SELECT *, 2 * (CASE WHEN a > 0 THEN a * ln(a / (mine * p)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / (rest * p)) ELSE 0 END
   + CASE WHEN mine - a > 0 THEN (mine - a) * ln((mine - a) / (mine * (1 - p))) ELSE 0 END
   + CASE WHEN rest - b > 0 THEN (rest - b) * ln((rest - b) / (rest * (1 - p))) ELSE 0 END) g FROM x),
z AS (SELECT *, round(CASE WHEN a * rest >= b * mine THEN g ELSE -g END, 6) w FROM y),
k AS (SELECT *, row_number() OVER (PARTITION BY chunk_ord ORDER BY w DESC, term) place FROM z)
SELECT chunk_ord, place::INT place, term, a::INT tf, df, round(w, 3) weight FROM k WHERE place <= 5""",
}
