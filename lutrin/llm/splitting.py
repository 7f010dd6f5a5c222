"""Splitting oversized texts at natural boundaries with overlap (problem 7), by pointer doubling.

Every boundary is joined to its farthest legal successor once; the successor tables are then squared,
so all greedy cuts of all texts come out in a number of rounds that is the logarithm of the most pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lutrin.plans.scale import buckets_for, written

LIMIT, OVERLAP = 1200, 200
#: Characters of one text that a single window task sees at most (besides one step of the next block).
BLOCK = 1_000_000
#: Characters of texts whose boundaries one task works on.
PER_TASK = 4_000_000


def segments(text: Column, step: int) -> Column:
    """The text cut after paragraphs, lines and sentences; inside longer stretches after words, and
    inside longer words after `step` characters. Concatenated, the segments are the text."""
    sentences = F.split(text, r"(?<=[.!?…;:])(?=\s)|(?<=\n)")
    hard = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.length(w) - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(w, i + 1, F.lit(step)))
    by_word = lambda s: F.flatten(F.transform(F.split(s, r"(?<=\s)(?=\S)"), lambda w: F.when(F.length(w) > step, hard(w)).otherwise(F.array(w))))
    return F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) > step, by_word(s)).otherwise(F.array(s))))


def boundaries(texts: DataFrame, row: str, text: str, step: int, overlap: int) -> DataFrame:
    """(row, pos): the place where each text's walk starts (`overlap` characters in, where a piece before the first
    would have ended) and the lengths of the prefixes beyond it at which the text may be cut, its end included.

    Where the first of them is more than a step away there is a hard cut one step in. The segments are
    lengths in their text's row and are added up there: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, column = b.column(0).to_numpy(), b.column(1)
            counts = np.diff(column.offsets.to_numpy())
            ends = np.cumsum(column.flatten().to_numpy().astype(np.int64))
            first = np.cumsum(counts) - counts
            before = np.where(first > 0, ends[np.maximum(first - 1, 0)], 0) if len(ends) else np.zeros(len(ids), np.int64)
            who = np.repeat(np.arange(len(ids)), counts)
            pos = ends - before[who]
            keep = pos > overlap
            who, pos = who[keep], pos[keep]
            nearest = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(nearest, who, pos)
            far = np.flatnonzero((nearest > overlap + step) & (nearest < np.iinfo(np.int64).max))
            who = np.concatenate([who, far, np.arange(len(ids))])
            pos = np.concatenate([pos, np.full(len(far), overlap + step), np.full(len(ids), overlap)])
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(pos)], [row, "pos"])

    lengths = F.transform(segments(F.col(text), step), lambda s: F.length(s))
    return texts.select(row, F.filter(lengths, lambda n: n > 0).alias("n")).mapInArrow(run, f"{row} long, pos long")


def successors(points: DataFrame, row: str, step: int, parts: int) -> DataFrame:
    """(row, pos, nxt): the farthest boundary at most `step` beyond each boundary.

    Windows run over blocks of a text; each block also holds the boundaries one step into the next. The
    blocks go to `parts` tasks, a number made from the size of all texts, so that a task's share does not grow.
    """
    own = F.floor(F.col("pos") / BLOCK)
    near = (F.col("pos") % BLOCK <= step) & (F.col("pos") >= BLOCK)
    homes = F.when(near, F.array(own, own - 1)).otherwise(F.array(own))
    spread = points.select(row, "pos", own.alias("own"), F.explode(homes).alias("block")).repartition(parts, row, "block")
    ahead = W.partitionBy(row, "block").orderBy("pos").rangeBetween(0, step)
    return spread.withColumn("nxt", F.max("pos").over(ahead)).where("own = block").select(row, "pos", "nxt")


def cuts(points: DataFrame, row: str, step: int, overlap: int, longest: int, parts: int) -> DataFrame:
    """(row, pos): the greedy cuts of texts with these boundaries."""
    jump = written(successors(points, row, step, parts), "jump")
    reached = jump.where(F.col("pos") == overlap).select(row, "pos")
    # Two greedy steps together advance more than `step`, which bounds the pieces.
    for _ in range(max(1, math.ceil(math.log2(2 * longest / step + 2)))):
        there = reached.join(jump, [row, "pos"]).select(row, F.col("nxt").alias("pos"))
        reached = written(reached.unionByName(there).distinct(), "reached")
        a, b = jump.alias("a"), jump.alias("b")
        jump = written(a.join(b, (F.col(f"a.{row}") == F.col(f"b.{row}")) & (F.col("a.nxt") == F.col("b.pos"))).select(f"a.{row}", "a.pos", "b.nxt"), "jump")
    return reached.where(F.col("pos") != overlap)


def split(rows: DataFrame, text: str = "content", keep: tuple[str, ...] = ("chunk_ord", "section", "page"), limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keep..., piece, start_pos, end_pos, piece_text): pieces of at most `limit` code points.

    Each piece but the first begins exactly `overlap` code points before its predecessor's end. Texts
    within the limit are one piece; null texts give none, an empty text gives one empty piece. Rows are
    told apart by an internal number, so repeated or null keys are no trouble. A boundary within the
    first `overlap` characters is no cut.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and smaller than limit")
    step = limit - overlap
    kept = [F.col(k) for k in keep]
    fits = rows.where(F.length(text) <= limit).select(*kept, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_pos"), F.length(text).cast("long").alias("end_pos"), F.col(text).alias("piece_text"))
    large = written(rows.where(F.length(text) > limit).select(*kept, F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row")), "large")
    longest, total = large.agg(F.max(F.length("__text")), F.sum(F.length("__text"))).first()
    if not longest:
        return fits
    points = boundaries(large, "__row", "__text", step, overlap)
    found = cuts(points, "__row", step, overlap, longest, buckets_for(total, per=PER_TASK))
    order = W.partitionBy("__row").orderBy("pos")
    pieces = found.select("__row", (F.row_number().over(order) - 1).alias("piece"), F.col("pos").alias("end_pos"),
                          F.coalesce(F.lag("pos").over(order) - overlap, F.lit(0).cast("long")).alias("start_pos"))
    cut = pieces.join(large, "__row").select(
        *kept, "piece", "start_pos", "end_pos",
        F.substring(F.col("__text"), (F.col("start_pos") + 1).cast("int"), (F.col("end_pos") - F.col("start_pos")).cast("int")).alias("piece_text"),
    )
    return fits.unionByName(cut)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that the splitter had to cut."""
    pieces = split(spark.read.parquet(f"{sf}/chunks.parquet"))
    return pieces.where("piece = 1").select("chunk_ord").distinct()


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All pieces with their chunk's section and page."""
    return split(spark.read.parquet(f"{sf}/chunks.parquet"))


QUERIES = {"p7_found": p7_found, "p7_pieces": p7_pieces}
ORACLE = {
    "p7_found": "SELECT DISTINCT chunk_ord FROM chunks WHERE length(content) > 1200",
    # Boundaries by marks put into the text, then the greedy walk one cut at a time.
    "p7_pieces": r"""
WITH RECURSIVE l AS (SELECT chunk_ord, section, page, content, length(content) AS n FROM chunks WHERE length(content) > 1200),
m AS (SELECT chunk_ord, string_split(regexp_replace(regexp_replace(content, '([.!?…;:])([\s\x{B}])', '\1' || chr(1) || '\2', 'g'), '\n', chr(10) || chr(1), 'g'), chr(1)) AS ss FROM l),
s AS (SELECT chunk_ord, i, unnest(CASE WHEN length(x) > 1000 THEN string_split(regexp_replace(x, '([\s\x{B}])([^\s\x{B}])', '\1' || chr(1) || '\2', 'g'), chr(1)) ELSE [x] END) AS w, x
  FROM (SELECT chunk_ord, unnest(ss) AS x, generate_subscripts(ss, 1) AS i FROM m)),
w AS (SELECT chunk_ord, i, row_number() OVER (PARTITION BY chunk_ord, i) AS j, w FROM s),
h AS (SELECT chunk_ord, i, j, k, CASE WHEN length(w) > 1000 THEN substring(w, k::INT + 1, 1000) ELSE w END AS p FROM (SELECT *, unnest(range(0, CASE WHEN length(w) > 1000 THEN length(w) ELSE 1 END, 1000)) AS k FROM w)),
b0 AS (SELECT chunk_ord, sum(length(p)) OVER (PARTITION BY chunk_ord ORDER BY i, j, k)::BIGINT AS pos FROM h),
b1 AS (SELECT DISTINCT chunk_ord, pos FROM b0 WHERE pos > 200),
b AS (SELECT * FROM b1 UNION SELECT chunk_ord, 1200 FROM b1 GROUP BY chunk_ord HAVING min(pos) > 1200),
g AS (SELECT chunk_ord, 200::BIGINT AS pos FROM l
  UNION ALL SELECT g.chunk_ord, (SELECT max(b.pos) FROM b WHERE b.chunk_ord = g.chunk_ord AND b.pos > g.pos AND b.pos <= g.pos + 1000) FROM g JOIN l USING (chunk_ord) WHERE g.pos < l.n),
e AS (SELECT chunk_ord, pos AS end_pos, row_number() OVER (PARTITION BY chunk_ord ORDER BY pos) - 1 AS piece, coalesce(lag(pos) OVER (PARTITION BY chunk_ord ORDER BY pos) - 200, 0) AS start_pos FROM g WHERE pos <> 200)
SELECT chunk_ord, section, page, piece::INT AS piece, start_pos, end_pos, substring(content, start_pos::INT + 1, (end_pos - start_pos)::INT) AS piece_text FROM e JOIN l USING (chunk_ord)
UNION ALL SELECT chunk_ord, section, page, 0, 0, length(content), content FROM chunks WHERE length(content) <= 1200""",
}
