"""Pages to chunks: windows or articles, page and section of each chunk, quality filter, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lutrin.config import Settings
from lutrin.functions.text import alpha_ratio, shortened, stem
from lutrin.operators import spans
from lutrin.operators.families import RULES, family
from lutrin.plans.scale import buckets_for, hot_keys, running_sum, written

# Rows of reservation tables and of address lists, which are few letters but wanted.
TABLE_ROW = r"(?U)\b(?:LS|BRS)\s+\d{2,3}-\d{2,3}\b"
ADDRESS_ROW = (
    r"(?Umd)^\s*\d{1,2}(?:er|e)?\s+.{0,40}?\b"
    r"(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Ii]mpasse|[Qq]uai|[Aa]llée|[Ss]quare|[Vv]illa|[Vv]oie|[Cc]ité|[Pp]assage)\b"
)
STRUCTURED = "reglement_ecrit"


def worth_keeping(content: Column, least: float) -> Column:
    """Enough letters, or a row of a table or an address list."""
    return (alpha_ratio(content) >= least) | content.rlike(TABLE_ROW) | content.rlike(ADDRESS_ROW)


def numbered(chunks: DataFrame, order: str = "off", hot: dict | None = None) -> DataFrame:
    """chunks with raw_idx: their number inside the file, before anything is filtered."""
    one = chunks.withColumn("one", F.lit(1).cast("long"))
    hot = hot_keys(one, "source_path") if hot is None else hot
    return running_sum(one, "source_path", order, "one", "n1", hot).withColumn("raw_idx", F.col("n1") - 1).drop("one", "n1")


def under_section(rows: DataFrame) -> DataFrame:
    """rows (content, article_pos, code, annexe struct<pos, title>) with section and, under an annexe, its title
    put before the content. A section is the last article or annexe header at or before the chunk, whichever
    is later; a tie goes to the article. A chunk that begins after blanks still belongs to its span's article."""
    inside = F.coalesce(F.col("annexe.pos"), F.lit(-1)) > F.col("article_pos")
    title = shortened(F.col("annexe.title"))
    return rows.withColumns({
        "section": F.when(inside, title).otherwise(F.col("code")),
        "content": F.when(inside, F.concat(F.lit("[Section: "), title, F.lit("]\n"), F.col("content"))).otherwise(F.col("content")),
    })


def raw_chunks(pages: DataFrame, settings: Settings = Settings(), rules=RULES) -> DataFrame:
    """(source_path, doc_family, s, raw_idx, off, content, page, section) before the quality filter.

    Files of the structured family are cut at article headers, others by sliding windows.
    """
    placed = spans.layout(pages, headed=True).withColumn("doc_family", family(F.col("source_path"), rules))
    structured, other = placed.where(F.col("doc_family") == STRUCTURED), placed.where(F.col("doc_family") != STRUCTURED)
    heads = written(spans.headers(structured), "heads")
    hot = spans.hot_files(placed, heads, settings.chunk_size - settings.chunk_overlap)
    by_article = spans.cut(structured, spans.articles(structured, heads, settings.chunk_size, hot))
    # Between a span's start and its first letter there are only blanks: no annexe, unless one begins there.
    by_article = by_article.withColumn("annexe", F.when(F.col("after.pos") <= F.col("off"), F.col("after")).otherwise(F.col("before")))
    by_article = under_section(by_article).select("source_path", "s", "off", "page", "section", "content")
    by_window = spans.cut(other, spans.windows(other, settings.chunk_size, settings.chunk_overlap)).select("source_path", "s", "off", "page", F.lit(None).cast("string").alias("section"), "content")
    return numbered(by_article.unionByName(by_window), "s", hot).withColumn("doc_family", family(F.col("source_path"), rules))


def chunks(pages: DataFrame, settings: Settings = Settings(), rules=RULES) -> DataFrame:
    """(chunk_id, source_path, doc_family, content, page, section, raw_idx) of all pages."""
    kept = raw_chunks(pages, settings, rules).where(worth_keeping(F.col("content"), settings.min_alpha_ratio))
    return kept.select(F.concat(stem(F.col("source_path")), F.lit("-"), F.col("raw_idx")).alias("chunk_id"), "source_path", "doc_family", "content", "page", "section", "raw_idx")


def distinct_contents(rows: DataFrame, order: tuple[str, ...] = ("source_path", "raw_idx")) -> DataFrame:
    """One row per content, the first in `order` (then by chunk_id or chunk_ord where there are such columns).

    The first row itself is what the aggregation carries, combined before the shuffle: a text repeated in a
    third of all rows reaches its one place as a row per task. Null contents count as one content.
    """
    last = [c for c in ("chunk_id", "chunk_ord") if c in rows.columns and c not in order]
    first = F.min_by(F.struct(*rows.columns), F.struct(*order, *last))
    return rows.groupBy(F.md5("content").alias("h")).agg(first.alias("r")).select("r.*")


def with_ordinal(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """rows with chunk_ord: place in the order of (source_path, chunk_id), from 0.

    The rows are written in ranges of that order, as many as their number asks for; each range is numbered
    by itself and begins after the sizes of the ranges before it. A file with a third of all chunks just
    fills several ranges.
    """
    order = ["source_path", "chunk_id"]
    rows = written(rows, "unordered")  # finding the ranges reads the rows once more
    ranges = ranges or buckets_for(rows.count(), per=200_000)
    parts = written(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ordinal")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    ahead = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    place = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("place", place).join(F.broadcast(ahead), "part").withColumn("chunk_ord", F.col("ahead") + F.col("place")).drop("place", "ahead", "part")
