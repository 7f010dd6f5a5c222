"""Texts that reach over the pages of a file, cut into spans without ever gathering a file in one task.

A file's text is its pages joined by line feeds. Pages get their offsets by running sums that split hot
files; everything else works on (file, offset) rows, and only the characters of one span meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lutrin.functions.text import leading, strip
from lutrin.plans.scale import HOT_ROWS, hot_keys, running, written

#: Characters of a file that meet in one join key; spans and pages fall into the blocks they touch.
BLOCK = 8192

# Header patterns of articles (group 1 is the code) and annexes.
ARTICLE = r"(?<!\()\b((?:UG(?:SU)?|UV|N|A|P)\w*\.\d+(?:\.\d+)*)\s+[A-ZÀÂÄÉÈÊËÎÏÔÙÛÜŸÇ][a-zàâäéèêëîïôùûüÿç]"
ANNEXE = r"A\s*NNEXE\s+[IVXLCDM]+\s*[:\–\-]?\s*[A-ZÀÂÄÉÈÊËÎÏÔÙÛÜŸÇ][^\n]{0,120}"
#: Ends of a page in which such a header may have begun (Java).
BEGUN = r"(?iU)(?:\.\d+|A|A\s*NNEXE|NNEXE\s+[IVXLCDM]+\s*[:–-]?)\s*\z"


def layout(pages: DataFrame, hot_rows: int = HOT_ROWS, headed: bool = False) -> DataFrame:
    """(source_path, page_num, text, n, start): offset of each page in its file, counted from 0.

    Blank and null pages are dropped, a page delivered twice counts once (smallest text). headed: with
    `follow`, the text of the next page where a header may have begun at the end of this one, and
    `bracket`, whether the page before ends with an open bracket (pages of white space do not count).
    """
    kept = pages.where(F.col("text").isNotNull() & (F.col("text") != "") & F.col("source_path").isNotNull() & F.col("page_num").isNotNull())
    hot = hot_keys(kept, "source_path", hot_rows)
    one = kept.groupBy("source_path", "page_num").agg(F.min("text").alias("text")).withColumn("n", F.length("text")).withColumn("step", (F.col("n") + 1).cast("long"))
    columns = ["source_path", "page_num", "text", "n", (F.col("end") - F.col("step")).alias("start")]
    if not headed:
        run = running(one, "source_path", "page_num", hot, {"end": "step"})
    else:
        full = F.col("text").rlike(r"(?U)\S")
        one = one.withColumn("closing", F.when(full, F.col("text").rlike(r"(?U)\(\s*\z"))).withColumn("words", F.when(full, F.col("text")))
        run = running(one, "source_path", "page_num", hot, {"end": "step"}, {"bracket": "closing"})
        run = running(run, "source_path", "page_num", hot, lasts={"follow": "words"}, descending=True)
        columns += [F.when(F.col("text").rlike(BEGUN), F.col("follow")).alias("follow"), F.coalesce("bracket", F.lit(False)).alias("bracket")]
    # Every later step reads the pages with their offsets: they are written once.
    return written(run.select(*columns), "layout")


def totals(placed: DataFrame) -> DataFrame:
    return placed.groupBy("source_path").agg(F.max(F.col("start") + F.col("n")).alias("total"))


def windows(placed: DataFrame, size: int, overlap: int) -> DataFrame:
    """(source_path, s, e): sliding windows; none begins once another has reached the end."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - size) / step)).cast("long")
    t = totals(placed).where("total > 0").select("source_path", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    return t.select("source_path", (F.col("k") * step).alias("s"), F.least(F.col("k") * step + size, F.col("total")).alias("e"))


def cut(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (source_path, s, e, ...) with off, content, page: their stripped text, where it begins, on
    which page. Blank spans are dropped. (source_path, s) must tell spans apart."""
    def block(c: Column) -> Column:
        return F.floor(c / BLOCK)

    p = placed.select(F.col("source_path").alias("pp"), "page_num", "text", "n", F.col("start").alias("ps"), F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("n")))).alias("pb"))
    names = [c for c in spans.columns if c not in ("source_path", "s")]
    s = spans.withColumn("sb", F.explode(F.sequence(block(F.col("s")), block(F.greatest(F.col("e") - 1, F.col("s"))))))
    pe = F.col("ps") + F.col("n") + 1  # with the line feed that joins the next page
    j = s.join(p, (F.col("source_path") == F.col("pp")) & (F.col("sb") == F.col("pb"))).where(
        (F.col("s") < pe) & (F.col("e") > F.col("ps")) & (F.col("sb") == F.greatest(block(F.col("s")), block(F.col("ps"))))
    )
    a, b = F.greatest("s", "ps"), F.least("e", pe)
    part = F.substring(F.concat("text", F.lit("\n")), (a - F.col("ps") + 1).cast("int"), (b - a).cast("int"))
    parts = j.groupBy("source_path", "s").agg(
        *[F.first(c).alias(c) for c in names], F.array_sort(F.collect_list(F.struct(F.col("ps"), F.col("page_num"), part.alias("t")))).alias("parts")
    )
    raw = F.array_join(F.transform("parts", lambda x: x.t), "")
    out = parts.withColumn("raw", raw).withColumn("off", F.col("s") + leading(F.col("raw"))).withColumn("content", strip(F.col("raw")))
    page = F.try_element_at(F.filter("parts", lambda x: x.ps <= F.col("off")), F.lit(-1)).page_num
    return out.where("content <> ''").select("source_path", "s", *names, "off", "content", page.alias("page"))


def headers(placed: DataFrame) -> DataFrame:
    """(source_path, pos, title, article): article headers with their code and annexe headers with their line, by
    offset in the file. placed is a headed layout.

    A header may begin on one page and end on the next that has any text. Annexes after an open bracket, which
    may end the page before, are references and left out.
    """
    article, annexe = re.compile(ARTICLE), re.compile(ANNEXE, re.I)

    def found(text: str, n: int, bracket: bool) -> Iterator[tuple[int, str, bool]]:
        if "." in text:
            yield from ((m.start(), m.group(1), True) for m in article.finditer(text) if m.start() < n)
        for m in annexe.finditer(text):
            before = text[: m.start()].rstrip()
            if m.start() < n and not (before.endswith("(") if before else bracket):
                yield m.start(), m.group(0).strip(), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, at, titles, kinds = [], [], [], []
            for path, text, n, start, follow, bracket in zip(*(c.to_pylist() for c in b.columns)):
                for pos, title, kind in found(text if follow is None else f"{text}\n{follow}", n, bracket):
                    paths.append(path), at.append(start + pos), titles.append(title), kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(at, pa.int64()), pa.array(titles, pa.string()), pa.array(kinds, pa.bool_())], ["source_path", "pos", "title", "article"])

    return placed.select("source_path", "text", "n", "start", "follow", "bracket").mapInArrow(run, "source_path string, pos long, title string, article boolean")


def hot_files(placed: DataFrame, heads: DataFrame, step: int, hot_rows: int = HOT_ROWS) -> dict:
    """Files that may have more than hot_rows spans of at least `step` characters or headers, and a bound of their number;
    there are at most all spans / hot_rows of them."""
    spans = placed.groupBy("source_path").agg((F.sum("n") / step + F.count(F.lit(1))).alias("n"))
    both = spans.unionByName(heads.groupBy("source_path").agg((F.lit(2.0) * F.count(F.lit(1))).alias("n"))).groupBy("source_path").agg(F.sum("n").cast("long").alias("n"))
    return {r[0]: r[1] for r in both.where(F.col("n") > hot_rows).collect()}


def articles(placed: DataFrame, heads: DataFrame, size: int, hot: dict | None = None) -> DataFrame:
    """(source_path, s, e, article_pos, code, before, after): text from each article header to the next, in spans
    of at most `size`, with the last annexe (pos, title) at or before their start and the first one after it.

    Text before a file's first header is left out; a file without headers is cut as a whole. Headers and
    spans are one sequence of positions per file, worked by running values; no text takes part.
    """
    own = heads.where("article").select("source_path", "pos", F.col("title").alias("code"))
    hot = hot_files(placed, heads, size) if hot is None else hot
    t = totals(placed)
    follow = running(own, "source_path", "pos", hot, lasts={"end": "pos"}, descending=True).join(t, "source_path")
    spans = follow.select("source_path", F.col("pos").alias("article_pos"), "code", F.coalesce("end", "total").alias("stop"))
    bare = t.join(own, "source_path", "left_anti").select("source_path", F.lit(0).cast("long").alias("article_pos"), F.lit(None).cast("string").alias("code"), F.col("total").alias("stop"))
    starts = F.sequence(F.col("article_pos"), F.col("stop") - 1, F.lit(size).cast("long"))
    pieces = spans.unionByName(bare).where("stop > article_pos").select("source_path", F.explode(starts).alias("s"), "stop", "article_pos", "code").select(
        "source_path", "s", F.least(F.col("s") + size, F.col("stop")).alias("e"), F.when(F.col("code").isNotNull(), F.col("article_pos")).otherwise(-1).alias("article_pos"), "code"
    )
    annexes = heads.where("NOT article").select("source_path", (F.col("pos") * 2).alias("o"), F.struct("pos", "title").alias("mark"))
    events = pieces.withColumn("o", F.col("s") * 2 + 1).unionByName(annexes, allowMissingColumns=True)
    both = running(running(events, "source_path", "o", hot, lasts={"before": "mark"}), "source_path", "o", hot, lasts={"after": "mark"}, descending=True)
    return both.where("mark IS NULL").select(*pieces.columns, "before", "after")
