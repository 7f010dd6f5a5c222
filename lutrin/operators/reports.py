"""Answers' inputs and outputs, and the evaluation of searches against a golden question set."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lutrin.functions import text as X

GOLDEN = "id string, question string, expected_articles array<string>, expected_keywords array<string>, expected_answer_summary string, family string, complexity string"


@F.pandas_udf(T.StringType())
def _fixed(value: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f"{v:.{d}f}" for v, d in zip(value, digits)])


def fixed(value: Column, digits: int) -> Column:
    """The number with so many digits, rounded on its exact binary value (Java rounds its shortest decimal
    form). Only for the few rows of a report."""
    return _fixed(value.cast("double"), F.lit(digits))


def ordered_text(parts: Column, order: str, glue: str) -> Column:
    """Aggregate: the strings `parts` joined in the order of a column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), parts.alias("t")))), lambda x: x.t), glue)


def hit_line(hit: str = "") -> Column:
    c = lambda n: F.col(hit + n)
    return F.concat(F.lit("[score="), fixed(c("score"), 3), F.lit("] ["), c("doc_family"), F.lit("] "), c("source_path"), F.lit("\n"), X.excerpted(c("content")))


def passages(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """(query_id, passages): the shown hits of each query; there are top_k of them."""
    return hits.withColumn("line", hit_line()).groupBy("query_id").agg(ordered_text(F.col("line"), rank, "\n\n").alias("passages"))


def debug_line() -> Column:
    n = lambda c, d: F.coalesce(fixed(F.col(c), d), F.lit("n/a"))
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    return F.concat_ws(" | ", X.basename(F.col("source_path")), F.col("doc_family"), n("dense_score", 4), n("bm25_score", 4), fixed(F.col("score"), 5), some("page"), some("section"), F.substring("content", 1, 200))


def prompts(hits: DataFrame, questions: DataFrame, rank: str = "rank") -> DataFrame:
    """(query_id, user): the question with the contents of its hits, 3,000 characters each."""
    block = F.concat(F.lit("Source: "), X.basename(F.col("source_path")), F.lit("\nContent: "), F.substring("content", 1, 3000))
    context = hits.withColumn("block", block).groupBy("query_id").agg(ordered_text(F.col("block"), rank, "\n\n").alias("context"))
    return questions.join(context, "query_id").select("query_id", F.concat(F.lit("Question: "), F.col("text"), F.lit("\n\nContext:\n"), F.col("context")).alias("user"))


def citations(hits: DataFrame, rank: str = "rank") -> DataFrame:
    one = F.struct(F.col(rank).alias("rank"), X.basename(F.col("source_path")).alias("source"), F.col("source_path").alias("full_path"), F.col("doc_family").alias("family"), X.excerpted(F.col("content")).alias("excerpt"), "page", "section")
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("citations"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _strings(raw: pd.Series) -> pd.Series:
    def parse(text: str | None) -> list[str]:
        try:
            items = json.loads(text or "")
        except ValueError:
            return []
        return [x for x in items if isinstance(x, str) and x.strip()] if isinstance(items, list) else []

    return raw.map(parse)


def bracketed_strings(raw: Column) -> Column:
    """Non-blank strings of the JSON list between the first [ and the last ]; an empty array otherwise.

    Spark's JSON functions overlook what follows a value, so the few replies of a question set are parsed
    in Python.
    """
    a, b = F.locate("[", raw), F.length(raw) - F.locate("]", F.reverse(raw)) + 1
    return _strings(F.when((a > 0) & (F.locate("]", raw) > 0) & (b > a), F.substring(raw, a, b - a + 1)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _listed(raw: pd.Series) -> pd.Series:
    def parse(text: str | None) -> list[str]:
        try:
            items = ast.literal_eval(text or "")
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return []
        return [str(x) for x in items] if isinstance(items, list) else []

    return raw.map(parse)


# Lines of a stored output, as the command line prints them.
PASSAGES_MARK, ANSWER_MARK = "Retrieved passages:", "LLM answer:"
CODES_MARK, EXPANSION_MARK = "[query expansion] articles inférés : ", "[query expansion] expansion query  : "


def output_parts(raw: Column) -> Column:
    """struct<passages, answer, expansion, codes> of a stored output.

    Without the passages' mark all of it is passages; without the answer's mark there is no answer. Of
    several expansion lines the last counts; codes that cannot be read are none.
    """
    at = F.locate(PASSAGES_MARK, raw)
    rest = F.when(at > 0, F.substring(raw, at + len(PASSAGES_MARK), F.length(raw))).otherwise(raw)
    cut = F.when(at > 0, F.locate(ANSWER_MARK, rest)).otherwise(F.lit(0))
    lines = F.split(raw, r"\r\n|\r|\n", -1)
    last = lambda mark: F.try_element_at(F.filter(lines, lambda x: F.startswith(x, F.lit(mark))), F.lit(-1))
    after = lambda mark: X.strip(F.substring(last(mark), F.lit(len(mark) + 1), F.length(last(mark))))
    return F.struct(
        X.strip(F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(rest)).alias("passages"),
        F.when(cut > 0, X.strip(F.substring(rest, cut + len(ANSWER_MARK), F.length(rest)))).otherwise("").alias("answer"),
        F.coalesce(after(EXPANSION_MARK), F.lit("")).alias("expansion"),
        F.coalesce(_listed(after(CODES_MARK)), F.array().cast("array<string>")).alias("codes"),
    )


def missing(expected: Column, found_in: Column) -> Column:
    """Expected strings that do not occur in a text, without regard to case, in order."""
    text = F.lower(F.coalesce(found_in, F.lit("")))
    return F.filter(F.coalesce(expected, F.array().cast("array<string>")), lambda e: ~F.contains(text, F.lower(e)))


def share_found(expected: Column, lost: Column) -> Column:
    n = F.size(F.coalesce(expected, F.array().cast("array<string>")))
    return F.when(n > 0, (n - F.size(lost)) / n).otherwise(F.lit(1.0))


def scored(cases: DataFrame) -> DataFrame:
    """Golden cases with passages, answer and error scored; a case with an error scores nothing."""
    failed = F.col("error").isNotNull()
    empty = F.array().cast("array<string>")
    lost = lambda e, t: F.when(failed, F.coalesce(F.col(e), empty)).otherwise(missing(F.col(e), F.col(t)))
    x = cases.withColumn("missing_articles", lost("expected_articles", "passages")).withColumn("missing_keywords", lost("expected_keywords", "answer"))
    score = lambda e, m: F.when(failed, F.lit(0.0)).otherwise(F.bround(share_found(F.col(e), F.col(m)), 4))
    return x.withColumn("retrieval_score", score("expected_articles", "missing_articles")).withColumn("answer_score", score("expected_keywords", "missing_keywords"))


def retrieval_scores(cases: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(run, id, retrieval_score) of cases (id, expected_articles) in each run of hits (run, query_id, carried, rank,
    chunk_ord, shown), as `passages` and `scored` have it; carried are the expected articles.

    Each hit's line is searched for them where it meets its chunk, so no passages are put together, except
    for cases with an article that could go over the end of a line.
    """
    empty = F.array().cast("array<string>")
    texts = chunks.join(hits.select("chunk_ord").distinct(), "chunk_ord", "left_semi").select(
        "chunk_ord", F.lower(F.concat(F.lit("] ["), F.col("doc_family"), F.lit("] "), F.col("source_path"), F.lit("\n"), X.excerpted(F.coalesce("content", F.lit(""))))).alias("tail"))
    line = F.concat(F.lit("[score="), F.col("shown"), F.col("tail"))
    over = F.coalesce(F.exists("carried", lambda e: F.contains(e, F.lit("\n"))), F.lit(False))
    lines = hits.join(texts, "chunk_ord").select(
        "run", "query_id", "rank", F.filter(F.coalesce("carried", empty), lambda e: F.contains(line, F.lower(e))).alias("found"), F.when(over, line).alias("line"))
    seen = lines.groupBy("run", "query_id").agg(F.flatten(F.collect_set("found")).alias("found"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("rank", "line")))), lambda x: x.line), "\n\n").alias("text"))
    each = cases.select("id", F.coalesce("expected_articles", empty).alias("expected")).crossJoin(F.broadcast(hits.select("run").distinct()))  # a handful of runs
    x = each.join(seen.withColumnRenamed("query_id", "id"), ["run", "id"], "left")
    lost = F.filter("expected", lambda e: ~(F.contains(F.coalesce("text", F.lit("")), F.lower(e)) | F.array_contains(F.coalesce("found", empty), e)))
    return x.select("run", "id", F.bround(share_found(F.col("expected"), lost), 4).alias("retrieval_score"))


def compared(runs: DataFrame, base: str) -> DataFrame:
    """runs (run, id, retrieval_score) against the run `base`, whose cases drive: score, delta and arrow."""
    first = runs.where(F.col("run") == base).select("id", F.col("retrieval_score").alias("base_score"))
    names = runs.select("run").distinct()
    cases = first.crossJoin(F.broadcast(names))  # a handful of runs
    x = cases.join(runs.select("run", "id", "retrieval_score"), ["run", "id"], "left").withColumn("retrieval_score", F.coalesce("retrieval_score", F.lit(0.0)))
    delta = F.round(F.col("retrieval_score") - F.col("base_score"), 6)
    return x.select("run", "id", "retrieval_score", delta.alias("delta"), F.when(delta > 0, "↑").when(delta < 0, "↓").otherwise("=").alias("arrow"))


def leading_hits(hits: DataFrame, score: str, k: int) -> DataFrame:
    """The k best logged hits of each query by a score, repeated ones once; rank from 1."""
    one = hits.where(F.col(score).isNotNull()).dropDuplicates(["query_id", "chunk_ord"])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col(score).desc(), "chunk_ord"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k)
