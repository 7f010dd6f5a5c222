import random

import pytest
from pyspark.sql import functions as F

from lutrin.operators import leaders, lexical, reports
from lutrin.plans import queries

SF = "/root/testdata/sf0.001"


def test_all_golden_questions_are_compared(spark):
    golden = spark.read.parquet(f"{SF}/golden.parquet")
    got = queries.eval_compare(spark, SF).collect()
    ids = {r["id"] for r in golden.collect()}
    assert {(r["run"], r["id"]) for r in got} == {(run, i) for run in ("plain", "alpha=0.7", "alpha=0.5") for i in ids} and len(got) == 3 * len(ids)
    # The same by one search after the other, with the passages put together.
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("v"), "embedding")
    asked = golden.join(vectors, queries._number(F.col("id")) == F.col("v"), "left").select(
        F.col("id").alias("query_id"), F.col("question").alias("text"), "embedding", F.array_join("expected_keywords", " ").alias("expansion"), F.col("embedding").alias("expansion_embedding"))
    searcher, score = queries._searcher(spark, SF), {(r["run"], r["id"]): r["retrieval_score"] for r in got}
    for run, hits in (("plain", searcher.search(asked, 5)), ("alpha=0.5", searcher.search_weighted(asked, 5, 0.5))):
        shown = reports.passages(hits.withColumn("content", F.coalesce("content", F.lit(""))))
        cases = golden.join(shown, F.col("id") == F.col("query_id"), "left").withColumn("answer", F.lit("")).withColumn("error", F.lit(None).cast("string"))
        assert {r["id"]: r["retrieval_score"] for r in reports.scored(cases).collect()} == {i: score[run, i] for i in ids}


def test_articles_are_found_in_lines_as_in_passages(spark):
    hit = "run string, query_id string, carried array<string>, rank int, chunk_ord long, shown string"
    wanted = ["UG.1", "padd] b.pdf", "a\n\n[SCORE=0.5", "N.9", "", None, "0.500"]
    hits = spark.createDataFrame([("r", "1", wanted, 1, 0, "0.500"), ("r", "1", wanted, 2, 1, "0.500"), ("s", "1", wanted, 1, 2, "0.100")], hit)
    chunks = spark.createDataFrame([(0, "padd", "a.pdf", "see ug.1.2 a"), (1, "padd", "b.pdf", None), (2, None, "c.pdf", "ug.1")], "chunk_ord long, doc_family string, source_path string, content string")
    cases = spark.createDataFrame([("1", wanted), ("2", []), ("3", ["x"])], "id string, expected_articles array<string>")
    got = {(r["run"], r["id"]): r["retrieval_score"] for r in reports.retrieval_scores(cases, hits, chunks).collect()}
    # Missing are N.9 in run r, and all that a line could hold in s, whose only line is null as it has no family.
    assert got == {("r", "1"): round(6 / 7, 4), ("s", "1"): round(2 / 7, 4), ("r", "2"): 1.0, ("s", "2"): 1.0, ("r", "3"): 0.0, ("s", "3"): 0.0}


@pytest.mark.parametrize("first, cells, bags", [(1000, 6_000_000, 120_000), (9, 2000, 50)])
def test_leaders_are_lexical_top(spark, monkeypatch, first, cells, bags):
    monkeypatch.setattr(leaders, "FIRST", first)
    monkeypatch.setattr(leaders, "CELLS", cells)
    monkeypatch.setattr(leaders, "BAGS", bags)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    often = [1 / (i + 1) for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, often, k=rng.randint(0, 25)))) for i in range(400)]
    docs += [(1000 + i, docs[i][1]) for i in range(60)]
    ix = lexical.index(spark.createDataFrame(docs, "chunk_ord long, content string").repartition(3))
    texts = [(f"q{i}", " ".join(rng.choices([*words, "zz"], [*often, 0.3], k=rng.randint(0, 8)))) for i in range(150)]
    q = spark.createDataFrame(texts, "query_id string, text string").withColumn("bag", leaders.bag(F.col("text")))
    for k, of in ((7, ix), (50, ix), (3, lexical.index(spark.createDataFrame(docs[:2], "chunk_ord long, content string")))):
        want = {}
        for r in lexical.top(of, q, k).orderBy("bm25_rank").collect():
            want.setdefault(r["query_id"], []).append(r["chunk_ord"])
        assert {r["query_id"]: r["ords"] for r in q.join(leaders.top(of, q, k), "bag").collect()} == want
