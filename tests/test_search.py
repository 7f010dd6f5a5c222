import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lutrin.operators import dense, fusion, lexical, reports
from lutrin.plans.search import Searcher

Q = "query_id string, text string"


def bm25(docs, query):
    toks = {i: d.split() for i, d in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {t: sum(t in x for x in toks.values()) for x in toks.values() for t in x}
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    return {i: sum(idf.get(t, 0) * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in query.split()) for i, x in toks.items()}


def test_bm25_with_repeats_unknown_words_and_zero_fill(spark):
    docs = {0: "a b b c", 1: "a c d", 2: "a e", 3: "f g h i"}
    chunks = spark.createDataFrame(list(docs.items()), "chunk_ord long, content string")
    queries = spark.createDataFrame([("q1", "b b a zz"), ("q2", "zz"), ("q3", None)], Q)
    ix = lexical.index(chunks)
    rows = lexical.top(ix, queries, 3).collect()
    want = bm25(docs, "b b a zz")
    order = sorted(docs, key=lambda i: (-round(want[i], 9), -i))[:3]
    assert [r["chunk_ord"] for r in sorted((r for r in rows if r["query_id"] == "q1"), key=lambda r: r["bm25_rank"])] == order
    for r in rows:
        if r["query_id"] == "q1":
            assert abs(r["bm25_score"] - want[r["chunk_ord"]]) < 1e-9
        else:
            assert r["bm25_score"] == 0
    assert [r["chunk_ord"] for r in sorted((r for r in rows if r["query_id"] == "q2"), key=lambda r: r["bm25_rank"])] == [3, 2, 1]
    some = lexical.scores(ix, queries).collect()
    assert {(r["query_id"], r["chunk_ord"]): round(r["bm25_score"], 9) for r in some} == {("q1", i): round(want[i], 9) for i in (0, 1, 2)}
    assert lexical.top(ix, queries.limit(0), 3).count() == 0
    empty = lexical.index(chunks.limit(0))
    assert lexical.top(empty, queries, 3).count() == 0


def test_blocks_of_queries_and_cells_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 12)))) for i in range(80)]
    ix = lexical.index(spark.createDataFrame(docs, "chunk_ord long, content string"))
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choices("abcdefghijxyz", k=3))) for i in range(11)], Q)
    run = lambda: ({tuple(r) for r in lexical.top(ix, queries, 7).collect()}, {tuple(r) for r in lexical.scores(ix, queries).collect()})
    want = run()
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)
    monkeypatch.setattr(lexical, "CELLS", 25)
    assert run() == want and len(want[0]) == 77


@pytest.mark.parametrize("bytes_", [64 << 20, 64])
def test_dense_top_is_brute_force(spark, monkeypatch, bytes_):
    monkeypatch.setattr(dense, "QUERY_BYTES", bytes_)
    rng = np.random.default_rng(0)
    vs = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vs)] + [(99, None), (98, [1.0])]
    df = spark.createDataFrame(rows, "chunk_ord long, embedding array<float>")
    q = spark.createDataFrame([(f"q{i}", rows[i][1]) for i in range(3)] + [("none", None)], "query_id string, embedding array<float>")
    got = dense.top(df, q, 5).collect()
    for i in range(3):
        s = np.round(vs.astype(np.float64) @ vs[i].astype(np.float64), 9)
        want = sorted(range(60), key=lambda j: (-s[j], j))[:5]
        assert [r["chunk_ord"] for r in sorted((r for r in got if r["query_id"] == f"q{i}"), key=lambda r: r["dense_rank"])] == want
    assert not [r for r in got if r["query_id"] == "none"]
    n = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(dense.normalized(F.col("v")).alias("v")).collect()
    assert [[round(x, 6) for x in r["v"]] for r in n] == [[0.6, 0.8], [0.0, 0.0]]


def test_fusion_ties_and_weights(spark):
    d = spark.createDataFrame([("q", 1, 0.9, 1), ("q", 2, 0.8, 2)], "query_id string, chunk_ord long, dense_score double, dense_rank int")
    b = spark.createDataFrame([("q", 3, 5.0, 1), ("q", 2, 4.0, 2)], "query_id string, chunk_ord long, bm25_score double, bm25_rank int")
    fused = fusion.reciprocal(d, b)
    best = [r["chunk_ord"] for r in fusion.best(fused, "rrf", 3).orderBy("rank").collect()]
    assert best == [2, 1, 3]  # both legs; then the dense hit before the lexical one of the same rank
    for a in (0.0, 0.5, 1.0):
        w = {r["chunk_ord"]: r["combined"] for r in fusion.weighted(fused.where("chunk_ord < 3"), fused.where("chunk_ord > 1"), a).collect()}
        assert abs(w[1] - a / 61) < 1e-12 and abs(w[3] - (1 - a) / 61) < 1e-12 and abs(w[2] - 2 / 62) < 1e-12


def test_batch_search_is_single_search(spark):
    rng = random.Random(3)
    words = "sol mur toit rue parc eau bois zinc".split()
    rows = [(i, f"f{i % 3}.pdf", "annexes" if i % 4 == 0 else "padd", " ".join(rng.choices(words, k=9)), i % 5, None) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_ord long, source_path string, doc_family string, content string, page int, section string")
    vec = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(30)], "chunk_ord long, embedding array<float>")
    qs = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=2)), [rng.random() for _ in range(4)], "" if i else "bois zinc", None) for i in range(2)], "query_id string, text string, embedding array<float>, expansion string, expansion_embedding array<float>")
    s = Searcher(chunks, vec)
    key = lambda df: {(r["query_id"], r["rank"], r["chunk_ord"], round(r["score"], 12)) for r in df.collect()}
    both = key(s.search(qs, 2))
    assert both == key(s.search(qs.where("query_id = 'q0'"), 2)) | key(s.search(qs.where("query_id = 'q1'"), 2)) and len(both) == 4
    assert all(0 < x[3] <= 2 / 61 for x in both)
    assert {r["doc_family"] for r in s.search(qs, 2, ["annexes"]).collect()} == {"annexes"}
    assert s.search(qs, 2, ["nowhere"]).count() == 0
    w = s.search_weighted(qs, 2, 0.5)
    assert {x for x in key(w) if x[0] == "q1"} == {x for x in both if x[0] == "q1"}


def test_reports(spark):
    raw = ['x ["UG.1", " ", 3, "N.2"] y', "none", "] [", "[1,", '[{"a": [1]}]', None, '["a"]']
    df = spark.createDataFrame([(t,) for t in raw], "t string")
    assert [r[0] for r in df.select(reports.bracketed_strings(F.col("t"))).collect()] == [["UG.1", "N.2"], [], [], [], [], [], ["a"]]
    cases = spark.createDataFrame(
        [("1", ["UG.3.1", "N.9"], ["Mur"], "see ug.3.10", "le mur", None), ("2", [], None, "", None, None), ("3", ["a"], [], "a", "a", "late")],
        "id string, expected_articles array<string>, expected_keywords array<string>, passages string, answer string, error string")
    got = {r["id"]: (r["retrieval_score"], r["answer_score"], r["missing_articles"]) for r in reports.scored(cases).collect()}
    assert got == {"1": (0.5, 1.0, ["N.9"]), "2": (1.0, 1.0, []), "3": (0.0, 0.0, ["a"])}
    runs = spark.createDataFrame([("base", "1", 0.5), ("base", "2", 1.0), ("new", "1", 0.75)], "run string, id string, retrieval_score double")
    assert {(r["run"], r["id"], r["delta"], r["arrow"]) for r in reports.compared(runs, "base").collect()} == {("base", "1", 0.0, "="), ("base", "2", 0.0, "="), ("new", "1", 0.25, "↑"), ("new", "2", -1.0, "↓")}
