import re

import pytest
from pyspark.sql import functions as F

from lutrin.config import Settings
from lutrin.functions import text as X
from lutrin.operators import chunking, families, spans

PAGES = "page_id long, source_path string, page_num int, text string"
REG = "R/Règlement/Pièces écrites/a.pdf"


def windows(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        piece = text[start : start + size]
        if piece.strip():
            out.append((start + len(piece) - len(piece.lstrip()), piece.strip()))
        if start + size >= len(text):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("hot_rows", [2_000_000, 1])
def test_windows_over_pages(spark, hot_rows):
    texts = ["alpha beta " * 9, "x" * 95, " y" * 3 + "z", "omega"]
    rows = [(i, "d/f.pdf", i + 1, t) for i, t in enumerate(texts)] + [(9, "d/f.pdf", 1, texts[0]), (10, "d/g.pdf", 3, "one"), (11, "d/g.pdf", 4, None), (12, None, 1, "q"), (13, "d/g.pdf", 5, "")]
    placed = spans.layout(spark.createDataFrame(rows, PAGES), hot_rows)
    got = spans.cut(placed, spans.windows(placed, 40, 10)).collect()
    whole = "\n".join(texts)
    assert sorted((r["off"], r["content"]) for r in got if r["source_path"] == "d/f.pdf") == sorted(windows(whole, 40, 10))
    assert [(r["off"], r["content"], r["page"]) for r in got if r["source_path"] == "d/g.pdf"] == [(0, "one", 3)]
    starts = [sum(len(t) + 1 for t in texts[:i]) for i in range(4)]
    for r in got:
        if r["source_path"] == "d/f.pdf":
            assert r["page"] == max(i + 1 for i, s in enumerate(starts) if s <= r["off"])


def test_articles_annexes_and_sections(spark):
    pages = [
        (1, REG, 1, "Preamble is lost. UG.3.1 Hauteur of things (UG.3.2 Plafond) and UG.3.1, 3. end UGSU.1.2\n"),
        (2, REG, 3, "Élévation text. N.1 Zone " + "w" * 50 + "\nA NNEXE V : LISTE des lieux\nLS 12-345 AB (Annexe IV) rest"),
        (3, "R/Règlement/Pièces écrites/b.pdf", 1, "no header here at all"),
    ]
    rows = chunking.raw_chunks(spark.createDataFrame(pages, PAGES), Settings(chunk_size=40, chunk_overlap=5)).orderBy("source_path", "s").collect()
    a = [r for r in rows if r["source_path"] == REG]
    text = pages[0][3] + "\n" + pages[1][3]
    heads = [m.start() for m in re.finditer(spans.ARTICLE, text)]
    assert min(r["s"] for r in a) == heads[0] and {r["section"] for r in a if not r["content"].startswith("[")} == {"UG.3.1", "UGSU.1.2", "N.1"}
    assert all(text[r["off"] :].startswith(r["content"]) for r in a if not r["content"].startswith("["))
    tail = [r for r in a if r["content"].startswith("[Section: A NNEXE V : LISTE des lieux]\n")]
    assert tail and all(r["page"] == 3 for r in tail) and [r["raw_idx"] for r in a] == list(range(len(a)))
    assert [(r["content"], r["section"]) for r in rows if r["source_path"].endswith("b.pdf")] == [("no header here at all", None)]


def test_headers_over_pages_without_a_reach(spark):
    """Headers that begin on one page and end far into the next, brackets on the page before, blank pages between."""
    texts = ["UG.1.1 Première règle (voir", "  \n ", "Annexe IV des lieux) puis\nA", " " * 900 + "NNEXE V : Liste", "fin du texte UG.2.1", "\n" * 700 + "Toiture plate (", "Annexe II est citée\nANNEXE VII :", "Titre"]
    rows = [(i, REG, i + 1, t) for i, t in enumerate(texts)]
    whole = "\n".join(texts)
    want = {(m.start(), m.group(1)) for m in re.finditer(spans.ARTICLE, whole)}
    want |= {(m.start(), m.group(0).strip()) for m in re.finditer(spans.ANNEXE, whole, re.I) if not whole[: m.start()].rstrip().endswith("(")}
    for hot_rows in (2_000_000, 1):
        got = {(r["pos"], r["title"]) for r in spans.headers(spans.layout(spark.createDataFrame(rows, PAGES), hot_rows, headed=True)).collect()}
        assert got == want and len(got) == 5


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        Settings(chunk_size=10, chunk_overlap=10)


def test_quality_families_and_names(spark):
    df = spark.createDataFrame([("12 34 56 78",), ("LS 12-345 99 11",), ("11e 12 rue de 99 88 77",), ("words here",), ("",)], "t string")
    kept = [r[0] for r in df.where(chunking.worth_keeping(F.col("t"), 0.55)).collect()]
    assert kept == ["LS 12-345 99 11", "11e 12 rue de 99 88 77", "words here"]
    paths = ["x/Règlement/Pièces écrites/OAP.pdf", "x/Règlement/Pièces écrites/n.pdf", "x/oap/a.pdf", "x/PADD/OAP/a.pdf", None]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(families.family(F.col("p"))).collect()]
    assert got == ["reglement_ecrit", "reglement_ecrit", "other", "oap", "other"]
    names = spark.createDataFrame([("a/b.c.pdf",), (".hidden",), ("x",)], "p string").select(X.stem(F.col("p"))).collect()
    assert [r[0] for r in names] == ["b.c", ".hidden", "x"]


def test_duplicates_and_ordinals(spark):
    rows = [("b", 0, "b-0", "same"), ("a", 2, "a-10", "same"), ("a", 1, "a-2", "other"), ("c", 0, "c-0", None), ("d", 0, "d-0", None)]
    df = spark.createDataFrame(rows, "source_path string, raw_idx long, chunk_id string, content string")
    one = chunking.distinct_contents(df)
    assert {r["chunk_id"] for r in one.collect()} == {"a-10", "a-2", "c-0"}
    assert [(r["chunk_ord"], r["chunk_id"]) for r in chunking.with_ordinal(df, 3).orderBy("chunk_ord").collect()] == [(0, "a-10"), (1, "a-2"), (2, "b-0"), (3, "c-0"), (4, "d-0")]


def test_text_functions(spark):
    f = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    assert f(X.page_text, "\xa0 a\t b \r\n\r\r\n\nc  ") == "a b\n\n• c"
    assert f(X.plain_markdown, "**a** *b*\n - c\nC:\\x\\y\\z.pdf") == "a b\n• c\nz.pdf"
    assert f(X.excerpted, " a \n b ") == "a b"
    assert len(f(X.excerpted, "word " * 200)) <= 500
    assert f(X.tokens, "L'Été ²_x 3½") == ["l", "été", "²_x", "3½"]
    assert {(t["term"], t["tf"]) for t in f(X.term_counts, "ab abc ab AB a")} == {("ab", 3), ("abc", 1), ("a", 1)}
    assert f(X.term_counts, "") == []
