"""The retrieval engine's operators as queries over the project tables, with the SQL that says the same.

Searches take as queries every golden question whose number is divisible by 20 (eval_compare all), against all chunks; a
question's vector is the embedding of its number, a chunk's that of its ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lutrin.config import Settings
from lutrin.functions import text as X
from lutrin.operators import chunking, dense, families, lexical, reports, spans
from lutrin.operators.ledger import Ledger
from lutrin.plans.build import build, cache_plan, patch_families, stored_index
from lutrin.plans.scale import own_folder, written
from lutrin.plans.search import Searcher
from lutrin.sources.store import Store

DEFAULT = Settings()


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "doc_pages").select("page_id", "source_path", "page_num", "text")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "chunks")


def _number(c):
    return F.regexp_extract(c, r"(\d+)$", 1).cast("long")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    g = _t(spark, sf, "golden").where(_number(F.col("id")) % 20 == 0)
    v = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    return g.join(v, _number(F.col("id")) == F.col("v"), "left").select(F.col("id").alias("query_id"), F.col("question").alias("text"), "embedding", "expected_keywords")


def _searcher(spark: SparkSession, sf: str) -> Searcher:
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_ord"), "embedding")
    chunks = _chunks(spark, sf).select("chunk_ord", "chunk_id", "source_path", "doc_family", "content", "page", "section")
    # Vectors without a chunk belong to no document.
    return Searcher(chunks, vectors.join(chunks.select("chunk_ord"), "chunk_ord", "left_semi"))


# --- pages and projections ---------------------------------------------------------------------------

def family_inference(spark, sf):
    return _chunks(spark, sf).where("source_path IS NOT NULL").select("source_path").distinct().select("source_path", families.family(F.col("source_path")).alias("family"))


def family_counts(spark, sf):
    return _chunks(spark, sf).groupBy("doc_family").agg(F.count(F.lit(1)).alias("n"))


def listing_limit(spark, sf):
    """SRC-12: the first 25 files by path (max_files)."""
    return _t(spark, sf, "listing").select("source_path").distinct().orderBy("source_path").limit(25)


def text_normalize(spark, sf):
    """Private-use glyphs and white space, on contents with such characters put in."""
    dirty = F.concat(F.lit("  \uf0b7"), F.replace(F.coalesce("content", F.lit("")), F.lit(" "), F.lit(" \t ")), F.lit("\r\n\r\n\r\r x"))
    return _chunks(spark, sf).select("chunk_ord", F.md5(X.page_text(dirty)).alias("h"))


def page_drop(spark, sf):
    """FLT-1: pages that are left after cleaning, with their numbers."""
    return _pages(spark, sf).withColumn("text", X.page_text(F.col("text"))).where("text <> ''").select("page_id", "page_num", F.length("text").cast("long").alias("n"))


def page_offsets(spark, sf):
    return spans.layout(_pages(spark, sf)).select("source_path", "page_num", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"))


def alpha_ratio(spark, sf):
    return _chunks(spark, sf).where("content IS NOT NULL").select("chunk_ord", F.round(X.alpha_ratio(F.col("content")), 9).alias("ratio"))


def quality_filter(spark, sf):
    c = F.col("content")
    rows = _chunks(spark, sf).where("content IS NOT NULL")
    return rows.where(chunking.worth_keeping(c, DEFAULT.min_alpha_ratio)).select("chunk_ord", c.rlike(chunking.TABLE_ROW).alias("table_row"), c.rlike(chunking.ADDRESS_ROW).alias("address_row"))


def chunk_ids(spark, sf):
    rows = _chunks(spark, sf).where("source_path IS NOT NULL").select("source_path", "chunk_ord").dropDuplicates(["source_path", "chunk_ord"])
    return chunking.numbered(rows, "chunk_ord").select("chunk_ord", F.concat(X.stem(F.col("source_path")), F.lit("-"), F.col("raw_idx")).alias("chunk_id"))


def inspect_chunks(spark, sf):
    return _chunks(spark, sf).where(X.basename(F.col("source_path")) == "reglement_general_valmorane.pdf").select("chunk_ord", "chunk_id", F.substring("content", 1, 300).alias("head"))


# --- chunking ------------------------------------------------------------------------------------------

def window_chunks(spark, sf):
    """Sliding windows over the joined pages of every file, with the page each begins on."""
    placed = spans.layout(_pages(spark, sf))
    cut = spans.cut(placed, spans.windows(placed, DEFAULT.chunk_size, DEFAULT.chunk_overlap))
    return cut.select("source_path", F.col("off").cast("long").alias("off"), F.md5("content").alias("h"), F.col("page").cast("int").alias("page"))


def fixed_chunks(spark, sf):
    """Fixed-size pieces without overlap of all documents, each a file of one page."""
    pages = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_path"), F.lit(1).alias("page_num"), "text")
    placed = spans.layout(pages)
    cut = spans.cut(placed, spans.windows(placed, DEFAULT.chunk_size, 0))
    return cut.select(F.col("source_path").cast("long").alias("doc_id"), F.col("off").cast("long").alias("off"), F.md5("content").alias("h"))


def article_codes(spark, sf):
    heads = spans.headers(spans.layout(_pages(spark, sf), headed=True)).where("article")
    return heads.select("source_path", F.col("pos").cast("long").alias("pos"), F.col("title").alias("code"))


def _annexed(spark, sf):
    """The pages with annexe headers, some of them over a page's end, and references in brackets put in."""
    n = F.col("page_num")
    end = F.when(n % 5 == 1, " (voir (").when(n % 3 == 0, "\nA NNEXE IV :").when(n % 7 == 4, "\nANNEXE X : " + "Liste des terrains " * 9).otherwise("")
    return _pages(spark, sf).where("text <> ''").withColumn("text", F.concat(F.when(n % 5 == 2, "Annexe VI des lieux ").otherwise(""), "text", end))


def annexe_headers(spark, sf):
    """Annexe headers of the joined pages, without references in brackets."""
    heads = spans.headers(spans.layout(_annexed(spark, sf), headed=True)).where("NOT article")
    return heads.select("source_path", F.col("pos").cast("long").alias("pos"), "title")


def article_chunks(spark, sf):
    placed = spans.layout(_pages(spark, sf), headed=True)
    cut = spans.cut(placed, spans.articles(placed, written(spans.headers(placed), "heads"), DEFAULT.chunk_size))
    return cut.select("source_path", F.col("off").cast("long").alias("off"), "code", F.md5("content").alias("h"), F.col("page").cast("int").alias("page"))


def _corpus(pages):
    cleaned = pages.withColumn("text", X.page_text(F.col("text"))).where("text <> ''")
    made = chunking.distinct_contents(chunking.chunks(cleaned))
    return chunking.with_ordinal(made).select("chunk_ord", "chunk_id", "source_path", "doc_family", "page", "section", F.md5("content").alias("h"))


def corpus_chunks(spark, sf):
    """GEN-10: all pages to chunks with id, family, page and section, without their duplicates."""
    return _corpus(_pages(spark, sf))


def annexe_chunks(spark, sf):
    """GEN-10 with annexes: sections and prefixes of chunks under articles and annexes."""
    return _corpus(_annexed(spark, sf))


def dedup_chunks(spark, sf):
    rows = _chunks(spark, sf).select("source_path", "chunk_ord", "content")
    return chunking.distinct_contents(rows, ("source_path", "chunk_ord")).select("chunk_ord")


def corpus_ordinal(spark, sf):
    rows = _chunks(spark, sf).where("source_path IS NOT NULL").groupBy("source_path", "chunk_id").agg(F.count(F.lit(1)).alias("rows"))
    return chunking.with_ordinal(rows).select("source_path", "chunk_id", F.col("chunk_ord").cast("long").alias("ordinal"))


def section_prefix(spark, sf):
    """Section line of chunks under an annexe; titles of over 100 characters are cut."""
    title = F.concat("section", F.lit(" : "), F.repeat(F.col("section"), 20))
    rows = _chunks(spark, sf).where("section IS NOT NULL AND content IS NOT NULL").select(
        "chunk_ord", "content", F.lit(-1).alias("article_pos"), F.lit(None).cast("string").alias("code"), F.struct(F.lit(0).alias("pos"), F.when(F.col("chunk_ord") % 2 == 0, title).otherwise(F.col("section")).alias("title")).alias("annexe"))
    return chunking.under_section(rows).select("chunk_ord", F.col("section").alias("short"), F.md5("content").alias("h"))


# --- catalogue ----------------------------------------------------------------------------------------

def _last_listing(spark, sf):
    listing = _t(spark, sf, "listing")
    last = listing.agg(F.max("run_id").alias("run_id"))
    return listing.join(F.broadcast(last), "run_id", "left_semi").groupBy("source_path").agg(F.max("size_bytes").alias("size_bytes"), F.max("modified_time").alias("modified_time"))  # one row


def _plan(spark, sf, rebuild, families_):
    plan = cache_plan(_last_listing(spark, sf), _t(spark, sf, "manifest"), _chunks(spark, sf), rebuild, families_)
    return plan.select("source_path", F.col("stored_chunks").cast("long").alias("stored_chunks"), "forced", "cached")


def cache_plan_(spark, sf):
    return _plan(spark, sf, False, None)


def rebuild_plan(spark, sf):
    return _plan(spark, sf, True, ["annexes"])


def files_to_process(spark, sf):
    """Files of the last listing that no unchanged manifest row covers (anti join), whatever their chunks."""
    m = _t(spark, sf, "manifest")
    return _last_listing(spark, sf).join(m, ["source_path", "size_bytes", "modified_time"], "left_anti").select("source_path")


def chunk_counts(spark, sf):
    """Chunks of every listed file, 0 where it has none."""
    counts = _chunks(spark, sf).groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    return _last_listing(spark, sf).join(counts, "source_path", "left").select("source_path", F.coalesce("n", F.lit(0)).alias("n"))


def union_cached_processed(spark, sf):
    """Cached chunks and pages' own rows as one list, by origin."""
    plan = cache_plan(_last_listing(spark, sf), _t(spark, sf, "manifest"), _chunks(spark, sf))
    hit, todo = plan.where("cached"), plan.where("NOT cached")
    a = _chunks(spark, sf).join(hit, "source_path", "left_semi").select("source_path", F.lit("cached").alias("origin"))
    b = _pages(spark, sf).join(todo, "source_path", "left_semi").select("source_path", F.lit("processed").alias("origin"))
    return a.unionByName(b).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_path").alias("files"))


# --- the stored index ----------------------------------------------------------------------------------

def _built(spark, sf) -> Store:
    """An index of all pages, built in two steps: half of the files, then all, of which that half is cached."""
    pages = written(_pages(spark, sf).withColumn("text", X.page_text(F.col("text"))).where("text <> '' AND source_path IS NOT NULL"), "build-pages")
    listed = pages.groupBy("source_path").agg(F.sum(F.length("text")).alias("size_bytes"), F.lit(1.0).alias("modified_time"))
    store = Store(spark, own_folder(spark, "index"))
    read = lambda wanted: pages.join(wanted, "source_path", "left_semi")
    half = listed.where(F.pmod(F.crc32("source_path"), F.lit(2)) == 0)
    if not half.isEmpty():
        build(store, half, read)
    build(store, listed, read)
    return store


def build_chunks(spark, sf):
    """BLD-1, SNK-1: chunks of an index that was built in two steps."""
    return _built(spark, sf).table("chunks", True).select("chunk_ord", "chunk_id", "source_path", "doc_family", "page", "section", F.md5("content").alias("h"))


def build_manifest(spark, sf):
    """SNK-2: the manifest of that index; chunks are counted before duplicates are dropped."""
    return _built(spark, sf).table("manifest", True).select("source_path", "size_bytes", "modified_time", F.col("chunk_count").cast("long").alias("chunk_count"))


def build_ledger(spark, sf):
    """Work items of that index: every file done at its size."""
    return Ledger(_built(spark, sf)).items().select("source_path", "state", F.col("done.size_bytes").alias("done_size"))


def stored_search(spark, sf):
    """SRC-7, SNK-3, SNK-4: hybrid search on an index that was written and read again."""
    chunks = _chunks(spark, sf).select("chunk_ord", "chunk_id", "source_path", "doc_family", "content", "page", "section")
    ix, store = lexical.index(chunks), Store(spark, own_folder(spark, "index"))
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_ord"), dense.normalized(F.col("embedding")).alias("embedding"))
    store.write({"chunks": chunks, "docs": ix.docs, "terms": ix.terms, "stats": ix.stats, "vectors": vectors.join(chunks.select("chunk_ord"), "chunk_ord", "left_semi")})
    searcher = Searcher(store.table("chunks", True), store.table("vectors", True), DEFAULT, stored_index(store))
    return _shown(searcher.search(_questions(spark, sf), 5))


def patched_families(spark, sf):
    """BLD-2, SNK-5, AGG-6: chunks of each family before and after a patch to other rules."""
    store = Store(spark, own_folder(spark, "index"))
    store.write({"chunks": _chunks(spark, sf).where("source_path IS NOT NULL").select("chunk_ord", "source_path", "doc_family", "content")})
    return patch_families(store, (("Annexes", "annexes"), ("pdf", "files")))


# --- lexical and dense legs ----------------------------------------------------------------------------

def term_frequency(spark, sf):
    return lexical.index(_chunks(spark, sf)).postings.select("chunk_ord", "term", F.col("tf").cast("long").alias("tf"))


def document_frequency(spark, sf):
    return lexical.index(_chunks(spark, sf)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def doc_length(spark, sf):
    return lexical.index(_chunks(spark, sf)).lengths


def corpus_stats(spark, sf):
    return lexical.index(_chunks(spark, sf)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_scores(spark, sf):
    return lexical.scores(lexical.index(_chunks(spark, sf)), _questions(spark, sf)).select("query_id", "chunk_ord", F.round("bm25_score", 6).alias("bm25_score"))


def bm25_topk(spark, sf):
    chunks, q = _chunks(spark, sf), _questions(spark, sf)
    return lexical.top(lexical.index(chunks), q, 10).select("query_id", "chunk_ord", F.round("bm25_score", 6).alias("bm25_score"), "bm25_rank")


def vector_normalize(spark, sf):
    v = F.transform("embedding", lambda x: (x * 3).cast("float"))
    return _t(spark, sf, "embeddings").select("vec_id", F.round(dense.inner(dense.normalized(v), F.col("embedding")), 5).alias("cosine"))


def dense_topk(spark, sf):
    e = _t(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.top(e.select(F.col("vec_id").alias("chunk_ord"), "embedding"), q, 10).select("query_id", "chunk_ord", F.round("dense_score", 6).alias("dense_score"), "dense_rank")


# --- search --------------------------------------------------------------------------------------------

def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_ord", "rank", F.round("score", 9).alias("score"), "source_path", F.md5(F.coalesce("content", F.lit(""))).alias("h"), F.coalesce("page", F.lit(-1)).alias("page"))


def hybrid_search(spark, sf):
    return _shown(_searcher(spark, sf).search(_questions(spark, sf), 5))


def hybrid_search_family(spark, sf):
    return _shown(_searcher(spark, sf).search(_questions(spark, sf), 5, ["annexes", "padd"]))


def hybrid_search_debug(spark, sf):
    hits = _searcher(spark, sf).search(_questions(spark, sf), 5)
    # A leg that did not find the chunk shows as -1.
    none = lambda c: F.coalesce(c, F.lit(-1)).alias
    return hits.select("query_id", "rank", *[none(F.round(c, 6))(c) for c in ("dense_score", "bm25_score")], *[none(F.col(c))(c) for c in ("dense_rank", "bm25_rank")])


def _expanded(spark, sf):
    q = _questions(spark, sf)
    return q.select("query_id", "text", "embedding", F.array_join("expected_keywords", " ").alias("expansion"), F.col("embedding").alias("expansion_embedding"))


def weighted_search(spark, sf):
    """The question weighted 0.7 against its expected keywords; questions without keywords are searched plainly."""
    return _shown(_searcher(spark, sf).search_weighted(_expanded(spark, sf), 5, 0.7))


# --- reports -------------------------------------------------------------------------------------------

def _lead(spark, sf, score="score", k=5):
    """The k best logged hits of each query, with the whole contents of their chunks."""
    texts = _chunks(spark, sf).select("chunk_ord", F.coalesce("content", F.lit("")).alias("content"))
    return reports.leading_hits(_t(spark, sf, "hits"), score, k).drop("content").join(texts, "chunk_ord")


def hit_passages(spark, sf):
    return reports.passages(_lead(spark, sf)).select("query_id", F.md5("passages").alias("h"))


def prompt_context(spark, sf):
    g = _t(spark, sf, "golden").select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    return reports.prompts(_lead(spark, sf), g).select("query_id", F.md5("user").alias("h"))


def citation_rows(spark, sf):
    c = reports.citations(_lead(spark, sf))
    c = c.select("query_id", F.explode("citations").alias("c"))
    return c.select("query_id", "c.rank", "c.source", "c.full_path", "c.family", F.md5("c.excerpt").alias("excerpt"), F.coalesce("c.page", F.lit(-1)).alias("page"), "c.section")


def debug_rows(spark, sf):
    rows = _lead(spark, sf).withColumn("dense_score", F.col("faiss_score"))
    return rows.select("query_id", "rank", reports.debug_line().alias("line"))


def excerpts(spark, sf):
    """At most 500 characters of whole words of every document."""
    return _t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", X.excerpted(F.col("text")).alias("excerpt"))


def markdown_strip(spark, sf):
    t = F.concat(F.lit("**"), F.col("lang"), F.lit("** *x*\n - "), F.col("text"), F.lit("\n* C:\\docs\\plu\\REG1.pdf *fin"))
    return _t(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.md5(X.plain_markdown(t)).alias("h"))


def expansion_parse(spark, sf):
    raw = F.concat(F.lit("Codes : "), F.to_json("expected_articles"), F.when(F.length("question") % 3 == 0, F.lit("] fin [")).when(F.length("question") % 3 == 1, F.lit(".")).otherwise(F.lit("")))
    return _t(spark, sf, "golden").select("id", F.array_join(reports.bracketed_strings(raw), "|").alias("codes"))


def output_parts(spark, sf):
    """EVL-3: stored outputs taken apart again into passages, answer, expansion and codes."""
    g = _t(spark, sf, "golden").join(reports.passages(_lead(spark, sf)), F.col("id") == F.col("query_id")).drop("query_id")
    n = F.length("question") % 4
    head = F.when(n == 1, F.concat(F.lit(reports.CODES_MARK), F.to_json("expected_keywords"), F.lit("\n"), F.lit(reports.EXPANSION_MARK), F.array_join("expected_keywords", " "), F.lit("\n\n"))).otherwise("")
    tail = F.when(n != 2, F.concat(F.lit("\n\n" + reports.ANSWER_MARK + "\n\n"), F.coalesce("expected_answer_summary", F.lit("")), F.lit("\n"))).otherwise("")
    raw = F.when(n == 3, F.col("passages")).otherwise(F.concat(head, F.lit(reports.PASSAGES_MARK + "\n\n"), "passages", tail))
    p = reports.output_parts(raw)
    return g.select("id", p.alias("p")).select("id", F.md5("p.passages").alias("passages"), "p.answer", "p.expansion", F.array_join("p.codes", "|").alias("codes"))


def _golden(spark, sf):
    """Cases whose questions are searched."""
    return _t(spark, sf, "golden").where(_number(F.col("id")) % 20 == 0)


def _cases(spark, sf, hits):
    shown = reports.passages(hits.withColumn("content", F.coalesce("content", F.lit(""))))
    g = _golden(spark, sf).join(shown, F.col("id") == F.col("query_id"), "left").drop("query_id")
    return reports.scored(g.withColumn("answer", F.col("expected_answer_summary")).withColumn("error", F.lit(None).cast("string")))


def _searched_cases(spark, sf):
    return _cases(spark, sf, _searcher(spark, sf).search(_questions(spark, sf), 5))


def golden_scores(spark, sf):
    """Scores of the golden questions' searches and of their reference answers."""
    c = _searched_cases(spark, sf)
    return c.select("id", "retrieval_score", "answer_score", F.array_join("missing_articles", "|").alias("missing_articles"), F.array_join("missing_keywords", "|").alias("missing_keywords"))


def eval_summary(spark, sf):
    c = _searched_cases(spark, sf).withColumn("complexity", F.lower("complexity"))
    return c.groupBy("complexity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("retrieval_score"), 6).alias("retrieval"), F.round(F.avg("answer_score"), 6).alias("answer"))


def eval_compare(spark, sf):
    """Retrieval with expanded questions at two weights against the plain search, for all golden questions."""
    golden = _t(spark, sf, "golden").where("id IS NOT NULL")
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    number = F.regexp_extract("id", r"(\d+)$", 1).try_cast("long")
    asked = golden.join(vectors, number == F.col("v"), "left").select(
        F.col("id").alias("query_id"), F.col("expected_articles").alias("carried"), F.col("question").alias("text"), F.array_join("expected_keywords", " ").alias("expansion"), "embedding")
    searcher = _searcher(spark, sf)
    hits = written(searcher.runs(asked, 5, {"plain": None, "alpha=0.7": 0.7, "alpha=0.5": 0.5}), "run-hits")
    runs = written(reports.retrieval_scores(golden, hits, searcher.chunks), "runs")
    return reports.compared(runs, "plain").select("run", "id", "retrieval_score", "delta", "arrow")


def score_bands(spark, sf):
    c = _searched_cases(spark, sf)
    return c.select("id", X.band(F.col("answer_score")).alias("band"), X.bar(F.col("answer_score")).alias("bar"), X.abbreviated(F.col("question"), 52).alias("short"))


def prefix_sizes(spark, sf):
    """WIN-3 on hits: running number of logged hits of each query by rank of their id."""
    w = W.partitionBy("query_id").orderBy("hit_id").rowsBetween(W.unboundedPreceding, -1)
    return _t(spark, sf, "hits").select("hit_id", F.coalesce(F.sum(F.length("content").cast("long")).over(w), F.lit(0)).alias("before"))


QUERIES = {
    "bm25_topk": bm25_topk, "family_inference": family_inference, "family_counts": family_counts, "listing_limit": listing_limit, "text_normalize": text_normalize,
    "page_drop": page_drop, "page_offsets": page_offsets, "alpha_ratio": alpha_ratio, "quality_filter": quality_filter, "chunk_ids": chunk_ids, "inspect_chunks": inspect_chunks,
    "window_chunks": window_chunks, "fixed_chunks": fixed_chunks, "article_codes": article_codes, "annexe_headers": annexe_headers, "article_chunks": article_chunks, "corpus_chunks": corpus_chunks, "annexe_chunks": annexe_chunks,
    "build_chunks": build_chunks, "build_manifest": build_manifest, "build_ledger": build_ledger, "stored_search": stored_search, "patched_families": patched_families,
    "dedup_chunks": dedup_chunks, "corpus_ordinal": corpus_ordinal, "section_prefix": section_prefix, "cache_plan": cache_plan_, "rebuild_plan": rebuild_plan,
    "files_to_process": files_to_process, "chunk_counts": chunk_counts, "union_cached_processed": union_cached_processed, "term_frequency": term_frequency,
    "document_frequency": document_frequency, "doc_length": doc_length, "corpus_stats": corpus_stats, "bm25_scores": bm25_scores, "vector_normalize": vector_normalize,
    "dense_topk": dense_topk, "hybrid_search": hybrid_search, "hybrid_search_family": hybrid_search_family, "hybrid_search_debug": hybrid_search_debug,
    "weighted_search": weighted_search, "hit_passages": hit_passages, "prompt_context": prompt_context, "citation_rows": citation_rows, "debug_rows": debug_rows,
    "excerpts": excerpts, "markdown_strip": markdown_strip, "expansion_parse": expansion_parse, "golden_scores": golden_scores, "eval_summary": eval_summary,
    "eval_compare": eval_compare, "score_bands": score_bands, "output_parts": output_parts, "prefix_sizes": prefix_sizes,
}
