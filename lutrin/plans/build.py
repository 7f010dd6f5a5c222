"""Incremental index builds."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lutrin.config import Settings
from lutrin.operators import chunking, dense, lexical
from lutrin.operators.families import RULES, family
from lutrin.operators.ledger import Fenced, Ledger
from lutrin.plans.scale import scratch, written
from lutrin.sources.store import Store, Version


def cache_plan(listed: DataFrame, manifest: DataFrame, stored: DataFrame, rebuild: bool = False, families: list[str] | None = None) -> DataFrame:
    """listed files with their manifest entry, the number of stored chunks, `forced` and `cached`.

    A file is cached if it is not forced, its size and time are those of the manifest and it has as many
    stored chunks as the manifest says; a file without chunks is cached at 0 = 0. A rebuild forces the
    given families, or all. Files that are not listed take no part.
    """
    m = manifest.dropDuplicates(["source_path"]).select("source_path", F.col("size_bytes").alias("m_size"), F.col("modified_time").alias("m_time"), F.col("chunk_count").alias("m_chunks"))
    counts = stored.groupBy("source_path").agg(F.count(F.lit(1)).alias("stored_chunks"))
    x = listed.join(m, "source_path", "left").join(counts, "source_path", "left").na.fill(0, ["stored_chunks"])
    forced = F.lit(False) if not rebuild else family(F.col("source_path")).isin(families) if families else F.lit(True)
    same = (F.col("size_bytes") == F.col("m_size")) & (F.col("modified_time") == F.col("m_time")) & (F.col("stored_chunks") == F.col("m_chunks"))
    return x.withColumn("forced", forced).withColumn("cached", ~F.col("forced") & F.coalesce(same, F.lit(False)))


def build(
    store: Store, listed: DataFrame, pages: Callable[[DataFrame], DataFrame], settings: Settings = Settings(), rebuild: bool = False,
    families: list[str] | None = None, encoder: Callable[[DataFrame], DataFrame] | None = None, progress: Callable[[str, int], None] | None = None, rules=RULES,
    lease: timedelta = timedelta(hours=1), clock: Callable[[], datetime] = datetime.now,
) -> tuple[int, int]:
    """Bring the index to the listed files; (files, chunks) of it.

    pages(files) gives the pages (source_path, page_num, text) of the files that must be read. Cached
    files keep their chunks; files that are no longer listed disappear. chunk_count is counted before
    duplicates are dropped. encoder(chunks) gives (chunk_ord, embedding), normalised here. progress is
    told the name and size of each finished part, and of each file that was read or kept with its chunks.

    The files are work items of the store's ledger: those to read are leased, and the index is published in
    the same step that marks them done. Files that another build has leased keep what is stored of them.
    The lease is renewed after every part. A build that fails gives its files back; one whose driver is lost
    leaves them to whoever comes after the deadline. A build that was too slow, or that another one
    overtook, publishes nothing (ledger.Fenced).
    """
    if families and not rebuild:
        raise ValueError("families need rebuild")
    ledger = Ledger(store)
    with scratch(store.spark):
        plan = written(cache_plan(listed, store.table("manifest"), store.table("chunks"), rebuild, families), "plan")
        ledger.observe(plan.select("source_path", "size_bytes", "modified_time", (~F.col("cached")).alias("force")), complete=True)
        items, token = ledger.lease(clock(), clock() + lease)
        try:
            held = written(items.select("source_path"), "held")
            return _built(store, ledger, plan, held, token, pages, settings, encoder, progress or (lambda *_: None), rules, lease, clock)
        except Fenced:
            raise
        except BaseException:
            ledger.release(token)
            raise


def _built(store, ledger, plan, held, token, pages, settings, encoder, tell, rules, lease, clock) -> tuple[int, int]:
    since = store.current()

    def done(part: str, size: int) -> None:
        ledger.renew(token, clock(), clock() + lease)
        tell(part, size)

    old, manifest = store.table("chunks", version=since), store.table("manifest", version=since)
    todo = plan.where("NOT cached").join(held, "source_path", "left_semi").select("source_path", "size_bytes", "modified_time")
    kept_files = plan.join(todo, "source_path", "left_anti").select("source_path")
    new = written(chunking.chunks(pages(todo), settings, rules), "new-chunks")
    done("new chunks", new.count())
    kept = old.join(kept_files, "source_path", "left_semi").select(*new.columns)
    everything = kept.unionByName(new)
    if everything.isEmpty():
        raise RuntimeError("no chunk in any file")
    counts = new.groupBy("source_path").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    fresh = todo.join(counts, "source_path", "left").na.fill(0, ["chunk_count"])
    manifest = written(manifest.join(kept_files, "source_path", "left_semi").unionByName(fresh), "manifest")
    chunks = written(chunking.with_ordinal(chunking.distinct_contents(everything)), "chunks")
    done("chunks", chunks.count())
    ix = lexical.index(chunks)
    tables = {"manifest": manifest.sort("source_path"), "chunks": chunks, "docs": ix.docs, "terms": ix.terms, "stats": ix.stats}
    if encoder:
        tables["vectors"] = encoder(chunks).select("chunk_ord", dense.normalized(F.col("embedding")).alias("embedding"))
    ledger.commit(held, token, clock(), tables, since)
    for r in manifest.join(todo.select("source_path", F.lit("processed").alias("how")), "source_path", "left").orderBy("source_path").toLocalIterator():
        tell(f"{r['how'] or 'cached'} {r['source_path']}", r["chunk_count"])
    tell("index", len(tables))
    store.tidy(age_seconds=max(lease.total_seconds(), 3600.0))
    return plan.count(), chunks.count()


def stored_index(store: Store, version: Version | None = None) -> lexical.LexicalIndex:
    version = version or store.current()
    return lexical.LexicalIndex(*[store.table(n, True, version) for n in ("docs", "terms", "stats")])


def patch_families(store: Store, rules=RULES) -> DataFrame:
    """Recompute doc_family of the stored chunks in a new version; families with their chunks before and after."""
    base = store.current()
    old = store.table("chunks", True, base)
    made = store.write({"chunks": old.withColumn("doc_family", family(F.col("source_path"), rules))}, base)
    count = lambda df, name: df.groupBy("doc_family").agg(F.count(F.lit(1)).alias(name))
    both = count(old, "before").join(count(store.table("chunks", True, made), "after"), "doc_family", "full_outer")
    return both.na.fill(0, ["before", "after"]).orderBy("doc_family")
