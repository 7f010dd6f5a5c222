"""Files to pages. PDF text comes from a pluggable extractor; plain text and page tables need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.functions.text import page_text


class PageExtractor(Protocol):
    def __call__(self, content: bytes) -> list[str]:
        """Raw text of each page, in order."""


def pdf_pages(content: bytes) -> list[str]:
    """PDF text by pypdf, where that is installed."""
    import io

    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def plain_pages(content: bytes) -> list[str]:
    """Pages of plain text, parted by form feeds."""
    return content.decode("utf-8").split("\f")


def listing(spark: SparkSession, root: str, pattern: str = "*.pdf", max_files: int | None = None) -> DataFrame:
    """(source_path, size_bytes, modified_time): all files under root, the first max_files by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    out = files.select(F.col("path").alias("source_path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") / 1e6).alias("modified_time"))
    return out.orderBy("source_path").limit(max_files) if max_files else out


def pages(spark: SparkSession, root: str, wanted: DataFrame | None = None, extractor: Callable[[bytes], list[str]] = pdf_pages, pattern: str = "*.pdf", workers: int | None = None) -> DataFrame:
    """(source_path, page_num, text, error): cleaned pages, numbered from 1 before blank ones are dropped.

    A file that cannot be read gives one row with its error and no text. wanted: only these source_paths.
    workers: files are read by so many tasks at a time; by as many as Spark finds fit without it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select(F.col("path").alias("source_path"), "content")
    if wanted is not None:
        files = files.join(wanted.select("source_path"), "source_path", "left_semi")
    if workers:
        files = files.repartition(workers, "source_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(extractor(content), 1)]
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], ["source_path", "page_num", "text", "error"])

    raw = files.mapInArrow(run, "source_path string, page_num int, text string, error string")
    return cleaned(raw)


def cleaned(raw: DataFrame) -> DataFrame:
    """Page rows with normalised text; blank pages are dropped, error rows stay."""
    out = raw.withColumn("text", page_text(F.col("text")))
    return out.where((F.col("text") != "") | F.col("error").isNotNull()) if "error" in raw.columns else out.where(F.col("text") != "")
