"""Continuous ingest: new files reach the index through the same incremental build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lutrin.config import Settings
from lutrin.plans.build import build
from lutrin.sources.store import Store


def watch(spark: SparkSession, root: str, store: Store, pages: Callable[[DataFrame], DataFrame], checkpoint: str, settings: Settings = Settings(), pattern: str = "*.pdf", encoder=None) -> StreamingQuery:
    """Index files as they appear. Each micro-batch is a build over the known files and the batch's, so a
    batch that is delivered again changes nothing; deletions need a batch build of a full listing."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    seen = files.select(F.col("path").alias("source_path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") / 1e6).alias("modified_time"))

    def take(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        new = batch.dropDuplicates(["source_path"])
        known = store.table("manifest").select("source_path", "size_bytes", "modified_time").join(new, "source_path", "left_anti")
        build(store, known.unionByName(new), pages, settings, encoder=encoder)

    return seen.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
