"""The index directory: immutable tables, and versions that say which of them are current.

A version is one small file, `NNNNNNNNN.version`, that maps table names to directories. Publishing it is the
only commit and a single atomic step that fails if the number is taken, so of two writers that read the same
version one wins and the other learns of it. A writer that dies before leaves directories that no version
names; nothing has to be undone and nothing stays locked.

On a local or mounted folder the step is a hard link, elsewhere a rename without overwriting, which must be
atomic (HDFS). Plain object stores give no such step: there the version files need a folder that does.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "manifest": "source_path string, size_bytes long, modified_time double, chunk_count int",
    "chunks": "chunk_ord long, chunk_id string, source_path string, doc_family string, content string, page int, section string, raw_idx long",
    "ledger": (
        "source_path string, item struct<size_bytes: bigint, modified_time: double, state: string, token: bigint, "
        "lease_until: timestamp, done: struct<size_bytes: bigint, modified_time: double>>"
    ),
}
SUFFIX = ".version"


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    tables: dict[str, str] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs

    def _fs(self):
        return self.hadoop.Path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.folder}/{name}")

    def _local(self) -> str | None:
        """The folder as a local path, if it is one."""
        uri = self._fs().makeQualified(self.hadoop.Path(self.folder)).toString()
        return unquote(urlparse(uri).path) if uri.startswith("file:") else None

    def numbers(self) -> list[int]:
        fs, root = self._fs(), self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removesuffix(SUFFIX)) for n in names if n.endswith(SUFFIX))

    def version(self, number: int) -> Version:
        stream = self._fs().open(self._path(f"{number:09d}{SUFFIX}"))
        try:
            return Version(number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def current(self) -> Version:
        """The newest version; number 0 without tables before the first."""
        known = self.numbers()
        return self.version(known[-1]) if known else Version()

    def table(self, name: str, required: bool = False, version: Version | None = None) -> DataFrame:
        """A table of a version (the current one); empty where there is none yet, an error if it is required."""
        version = version or self.current()
        if name not in version.tables:
            if required or name not in SCHEMAS:
                raise FileNotFoundError(f"no index table {name} under {self.folder}: run ingest first")
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.parquet(f"{self.folder}/{version.tables[name]}")

    def write(self, tables: dict[str, DataFrame], base: Version | None = None, whole: bool = False) -> Version:
        """Publish the version after `base` (the one the tables were made from; the current one if none is
        given) with these tables; base's other tables stay unless the version is whole. Conflict if another
        writer published after base."""
        base = base or self.current()
        mark = uuid.uuid4().hex[:12]
        names = {name: f"{base.number + 1:09d}-{mark}/{name}" for name in tables}
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{self.folder}/{names[name]}")
        made = Version(base.number + 1, names if whole else {**base.tables, **names})
        self._publish(made)
        return made

    def _publish(self, version: Version) -> None:
        name, temporary, data = f"{version.number:09d}{SUFFIX}", f".{uuid.uuid4().hex}.tmp", json.dumps(version.tables)
        if folder := self._local():
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/{temporary}", "w", encoding="utf-8") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(f"{folder}/{temporary}", f"{folder}/{name}")
            except FileExistsError:
                raise Conflict(f"version {version.number} of {self.folder} is taken") from None
            finally:
                os.unlink(f"{folder}/{temporary}")
            return
        self._publish_by_rename(name, temporary, data, version.number)

    def _publish_by_rename(self, name: str, temporary: str, data: str, number: int) -> None:
        out = self._fs().create(self._path(temporary), False)
        try:
            out.write(bytearray(data, "utf-8"))
        finally:
            out.close()
        option = self.hadoop.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.NONE
        context = self.hadoop.FileContext.getFileContext(self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(temporary), self._path(name), options)
        except Py4JJavaError as e:
            self._fs().delete(self._path(temporary), False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {number} of {self.folder} is taken") from None
            raise

    def tidy(self, keep: int = 3, age_seconds: float = 86_400) -> list[str]:
        """Delete the directories that none of the last `keep` versions names, and older version files; what
        is younger than `age_seconds` may belong to a writer at work and stays. Names of what was deleted."""
        known = self.numbers()
        last = [self.version(n) for n in known[-keep:]]
        wanted = {d.split("/")[0] for v in last for d in v.tables.values()} | {f"{v.number:09d}{SUFFIX}" for v in last}
        fs, gone = self._fs(), []
        for s in fs.listStatus(self._path("")) if known else []:
            name = s.getPath().getName()
            ours = name.endswith((SUFFIX, ".tmp")) or s.isDirectory() and name[:9].isdigit()
            if ours and name not in wanted and s.getModificationTime() / 1000 <= time.time() - age_seconds:
                fs.delete(s.getPath(), True)
                gone.append(name)
        return gone
