"""Physical helpers shared by the operators: shared-folder tables and skew-safe ranking."""

from __future__ import annotations

import contextlib
import getpass
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of one key beyond which its window is cut into value ranges instead of going to one task.
HOT_ROWS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master, where driver and executors are one process, may fall back to a temporary
    folder, which the session's settings do not learn of; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{tempfile.gettempdir()}/lutrin-{getpass.getuser()}"


def _owned(spark: SparkSession, name: str):
    """A path under the application's own directory in the shared folder, deleted when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lutrin-{spark.sparkContext.applicationId}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return fs, spark._jvm.org.apache.hadoop.fs.Path(path, name) if name else path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a compressed table in the shared folder and read it back.

    Unlike a local checkpoint the table outlives any executor. It belongs to the innermost `scratch` around
    the call, else to the application: it is deleted when the driver ends, or by `release`.
    """
    spark = df.sparkSession
    path = _owned(spark, f"{name}-{uuid.uuid4().hex}")[1]
    for names in _OPEN[-1:]:
        names.append(path.getName())
    df.write.option("compression", "zstd").parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder among the application's own, deleted with them."""
    return _owned(spark, f"{name}-{uuid.uuid4().hex}")[1].toString()


_OPEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at its end; nothing that reads them may be used after it."""
    _OPEN.append([])
    try:
        yield
    finally:
        for name in _OPEN.pop():
            fs, path = _owned(spark, name)
            fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application wrote by `written`."""
    fs, path = _owned(spark, "")
    fs.delete(path, True)


def buckets_for(rows: int, per: int = HOT_ROWS // 2, least: int = 8) -> int:
    """Parts for so many rows: it grows with them, so that a part does not."""
    return max(least, -(-rows // per))


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> dict:
    """Keys with more than hot_rows rows, and their rows; there are at most rows / hot_rows of them."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return {r[0]: r[1] for r in counts.where(F.col("__n") > hot_rows).select(key, "__n").collect()}


def _with_range(df: DataFrame, key: str, value: str, buckets: int) -> DataFrame:
    """df, written in `buckets` ranges of (key, value), with the number of its range as __range."""
    return written(df.repartitionByRange(buckets, key, value).withColumn("__range", F.spark_partition_id()), "ranges")


def rank_in_key(df: DataFrame, key: str, value: str, out: str, ties: str, hot: dict, buckets: int | None = None) -> DataFrame:
    """Descending competition rank of value inside key (1 + rows strictly higher) and its tie count.

    Null values get null rank. Keys in `hot` (with their rows) never enter one window: equal values are
    counted first, the counts are ranked inside value ranges, as many as the rows ask for, and the totals
    of the higher ranges are added.
    """
    buckets, hot = buckets or buckets_for(sum(hot.values())), list(hot)
    w = W.partitionBy(key)
    plain = df.where(~F.col(key).isin(hot) | F.col(key).isNull()) if hot else df
    present = F.col(value).isNotNull()
    plain = plain.withColumn(out, F.when(present, F.rank().over(w.orderBy(F.col(value).desc_nulls_last())))).withColumn(
        ties, F.when(present, F.count(F.lit(1)).over(W.partitionBy(key, value)))
    )
    if not hot:
        return plain
    rows = df.where(F.col(key).isin(hot))
    counts = rows.where(present).groupBy(key, value).agg(F.count(F.lit(1)).alias(ties))
    ranged = _with_range(counts, key, value, buckets)
    totals = ranged.groupBy(key, "__range").agg(F.sum(ties).alias("__total"))
    higher = W.partitionBy(key).orderBy(F.col("__range").desc()).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(key, "__range", F.coalesce(F.sum("__total").over(higher), F.lit(0)).alias("__before"))
    inside = W.partitionBy(key, "__range").orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, -1)
    ranked = ranged.join(F.broadcast(totals), [key, "__range"]).select(  # a row a range, a key more in few of them
        key, value, ties, (F.lit(1) + F.col("__before") + F.coalesce(F.sum(ties).over(inside), F.lit(0))).cast("int").alias(out)
    )
    left = rows.alias("l").join(ranked.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col(f"l.{value}") == F.col(f"r.{value}")), "left")
    return plain.unionByName(left.select("l.*", f"r.{out}", f"r.{ties}"))


def running(
    df: DataFrame, key: str, order: str, hot: dict, sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None,
    descending: bool = False, buckets: int | None = None,
) -> DataFrame:
    """df with running values inside key by the column `order` (unique inside a key), by output name.

    sums: inclusive running sum of a column; lasts: the last value of a column that is not null, before the
    row. Hot keys are worked range by range, as in rank_in_key: each range begins after the values that
    the ranges before it end with.
    """
    sums, lasts = sums or {}, lasts or {}
    buckets, hot = buckets or buckets_for(sum(hot.values())), list(hot)

    def worked(rows: DataFrame, *part: str) -> DataFrame:
        w = W.partitionBy(*part).orderBy(F.col(order).desc() if descending else F.col(order))
        so_far, before = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, -1)
        return rows.select("*", *[F.sum(v).over(so_far).alias(o) for o, v in sums.items()], *[F.last(v, ignorenulls=True).over(before).alias(o) for o, v in lasts.items()])

    plain = df.where(~F.col(key).isin(hot) | F.col(key).isNull()) if hot else df
    plain = worked(plain, key)
    if not hot:
        return plain
    ranged = _with_range(df.where(F.col(key).isin(hot)), key, order, buckets)
    final = F.min_by if descending else F.max_by
    ends = ranged.groupBy(key, "__range").agg(
        *[F.sum(v).alias(f"__{o}") for o, v in sums.items()], *[final(F.col(v), F.when(F.col(v).isNotNull(), F.col(order))).alias(f"__{o}") for o, v in lasts.items()])
    w = W.partitionBy(key).orderBy(F.col("__range").desc() if descending else F.col("__range")).rowsBetween(W.unboundedPreceding, -1)
    ahead = ends.select(key, "__range", *[F.sum(f"__{o}").over(w).alias(f"__{o}") for o in sums], *[F.last(f"__{o}", ignorenulls=True).over(w).alias(f"__{o}") for o in lasts])
    inside = worked(ranged, key, "__range").join(F.broadcast(ahead), [key, "__range"])  # a row a range
    done = inside.select(
        *df.columns, *[(F.coalesce(F.col(f"__{o}"), F.lit(0)) + F.col(o)).alias(o) for o in sums], *[F.coalesce(o, f"__{o}").alias(o) for o in lasts])
    return plain.unionByName(done)


def running_sum(df: DataFrame, key: str, order: str, value: str, out: str, hot: dict, buckets: int | None = None) -> DataFrame:
    """Inclusive running sum of value inside key by the column `order` (unique inside a key)."""
    return running(df, key, order, hot, sums={out: value}, buckets=buckets)
