"""Filling fixed-capacity containers with whole texts (problem 8), by large-item matching.

Texts above a third of the capacity go at most two to a container and are matched greedily; smaller ones
fill the gaps best-fit. Only sizes matter, and there are at most `capacity` different ones: the greedy runs
on the counts of the sizes, many equal containers in one step, and gives exactly what it would give on
the single texts. Texts then find their container by their rank among the texts of their size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.llm.tokens import sized
from lutrin.plans.scale import HOT_ROWS, hot_keys, running_sum, written


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """((size, first_rank, first_container, per_container) in order of size and rank, containers).

    The items of a size from first_rank on lie per_container to a container, from first_container on.
    The number of entries is bounded by the capacity, whatever the number of items.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first container, containers)
    order: list[int] = []  # gaps in use, ascending
    total = 0

    def place(size: int, first: int, containers: int, each: int) -> None:
        out.append((size, used[size], first, each))
        used[size] += containers * each
        left[size] -= containers * each

    def free(gap: int, first: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    alive = list(large)
    for a in reversed(large):
        while left[a]:
            i = bisect_left(alive, capacity - a + 1) - 1
            while i >= 0 and not left[alive[i]]:
                alive.pop(i)
                i -= 1
            b = alive[i] if i >= 0 else None
            if b is None or b == a and left[a] < 2:
                n = left[a]
                place(a, total, n, 1)
                free(capacity - a, total, n)
            elif b == a:
                n = left[a] // 2
                place(a, total, n, 2)
                free(capacity - 2 * a, total, n)
            else:
                n = min(left[a], left[b])
                place(a, total, n, 1)
                place(b, total, n, 1)
                free(capacity - a - b, total, n)
            total += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(order, s)
            if i == len(order):
                each = min(capacity // s, left[s])
                n = left[s] // each
                place(s, total, n, each)
                free(capacity - each * s, total, n)
                total += n
                continue
            gap = order[i]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[i]
            each = min(gap // s, left[s])
            m = min(n, left[s] // each)
            place(s, first, m, each)
            free(gap - each * s, first, m)
            free(gap, first + m, n - m)
    return sorted(out), total


def pack(sizes: DataFrame, packs: DataFrame, record: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(pack_name, container, record, piece, token_start, tokens) for sizes (record, tokens).

    A text larger than the capacity fills containers of its own with pieces of exactly the capacity; its
    rest is an item like any other. Records without tokens are in no container. Packs without name or
    with a capacity below 1 are ignored, repeated packs count once. Container names are unique in a pack.
    """
    wanted = [(r["pack_name"], int(r["capacity_tokens"])) for r in packs.where("pack_name IS NOT NULL AND capacity_tokens >= 1").groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity_tokens")).collect()]
    limits = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("long").alias("cap")) for n, c in wanted]) if wanted else F.array().cast("array<struct<pack_name:string,cap:bigint>>")
    frozen = written(sizes.where("tokens > 0").select(F.col(record), "tokens").withColumn("row", F.monotonically_increasing_id()), "sizes")
    by_pack = frozen.select("*", F.explode(limits).alias("p")).select(record, "row", "tokens", "p.pack_name", "p.cap")
    over = F.col("tokens") > F.col("cap")
    rest = F.when(over, F.col("tokens") % F.col("cap")).otherwise(F.col("tokens"))
    items = by_pack.withColumn("size", rest).where("size > 0").withColumn("key", F.concat_ws("|", "pack_name", "size")).withColumn("one", F.lit(1).cast("long"))
    plans = {}
    # At most `capacity` sizes a pack reach the driver.
    counts = {}
    for r in items.groupBy("pack_name", "size").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["pack_name"], {})[r["size"]] = r["n"]
    for name, cap in wanted:
        steps, _ = plan(counts.get(name, {}), cap)
        plans[name] = tuple(np.array([x[i] for x in steps], np.int64) for i in range(4))
    ranked = running_sum(items, "key", "row", "one", "rank", hot_keys(items, "key", hot_rows))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b.column(1).to_pylist(), object)
            size, rank = b.column(2).to_numpy(), b.column(3).to_numpy() - 1
            where = np.zeros(len(names), np.int64)
            for name, (s, first, container, each) in plans.items():
                mine = names == name
                if mine.any():
                    # Sizes and ranks are below 2**31 and 2**40: one number orders both.
                    at = np.searchsorted(s * 2**40 + first, size[mine] * 2**40 + rank[mine], "right") - 1
                    where[mine] = container[at] + (rank[mine] - first[at]) // each[at]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(where), b.column(2), b.column(4), b.column(5)], ["id", "pack_name", "container", "size", "tokens", "cap"])

    kind = sizes.schema[record].dataType.simpleString()
    placed = ranked.select(F.col(record).alias("id"), "pack_name", "size", "rank", "tokens", "cap").mapInArrow(assign, f"id {kind}, pack_name string, container long, size long, tokens long, cap long")
    shared = placed.select("pack_name", F.concat(F.lit("s"), "container").alias("container"), F.col("id").alias(record), F.when(F.col("tokens") > F.col("cap"), F.floor(F.col("tokens") / F.col("cap"))).otherwise(0).cast("int").alias("piece"), (F.col("tokens") - F.col("size")).alias("token_start"), F.col("size").alias("tokens"))
    full = by_pack.where(over).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("tokens") / F.col("cap")) - 1)).alias("k"))
    alone = full.select("pack_name", F.concat_ws("-", F.lit("o"), "row", "k").alias("container"), record, F.col("k").cast("int").alias("piece"), (F.col("k") * F.col("cap")).alias("token_start"), F.col("cap").alias("tokens"))
    return shared.unionByName(alone)


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return pack(sized(docs, "text", ["doc_id"]), spark.read.parquet(f"{sf}/pack_limits.parquet"), "doc_id")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, or piece of one larger than a container, with its container of each capacity."""
    return _packed(spark, sf)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and share of filled space for each capacity."""
    limits = spark.read.parquet(f"{sf}/pack_limits.parquet").groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    each = _packed(spark, sf).groupBy("pack_name", "container").agg(F.sum("tokens").alias("t"))
    total = each.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return total.join(limits, "pack_name").withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
ORACLE: dict[str, str] = {}
