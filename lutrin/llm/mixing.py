"""Mixing sources to target weights (problem 9), by Efraimidis-Spirakis sampling.

Every document draws an exponential key at the rate of its quality weight; in the order of the keys the
first documents of a source are a weighted sample without replacement, of whatever size is wanted.
Sources smaller than their budget are used in complete epochs before the rest is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.llm.tokens import sized
from lutrin.plans.scale import HOT_ROWS, hot_keys, running_sum, written

#: A total: as many tokens as the target sources hold.
AVAILABLE = "available"


def quality(text: Column) -> Column:
    """Weight of a document in 0.05..1: its share of letters and blanks, less for very short texts."""
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(letters / (n + 200), F.lit(0.0)))


def _name(source: Column) -> Column:
    return F.lower(F.trim(source))


def mix(docs: DataFrame, targets: DataFrame, record: str, seed: int = 1, total: int | str | None = None, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) from docs (record, source, tokens, weight) and targets (source, target_share, max_repeats).

    chosen (record, source, tokens, copies): documents used at least once; shares: per target source what
    was available, wanted and taken. total is a number of tokens, or AVAILABLE for all tokens of the target
    sources; sources that cannot fill their budget are used as often as allowed and fall short of their share.
    Without `total`, the mix is the largest in which every source that has tokens keeps its share within
    its cap, so the scarcest source decides its size. Source names are compared in lower case without surrounding blanks; documents of no
    target source, or without tokens, are unused; targets without documents are reported with 0. The last
    document of a sample is taken if more than half of it fits. Repeated target rows add up their
    shares; documents with equal keys are taken in the order of their records.
    """
    goal = targets.where("source IS NOT NULL").groupBy(_name(F.col("source")).alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(record)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    pool = docs.where("tokens > 0").select(F.col(record), _name(F.col("source")).alias("source"), "tokens", (-F.ln(u) / F.col("weight")).alias("draw"))
    # Targets are one row a source in a table of a fixed few; Spark checks their size before it broadcasts.
    pool = written(pool.join(goal.select("source"), "source", "left_semi"), "pool")
    have = pool.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    supply = goal.join(have, "source", "left").na.fill(0, ["available", "documents"])
    usable = (F.col("available") > 0) & (F.col("target_share") > 0)
    if total is None:
        total = supply.where(usable).agg(F.min(F.col("max_repeats") * F.col("available") / F.col("target_share"))).first()[0] or 0
    elif total == AVAILABLE:
        total = supply.where(usable).agg(F.sum("available")).first()[0] or 0  # one number
    budget = F.col("target_share") * F.lit(float(total))
    need = supply.withColumn("budget", F.when(usable, budget).otherwise(F.lit(0.0)))
    need = need.withColumn("epochs", F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available") + F.lit(1e-9)), F.col("max_repeats").cast("long"))).otherwise(F.lit(0).cast("long")))
    need = need.withColumn("fraction", F.when(F.col("epochs") < F.col("max_repeats"), F.greatest(F.col("budget") - F.col("epochs") * F.col("available"), F.lit(0.0))).otherwise(F.lit(0.0)))
    # The record tells equal keys apart.
    ordered = running_sum(pool.withColumn("place", F.struct("draw", record)), "source", "place", "tokens", "filled", hot_keys(pool, "source", hot_rows))
    picked = ordered.join(need.select("source", "epochs", "fraction"), "source")
    half = F.col("filled") - F.col("tokens") / 2 <= F.col("fraction")
    copies = F.col("epochs") + F.when((F.col("fraction") > 0) & half, 1).otherwise(0)
    chosen = picked.select(record, "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")
    taken = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most_copies"))
    shares = need.join(taken, "source", "left").na.fill(0, ["taken", "most_copies"])
    whole = shares.agg(F.sum("taken").alias("whole"))
    shares = shares.crossJoin(F.broadcast(whole)).select(  # one row
        "source", "target_share", "max_repeats", "documents", "available", F.round("budget").cast("long").alias("budget"), "taken", "most_copies",
        F.round(F.when(F.col("whole") > 0, F.col("taken") / F.col("whole")).otherwise(0.0), 6).alias("actual_share"))
    return chosen, shares


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("weight", quality(F.col("text")))
    return mix(sized(docs, "text", ["doc_id", "source", "weight"]), spark.read.parquet(f"{sf}/mix_targets.parquet"), "doc_id", total=AVAILABLE)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the mix with the number of times each is used."""
    return _mixed(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mixed(spark, sf)[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
ORACLE: dict[str, str] = {}
