"""Near-duplicate records with small edits (problem 6), by a generalised pigeonhole search on sketches.

A text's set of word runs is sketched as minwise symbols of 8 bits; the bits of one symbol agree or
differ together, so they are never parted. Symbols are grouped into partitions of unequal width: within
a partition no symbol may differ, the symbols outside may. How many partitions of which width are probed
is decided by dynamic programming on candidate counts estimated from all sketches: the cheapest set that
misses a pair at the threshold with at most the stated probability (the worst case that plain
pigeonhole counting covers would need every single symbol as a partition at this threshold). Candidates
are then verified on the exact sets.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lutrin.plans import scale
from lutrin.plans.scale import written

SYMBOLS = 200
WIDTHS = (2, 3, 4, 5, 6, 8, 10)
#: Probability of missing a pair exactly at the threshold; pairs above it are missed far more rarely.
MISS = 1e-3
#: Cost of checking a candidate pair in place, in units of sending one probe through the shuffle.
PAIR_COST = 0.2
#: Texts of one probe value that are compared in one place; larger sets are compared block by block.
BLOCK = 1000
#: Texts of one probe value beyond which they are dealt to several tasks, and the share that is counted to find such.
HOT_TEXTS, SAMPLE = 200_000, 32
#: Bits of the cheap check before the exact one, and the standard deviations it allows.
BITS, SIGMAS = 128, 4
LEAST_WORDS = 20
#: Words of the texts that are cut into runs together.
GROUP = 30_000
#: Rows up to which a list of ids is broadcast (8 bytes each); longer lists are joined by a shuffle.
MOST_IDS = 1_000_000
#: Texts with copies up to which they are broadcast (a hash and an id each).
MOST_COPIED = 200_000


@functools.cache
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)


class Numbers(dict):
    """64-bit numbers of words, made when a word is first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return number


class Shingler:
    """Texts to sets of runs: 64-bit numbers of the distinct runs of `run` words, for many texts at once."""

    def __init__(self, run: int):
        self.run, self.of = run, Numbers()

    def words(self, text: str) -> list[str]:
        """Pieces of the lower-case text between spaces and line feeds."""
        return [w for w in text.lower().replace("\n", " ").split(" ") if w]

    def groups(self, texts: list[str], least: int = 0) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Texts of at least `least` words in groups that end with GROUP words: places of a group's texts, their runs
        one text after the other, and the places where each text's begin, with the end of the last."""
        at, lists, n = [], [], 0
        for i, t in enumerate(texts):
            words = self.words(t)
            if len(words) >= least:
                at.append(i), lists.append(words)
                n += len(words)
            if n >= GROUP:
                yield at, *self.runs(lists)
                at, lists, n = [], [], 0
        if at:
            yield at, *self.runs(lists)

    def runs(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.of) > 500_000:
            self.of.clear()
        long = np.fromiter(map(len, lists), np.int64, len(lists))
        x = np.fromiter(map(self.of.__getitem__, chain.from_iterable(lists)), np.uint64, long.sum())
        h = np.zeros(max(0, len(x) - self.run + 1), np.uint64)
        for i in range(self.run):
            h = (h ^ x[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        # Runs that begin in one text and end in another are none.
        n = np.maximum(long - self.run + 1, 0)
        place = np.arange(len(h)) - np.repeat(np.cumsum(long) - long, long)[: len(h)]
        h = h[place < np.repeat(n, long)[: len(h)]]
        ends = np.concatenate([[0], np.cumsum(n)])
        for a, b in pairwise(ends.tolist()):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[ends[:-1][n > 0]] = True
        return h[new], np.concatenate([[0], np.cumsum(new)])[ends]


def _symbols(runs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The minwise symbols of each set, a row a set: of every linear hash of its runs the least value, mixed down to
    8 bits. No set is empty."""
    low = (runs >> np.uint64(32)).astype(np.uint32)  # the runs are well-mixed numbers: half of one will do
    hashed, least = np.empty_like(low), np.empty((SYMBOLS, len(ends) - 1), np.uint32)
    for a, b, row in zip(*_hashes(), least):
        np.multiply(low, a, out=hashed)
        np.add(hashed, b, out=hashed)
        np.minimum.reduceat(hashed, ends[:-1], out=row)
    least ^= least >> np.uint32(16)
    least *= np.uint32(0x85EBCA6B)
    least ^= least >> np.uint32(13)
    least *= np.uint32(0xC2B2AE35)
    return np.ascontiguousarray((least >> np.uint32(24)).astype(np.uint8).T)


def copies(rows: DataFrame, record: str, text: str) -> DataFrame:
    """(id, rep): every text and the smallest id with exactly the same characters.

    Only texts that stand in more than one row are looked up. If they are many, a text in very many rows is no join
    key of theirs: there are at most rows / HOT_ROWS such texts, and their ids are told by a broadcast of them.
    """
    keyed = rows.where(F.col(text).isNotNull() & F.col(record).isNotNull()).select(F.col(record).alias("id"), F.unhex(F.md5(text)).alias("same"))
    reps = keyed.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    again = written(reps.where("n > 1"), "again")
    found = again.select("same", "rep")
    if again.count() <= MOST_COPIED:
        return keyed.join(F.broadcast(found), "same", "left").select("id", F.coalesce("rep", "id").alias("rep")).distinct()
    hot = [(r["same"], r["rep"]) for r in again.where(F.col("n") > scale.HOT_ROWS).select("same", "rep").collect()]
    few = rows.sparkSession.createDataFrame(hot, f"same binary, hot {rows.schema[record].dataType.simpleString()}")
    told = keyed.join(F.broadcast(few), "same", "left")
    cold = told.where("hot IS NULL").join(found, "same", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return cold.unionByName(told.where("hot IS NOT NULL").select("id", F.col("hot").alias("rep"))).distinct()


def _listed(ids: DataFrame) -> DataFrame:
    """ids (one column), marked for broadcast if few enough."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def sketches(rows: DataFrame, record: str, text: str, run: int, least_words: int) -> DataFrame:
    """(id, runs, symbols, bits) of texts with at least `least_words` words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(run)
        for batch in batches:
            for at, runs, ends in cut.groups(batch.column(1).to_pylist(), max(least_words, run)):
                sym = _symbols(runs, ends)
                low = np.packbits(sym[:, :BITS] & 1, axis=1).view(">i8").astype(np.int64)
                cols = [batch.column(0).take(pa.array(at)), pa.array(np.diff(ends), pa.int32()), pa.array([x.tobytes() for x in sym], pa.binary()), pa.array(low[:, 0]), pa.array(low[:, 1])]
                yield pa.RecordBatch.from_arrays(cols, ["id", "runs", "symbols", "b0", "b1"])

    kind = rows.schema[record].dataType.simpleString()
    return rows.where(F.col(text).isNotNull() & F.col(record).isNotNull()).select(record, text).mapInArrow(make, f"id {kind}, runs int, symbols binary, b0 long, b1 long")


def collisions(sketch: DataFrame) -> tuple[int, dict[int, float]]:
    """Texts, and for each width the pairs of different texts that agree on a partition of that width.

    Counted over all sketches on one partition per width; one row per width reaches the driver.
    """
    parts = F.array(*[F.struct(F.lit(r).alias("r"), F.xxhash64(F.lit(r), F.substring("symbols", 1, r)).alias("h")) for r in WIDTHS])
    each = sketch.select(F.explode(parts).alias("p")).groupBy("p.r", "p.h").agg(F.count(F.lit(1)).alias("c"))
    rows = each.groupBy("r").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).collect()
    return max([r["n"] for r in rows], default=0), {r["r"]: float(r["pairs"]) for r in rows}


def allocate(n: int, pairs: dict[int, float], threshold: float, miss: float = MISS, steps: int = 4000) -> list[int]:
    """Widths of the partitions to probe: cheapest total of probes and expected candidates whose chance
    to miss a pair at the threshold is at most `miss`, re-used symbols counted (`missed`).

    Unbounded knapsack by dynamic programming over the logarithm of the chance. Partitions of one shuffle
    are independent, those of several are so only at a given number of agreeing symbols; where one
    shuffle is not enough, the gains are therefore also taken at the mean number and at 1 to 3 standard
    deviations below it, and each plan is extended until its true chance is within the bound.
    """
    cost = {r: n + PAIR_COST * pairs.get(r, 0.0) for r in WIDTHS}
    plans = [_plan({r: threshold**r for r in WIDTHS}, cost, threshold, miss, steps)]
    if len(rounds(plans[0])) > 1:
        mean, sd = SYMBOLS * threshold, math.sqrt(SYMBOLS * threshold * (1 - threshold))
        for k in (int(mean - z * sd) for z in range(4)):
            plans.append(_plan({r: math.comb(k, r) / math.comb(SYMBOLS, r) for r in WIDTHS if k >= r}, cost, threshold, miss, steps))
    return min(plans, key=lambda p: sum(cost[r] for r in p))


def _plan(chance: dict[int, float], cost: dict[int, float], threshold: float, miss: float, steps: int) -> list[int]:
    """Cheapest widths by the chances to agree, with the least total gain whose true miss is within the bound."""
    unit = math.log(1 / miss) / steps
    gain = {r: max(1, int(-math.log1p(-q) / unit)) for r, q in chance.items()}
    best, pick = [0.0], [0]

    def widths(s: int) -> list[int]:
        for at in range(len(best), s + 1):
            c, r = min((best[max(0, at - g)] + cost[r], r) for r, g in gain.items())
            best.append(c), pick.append(r)
        out = []
        while s > 0:
            out.append(pick[s])
            s = max(0, s - gain[pick[s]])
        return sorted(out)

    low, high = 0, steps
    if missed(found := widths(steps), threshold) <= miss:
        return found
    while missed(found := widths(high), threshold) > miss:
        low, high = high, high * 2
    while high - low > steps // 100:
        mid = (low + high) // 2
        if missed(w := widths(mid), threshold) <= miss:
            high, found = mid, w
        else:
            low = mid
    return found


def missed(widths: list[int], threshold: float) -> float:
    """Chance that a pair at the threshold agrees on no partition: over the binomial number of agreeing
    symbols, the product of every shuffle's exact chance (its partitions are disjoint)."""
    log = [math.lgamma(SYMBOLS + 1) - math.lgamma(k + 1) - math.lgamma(SYMBOLS - k + 1) for k in range(SYMBOLS + 1)]
    k = np.arange(SYMBOLS + 1)
    left = np.exp(np.array(log) + k * math.log(threshold) + (SYMBOLS - k) * math.log1p(-threshold)) if threshold < 1 else (k == SYMBOLS).astype(float)
    sets = np.array([float(math.comb(SYMBOLS, int(i))) for i in k])
    for part, times in Counter(map(tuple, rounds(widths))).items():
        # Choices of k agreeing symbols that leave no partition of this shuffle whole.
        ways = np.array([float(math.comb(SYMBOLS - sum(part), i)) for i in range(SYMBOLS - sum(part) + 1)])
        for r in part:
            ways = np.convolve(ways, [float(math.comb(r, i)) for i in range(r)])
        left = left * (np.pad(ways, (0, SYMBOLS + 1 - len(ways))) / sets) ** times
    return float(left.sum())


def rounds(widths: list[int]) -> list[list[int]]:
    """Widths of the partitions that share one shuffle of the symbols."""
    out: list[list[int]] = [[]]
    for r in widths:
        if sum(out[-1]) + r > SYMBOLS:
            out.append([])
        out[-1].append(r)
    return out


def partitions(widths: list[int]) -> list[list[int]]:
    """Symbols of each partition: disjoint while they last, then new shuffles of all symbols."""
    rng, order, out = np.random.default_rng(7), list(range(SYMBOLS)), []
    for i, part in enumerate(rounds(widths)):
        if i:
            order = [int(x) for x in rng.permutation(SYMBOLS)]
        ends = np.cumsum([0, *part])
        out += [order[a:b] for a, b in zip(ends, ends[1:])]
    return out


def _probe(i: int, symbols: list[int]) -> Column:
    if symbols == list(range(symbols[0], symbols[0] + len(symbols))):
        value = F.substring("symbols", symbols[0] + 1, len(symbols))
    else:
        value = F.concat(*[F.substring("symbols", s + 1, 1) for s in symbols])
    return F.xxhash64(F.lit(i), value)


def similar(rows: DataFrame, threshold: float = 0.8, run: int = 5, least_words: int = 5, record: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of texts whose sets of word runs have a Jaccard similarity of `threshold` or more.

    members (id, rep): every text with at least `least_words` words and the smallest id among its exact
    copies; pairs (rep_a, rep_b, similarity), rep_a < rep_b, between different texts.
    Copies are thus never multiplied out. Null texts and ids and shorter texts are in neither.
    """
    members = written(copies(rows, record, text), "members")
    extra = members.where("id <> rep").select("id")
    single = rows.join(_listed(extra), F.col(record) == F.col("id"), "left_anti")
    sketch = written(sketches(single, record, text, run, least_words), "sketch")
    n, counted = collisions(sketch)
    probes = partitions(allocate(n, counted, threshold))
    near = written(candidates(sketch, probes, threshold), "near")
    return verified(rows, near, threshold, run, record, text), members.join(sketch.select("id").withColumnRenamed("id", "rep"), "rep", "left_semi").select("id", "rep")


def _hot_probes(each: DataFrame, texts: int) -> DataFrame | None:
    """(probe, parts): probe values of so many texts that one task should not have them all, and the parts they are dealt
    to. Their sizes are estimated from every SAMPLE-th text, which decides where texts meet, never whether."""
    if texts <= HOT_TEXTS:
        return None
    some = each.where(F.pmod(F.xxhash64("t.rep"), F.lit(SAMPLE)) == 0).groupBy("probe").agg((F.count(F.lit(1)) * SAMPLE).alias("size"))
    return written(some.where(F.col("size") > HOT_TEXTS / 2).select("probe", F.ceil(F.col("size") / BLOCK).cast("long").alias("parts")), "hot")


def _together(each: DataFrame, dealt: Column) -> DataFrame:
    """each with the place of every text in its part of a probe value, without the texts that are alone with a value:
    most are, and leave before anything is gathered. A value that was dealt may have others in other parts."""
    w = W.partitionBy("probe", "part").orderBy("t.rep")
    placed = each.withColumn("place", F.row_number().over(w) - 1).withColumn("next", F.lead("probe").over(w))
    return placed.where((F.col("place") > 0) | F.col("next").isNotNull() | dealt).drop("next")


def candidates(sketch: DataFrame, probes: list[list[int]], threshold: float) -> DataFrame:
    """(rep_a, rep_b): different texts that agree on a probe and pass the cheap check.

    One exchange by probe value, and for hot values by part of it, serves everything: inside it the texts are
    numbered and gathered in blocks of bounded size. The blocks of one value then meet in pairs, each pair by
    itself, so that no task has a whole value and none has all of its pairs.
    """
    each = sketch.select(F.struct(F.col("id").alias("rep"), "runs", "b0", "b1").alias("t"), F.explode(F.array(*[_probe(i, p) for i, p in enumerate(probes)])).alias("probe"))
    hot = _hot_probes(each, sketch.count())
    if hot is None:
        each = each.withColumn("part", F.lit(0).cast("long"))
    else:
        dealt = F.pmod(F.xxhash64("t.rep", "probe"), F.col("parts"))
        each = each.join(hot, "probe", "left").withColumn("part", F.coalesce(dealt, F.lit(0).cast("long")))
    each = _together(each, F.lit(False) if hot is None else F.col("parts").isNotNull())
    # Parts and places make one number: a part holds fewer than 2**20 blocks.
    number = F.col("part") * 2**20 + F.floor(F.col("place") / BLOCK)
    blocks = each.withColumn("block", number).groupBy("probe", "part", "block").agg(F.collect_list("t").alias("ts"))
    dealt_out = F.lit(False) if hot is None else F.col("hot").isNotNull()
    if hot is not None:
        blocks = blocks.join(hot.select("probe", F.lit(True).alias("hot")), "probe", "left")
    blocks = blocks.withColumn("long", dealt_out | (F.size("ts") >= BLOCK) | (F.col("block") != F.col("part") * 2**20))
    blocks = blocks.where("size(ts) > 1 OR long").select("probe", "block", "long", "ts")
    # One-bit check: differing low bits at the threshold are binomial with (1 - t) / 2.
    p = (1 - threshold) / 2
    most = BITS * p + SIGMAS * math.sqrt(BITS * p * (1 - p))
    apart = F.bit_count(F.col("x.b0").bitwiseXOR(F.col("y.b0"))) + F.bit_count(F.col("x.b1").bitwiseXOR(F.col("y.b1")))
    fits = F.least("x.runs", "y.runs") >= threshold * F.greatest("x.runs", "y.runs")
    close = (F.col("x.rep") != F.col("y.rep")) & (apart <= most) & fits
    ends = [F.least("x.rep", "y.rep").alias("rep_a"), F.greatest("x.rep", "y.rep").alias("rep_b")]
    # One pass gives the pairs inside blocks and, as pairs of a text with itself, the texts of long sets.
    met = blocks.select("probe", "block", "long", F.explode("ts").alias("x"), "ts").select("probe", "block", "long", "x", F.explode("ts").alias("y"))
    itself = F.col("long") & (F.col("x.rep") == F.col("y.rep"))
    once = close & (F.col("x.rep") < F.col("y.rep"))
    met = written(met.where(once | itself).select(*ends, *[F.when(itself, F.col(c)).alias(c) for c in ("probe", "block", "x")]), "met")
    inside, rest = met.where("x IS NULL").select("rep_a", "rep_b"), met.where("x IS NOT NULL").select("probe", "block", "x")
    if rest.isEmpty():
        return inside.distinct()
    sets = written(rest.groupBy("probe", "block").agg(F.collect_list("x").alias("ts")), "sets")
    # Each block goes to every pair of blocks it is in; a pair is one row, wherever its value's others are.
    others = sets.groupBy("probe").agg(F.collect_set("block").alias("all"))
    paired = sets.join(others, "probe").select("probe", "block", "ts", F.explode("all").alias("other")).where("block <> other")
    paired = paired.select("probe", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.when(F.col("block") < F.col("other"), F.col("ts")).alias("xs"), F.when(F.col("block") > F.col("other"), F.col("ts")).alias("ys"))
    both = paired.groupBy("probe", "lo", "hi").agg(F.first("xs", ignorenulls=True).alias("xs"), F.first("ys", ignorenulls=True).alias("ys"))
    across = both.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y")).where(close).select(*ends)
    return inside.unionByName(across).distinct()


def verified(rows: DataFrame, pairs: DataFrame, threshold: float, run: int, record: str, text: str) -> DataFrame:
    """(rep_a, rep_b, similarity) of the pairs that reach the threshold on their exact sets."""
    kind = rows.schema[record].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(run)
        for batch in batches:
            for at, runs, ends in cut.groups(batch.column(1).to_pylist()):
                sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(runs.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), sets], ["id", "runs"])

    wanted = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("w")).distinct()
    texts = rows.where(F.col(text).isNotNull()).select(F.col(record).alias("id"), F.col(text).alias("t")).join(_listed(wanted), F.col("id") == F.col("w"), "left_semi")
    sets = texts.select("id", "t").mapInArrow(make, f"id {kind}, runs array<bigint>").groupBy("id").agg(F.first("runs").alias("runs"))
    a, b = sets.select(F.col("id").alias("rep_a"), F.col("runs").alias("ra")), sets.select(F.col("id").alias("rep_b"), F.col("runs").alias("rb"))
    both = F.size(F.array_intersect("ra", "rb"))
    scored = pairs.join(a, "rep_a").join(b, "rep_b").withColumn("both", both)
    score = F.col("both") / (F.size("ra") + F.size("rb") - F.col("both"))
    return scored.select("rep_a", "rep_b", score.alias("similarity")).where(F.col("similarity") >= threshold)


def classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, links): connected groups of similar texts; links counts the different texts that a
    text is similar to. Labels are halved by joining each label to its own label until nothing changes,
    so the rounds grow with the logarithm of a chain's length."""
    edges = written(pairs.select(F.col("rep_a").alias("x"), F.col("rep_b").alias("y")).unionByName(pairs.select(F.col("rep_b").alias("x"), F.col("rep_a").alias("y"))), "edges")
    label = written(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")), "label")
    while True:
        near = edges.join(label.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        step = label.join(near, "x").select("x", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        jump = step.select(F.col("x").alias("l"), F.col("l").alias("ll"))
        new = written(step.join(jump, "l", "left").select("x", F.least("l", F.coalesce("ll", "l")).alias("l"), "old"), "label")
        changed = new.where("l <> old").limit(1).count()
        label = new.select("x", "l")
        if not changed:
            break
    degree = edges.groupBy("x").agg(F.count(F.lit(1)).alias("links"))
    known = label.join(degree, "x")
    return members.join(known, F.col("rep") == F.col("x"), "left").select("id", F.coalesce("l", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _chunk_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chunks = spark.read.parquet(f"{sf}/chunks.parquet")
    return similar(chunks, threshold=0.6, run=3, least_words=LEAST_WORDS, record="chunk_ord", text="content")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of chunks of at least 20 words whose runs of three words overlap by 0.6 or more."""
    pairs, members = _chunk_pairs(spark, sf)
    a = members.select(F.col("rep").alias("rep_a"), F.col("id").alias("ia"))
    b = members.select(F.col("rep").alias("rep_b"), F.col("id").alias("ib"))
    across = pairs.join(a, "rep_a").join(b, "rep_b").select("ia", "ib")
    copies = a.join(b, F.col("rep_a") == F.col("rep_b")).where("ia < ib").select("ia", "ib")
    return across.unionByName(copies).select(F.least("ia", "ib").alias("chunk_ord_a"), F.greatest("ia", "ib").alias("chunk_ord_b"))


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk of at least 20 words with its class and the number of different texts it is near."""
    pairs, members = _chunk_pairs(spark, sf)
    return classes(pairs, members).select(F.col("id").alias("chunk_ord"), "class_id", "links")


def p6_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The same for whole documents, on runs of five words at a similarity of 0.8."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return classes(*similar(docs, record="doc_id", text="text")).select(F.col("id").alias("doc_id"), "class_id", "links")


QUERIES = {"p6_found": p6_found, "p6_classes": p6_classes, "p6_documents": p6_documents}


def _sql(table: str, record: str, text: str, run: int, least_words: int, tenths: int) -> str:
    """pairs(a, b) of all texts by their shared runs, each met with each other that has it: for small tables."""
    words = " || ' ' || ".join(f"ws[i + {k}]" for k in range(run))
    return f"""WITH RECURSIVE ids AS (SELECT {record} AS id, {text} AS t, min({record}) OVER (PARTITION BY {text}) AS rep FROM {table} WHERE {text} IS NOT NULL),
ws AS (SELECT id, rep, list_filter(string_split(replace(lower(t), chr(10), ' '), ' '), lambda x: x <> '') AS ws FROM ids),
mem AS (SELECT id, rep FROM ws WHERE len(ws) >= {max(least_words, run)}),
runs AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - {run} + 2), lambda i: {words})) AS run FROM ws WHERE id = rep AND len(ws) >= {max(least_words, run)}),
size AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM runs x JOIN runs y ON x.run = y.run AND x.id < y.id GROUP BY ALL),
pairs AS (SELECT a, b FROM shared JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE 10 * shared.n >= {tenths} * (p.n + q.n - shared.n))"""


_SQL_CLASSES = """,
edges AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT x, x AS l FROM edges UNION SELECT edges.y, reach.l FROM reach JOIN edges ON edges.x = reach.x),
label AS (SELECT x, min(l) AS l FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS links FROM edges GROUP BY x)
SELECT mem.id AS {record}, coalesce(l, rep) AS class_id, coalesce(links, 0) AS links FROM mem LEFT JOIN label ON label.x = rep LEFT JOIN degree ON degree.x = rep"""
ORACLE = {
    "p6_found": _sql("chunks", "chunk_ord", "content", 3, LEAST_WORDS, 6) + """,
twins AS (SELECT x.id AS a, y.id AS b FROM mem x JOIN mem y ON x.rep = y.rep AND x.id < y.id),
across AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM pairs JOIN mem x ON x.rep = pairs.a JOIN mem y ON y.rep = pairs.b)
SELECT a AS chunk_ord_a, b AS chunk_ord_b FROM twins UNION ALL SELECT a, b FROM across""",
    "p6_classes": _sql("chunks", "chunk_ord", "content", 3, LEAST_WORDS, 6) + _SQL_CLASSES.format(record="chunk_ord"),
    "p6_documents": _sql("documents", "doc_id", "text", 5, 5, 8) + _SQL_CLASSES.format(record="doc_id"),
}
