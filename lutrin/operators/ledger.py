"""Work-item ledger: process only what is new or changed, once, whatever fails in between.

An item is pending until a run leases it, leased until the run commits it and done afterwards. A lease
that is not committed in time returns the item to pending. Every lease carries a fencing token, larger
than that of any earlier lease; a commit with another token than the item's current one is rejected.
Output paths depend on the item and its version only, so a retry overwrites its own output.

The four transitions are column expressions on an item's state. The live ledger applies them to its table,
`history` folds the same ones over the recorded runs of each item.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lutrin.sources.store import SCHEMAS, Conflict, Store, Version

ITEM = SCHEMAS["ledger"].split("item ", 1)[1]
SIGNATURE = "struct<size_bytes: bigint, modified_time: double>"


class Fenced(RuntimeError):
    """The writer no longer holds the lease of all its items: a later token or its own deadline took them."""


def output_path(root: str, path, size, time):
    """Deterministic target of an item: the same version of the same item always has the same path."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.sha2(F.concat_ws("\u0001", path, size.cast("string"), F.hex(time.cast("string").cast("binary"))), 256))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _item(size, time, state, token, until, done) -> Column:
    return F.struct(size.alias("size_bytes"), time.alias("modified_time"), state.alias("state"), token.cast("long").alias("token"), until.cast("timestamp").alias("lease_until"), done.alias("done")).cast(ITEM)


def _state(item: Column) -> Column:
    return item.getField("state")


def observed(item: Column, size: Column, time: Column, force: Column | None = None) -> Column:
    """The item (null if unknown) after a listing. It is done if this version was committed, stays leased if this
    version is being processed, and is pending otherwise. A changed item loses its lease, so that the commit of
    the version before is rejected. force: pending although its version was committed."""
    done = item.getField("done")
    was = done.isNotNull() & done.getField("size_bytes").eqNullSafe(size) & done.getField("modified_time").eqNullSafe(time)
    held = F.coalesce(_state(item) == "leased", F.lit(False)) & item.getField("size_bytes").eqNullSafe(size) & item.getField("modified_time").eqNullSafe(time)
    fresh = was if force is None else was & ~F.coalesce(force, F.lit(False))
    state = F.when(held, F.lit("leased")).when(fresh, F.lit("done")).otherwise(F.lit("pending"))
    return _item(size, time, state, F.coalesce(item.getField("token"), F.lit(0)), F.when(held, item.getField("lease_until")), done)


def expired(item: Column, now: Column | None) -> Column:
    """A lease beyond its deadline (any lease, if no time is given) returns the item to pending."""
    late = F.lit(True) if now is None else ~F.coalesce(now <= item.getField("lease_until"), F.lit(False))
    return F.when((_state(item) == "leased") & late, item.withField("state", F.lit("pending")).withField("lease_until", F.lit(None).cast("timestamp"))).otherwise(item)


def leased(item: Column, token: Column, until: Column) -> Column:
    """A pending item under a new token and deadline; other items as they are."""
    taken = _item(item.getField("size_bytes"), item.getField("modified_time"), F.lit("leased"), token, until, item.getField("done"))
    return F.when(_state(item) == "pending", taken).otherwise(item)


def holds(item: Column, token: Column, now: Column) -> Column:
    """Whether the writer with this token still holds the item."""
    return F.coalesce((_state(item) == "leased") & (item.getField("token") == token) & (now <= item.getField("lease_until")), F.lit(False))


def committed(item: Column, token: Column, now: Column) -> Column:
    """The item done, if the writer holds it; later tokens and leases beyond their deadline are left alone."""
    done = F.struct(item.getField("size_bytes").alias("size_bytes"), item.getField("modified_time").alias("modified_time"))
    finished = _item(item.getField("size_bytes"), item.getField("modified_time"), F.lit("done"), item.getField("token"), F.lit(None).cast("timestamp"), done)
    return F.when(holds(item, token, now), finished).otherwise(item)


def history(manifest: DataFrame, listing: DataFrame, runs: DataFrame) -> DataFrame:
    """Ledger transitions of recorded runs: one row per (run, item) with the states it went through.

    Each run observes the item, leases it if it is pending (token: the run; deadline: the run's last commit)
    and commits it at the time it was listed, which the ledger rejects beyond the deadline; a lease left
    over expires at the end of the run. A successful run forgets the items that it did not list.

    Columns: run_id, source_path, size_bytes, modified_time, known_size, known_time (the version committed
    before), was_pending (new or changed at the start of the run), state and token at the end of the run.

    Per item there is at most one row a run, so an item's fold holds runs, not rows; the item listed in a
    third of all rows is folded before by partial aggregation. Rows without path or run are ignored; a
    run missing from `runs` counts as neither committed nor successful; repeated rows fold to one (latest
    listing wins if they differ); a null listed_at or commit time is no commit. Null size and time compare as values.
    """
    seen = (
        listing.where("source_path IS NOT NULL AND run_id IS NOT NULL")
        .groupBy("run_id", "source_path")
        .agg(
            F.max_by(F.struct("size_bytes", "modified_time"), F.struct("listed_at", "size_bytes", "modified_time")).alias("sig"),
            F.min("listed_at").alias("listed_at"),
        )
    )
    by_run = W.orderBy("run_id").rowsBetween(W.unboundedPreceding, -1)
    ok = F.coalesce(F.col("status") == "success", F.lit(False)).cast("int")
    marks = (  # one row a run: a single small window
        runs.where("run_id IS NOT NULL").groupBy("run_id").agg(F.max("status").alias("status"), F.max("last_commit_at").alias("last_commit_at"))
        .select("run_id", "last_commit_at", ok.cast("long").alias("ok"), F.coalesce(F.sum(ok).over(by_run), F.lit(0)).alias("ok_before"))
    )
    zero = F.lit(0).cast("long")
    rows = seen.join(marks, "run_id", "left").select(
        "source_path", "run_id", F.col("sig").cast(SIGNATURE).alias("sig"), F.col("listed_at").cast("timestamp").alias("listed_at"),
        F.col("last_commit_at").cast("timestamp").alias("until"), F.coalesce("ok", zero).alias("ok"), F.coalesce("ok_before", zero).alias("ok_before"),
    )
    start = (
        manifest.where("source_path IS NOT NULL").groupBy("source_path").agg(F.max(F.struct("size_bytes", "modified_time")).alias("sig"))
        .select("source_path", F.lit(None).cast(rows.schema["run_id"].dataType).alias("run_id"), F.col("sig").cast(SIGNATURE).alias("sig"), F.lit(None).cast("timestamp").alias("listed_at"), F.lit(None).cast("timestamp").alias("until"), zero.alias("ok"), zero.alias("ok_before"))
    )
    # The manifest's row has no run and sorts first.
    items = rows.unionByName(start).groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("run_id", "sig", "listed_at", "until", "ok", "ok_before"))).alias("runs"))
    first = F.try_element_at(F.filter("runs", lambda r: r.run_id.isNull()), F.lit(1))
    known = F.when(first.isNotNull(), _item(first.sig.size_bytes, first.sig.modified_time, F.lit("done"), F.lit(0), F.lit(None), first.sig))
    line = f"struct<run_id: {rows.schema['run_id'].dataType.simpleString()}, sig: {SIGNATURE}, known: {SIGNATURE}, was_pending: boolean, state: string, token: bigint>"
    fold = f"struct<item: {ITEM}, ok: bigint, lines: array<{line}>>"

    def one_run(acc: Column, run: Column) -> Column:
        before = F.when(run.ok_before > acc.ok, F.lit(None).cast(ITEM)).otherwise(acc.item)  # a successful run between did not list it

        def after(seen_: Column) -> Column:
            end = _let(leased(seen_, run.run_id, run.until), lambda x: _let(committed(x, run.run_id, run.listed_at), lambda y: expired(y, None)))
            return _let(end, lambda e: F.struct(
                e.alias("item"), (run.ok_before + run.ok).alias("ok"),
                F.concat(acc.lines, F.array(F.struct(run.run_id, run.sig, F.when(run.ok_before <= acc.ok, acc.item.done).alias("known"), _state(seen_) == "pending", _state(e), e.token).cast(line))).alias("lines"),
            ).cast(fold))

        return _let(before, lambda b: _let(observed(b, run.sig.size_bytes, run.sig.modified_time), after))

    begin = F.struct(known.alias("item"), zero.alias("ok"), F.array().cast(f"array<{line}>").alias("lines")).cast(fold)
    replayed = items.select("source_path", F.aggregate(F.filter("runs", lambda r: r.run_id.isNotNull()), begin, one_run).alias("a"))
    return replayed.select("source_path", F.explode("a.lines").alias("x")).select(
        "x.run_id", "source_path", "x.sig.size_bytes", "x.sig.modified_time", F.col("x.known.size_bytes").alias("known_size"), F.col("x.known.modified_time").alias("known_time"),
        "x.was_pending", "x.state", "x.token",
    )


class Ledger:
    """The live ledger: a table of the store, changed by publishing the version after the one it was read from.

    A step that meets another writer reads again and is decided anew; a step that dies leaves the version
    before it valid.
    """

    def __init__(self, store: Store, tries: int = 8):
        self.store, self.tries = store, tries

    def state(self, version: Version | None = None) -> DataFrame:
        """(source_path, item) of every known item."""
        return self.store.table("ledger", version=version)

    def items(self) -> DataFrame:
        return self.state().select("source_path", "item.*")

    def _step(self, change: Callable[[DataFrame, Version], dict[str, DataFrame]]) -> Version:
        for left in reversed(range(self.tries)):
            base = self.store.current()
            try:
                return self.store.write(change(self.state(base), base), base)
            except Conflict:
                if not left:
                    raise
        raise Conflict("no try allowed")

    def observe(self, listing: DataFrame, complete: bool = False) -> Version:
        """Take a listing (source_path, size_bytes, modified_time, optionally `force`): new, changed and forced
        items become pending. complete: items that are not listed are dropped."""
        force = F.max(F.coalesce("force", F.lit(False))) if "force" in listing.columns else F.lit(False)
        seen = listing.where("source_path IS NOT NULL").groupBy("source_path").agg(F.max(F.struct("size_bytes", "modified_time")).alias("sig"), force.alias("force"))

        def change(state: DataFrame, _: Version) -> dict[str, DataFrame]:
            both = state.join(seen, "source_path", "right" if complete else "full_outer")
            new = observed(F.col("item"), F.col("sig.size_bytes"), F.col("sig.modified_time"), F.col("force"))
            return {"ledger": both.select("source_path", F.when(F.col("sig").isNotNull(), new).otherwise(F.col("item")).alias("item"))}

        return self._step(change)

    def lease(self, now: datetime, until: datetime) -> tuple[DataFrame, int]:
        """Lease every pending item, and every item whose lease ran out, under a new token; (items, token)."""
        token = 0

        def change(state: DataFrame, _: Version) -> dict[str, DataFrame]:
            nonlocal token
            token = (state.agg(F.max("item.token")).first()[0] or 0) + 1  # one number
            return {"ledger": state.select("source_path", leased(expired(F.col("item"), F.lit(now).cast("timestamp")), F.lit(token), F.lit(until)).alias("item"))}

        version = self._step(change)
        mine = self.state(version).select("source_path", "item.*").where((F.col("token") == token) & (F.col("state") == "leased"))
        return mine, token

    def _move(self, change: Callable[[Column], Column]) -> Version:
        return self._step(lambda state, _: {"ledger": state.select("source_path", change(F.col("item")).alias("item"))})

    def renew(self, token: int, now: datetime, until: datetime) -> Version:
        """A later deadline for the items that this token still holds."""
        mine = lambda i: holds(i, F.lit(token), F.lit(now).cast("timestamp"))
        return self._move(lambda i: F.when(mine(i), i.withField("lease_until", F.lit(until).cast("timestamp"))).otherwise(i))

    def release(self, token: int) -> Version:
        """Give back the items of this token, as if its lease had run out."""
        return self._move(lambda i: F.when(i.getField("token") == token, expired(i, None)).otherwise(i))

    def commit(self, items: DataFrame, token: int, now: datetime, tables: dict[str, DataFrame] | None = None, since: Version | None = None) -> Version:
        """Mark the items (source_path) done that this token still holds; the others are left alone.

        tables: output published in the same version, made from the tables of version `since`. Then it is all
        or nothing: Fenced if any item is no longer held, Conflict if another writer replaced those tables.
        """
        asked = items.select("source_path").where("source_path IS NOT NULL").distinct().withColumn("__asked", F.lit(True))
        at, mark = F.lit(now).cast("timestamp"), F.lit(token)
        stored: dict[str, DataFrame] = {}

        def change(state: DataFrame, base: Version) -> dict[str, DataFrame]:
            both = state.join(asked, "source_path", "left")
            if tables is not None:
                others = lambda v: {k: d for k, d in v.tables.items() if k != "ledger"}
                if since is not None and others(base) != others(since):
                    raise Fenced("another build published these tables")
                lost = asked.join(state, "source_path", "left").where(~holds(F.col("item"), mark, at)).limit(1).count()
                if lost:
                    raise Fenced(f"token {token} no longer holds all its items")
            new = F.when(F.col("__asked"), committed(F.col("item"), mark, at)).otherwise(F.col("item"))
            return {**stored, "ledger": both.select("source_path", new.alias("item"))}

        stored.update(tables or {})
        return self._step(change)


def _recorded(spark: SparkSession, sf: str) -> DataFrame:
    return history(*(spark.read.parquet(f"{sf}/{n}.parquet") for n in ("manifest", "listing", "index_runs")))


def found(spark: SparkSession, sf: str) -> DataFrame:
    """p4_found: items that were pending when the run's ledger step began."""
    return _recorded(spark, sf).where("was_pending").select("run_id", "source_path")


def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    """p4_runs: per run, items listed, pending at its start, committed, and returned to pending."""
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    return _recorded(spark, sf).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("listed"), count(F.col("was_pending"), "pending"),
        count(F.col("was_pending") & (F.col("state") == "done"), "committed"), count(F.col("state") == "pending", "returned"),
    )


_REPLAY = """
WITH RECURSIVE r AS (SELECT run_id, status, last_commit_at, row_number() OVER (ORDER BY run_id) i FROM index_runs),
l AS (SELECT run_id, source_path p, max(size_bytes) s, max(modified_time) m, min(listed_at) t FROM listing GROUP BY ALL),
paths AS (SELECT source_path p FROM manifest UNION SELECT source_path FROM listing),
w AS (
  SELECT 0::BIGINT i, p, k.source_path IS NOT NULL AS have, size_bytes s, modified_time m, false AS listed, false AS hit, false AS kept
  FROM paths LEFT JOIN manifest k ON k.source_path = p
  UNION ALL
  SELECT r.i, w.p,
    CASE WHEN l.p IS NULL THEN w.have AND r.status <> 'success' WHEN l.t <= r.last_commit_at THEN true ELSE w.have END,
    CASE WHEN l.t <= r.last_commit_at THEN l.s ELSE w.s END, CASE WHEN l.t <= r.last_commit_at THEN l.m ELSE w.m END,
    l.p IS NOT NULL, l.p IS NOT NULL AND (NOT w.have OR l.s <> w.s OR l.m <> w.m), coalesce(l.t <= r.last_commit_at, false)
  FROM w JOIN r ON r.i = w.i + 1 LEFT JOIN l ON l.run_id = r.run_id AND l.p = w.p)
"""
QUERIES = {"p4_found": found, "p4_runs": run_totals}
ORACLE = {
    "p4_found": _REPLAY + "SELECT run_id, p AS source_path FROM w JOIN r USING (i) WHERE hit",
    "p4_runs": _REPLAY + """SELECT run_id, count(*) listed, count(*) FILTER (hit) pending, count(*) FILTER (hit AND kept) committed, count(*) FILTER (hit AND NOT kept) returned
FROM w JOIN r USING (i) WHERE listed GROUP BY run_id""",
}
