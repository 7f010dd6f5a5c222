import random
from datetime import datetime, timedelta

import pytest

from lutrin.operators.ledger import Fenced, Ledger, history, output_path
from lutrin.sources.store import Conflict, Store
from pyspark.sql import functions as F

T0 = datetime(2025, 1, 1)
M, L, R = "source_path string, size_bytes long, modified_time double, chunk_count int", "run_id int, source_path string, size_bytes long, modified_time double, listed_at timestamp", "run_id int, started_at timestamp, finished_at timestamp, last_commit_at timestamp, status string"


def replay(manifest, listing, runs):
    known, out = {m[0]: (m[1], m[2]) for m in manifest}, set()
    for run, commit, status in sorted(runs):
        rows = [x for x in listing if x[0] == run]
        out |= {(run, x[1]) for x in rows if known.get(x[1]) != (x[2], x[3])}
        known |= {x[1]: (x[2], x[3]) for x in rows if x[4] is not None and commit is not None and x[4] <= commit}
        if status == "success":
            known = {p: v for p, v in known.items() if p in {x[1] for x in rows}}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_history_is_the_replay_of_the_runs(spark, seed):
    rng = random.Random(seed)
    manifest = [(f"p{i}", rng.randint(1, 2), 1.0, 0) for i in range(5)]
    runs = [(r, rng.choice([None, T0 + timedelta(hours=10 * r + 5)]), rng.choice(["success", "partial", "failed"])) for r in range(6)]
    listing = []
    for r in range(6):
        for i in range(8):
            if rng.random() < 0.7:
                row = (r, f"p{i}", rng.randint(1, 2), 1.0, rng.choice([None, T0 + timedelta(hours=10 * r + rng.randint(0, 9))]))
                listing += [row] * rng.randint(1, 2)
    got = history(spark.createDataFrame(manifest, M), spark.createDataFrame(listing, L), spark.createDataFrame([(r, None, None, c, s) for r, c, s in runs], R))
    assert {tuple(x) for x in got.where("was_pending").select("run_id", "source_path").collect()} == replay(manifest, listing, runs)


def test_empty_and_null_rows(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert history(e(M), e(L), e(R)).count() == 0
    odd = spark.createDataFrame([(1, None, 1, 1.0, T0), (None, "a", 1, 1.0, T0), (1, "b", None, None, None)], L)
    rows = history(e(M), odd, e(R)).collect()
    assert [(r["source_path"], r["was_pending"], r["state"]) for r in rows] == [("b", True, "pending")]


ITEMS = "source_path string, size_bytes long, modified_time double"
HOUR = timedelta(hours=1)


def files(spark, *x):
    return spark.createDataFrame(list(x), ITEMS)


def states(ledger):
    return {r["source_path"]: r["state"] for r in ledger.items().collect()}


def test_leases_fence_stale_writers(spark, tmp_path):
    ledger = Ledger(Store(spark, f"{tmp_path}/ledger"))
    ledger.observe(files(spark, ("a", 1, 1.0), ("b", 1, 1.0), (None, 1, 1.0)))
    mine, token = ledger.lease(T0, T0 + HOUR)
    assert mine.count() == 2
    assert ledger.lease(T0, T0 + HOUR)[0].count() == 0
    again, newer = ledger.lease(T0 + 2 * HOUR, T0 + 3 * HOUR)  # the first lease ran out
    assert again.count() == 2 and newer > token
    ledger.commit(files(spark, ("a", 1, 1.0), ("b", 1, 1.0)), token, T0 + 2 * HOUR)
    assert set(states(ledger).values()) == {"leased"}
    ledger.commit(files(spark, ("a", 1, 1.0)), newer, T0 + 2 * HOUR)
    assert states(ledger) == {"a": "done", "b": "leased"}
    ledger.observe(files(spark, ("a", 1, 1.0), ("b", 2, 1.0)))
    assert states(ledger) == {"a": "done", "b": "pending"}
    ledger.observe(files(spark, ("b", 2, 1.0)), complete=True)
    assert states(ledger) == {"b": "pending"}


def test_a_writer_between_read_and_write_is_not_lost(spark, tmp_path, monkeypatch):
    """A (token 1) reads the state; B takes the expired lease; A's commit must then be rejected."""
    store = Store(spark, f"{tmp_path}/ledger")
    a, b = Ledger(store), Ledger(Store(spark, f"{tmp_path}/ledger"))
    a.observe(files(spark, ("x", 1, 1.0)))
    _, one = a.lease(T0, T0 + HOUR)
    plain, taken = store.write, []

    def late(tables, base=None, whole=False):
        if not taken:  # A has read; before it writes, B leases
            taken.append(b.lease(T0 + 2 * HOUR, T0 + 3 * HOUR)[1])
        return plain(tables, base, whole)

    monkeypatch.setattr(store, "write", late)
    a.commit(files(spark, ("x", 1, 1.0)), one, T0 + HOUR / 2)
    row = b.items().first()
    assert (row["state"], row["token"]) == ("leased", taken[0])


def test_only_the_next_version_is_published(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    base = store.current()
    store.write({"t": spark.range(1)}, base)
    with pytest.raises(Conflict):
        store.write({"t": spark.range(2)}, base)
    assert store.table("t").count() == 1


@pytest.mark.parametrize("rename", [False, True])
@pytest.mark.parametrize("step", ["write", "link", "after"])
def test_a_crash_anywhere_locks_nothing(spark, tmp_path, monkeypatch, step, rename):
    store = Store(spark, f"{tmp_path}/s")
    if rename:
        monkeypatch.setattr(Store, "_local", lambda self: None)
    store.write({"t": spark.range(1)})

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if step == "write":  # data is there, the version is not
            m.setattr(Store, "_publish", die)
        elif step == "link":  # killed before the atomic step
            m.setattr(Store, "_publish_by_rename", die) if rename else m.setattr("lutrin.sources.store.os.link", die)
        else:  # killed after it: the version counts
            whole = Store._publish
            m.setattr(Store, "_publish", lambda self, v: (whole(self, v), die()))
        with pytest.raises(KeyboardInterrupt):
            store.write({"t": spark.range(2)})
    assert store.table("t").count() == (2 if step == "after" else 1)
    store.write({"t": spark.range(5)})
    assert store.table("t").count() == 5
    with pytest.raises(Conflict):
        store.write({"t": spark.range(6)}, store.version(1))


def test_changed_items_lose_their_lease_and_forced_ones_are_pending(spark, tmp_path):
    ledger = Ledger(Store(spark, f"{tmp_path}/ledger"))
    ledger.observe(files(spark, ("a", 1, 1.0), ("b", 1, 1.0)))
    _, token = ledger.lease(T0, T0 + HOUR)
    ledger.observe(files(spark, ("a", 2, 1.0), ("b", 1, 1.0)))
    assert states(ledger) == {"a": "pending", "b": "leased"}
    with pytest.raises(Fenced):
        ledger.commit(files(spark, ("a", 1, 1.0), ("b", 1, 1.0)), token, T0, {"t": spark.range(1)})
    ledger.renew(token, T0, T0 + 5 * HOUR)
    ledger.commit(files(spark, ("b", 1, 1.0)), token, T0 + 4 * HOUR, {"t": spark.range(1)})
    assert states(ledger) == {"a": "pending", "b": "done"} and ledger.store.table("t").count() == 1
    ledger.observe(files(spark, ("b", 1, 1.0)).withColumn("force", F.lit(True)))
    assert states(ledger)["b"] == "pending"
    _, again = ledger.lease(T0, T0 + HOUR)
    ledger.release(again)
    assert set(states(ledger).values()) == {"pending"}


def test_output_path_depends_on_the_version_only(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("a", 2, 1.0)], "p string, s long, t double")
    paths = [r[0] for r in df.select(output_path("/out", F.col("p"), F.col("s"), F.col("t"))).collect()]
    assert paths[0] == paths[1] != paths[2]
