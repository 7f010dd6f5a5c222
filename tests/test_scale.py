import os
import random

from lutrin.plans.scale import buckets_for, rank_in_key, release, running, running_sum, scratch, written


def test_hot_keys_rank_like_plain_ones(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, float(rng.randint(0, 9)) if rng.random() > 0.1 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    plain = {tuple(r) for r in rank_in_key(df, "k", "v", "r", "t", {}).select("i", "r", "t").collect()}
    hot = {tuple(r) for r in rank_in_key(df, "k", "v", "r", "t", {"a": 200}, buckets=5).select("i", "r", "t").collect()}
    assert plain == hot
    for i, r, t in plain:
        k, _, v = rows[i]
        mine = [x[2] for x in rows if x[0] == k and x[2] is not None]
        assert (r, t) == ((1 + sum(x > v for x in mine), mine.count(v)) if v is not None else (None, None)) or v is None


def test_hot_running_sum(spark):
    rows = [("a", i, i % 7) for i in range(100)] + [("b", i, 1) for i in range(3)] + [(None, 1, 5)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    plain = {tuple(r) for r in running_sum(df, "k", "o", "v", "s", {}).collect()}
    assert plain == {tuple(r) for r in running_sum(df, "k", "o", "v", "s", {"a": 100}, buckets=7).collect()}
    assert ("a", 99, 1, sum(i % 7 for i in range(100))) in plain


def test_hot_last_values(spark):
    rng = random.Random(4)
    rows = [("ab"[i % 5 == 0], i, rng.choice([None, None, None, i])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    for down in (False, True):
        want = {tuple(r) for r in running(df, "k", "o", {}, lasts={"l": "v"}, descending=down).collect()}
        assert want == {tuple(r) for r in running(df, "k", "o", {"a": 96}, lasts={"l": "v"}, descending=down, buckets=6).collect()}
        for k, o, _, last in want:
            mine = [x[1:] for x in sorted(rows, key=lambda x: -x[1] if down else x[1]) if x[0] == k and (x[1] > o if down else x[1] < o)]
            assert last == next((v for _, v in reversed(mine) if v is not None), None)


def test_written_tables_have_an_owner(spark):
    kept = written(spark.range(3).toDF("i"), "kept")
    with scratch(spark):
        inner = written(spark.range(3).toDF("i"), "inner")
        paths = [p.removeprefix("file:") for df in (kept, inner) for p in df.inputFiles()]
        assert inner.count() == 3 and all(map(os.path.exists, paths))
    assert [os.path.exists(p) for p in paths] == [True] * (len(paths) - len(paths) // 2) + [False] * (len(paths) // 2)
    release(spark)
    assert not any(map(os.path.exists, paths))


def test_ranges_grow_with_the_rows():
    assert buckets_for(10) == 8 and buckets_for(10**12) == 10**6
