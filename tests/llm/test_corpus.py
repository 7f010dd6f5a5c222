import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lutrin.llm import mixing, neardup, packing, tokens

CHUNKS = "chunk_ord long, content string, rep string"


def corpus(seed=0, n=40):
    rng = random.Random(seed)
    words = [f"mot{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = rng.choices(words, k=rng.randint(25, 60))
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            edit = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(edit))
                edit[at : at + rng.randint(0, 1)] = [rng.choice(words)]
            rows.append(edit)
    texts = [" ".join(r) for r in rows]
    return [(i, t, "x") for i, t in enumerate(texts + texts[:5] + ["court", "", None])]


def jaccard(a, b, run):
    cut = lambda t: [w for w in t.lower().replace("\n", " ").split(" ") if w]
    s, t = (set(zip(*[cut(x)[i:] for i in range(run)])) for x in (a, b))
    return len(s & t) / len(s | t) if s | t else 0


def pairs_of(rows, threshold, run):
    long = [(i, t) for i, t, _ in rows if t and len(t.split()) >= 20]
    return {(a, b) for k, (a, s) in enumerate(long) for b, t in long[k + 1 :] if jaccard(s, t, run) >= threshold}


@pytest.mark.parametrize("block", [1000, 2])
def test_all_pairs_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus()
    pairs, members = neardup.similar(spark.createDataFrame(rows, CHUNKS), 0.6, 3, 20, "chunk_ord", "content")
    of = defaultdict(list)
    for r in members.collect():
        of[r["rep"]].append(r["id"])
    got = {(min(a, b), max(a, b)) for r in pairs.collect() for a in of[r["rep_a"]] for b in of[r["rep_b"]]} | {(a, b) for m in of.values() for a in m for b in m if a < b}
    assert got == pairs_of(rows, 0.6, 3)


@pytest.mark.parametrize("hot", [10**9, 30])
def test_a_probe_shared_by_many_texts(spark, monkeypatch, hot):
    """A third of the texts share boilerplate and so probe values: many more than a block, dealt to many parts."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "HOT_TEXTS", hot)
    monkeypatch.setattr(neardup, "SAMPLE", 2)
    rng = random.Random(6)
    plate = [f"plan{i}" for i in range(30)]
    rows = [(i, " ".join(plate + [f"mot{rng.randrange(900)}" for _ in range(rng.randint(6, 14))]), "x") for i in range(60)]
    rows += [(100 + i, " ".join(f"seul{rng.randrange(900)}" for _ in range(30)), "x") for i in range(60)]
    rows += [(200 + i, rows[i][1] + " fin", "x") for i in range(60)]
    sketch = neardup.sketches(spark.createDataFrame(rows, CHUNKS), "chunk_ord", "content", 3, 20)
    probes = [[i, i + 1] for i in range(0, 60, 2)]
    got = {tuple(r) for r in neardup.candidates(sketch, probes, 0.6).collect()}
    sets = {r["id"]: r for r in sketch.collect()}
    most = neardup.BITS * 0.2 + neardup.SIGMAS * math.sqrt(neardup.BITS * 0.2 * 0.8)
    want = set()
    for a in sets.values():
        for b in sets.values():
            if a["id"] < b["id"] and any(a["symbols"][p[0] : p[0] + 2] == b["symbols"][p[0] : p[0] + 2] for p in probes) and min(a["runs"], b["runs"]) >= 0.6 * max(a["runs"], b["runs"]):
                apart = sum(((a[k] ^ b[k]) & (2**64 - 1)).bit_count() for k in ("b0", "b1"))
                if apart <= most:
                    want.add((a["id"], b["id"]))
    assert got == want and len(want) > 500
    pairs, _ = neardup.similar(spark.createDataFrame(rows, CHUNKS), 0.6, 3, 20, "chunk_ord", "content")
    near, true = {(r["rep_a"], r["rep_b"]) for r in pairs.collect()}, pairs_of(rows, 0.6, 3)
    # So many pairs stand just at the threshold that some of the one in a thousand are among them.
    assert near <= true and len(true - near) <= 0.01 * len(true)


def test_copies_of_a_text_in_very_many_rows(spark, monkeypatch):
    rows = [(i, "même texte" if i % 3 == 0 else f"texte {i % 7}", "x") for i in range(60, 0, -1)] + [(3, "même texte", "x"), (None, "même texte", "x"), (99, None, "x")]
    df = spark.createDataFrame(rows, CHUNKS)
    want = {tuple(r) for r in neardup.copies(df, "chunk_ord", "content").collect()}
    monkeypatch.setattr(neardup.scale, "HOT_ROWS", 10)
    assert {tuple(r) for r in neardup.copies(df, "chunk_ord", "content").collect()} == want
    assert {r for i, r in want if i % 3 == 0} == {3} and len(want) == 60


@pytest.mark.parametrize("hot_rows", [2_000_000, 10])
def test_copies_of_many_texts_are_joined(spark, monkeypatch, hot_rows):
    """More texts with copies than are broadcast: the same ids, and texts in one row stand for themselves."""
    rows = [(i, f"texte {i % 40}" if i % 3 else f"seul {i}", "x") for i in range(200, 0, -1)] + [(4, "texte 5", "x"), (7, "texte 7", "x"), (None, "texte 1", "x"), (999, None, "x")]
    df = spark.createDataFrame(rows, CHUNKS)
    least = {}
    for i, t, _ in rows:
        if i is not None and t is not None:
            least[t] = min(i, least.get(t, i))
    want = sorted({(i, least[t]) for i, t, _ in rows if i is not None and t is not None})
    assert sorted(tuple(r) for r in neardup.copies(df, "chunk_ord", "content").collect()) == want
    monkeypatch.setattr(neardup, "MOST_COPIED", 0)
    monkeypatch.setattr(neardup.scale, "HOT_ROWS", hot_rows)
    assert sorted(tuple(r) for r in neardup.copies(df, "chunk_ord", "content").collect()) == want


@pytest.mark.parametrize("group", [1, 40, 30_000])
def test_runs_and_symbols_of_many_texts_at_once(monkeypatch, group):
    """No run crosses from one text into the next, and every set and sketch is as if its text were alone."""
    monkeypatch.setattr(neardup, "GROUP", group)
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 30))) for _ in range(60)] + ["", "a", "a b", "a b c", "a a a a a", "  a\n\nb  c ", "A B C", "été \udc80 x y"]
    number = lambda w: int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    a, b = (x.tolist() for x in neardup._hashes())

    def mixed(h):
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> shift)) * by % 2**32
        return h >> 24

    for least, run in ((0, 3), (5, 5), (20, 3)):
        got = {}
        for at, runs, ends in neardup.Shingler(run).groups(texts, least):
            symbols = neardup._symbols(runs, ends).tolist() if least >= run else [None] * len(at)
            got |= {i: (runs[p:q].tolist(), s) for i, p, q, s in zip(at, ends, ends[1:], symbols)}
        want = {}
        for i, t in enumerate(texts):
            words = [w for w in t.lower().replace("\n", " ").split(" ") if w]
            if len(words) < least:
                continue
            found = set()
            for k in range(len(words) - run + 1):
                h = 0
                for w in words[k : k + run]:
                    h = (h ^ number(w)) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                found.add(h)
            want[i] = (sorted(found), [mixed(min((((h >> 32) * x + y) % 2**32) for h in found)) for x, y in zip(a, b)] if least >= run else None)
        assert got == want and len(got) > 10


def test_texts_alone_with_a_value_are_not_gathered(spark):
    rows = [(1, 10, None), (2, 10, None), (3, 11, None), (4, 12, 2), (5, 12, 2), (6, 13, 9), (7, 14, None), (9, 14, None), (8, 14, None)]
    each = spark.createDataFrame(rows, "rep long, probe long, parts long").selectExpr("struct(rep) AS t", "probe", "parts")
    got = {(r["t"]["rep"], r["place"]) for r in neardup._together(each.withColumn("part", F.lit(0)), F.lit(False)).collect()}
    assert got == {(1, 0), (2, 1), (4, 0), (5, 1), (7, 0), (8, 1), (9, 2)}
    # Of a value that was dealt to parts, even a text alone in its part is kept.
    got = {r["t"]["rep"] for r in neardup._together(each.withColumn("part", F.coalesce(F.col("t.rep") % F.col("parts"), F.lit(0))), F.col("parts").isNotNull()).collect()}
    assert got == {1, 2, 4, 5, 6, 7, 8, 9}


def test_classes_are_components(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9), (7, 8, 0.9)], "rep_a long, rep_b long, similarity double")
    members = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4, 5, 7, 8)] + [(9, 5)], "id long, rep long")
    got = {r["id"]: (r["class_id"], r["links"]) for r in neardup.classes(pairs, members).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 2), 4: (1, 1), 5: (5, 0), 9: (5, 0), 7: (7, 1), 8: (7, 1)}


def test_allocation_bounds_the_miss():
    for t in (0.6, 0.8):
        for n in (10**3, 10**9):
            widths = neardup.allocate(n, {r: (n**2) * 0.03**r for r in neardup.WIDTHS}, t)
            miss = 1.0
            for r in widths:
                miss *= 1 - t**r
            assert miss <= neardup.MISS * 1.01


@pytest.mark.parametrize("alike", [0.3, 0.4])
def test_allocation_counts_symbols_used_again(alike):
    # A third of the rows shares boilerplate: wide partitions, more symbols than there are.
    n = 150_000
    widths = neardup.allocate(n, {r: n**2 / 18 * alike**r for r in neardup.WIDTHS}, 0.6)
    assert sum(widths) > neardup.SYMBOLS and neardup.missed(widths, 0.6) <= neardup.MISS
    agree = np.random.default_rng(1).random((50_000, neardup.SYMBOLS)) < 0.6
    found = np.zeros(len(agree), bool)
    for p in neardup.partitions(widths):
        found |= agree[:, p].all(axis=1)
    assert 1 - found.mean() <= 1.5 * neardup.MISS  # three standard deviations of the simulation
    assert abs(neardup.missed([3] * 9, 0.6) - (1 - 0.6**3) ** 9) < 1e-12


def test_empty_tables(spark):
    empty = spark.createDataFrame([], CHUNKS)
    pairs, members = neardup.similar(empty, 0.6, 3, 20, "chunk_ord", "content")
    assert pairs.count() == 0 == members.count() and neardup.classes(pairs, members).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([1, 5, 10, 64, 512])
    counts = {rng.randint(1, cap): rng.randint(1, 30) for _ in range(rng.randint(0, 40))}
    steps, total = packing.plan(counts, cap)
    fill, placed, by = Counter(), Counter(), defaultdict(list)
    for s in steps:
        by[s[0]].append(s)
    for size, mine in by.items():
        for (_, first, container, each), nxt in zip(mine, [*[m[1] for m in mine[1:]], counts[size]]):
            for r in range(first, nxt):
                fill[container + (r - first) // each] += size
                placed[size] += 1
    assert placed == Counter(counts) and len(fill) == total and max(fill.values(), default=0) <= cap
    large = sum(n for s, n in counts.items() if 2 * s > cap)
    assert total <= max(large, 1.6 * sum(s * n for s, n in counts.items()) / cap + 2)


@pytest.mark.parametrize("hot_rows", [2_000_000, 5])
def test_pack_keeps_texts_whole(spark, hot_rows):
    sizes = [(i % 30, n) for i, n in enumerate([3] * 40 + [7, 50, 20, 20, 0, None, 10, 5, 5])]
    packs = spark.createDataFrame([("s", 10), ("m", 20), ("m", 20), (None, 5), ("bad", 0)], "pack_name string, capacity_tokens int")
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id long, tokens long"), packs, "doc_id", hot_rows).collect()
    total = sum(n or 0 for _, n in sizes)
    for name, cap in (("s", 10), ("m", 20)):
        mine = [r for r in rows if r["pack_name"] == name]
        fill = Counter()
        for r in mine:
            fill[r["container"]] += r["tokens"]
        assert sum(fill.values()) == total and max(fill.values()) <= cap
        assert len(mine) == sum(-(-n // cap) for _, n in sizes if n)
    assert {r["pack_name"] for r in rows} == {"s", "m"}


@pytest.mark.parametrize("hot_rows", [2_000_000, 50])
def test_mix_reaches_the_shares(spark, hot_rows):
    rng = random.Random(2)
    docs = [(i, s, rng.randint(1, 9), 0.05 + rng.random()) for i, s in enumerate(["Big"] * 900 + ["small "] * 30 + [None] * 5 + ["other"] * 9)] + [(9999, "big", 0, 1.0)]
    targets = [("big", 0.7, 1), ("SMALL", 0.25, 4), ("absent", 0.05, 2)]
    chosen, shares = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, tokens long, weight double"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), "doc_id", hot_rows=hot_rows)
    rows = chosen.collect()
    assert max(r["copies"] for r in rows if r["source"] == "small") == 4 and {r["copies"] for r in rows if r["source"] == "big"} == {1}
    got = {r["source"]: r["actual_share"] for r in shares.collect()}
    assert abs(got["big"] - 0.7 / 0.95) < 0.02 and abs(got["small"] - 0.25 / 0.95) < 0.02 and got["absent"] == 0
    again, _ = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, tokens long, weight double"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), "doc_id", hot_rows=10**9)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}


def test_mix_of_nothing_and_a_fixed_total(spark):
    d, t = "doc_id long, source string, tokens long, weight double", "source string, target_share double, max_repeats int"
    chosen, shares = mixing.mix(spark.createDataFrame([], d), spark.createDataFrame([("a", 1.0, 1)], t), "doc_id")
    assert chosen.count() == 0 and shares.first()["actual_share"] == 0
    chosen, shares = mixing.mix(spark.createDataFrame([(i, "a", 10, 1.0) for i in range(5)], d), spark.createDataFrame([("a", 1.0, 2)], t), "doc_id", total=500)
    assert {r["copies"] for r in chosen.collect()} == {2} and shares.first()["taken"] == 100


def test_mix_uses_the_corpus_beside_a_scarce_source(spark):
    d, t = "doc_id long, source string, tokens long, weight double", "source string, target_share double, max_repeats int"
    docs = [(i, "big", 10, 1.0) for i in range(399)] + [(1000 + i, "middle", 10, 1.0) for i in range(100)] + [(2000, "scarce", 10, 1.0)]
    targets = [("big", 0.5, 1), ("middle", 0.4, 3), ("scarce", 0.1, 2), ("absent", 0.0, 2)]
    chosen, shares = mixing.mix(spark.createDataFrame(docs, d), spark.createDataFrame(targets, t), "doc_id", total=mixing.AVAILABLE)
    got = {r["source"]: (r["budget"], r["taken"], r["most_copies"]) for r in shares.collect()}
    assert got == {"big": (2500, 2500, 1), "middle": (2000, 2000, 2), "scarce": (500, 20, 2), "absent": (0, 0, 0)}
    assert sum(r["tokens"] * r["copies"] for r in chosen.collect()) == 4520
    actual = {r["source"]: r["actual_share"] for r in shares.collect()}
    assert actual == {"big": round(2500 / 4520, 6), "middle": round(2000 / 4520, 6), "scarce": round(20 / 4520, 6), "absent": 0}


def test_queries_mix_the_whole_corpus(spark, tmp_path):
    # One short document of a wanted source must not take the mix to almost nothing.
    rows = [(i, "le mur de la commune est haut " * 20, "big") for i in range(40)] + [(99, "mot", "scarce")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.5, 1), ("scarce", 0.5, 2)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {r["source"]: r for r in mixing.p9_shares(spark, str(tmp_path)).collect()}
    assert got["big"]["taken"] >= 0.45 * got["big"]["available"] and got["scarce"]["most_copies"] == 2


def test_long_texts_count_like_short_ones():
    text = "La règle fixe la hauteur maximale. " * 9000
    whole = tokens._encoding(tokens.VOCABULARY).encode_ordinary(text)
    assert tokens.count(text) == len(whole) and tokens.count("") == 0 == tokens.count(None)
