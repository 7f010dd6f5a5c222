"""BM25 leaders of very many texts at once: the best chunks of every distinct bag of words, exactly.

`lexical.top` meets every chunk with every query. Here the bags are one tree, the words of most bags at its root,
which is walked over one part of a task's chunks after the other: bags that share words share their sums, and
on the way down only those chunks are kept that can still reach the k-th best so far of some bag below, by
what the words left can give at most. Nothing is left out that could come in.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lutrin.functions.text import tokens
from lutrin.operators.lexical import K1, B, LexicalIndex
from lutrin.plans.scale import written

#: Chunks that a task begins with, chunks x words that it holds at once, and words of chunks that it gathers before.
FIRST, CELLS, POSTINGS_HELD = 1000, 6_000_000, 8_000_000
#: Chunks that one task works on, unless there are more tasks than that needs.
DOCS_A_TASK = 400_000
#: Distinct bags carried by one pass over the index; more take more passes.
BAGS = 120_000
#: Above what sums in another order may differ by, and half a unit of the ninth digit.
_NEAR = 2e-9


def bag(text: Column) -> Column:
    """The words of a text, sorted: texts with the same words have the same leaders."""
    return F.array_join(F.array_sort(tokens(F.coalesce(text, F.lit("")))), " ")


@dataclass(frozen=True)
class _Tree:
    """Distinct bags as a tree without nodes of one child, in depth-first order; words of no chunk are left out.

    items (word, times); chains: runs of items; of each node but the root its parent, its chain and its bag (-1: none)."""

    items: list[tuple[str, int]]
    chains: list[tuple[int, ...]]
    nodes: list[tuple[int, int, int]]
    root_bag: int
    stands_for: list[np.ndarray]


def _tree(bags: list[str], known: set[str]) -> _Tree:
    counted = lambda: (Counter(w for w in text.split(" ") if w in known) for text in bags)  # noqa: E731 (made twice: they are large)
    often = Counter(x for c in counted() for x in c.items())
    items = sorted(often, key=lambda x: (-often[x], x))
    at = {x: i for i, x in enumerate(items)}
    of: dict[tuple[int, ...], list[int]] = {}
    for n, c in enumerate(counted()):
        of.setdefault(tuple(sorted(at[x] for x in c.items())), []).append(n)
    paths = sorted(of)
    shared = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(paths, paths[1:])]
    # Depths at which later paths leave a path, at the first path that has the node.
    opened: list[list[int]] = [[] for _ in paths]
    open_ = [(0, 0)]
    for i in range(1, len(paths)):
        first = i - 1
        while open_[-1][0] > shared[i]:
            first = open_.pop()[1]
        if open_[-1][0] < shared[i]:
            open_.append((shared[i], first))
            opened[first].append(shared[i])
    number: dict[tuple[int, ...], int] = {}
    nodes, above = [], [(0, -1)]
    for i, path in enumerate(paths):
        while above[-1][0] > shared[i]:
            above.pop()
        for depth in sorted({*opened[i], len(path)} - {0}):
            chain = path[above[-1][0] : depth]
            nodes.append((above[-1][1], number.setdefault(chain, len(number)), i if depth == len(path) else -1))
            above.append((depth, len(nodes) - 1))
    return _Tree(items, list(number), nodes, 0 if paths and not paths[0] else -1, [np.array(of[p], np.int64) for p in paths])


class _Leaders:
    """The best k chunks of each bag so far (ords, scores: a row a bag). `add` takes further chunks."""

    def __init__(self, tree: _Tree, k: int):
        self.tree, self.k = tree, k
        self.ords, self.scores = np.full((len(tree.stands_for), k), -1, np.int64), np.full((len(tree.stands_for), k), -np.inf)
        self.use = [n for n, _ in Counter(c for _, c, _ in tree.nodes).most_common()]

    def _meet(self, bag: int, ords: np.ndarray, s: np.ndarray) -> None:
        k = self.k
        if len(s) > 4 * k:
            some = s >= np.partition(s, len(s) - k)[len(s) - k] - _NEAR
            ords, s = ords[some], s[some]
        if self.ords[bag, 0] >= 0:
            had = np.isfinite(self.scores[bag])
            ords, s = np.concatenate([ords, self.ords[bag][had]]), np.concatenate([s, self.scores[bag][had]])
        order = np.lexsort((-ords, -np.round(s, 9)))[:k]
        self.ords[bag, : len(order)], self.scores[bag, : len(order)] = ords[order], s[order]

    def add(self, ords: np.ndarray, gives: np.ndarray, term: list[int]) -> None:
        """gives: what each word (row) gives each chunk (column); term: the row of each item's word."""
        tree, n = self.tree, len(ords)
        times = [t for _, t in tree.items]

        def of(chain: tuple[int, ...], who: np.ndarray | None) -> np.ndarray:
            total = None
            for x in chain:
                row = gives[term[x]] if who is None else gives[term[x]].take(who)
                row = row if times[x] == 1 else row * times[x]
                total = row if total is None else total + row
            return total

        most = np.maximum(gives.max(axis=1), 0)
        ready = {c: of(tree.chains[c], None) for c in self.use[: max(1, CELLS // n)]}
        gain = [max(0.0, ready[c].max()) if c in ready else sum(most[term[x]] * times[x] for x in chain) for c, chain in enumerate(tree.chains)]
        # Below its least a chunk is in no result under the node, whatever the words there give it.
        enough = self.scores[:, -1].tolist()
        least = [enough[bag] if bag >= 0 else np.inf for _, _, bag in tree.nodes]
        for i in range(len(least) - 1, -1, -1):
            above, chain, _ = tree.nodes[i]
            if above >= 0 and least[i] - gain[chain] < least[above]:
                least[above] = least[i] - gain[chain]
        if tree.root_bag >= 0:
            self._meet(tree.root_bag, ords, np.zeros(n))
        path: list[tuple[int, np.ndarray | None, np.ndarray]] = [(-1, None, np.zeros(n))]
        for i, (above, chain, bag) in enumerate(tree.nodes):
            while path[-1][0] != above:
                path.pop()
            _, who, s = path[-1]
            if not len(s):
                path.append((i, who, s))
                continue
            row = ready.get(chain)
            s = s + (of(tree.chains[chain], who) if row is None else row if who is None else row.take(who))
            if least[i] > -np.inf:
                some = np.flatnonzero(s >= least[i] - _NEAR)
                if len(some) < len(s):
                    who, s = some if who is None else who.take(some), s.take(some)
            path.append((i, who, s))
            if bag >= 0 and len(s):
                some = slice(None)
                if least[i] < enough[bag]:
                    some = np.flatnonzero(s >= enough[bag] - _NEAR)
                    if not len(some):
                        continue
                self._meet(bag, ords[some] if who is None else ords[who[some]], s[some])


def _merged(k: int):
    """Joins the lists of one text from several blocks of chunks; rows come sorted by text."""

    def whole(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        lists = t.column("ords").combine_chunks() if t.column("ords").num_chunks != 1 else t.column("ords").chunk(0)
        text = np.repeat(t.column("text").to_numpy(), pc.list_value_length(lists).to_numpy())
        ords = lists.flatten().to_numpy()
        scores = t.column("scores").chunk(0).flatten().to_numpy()
        order = np.lexsort((-ords, -np.round(scores, 9), text))
        text, ords = text[order], ords[order]
        starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.array([], np.int64)
        rank = np.arange(len(text)) - np.repeat(starts, np.diff(np.r_[starts, len(text)]))
        text, ords = text[rank < k], ords[rank < k]
        starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else starts
        ends = pa.array(np.r_[starts, len(text)].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(text[starts]), pa.ListArray.from_arrays(ends, pa.array(ords))], ["text", "ords"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            text = t.column("text").to_numpy()
            end = int(np.searchsorted(text, text[-1]))  # the last text may go on in the next batch
            if end:
                yield whole(t.slice(0, end))
            held = t.slice(end)
        if held is not None:
            yield whole(held)

    return run


def top(ix: LexicalIndex, texts: DataFrame, k: int) -> DataFrame:
    """(bag, ords array<long>): the best k chunks of each distinct bag (see `bag`), in the order of `lexical.top`."""
    spark = texts.sparkSession
    nothing = spark.createDataFrame([], "bag string, ords array<long>")
    asked = written(texts.where("bag IS NOT NULL").select("bag").distinct(), "bags")
    passes = -(-asked.count() // BAGS)
    got = ix.stats.first()
    if not passes or not k or not got or not got["n"]:
        return nothing
    avgdl = float(got["avgdl"] or 0.0) or 1.0
    blocks = max(spark.sparkContext.defaultParallelism, -(-got["n"] // DOCS_A_TASK))

    def one(part: DataFrame) -> DataFrame:
        words = part.select(F.explode(F.split("bag", " ")).alias("term")).distinct().join(ix.terms, "term").select("term", "df", "idf").toArrow().to_pydict()
        bags = sorted(part.toArrow().column("bag").to_pylist())
        tree = _tree(bags, set(words["term"]))
        vocabulary, idf = pa.array(words["term"], pa.string()), np.array(words["idf"], np.float64)
        number = {w: i for i, w in enumerate(words["term"])}
        item_term = [number[w] for w, _ in tree.items]
        most = max(1, CELLS // max(1, len(idf)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaders, held, step, any_ = _Leaders(tree, k), [], FIRST, False

            def work() -> None:
                # The first chunks are few: what they reach is what later ones are measured by.
                nonlocal step
                ords, dl, row, term, tf = (np.concatenate(x) for x in zip(*held))
                held.clear()
                value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl)) * idf[term]
                at = 0
                while at < len(ords):
                    end = min(len(ords), at + min(step, most))
                    a, b = np.searchsorted(row, (at, end))
                    gives = np.zeros((max(1, len(idf)), end - at))
                    gives[term[a:b], row[a:b] - at] = value[a:b]
                    leaders.add(ords[at:end], gives, item_term)
                    at, step = end, min(step * 5, most)

            for b in batches:
                if not len(b):
                    continue
                any_, first = True, sum(len(x[0]) for x in held)
                lengths = pc.list_value_length(b.column(2)).to_numpy()
                term = pc.index_in(b.column(2).flatten(), value_set=vocabulary)
                hit = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
                row = np.repeat(np.arange(len(b), dtype=np.int32), lengths)[hit] + np.int32(first)
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), row, term.take(pa.array(hit)).to_numpy().astype(np.int32), b.column(3).flatten().to_numpy()[hit]))
                if first + len(b) >= most + FIRST * 6 or sum(len(x[2]) for x in held) >= POSTINGS_HELD:
                    work()
            if held:
                work()
            for at in range(0, len(tree.stands_for) if any_ else 0, 2000):
                of = tree.stands_for[at : at + 2000]
                each = np.repeat(np.arange(at, at + len(of)), [len(x) for x in of])
                ords, scores = leaders.ords[each], leaders.scores[each]
                there = np.isfinite(scores)
                ends = pa.array(np.cumsum(np.r_[0, there.sum(axis=1)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(of)), pa.ListArray.from_arrays(ends, pa.array(ords[there])), pa.ListArray.from_arrays(ends, pa.array(scores[there]))], ["text", "ords", "scores"])

        docs = ix.docs.select("chunk_ord", "dl", "terms", "tfs").coalesce(blocks)
        each = docs.mapInArrow(run, "text long, ords array<long>, scores array<double>")
        joined = each.repartition("text").sortWithinPartitions("text").mapInArrow(_merged(k), "text long, ords array<long>")
        names = spark.createDataFrame(pa.table({"text": pa.array(range(len(bags)), pa.int64()), "bag": pa.array(bags, pa.string())}))
        return written(joined.join(names, "text").select("bag", "ords"), "leaders")

    parts = [one(asked.where(F.pmod(F.xxhash64("bag"), F.lit(passes)) == i) if passes > 1 else asked) for i in range(passes)]
    return reduce(DataFrame.unionByName, parts)
