"""Ranked lexical search: tries of documents' term vectors, searched by branch and bound for each item.

Documents are restricted to the terms that items have. A task takes a slice of these vectors, orders each by how frequent
its terms are, and makes a trie of them in which equal beginnings share a path. Every subtree knows the greatest count of
each term, the least m and the least doc_id in it, so what an item could score there at most is known without a look at
its documents. The search goes depth first, the best subtree first, and leaves out those that can't reach the item's best
so far. Where a subtree has few documents, or its documents' vectors are equal in all terms, they are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.shingles import plain
from strandloom.llm.text import slices
from strandloom.session import stored

#: Fixed values of the score, and how many documents an item gets.
BASE, SLOPE, TOP = 100, 50, 50
#: Terms of items that go to tasks at once, counted for each item; more items are searched block by block.
BLOCK_TERMS = 500_000
#: Subtrees of so many documents aren't divided further. A trie has so many entries of vectors, or one document.
LEAF, TRIE_ENTRIES = 64, 2_000_000
#: A task's share of vectors' entries, and how many tasks' results are merged at once.
TASK_ENTRIES, MERGED = 1_000_000, 64
#: Characters of text taken at once.
SLICE_CHARS = 6_000_000


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for i, t in zip(batch.column("item_id").to_pylist(), plain(batch.column("text").to_pylist()), strict=True):
                found = set(t.split())
                ids += [i] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    rows = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id long, term binary").distinct()


def vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tf) of each row that has a term: all its terms counted in n, those among `terms` by their place there."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        size = max(len(place), 1)
        for batch in batches:
            held = batch.column("text").to_pylist()
            for first, end in slices(held, SLICE_CHARS):
                words = [t.split() for t in plain(held[first:end])]
                n = np.fromiter(map(len, words), np.int64, len(words))
                at = np.fromiter(map(place.get, chain.from_iterable(words), repeat(-1)), np.int64, int(n.sum()))
                key, tf = np.unique((np.repeat(np.arange(len(n)), n) * size + at)[at >= 0], return_counts=True)
                ends = np.searchsorted(key, np.arange(len(n) + 1) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % size, tf)]
                part = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"]
                )
                yield part.filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def frequencies(held: DataFrame, size: int) -> np.ndarray:
    """In how many rows of vectors each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in held.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def gain(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score; more for greater tf, less for greater m."""
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Trie:
    """Documents in the order of their paths; a node is a run of them that share a beginning. Node 0 is the root."""

    def __init__(self, doc_id: np.ndarray, m: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, leaf: int = LEAF):
        """term holds places in the order of frequency, ascending in each document: entries ends[i] to ends[i + 1]."""
        paths = [term[a:b].astype(">u4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        size = np.diff(ends)[order]
        self.ends = np.append(0, np.cumsum(size))
        entry = np.repeat(ends[:-1][order] - self.ends[:-1], size) + np.arange(self.ends[-1])
        self.doc_id, self.m, self.term, self.tf = doc_id[order], m[order], term[entry], tf[entry]
        self._divide(size, leaf)
        self._sum_up()

    def _divide(self, size: np.ndarray, leaf: int) -> None:
        lo, hi, parent = [np.zeros(1, np.int64)], [np.array([len(size)])], [np.array([-1])]
        runs = np.array([[0, 0, len(size)]])  # node, first and end of those that may be divided further
        depth, nodes = 0, 1
        while len(runs := runs[runs[:, 2] - runs[:, 1] > leaf]):
            node, first, end = runs.T
            length = end - first
            doc = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
            has = size[doc] > depth
            step = np.where(has, self.term[np.minimum(self.ends[doc] + depth, max(len(self.term) - 1, 0))], -1)
            of = np.repeat(np.arange(len(runs)), length)
            new = np.append(True, (step[1:] != step[:-1]) | (of[1:] != of[:-1]))
            at = np.flatnonzero(new)
            begins, ends = doc[at], np.append(doc[at[1:] - 1], doc[-1]) + 1
            above = of[at]
            same = ends - begins == length[above]  # one child alone: the path goes on in the same node
            made = np.where(same, node[above], nodes + np.cumsum(~same) - 1)
            lo.append(begins[~same])
            hi.append(ends[~same])
            parent.append(node[above][~same])
            nodes += int((~same).sum())
            runs = np.stack([made, begins, ends], 1)[step[at] >= 0]  # a path that ended isn't divided
            depth += 1
        self.lo, self.hi, self.parent = np.concatenate(lo), np.concatenate(hi), np.concatenate(parent)
        # children stand side by side, as each level is made from the runs in order
        self.inner = np.zeros(nodes, bool)
        self.inner[self.parent[1:]] = True
        order = np.argsort(self.parent[1:], kind="stable") + 1
        self.child = order
        self.children = np.searchsorted(self.parent[order], np.arange(nodes + 1))

    def _sum_up(self) -> None:
        """Each subtree's least m, least doc_id and greatest tf of every term, the last by term."""
        nodes = len(self.lo)
        leaves = np.flatnonzero(~self.inner)
        leaves = leaves[np.argsort(self.lo[leaves])]
        least = lambda x: np.minimum.reduceat(x, self.lo[leaves])
        self.least_m, self.least_doc = np.full(nodes, 2**62), np.full(nodes, 2**63 - 1)
        self.least_m[leaves], self.least_doc[leaves] = least(self.m), least(self.doc_id)
        width = int(self.term.max(initial=0)) + 1
        doc_leaf = np.repeat(leaves, self.hi[leaves] - self.lo[leaves])
        key, tf = greatest(np.repeat(doc_leaf, np.diff(self.ends)) * width + self.term, self.tf)
        found = [(key, tf)]
        rank = self.parent.copy()  # a node's depth among nodes: children are numbered after their parents
        rank[0] = 0
        for i in range(1, nodes):
            rank[i] = rank[self.parent[i]] + 1
        carried = {int(d): ([], []) for d in np.unique(rank)}
        level = rank[key // width]
        for d in carried:
            carried[d][0].append(key[level == d])
            carried[d][1].append(tf[level == d])
        for d in sorted(carried, reverse=True):
            here = np.flatnonzero(rank == d)
            if d == 0:
                break
            np.minimum.at(self.least_m, self.parent[here], self.least_m[here])
            np.minimum.at(self.least_doc, self.parent[here], self.least_doc[here])
            key, tf = (np.concatenate(x) for x in carried[d])
            key, tf = greatest(self.parent[key // width] * width + key % width, tf)
            found.append((key, tf))
            carried[d - 1][0].append(key)
            carried[d - 1][1].append(tf)
        key, tf = greatest(np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found]))
        term, node = key % width, key // width
        order = np.argsort(term, kind="stable")
        self.at_node, self.most_tf = node[order], tf[order]
        self.by_term = np.searchsorted(term[order], np.arange(width + 1))

    def bounds(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What each subtree's documents score at most."""
        known = terms < len(self.by_term) - 1
        terms, weight = terms[known], weight[known]
        a, b = self.by_term[terms], self.by_term[terms + 1]
        n = b - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        node = self.at_node[at]
        out = np.zeros(len(self.lo), np.int64)
        np.add.at(out, node, gain(np.repeat(weight, n), self.most_tf[at], self.least_m[node]))
        return out

    def scores(self, node: int, weight_of: np.ndarray) -> np.ndarray:
        """Of a node's documents; weight_of is 0 for terms that the item lacks."""
        lo, hi = self.lo[node], self.hi[node]
        a, b = self.ends[lo], self.ends[hi]
        weight = weight_of[self.term[a:b]]
        some = np.flatnonzero(weight)
        doc = np.searchsorted(self.ends[lo : hi + 1], a + some, "right") - 1
        out = np.zeros(hi - lo, np.int64)
        np.add.at(out, doc, gain(weight[some], self.tf[a + some], self.m[lo + doc]))
        return out


def greatest(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the greatest value of each."""
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[new], np.maximum.reduceat(value, new)


class Best:
    """The best documents of one item so far: greater scores first, then smaller doc_ids."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.doc_id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def may_gain(self, bound: int, least_doc: int) -> bool:
        if bound <= 0 or self.top < 1:
            return False
        if len(self.score) < self.top or bound > self.score[-1]:
            return True
        return bound == self.score[-1] and least_doc < self.doc_id[-1]

    def add(self, score: np.ndarray, doc_id: np.ndarray) -> None:
        good = score > (0 if len(self.score) < self.top else self.score[-1] - 1)
        if good.any():
            score, doc_id = np.append(self.score, score[good]), np.append(self.doc_id, doc_id[good])
            order = np.lexsort((doc_id, -score))[: self.top]
            self.score, self.doc_id = score[order], doc_id[order]


def searched(trie: Trie, terms: np.ndarray, weight: np.ndarray, weight_of: np.ndarray, best: Best) -> int:
    """Go through the trie for one item, depth first; how many documents were scored."""
    bound = trie.bounds(terms, weight)
    stack, looked_at = [0], 0
    while stack:
        node = stack.pop()
        if not best.may_gain(bound[node], trie.least_doc[node]):
            continue
        if trie.inner[node]:
            below = trie.child[trie.children[node] : trie.children[node + 1]]
            stack += below[np.argsort(bound[below], kind="stable")].tolist()  # the last is the next
        else:
            best.add(trie.scores(node, weight_of), trie.doc_id[trie.lo[node] : trie.hi[node]])
            looked_at += int(trie.hi[node] - trie.lo[node])
    return looked_at


def _found(held: DataFrame, wanted: list[tuple[int, np.ndarray]], df: np.ndarray, n: int, length: int, top: int) -> DataFrame:
    """(item_id, doc_id, score, task): each task's best documents for each item."""
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(df), np.int64)
    rank[order] = np.arange(len(df))
    weight = np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)[order]
    shared = held.sparkSession.sparkContext.broadcast([(i, np.sort(rank[t])) for i, t in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best = [Best(top) for _ in shared.value]
        weight_of = np.zeros(len(weight), np.int64)
        for trie in tries(batches):
            for (_, terms), b in zip(shared.value, best, strict=True):
                weight_of[terms] = weight[terms]
                searched(trie, terms, weight[terms], weight_of, b)
                weight_of[terms] = 0
        task = TaskContext.get().partitionId()
        ids = np.repeat([i for i, _ in shared.value], [len(b.score) for b in best]).astype(np.int64)
        columns = [np.concatenate([np.zeros(0, np.int64), *[getattr(b, x) for b in best]]) for x in ("doc_id", "score")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), *map(pa.array, columns), pa.array(np.full(len(ids), task), pa.int32())], ["item_id", "doc_id", "score", "task"]
        )

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[Trie]:
        for batch in batches:
            size = np.diff(batch.column("terms").offsets.to_numpy())
            first = 0
            while first < batch.num_rows:
                end = first + max(1, int(np.searchsorted(np.cumsum(size[first:]), TRIE_ENTRIES, "right")))
                part = pa.record_batch(batch.slice(first, end - first))
                lists = [part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tf")]
                n_terms = part.column("n").to_numpy()
                m = BASE - SLOPE + SLOPE * n_terms * n // max(length, 1)
                ends = np.append(0, np.cumsum(size[first:end]))
                term = rank[lists[0]]
                inside = np.lexsort((term, np.repeat(np.arange(end - first), np.diff(ends))))
                yield Trie(part.column("doc_id").to_numpy(), m, ends, term[inside], lists[1][inside])
                first = end

    return held.select("doc_id", "n", "terms", "tf").mapInArrow(run, "item_id long, doc_id long, score long, task int")


def ranked(found: DataFrame, tasks: int, top: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of what tasks found, merged some tasks at a time."""
    best = F.row_number().over(Window.partitionBy("item_id", "task").orderBy(F.desc("score"), "doc_id"))
    while tasks > 1:
        found = found.withColumn("task", F.expr(f"task div {MERGED}").cast("int"))
        found = found.withColumn("rank", best).filter(F.col("rank") <= top)
        tasks = -(-tasks // MERGED)
    if "rank" not in found.columns:
        found = found.withColumn("rank", best)
    return found.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the `top` rows of docs that score highest, above 0, ties by doc_id.

    Terms are the runs of digits, letters and characters beyond ASCII, A-Z lower-cased. Null and empty texts have none; docs
    without terms count for nothing and are never found, items without terms find nothing. Rows with a null doc_id
    count for the statistics but aren't found; rows with a null item_id are left out; rows that share an item_id are
    one item with all their terms; repeated rows of docs are ranked one by one; other columns take no part; an empty table on
    either side gives an empty table; texts are whole.
    """
    spark = docs.sparkSession
    wanted = stored(item_terms(items), "terms")
    blocks = max(1, -(-wanted.count() // block_terms))
    out = []
    for block in range(blocks):
        here = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("item_id"), blocks) == block)
        rows = here.collect()  # about block_terms rows; an item's terms stay together
        terms = sorted({bytes(r.term) for r in rows})
        place = {t: i for i, t in enumerate(terms)}
        of: dict[int, list[int]] = {}
        for r in rows:
            of.setdefault(r.item_id, []).append(place[bytes(r.term)])
        held = stored(vectors(docs, terms), "vectors")
        n, length, entries = held.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first()
        df = frequencies(held, len(terms))
        tasks = max(spark.sparkContext.defaultParallelism, -(-(entries or 0) // TASK_ENTRIES))
        some = held.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).coalesce(tasks)
        found = _found(some, [(i, np.array(t)) for i, t in sorted(of.items())], df, n, length or 0, top)
        out.append(ranked(found, tasks, top))
    return out[0] if blocks == 1 else _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = stored(parts[0], "found")
    for p in parts[1:]:
        out = out.unionByName(stored(p, "found"))
    return out


def op13_document_fp_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP13_SQL = r"""
with side as (select 'd' as side, doc_id as id, text from documents union all select 'i', item_id, text from benchmark),
w as (select side, id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) as t from side),
i as (select distinct id, t from w where side = 'i'),
d as materialized (select id, t, count(*) as tf from w where side = 'd' group by id, t),
n as materialized (select id, sum(tf)::bigint as n from d group by id),
a as (select count(*) as n, sum(n)::bigint as l from n),
f as (select t, floor(1000 * ln((2 * a.n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from d, a group by t, a.n),
m as (select id, 50 + (50 * n.n * a.n) // a.l as m from n, a),
s as (select i.id as item_id, d.id as doc_id, sum(f.w * ((1000000000 * d.tf) // (1000 * d.tf + 20 * m.m)))::bigint as score
      from i join d using (t) join f using (t) join m on m.id = d.id group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 50
"""
