"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample of the distinct vectors by balanced splits. Every vector is indexed: in the list of its nearest centroid
and, where it lies near a boundary, in those of others that are nearly as near. A query searches the centroids through
a graph held in memory, and scans the lists whose centroid is within a ratio of the nearest one's distance.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import stored


@dataclass(frozen=True)
class Plan:
    #: Distinct vectors the centroids are fitted on, those of least hash; and the most centroids, which bounds what is broadcast.
    sample: int = 50_000
    most_lists: int = 16_384
    #: Vectors a list should hold: half the square root of their number, between these; beyond most_lists, more.
    list_size: tuple[int, int] = (16, 192)
    #: No list may hold over so many times its share of the sample's distinct vectors.
    balance: float = 2.0
    #: A vector goes to up to `copies` lists whose centroid is within 1 + `boundary` of its nearest one's distance.
    copies: int = 4
    boundary: float = 0.12
    #: A query scans lists within 1 + `reach` of the nearest centroid's distance: between `least` and twice as many times
    #: the square root of their number.
    reach: float = 0.35
    least: float = 2.0
    #: Neighbours of a centroid in the graph.
    degree: int = 24
    #: Vectors and queries that meet in one task: a list or a query set beyond is split.
    block: int = 1024
    seed: int = 5

    def lists(self, n: int, distinct: int) -> int:
        low, high = self.list_size
        return max(1, min(self.most_lists, round(n / min(high, max(low, math.sqrt(n) / 2))), distinct))

    def probes(self, lists: int) -> tuple[int, int]:
        least = min(lists, math.ceil(self.least * math.sqrt(lists)))
        return least, min(lists, 2 * least)


class Centroids:
    """Centroids and the graph of their nearest neighbours."""

    def __init__(self, points: np.ndarray, degree: int) -> None:
        self.points, self.norms = points, (points**2).sum(1)
        links: list[set[int]] = [set() for _ in points]
        for at in range(0, len(points), 512):
            d = self.norms[None, :] - 2 * points[at : at + 512] @ points.T
            near = np.argsort(d, axis=1, kind="stable")[:, : degree + 1]
            for i, row in enumerate(near.tolist(), at):
                links[i].update(j for j in row if j != i)
                for j in row:
                    if j != i:
                        links[j].add(i)
        self.links = [np.array(sorted(x), np.int64) for x in links]
        self.entry = list(range(0, len(points), max(1, len(points) // 16)))

    def search(self, q: np.ndarray, keep: int) -> list[tuple[float, int]]:
        """The `keep` nearest centroids found by best-first search, as (squared distance, number), nearest first."""
        seen = np.zeros(len(self.points), bool)
        base = float(q @ q)

        def far(ids: np.ndarray) -> np.ndarray:
            return np.maximum(self.norms[ids] - 2 * self.points[ids] @ q + base, 0)

        start = np.array(self.entry)
        seen[start] = True
        todo = [(d, int(i)) for d, i in zip(far(start).tolist(), start, strict=True)]
        heapq.heapify(todo)
        best = [(-d, -i) for d, i in heapq.nsmallest(keep, todo)]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) == keep and d > -best[0][0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            for d, j in zip(far(new).tolist(), new.tolist(), strict=True):
                if len(best) < keep or d < -best[0][0]:
                    heapq.heappush(todo, (d, j))
                    heapq.heappush(best, (-d, -j))
                    if len(best) > keep:
                        heapq.heappop(best)
        return sorted((-d, -i) for d, i in best)


def halves(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of x in two equal halves along its widest direction."""
    y = x - x.mean(0)
    v = np.random.default_rng(seed).standard_normal(x.shape[1])
    for _ in range(8):
        v = y.T @ (y @ v)
        v /= np.linalg.norm(v) or 1
    order = np.argsort(y @ v, kind="stable")
    return order[: len(x) // 2], order[len(x) // 2 :]


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c**2).sum(1) - 2 * x[at : at + 2048] @ c.T).argmin(1) for at in range(0, len(x), 2048)])


def balanced_centroids(x: np.ndarray, lists: int, seed: int, balance: float = 2.0) -> np.ndarray:
    """About `lists` centroids, to none of which over `balance` times its share of the distinct vectors of x is nearest.

    The sample is split in equal halves, again and again; then rounds of k-means follow, after each of which lists that are
    too full are halved again and those with very few vectors are given up to their neighbours. Equal vectors count once,
    and no centroid is left without vectors or where another one is: many in one place would fill up a query's share of
    lists with lists that hold nothing.
    """
    x = np.unique(x, axis=0)
    parts = [np.arange(len(x))]
    while len(parts) < lists:
        parts.sort(key=len)
        rows = parts.pop()
        if len(rows) < 2:
            parts.append(rows)
            break
        parts += [rows[h] for h in halves(x[rows], seed + len(parts))]
    c = np.stack([x[p].mean(0) for p in parts])
    share = len(x) / lists
    for again in range(24):
        near = closest(x, c)
        n = np.bincount(near, minlength=len(c))
        full = np.flatnonzero(n > max(1, balance * share))
        if again >= 4 and not len(full):
            break
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        means = total / np.maximum(n, 1)[:, None] if again < 4 else c  # later rounds only split
        stay = n > (share / 4 if again < 4 else 0)
        stay[full] = False
        split = [x[rows[h]].mean(0) for i in full for rows in [np.flatnonzero(near == i)] for h in halves(x[rows], seed + i)]
        c = np.unique(np.concatenate([means[stay], np.array(split).reshape(-1, x.shape[1])]), axis=0)
    return np.unique(c[np.bincount(closest(x, c), minlength=len(c)) > 0], axis=0)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more component, which makes the largest inner product the least distance whatever the vectors' lengths."""
    rest = np.sqrt(np.maximum(top**2 - (x**2).sum(1), 0))
    return np.concatenate([x, rest[:, None]], 1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>), one row for each vec_id, the least of its vectors.

    Without null ids and vectors that are null, empty, zero or not wholly finite numbers.
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, plan: Plan | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors found with the largest inner product with each query.

    Both inputs have vec_id and embedding. A query's own vec_id is no candidate of it; scores are inner products of
    the original vectors in double precision, ties go to the smaller vec_id, and there are fewer than k rows only if
    there are fewer candidates. Rows that are null in either column, zero vectors and vectors with null or non-finite
    components take no part, nor do vectors of another length than the commonest (of equally common ones, the longest).
    Of several vectors of one vec_id the least counts, component by component. Vectors are placed in lists scaled by a
    power of two; scores come from the vectors as they are. Where that overflows, the score is that of the scaled ones
    scaled back, which may be infinite; infinite scores are in the order of those. Equal vectors
    under different ids are all found alike; other columns take no part; an empty table gives an empty table.
    """
    plan = plan or Plan()
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    points = stored(usable(vectors), "vectors")
    sizes = points.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], out)
    largest = F.array_max(F.transform("v", F.abs))
    power = math.frexp(points.filter(F.size("v") == common.d).agg(F.max(largest)).first()[0])[1]

    halved = [2.0 ** (-power // 2), 2.0 ** (-power - -power // 2)]  # 2 ** -power may be no double

    def scaled(column: pa.Array) -> np.ndarray:
        """With no component over one."""
        return np.ldexp(matrix(column), -power)

    points, asked = (df.filter(F.size("v") == common.d) for df in (points, usable(queries)))
    square = F.aggregate(F.transform("v", lambda x: x * halved[0] * halved[1]), F.lit(0.0), lambda s, x: s + x * x)
    size = points.agg(F.count("*").alias("n"), F.max(square).alias("top")).first()
    top = math.sqrt(size.top)
    picked = points.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(plan.sample)  # the bounded sample
    sample = lifted(np.ldexp(np.array([r.v for r in picked.toLocalIterator()]), -power), top)
    centroids = balanced_centroids(sample, plan.lists(size.n, len(sample)), plan.seed, plan.balance)
    lists = len(centroids)
    least, most = plan.probes(lists)
    shared = spark.sparkContext.broadcast(Centroids(centroids, plan.degree))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                if not part.num_rows:
                    continue
                x = lifted(scaled(part.column("v")), top)
                d = np.maximum(graph.norms + (x**2).sum(1)[:, None] - 2 * x @ graph.points.T, 0)
                near = np.argpartition(d, min(plan.copies, lists) - 1, axis=1)[:, : plan.copies]
                near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
                far = np.take_along_axis(d, near, 1)
                row, col = (np.sqrt(far) <= (1 + plan.boundary) * np.sqrt(far[:, :1])).nonzero()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near[row, col]), part.column("vec_id").take(pa.array(row)), part.column("v").take(pa.array(row))],
                    ["list", "vec_id", "v"],
                )

    postings = stored(points.mapInArrow(place, "list long, vec_id long, v array<double>"), "postings")
    sizes_of = {r["list"]: r["n"] for r in postings.groupBy("list").agg(F.count("*").alias("n")).collect()}  # bounded by most_lists

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for batch in batches:
            row, number = [], []
            x = scaled(batch.column("v")) if batch.num_rows else np.zeros((0, 1))
            # a query is as long as the longest vector: its own length changes no order
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(norm > 0, norm, 1) * top
            for i, q in enumerate(np.concatenate([x, np.zeros((len(x), 1))], 1)):
                keep, found = most, []
                while True:
                    found = graph.search(q, keep)
                    edge = (1 + plan.reach) * math.sqrt(found[0][0])
                    chosen = [j for n, (d, j) in enumerate(found) if n < least or math.sqrt(d) <= edge]
                    # copies of the query itself and of vectors in several lists count for nothing new
                    if sum(sizes_of.get(j, 0) for j in chosen) >= plan.copies * (k + 1) or keep >= lists:
                        break
                    keep = min(lists, keep * 2)
                    if keep == lists:
                        chosen = list(range(lists))
                        break
                row += [i] * len(chosen)
                number += chosen
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int64()), batch.column("vec_id").take(at), batch.column("v").take(at)], ["list", "vec_id", "v"]
            )

    probes = stored(asked.mapInArrow(probe, "list long, vec_id long, v array<double>"), "probes")
    asks = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}
    cells = [(i, math.ceil(n / plan.block), math.ceil(asks.get(i, 0) / plan.block)) for i, n in sizes_of.items() if i in asks]
    dealt = F.broadcast(spark.createDataFrame(cells or [(-1, 1, 1)], "list long, parts int, asks int"))
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = postings.join(dealt, "list").select("list", mine("parts").alias("part"), upto("asks").alias("ask"), "vec_id", "v")
    right = probes.join(dealt, "list").select("list", upto("parts").alias("part"), mine("asks").alias("ask"), "vec_id", "v")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        """The k best of a block of a list for each query of a block."""
        if not a.num_rows or not b.num_rows:
            kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64(), "beyond": pa.float64()}
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        x, y = (matrix(t.column("v").combine_chunks()) for t in (a, b))
        ids, q = (t.column("vec_id").to_numpy() for t in (a, b))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        beyond = np.zeros((len(q), len(ids)))
        with np.errstate(over="ignore", invalid="ignore"):
            scores = np.einsum("qd,vd->qv", y, x)
            over = ~np.isfinite(scores)
            if over.any():
                small = np.einsum("qd,vd->qv", *(np.ldexp(m, -power) for m in (y, x)))
                scores[over] = np.ldexp(np.ldexp(small[over], power), power)
                beyond = np.where(np.isinf(scores), small, 0)
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -beyond, -scores), axis=1)
        own = np.take_along_axis(q[:, None] == ids[None, :], order, 1)
        best = np.take_along_axis(order, np.argsort(own, axis=1, kind="stable"), 1)[:, :k]  # a query's own row comes last
        row, col = (np.take_along_axis(q[:, None] == ids[None, :], best, 1) == 0).nonzero()
        at = best[row, col]
        return pa.table({"query_id": q[row], "vec_id": ids[at], "score": scores[row, at], "beyond": beyond[row, at]})

    met = (
        left.groupBy("list", "part", "ask").cogroup(right.groupBy("list", "part", "ask"))
        .applyInArrow(meet, "query_id long, vec_id long, score double, beyond double")
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("beyond").alias("beyond"))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")  # at most k rows a list scanned
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_posting_lists(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
