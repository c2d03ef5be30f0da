"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves and each half is quantised by centroids of its
own, so K centroids a half make K * K cells.  A query walks the pairs of
centroids in order of the summed distance, here the negative inner products of
its halves, with a heap, until the cells it has passed hold its budget of entries.
The entries of these cells are reranked by the exact inner product.

K grows with the square root of the number n of entries, and the budget is
`effort` * n ** `growth`, less than in proportion to n, by the same rule at every
size; an infinite effort reranks every entry, which is the exact way.  What recall
a budget gives depends on the data: see the README.

Equal vectors are folded into one entry with its `k + 1` smallest ids before
anything else: more can never be among a query's k nearest, ties going to the
smaller id.  Entries and queries meet in blocks of bounded size, so a cell that
holds much of the data is spread over many tasks, and what a block pair returns is
k rows a query at most.  A query is sent to the blocks that hold a cell it has
passed, with the summed distance where its walk ended.

The centroids are fitted on a bounded sample (`sample_rows`); every vector is
indexed.  What is broadcast is the centroids and the number of entries of each
cell, both bounded by MAX_CENTROIDS.

Edge cases: vectors that are null, empty, zero, of another length than most, or
that hold null or non-finite components take no part, neither do null ids.
Repeated ids with equal vectors count once; an id with different vectors is as many
queries, told apart by query_hash, and none of its vectors is a neighbour of
another.  Fewer candidates than k give fewer rows.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import text as kernel
from tessera.llm.common import bounded_batches, persisted

#: Centroids of a half at most: reached at a million entries, from where on cells hold more.
MAX_CENTROIDS = 2048


@dataclass(frozen=True)
class Settings:
    k: int = 20
    #: Vectors that the centroids are fitted on, about, when there are more: those with the smallest hashes.
    sample_rows: int = 20_000
    #: Centroids of a half for each square root of the entries.
    fineness: float = 2.0
    #: Entries that a query reranks, at least: effort * n ** growth of n.
    effort: float = 1.35
    growth: float = 0.85
    #: Entries and queries of a block at most.
    block: int = 4_096
    queries: int = 1_024
    rounds: int = 12


@dataclass(frozen=True)
class Index:
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray  # entries by left and right centroid
    runs: np.ndarray  # number of each cell's run of blocks
    budget: float


def usable(vector: Column) -> Column:
    """Neither null, empty or zero, nor holding null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def entries(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """vector and ids: distinct vectors with their k + 1 smallest ids, in order."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    own = own.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).withColumn("h", F.xxhash64("vector"))  # -0.0 becomes 0.0
    # Many copies of one vector are first cut down within shares, then together.
    spread = own.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (["h", "vector", "share"], ["h", "vector"]):
        rank = F.dense_rank().over(Window.partitionBy(*by).orderBy("id"))
        spread = spread.withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank")
    return spread.groupBy("h", "vector").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("vector", "ids")


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T).argmin(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most k centroids; one that loses its points moves to a random point."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    out = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, out)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, column, k) for column in x.T], axis=1)
        out = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], x[rng.integers(len(x), size=k)])
    return out


def cells(index_left: np.ndarray, index_right: np.ndarray, x: np.ndarray) -> np.ndarray:
    half = index_left.shape[1]
    return _nearest(x[:, :half], index_left) * len(index_right) + _nearest(x[:, half:], index_right)


#: Neighbouring centroids of a half, by distance from the query, that a walk takes together.
SIDE = 8


def walk(index: Index, a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed distance up to which a query passes pairs of centroids, and the occupied cells up to there.

    a and b are the distances to the left and right centroids.  Pairs are taken in squares
    of SIDE by SIDE neighbours, by their lowest sum from a heap, until the squares hold the
    budget.  Their highest sum bounds the one where the budget is reached, which is
    then found among all pairs up to that bound; so the pairs passed are exactly those of
    the lowest sums.
    """
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[by_a], b[by_b]
    counts = index.counts[by_a].take(by_b, axis=1)
    if math.isinf(index.budget):
        i, j = np.nonzero(counts)
        return math.inf, by_a[i] * len(b) + by_b[j]
    first_a, first_b = np.arange(0, len(a), SIDE), np.arange(0, len(b), SIDE)
    squares = np.add.reduceat(np.add.reduceat(counts, first_b, axis=1), first_a, axis=0).tolist()
    rows, columns = a[first_a].tolist(), b[first_b].tolist()
    far_a, far_b = a[np.minimum(first_a + SIDE, len(a)) - 1].tolist(), b[np.minimum(first_b + SIDE, len(b)) - 1].tolist()
    heap = [(rows[0] + columns[0], 0, 0)]
    got, bound = 0, -math.inf
    while heap and got < index.budget:
        _, i, j = heapq.heappop(heap)
        got += squares[i][j]
        bound = max(bound, far_a[i] + far_b[j])
        if j + 1 < len(columns):
            heapq.heappush(heap, (rows[i] + columns[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(rows):
            heapq.heappush(heap, (rows[i + 1] + columns[0], i + 1, 0))
    sums = a[:, None] + b[None, :]
    i, j = np.nonzero((sums <= bound) & (counts > 0))
    sums, cells_of = sums[i, j], by_a[i] * len(b) + by_b[j]
    if got < index.budget:
        return math.inf, cells_of
    by = np.argsort(sums, kind="stable")
    cut = float(sums[by[np.searchsorted(np.cumsum(counts[i, j][by]), index.budget)]])
    return cut, cells_of[sums <= cut]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, is_query: Column, settings: Settings | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score and query_hash (of the query's vector): the nearest of all rows for each row where is_query holds (a column over `id`)."""
    s = settings or Settings()
    spark = bounded_batches(vectors).sparkSession
    found = entries(vectors, s.k, id_col, vector_col)
    width = found.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_hash long")
    if width is None:
        return empty
    found = persisted(found.where(F.size("vector") == width["w"]), "vectors")
    total = found.count()
    share = F.pmod(F.xxhash64("vector"), F.lit(1_000_003)) < 1_000_003 * s.sample_rows / max(1, total)
    sample = found.select("vector").where(share) if total > s.sample_rows else found.select("vector")
    x = _matrix(sample.toArrow().column(0).combine_chunks())
    half = max(1, x.shape[1] // 2)
    k = int(min(MAX_CENTROIDS, max(2, round(s.fineness * total**0.5))))
    left, right = kmeans(x[:, :half], k, s.rounds, 1), kmeans(x[:, half:], k, s.rounds, 2)
    centroids = spark.sparkContext.broadcast((left, right))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = cells(*centroids.value, _matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(1), batch.column(0)], names=["cell", "ids", "vector"])

    placed = persisted(found.mapInArrow(kernel.lean(place), "cell int, ids array<long>, vector array<double>"), "cells")
    counts = np.zeros((len(left), len(right)), np.int32)
    listed = placed.groupBy("cell").count().toArrow()  # MAX_CENTROIDS squared at most
    counts.ravel()[np.asarray(listed.column(0))] = np.asarray(listed.column(1))
    shared = spark.sparkContext.broadcast(Index(left, right, counts, _runs(counts.ravel(), max(1, -(-total // s.block))), s.effort * total**s.growth))

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            q = _matrix(batch.column(1))
            cuts, runs = [], []
            for a, b in zip(-(q[:, :half] @ index.left.T), -(q[:, half:] @ index.right.T), strict=True):
                cut, passed = walk(index, a, b)
                cuts.append(cut)
                runs.append(np.unique(index.runs[passed]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.float64()), pa.array(runs, pa.list_(pa.int32()))], names=["query_id", "vector", "cut", "runs"])

    asked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & is_query & usable(F.col("vector")) & (F.size("vector") == width["w"]))
    asked = persisted(asked.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).distinct(), "queries")
    number = asked.count()
    tasks = max(1, min(number, max(spark.sparkContext.defaultParallelism, -(-number // s.queries))))
    visits = asked.repartition(tasks).mapInArrow(kernel.lean(walks), "query_id long, vector array<double>, cut double, runs array<int>")

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            cell = np.asarray(batch.column(0))
            # A cell of more rows than a block is spread over parts.
            parts = np.maximum(1, -(-index.counts.ravel()[cell] // s.block)).astype(np.uint64)
            first = np.asarray(batch.column(1).flatten())[np.asarray(batch.column(1).offsets)[:-1] - batch.column(1).offsets[0].as_py()]
            part = kernel.mix(first.view(np.uint64)) % parts
            yield pa.RecordBatch.from_arrays([pa.array(index.runs[cell]), pa.array(part.astype(np.int32)), *batch.columns], names=["run", "part", "cell", "ids", "vector"])

    held = placed.mapInArrow(kernel.lean(to_runs), "run int, part int, cell int, ids array<long>, vector array<double>")
    held = held.groupBy("run", "part").agg(F.collect_list(F.struct("cell", "ids", "vector")).alias("held"))
    wanted = visits.withColumn("group", F.pmod(F.xxhash64("query_id", "vector"), F.lit(max(1, -(-number // s.queries)))))
    wanted = wanted.select(F.explode("runs").alias("run"), "group", F.struct("query_id", F.xxhash64("vector").alias("query_hash"), "cut", "vector").alias("query")).groupBy("run", "group").agg(F.collect_list("query").alias("wanted"))
    met = held.join(wanted, "run").select("held", "wanted").mapInArrow(kernel.lean(_reranker(centroids, s.k)), "query_id long, query_hash long, ids array<long>, scores array<double>")
    pairs = F.zip_with("ids", "scores", lambda i, x: F.struct((-x).alias("score"), i.alias("id")))
    best = met.groupBy("query_id", "query_hash").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, s.k).alias("best"))
    out = best.select("query_id", "query_hash", F.posexplode("best").alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.score")).alias("score"), "query_hash")


def _runs(counts: np.ndarray, groups: int) -> np.ndarray:
    """Number of each cell's run: consecutive cells with about as many entries together as every other run."""
    total = max(1, int(counts.sum()))
    return ((np.cumsum(counts) - counts) * groups // total).astype(np.int32)


def _reranker(centroids, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                held, wanted = (pa.RecordBatch.from_struct_array(batch.column(c)[i].values) for c in (0, 1))
                yield rerank(*centroids.value, held, wanted, k)

    return run


def rerank(left: np.ndarray, right: np.ndarray, held: pa.RecordBatch, wanted: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """Of each query of a block, the k best ids in the cells it has passed of the other block, without its own id."""
    x, q = _matrix(held.column("vector")), _matrix(wanted.column("vector"))
    half = left.shape[1]
    cell = np.asarray(held.column("cell"))
    (rows, row_of), (columns, column_of) = (np.unique(part, return_inverse=True) for part in (cell // len(right), cell % len(right)))
    a, b = -(q[:, :half] @ left[rows].T), -(q[:, half:] @ right[columns].T)
    cut = np.asarray(wanted.column("cut"))
    cut = cut + 1e-9 * np.maximum(1.0, np.abs(cut))  # the walk's sums may differ in the last digits
    ids_at = np.concatenate([[0], np.cumsum(np.asarray(held.column("ids").value_lengths()))])
    ids = np.asarray(held.column("ids").flatten())
    out_ids, out_scores = [], []
    query_ids = np.asarray(wanted.column("query_id"))
    for j in range(len(wanted)):
        own = np.flatnonzero(a[j][row_of] + b[j][column_of] <= cut[j])
        score = np.einsum("ij,j->i", x[own], q[j])
        if len(own) > k + 1:
            edge = np.partition(score, len(own) - k - 1)[len(own) - k - 1]
            best = score >= edge
            own, score = own[best], score[best]
        n = ids_at[own + 1] - ids_at[own]
        got = np.concatenate([np.zeros(0, np.int64), *(ids[ids_at[e] : ids_at[e + 1]] for e in own)])
        score = np.repeat(score, n)
        score, got = score[got != query_ids[j]], got[got != query_ids[j]]
        by = np.lexsort((got, -score))[:k]
        out_ids.append(got[by])
        out_scores.append(score[by])
    at = np.concatenate([[0], np.cumsum([len(g) for g in out_ids])]).astype(np.int32)
    column = lambda parts, kind: pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, kind), *parts])))
    return pa.RecordBatch.from_arrays([wanted.column("query_id"), wanted.column("query_hash"), column(out_ids, np.int64), column(out_scores, np.float64)], names=["query_id", "query_hash", "ids", "scores"])
