"""Operator 10: exact top-k search by Fagin's threshold algorithm.

Candidates are dealt to blocks of bounded size. In a block every dimension has a list of its candidates, sorted by that
dimension. For a query all lists are read from their better end (by the sign of the query's component), a stretch of
positions at a time; candidates seen for the first time get their full score; reading stops when the scores at the
positions read to sum to less than the k-th best score so far. A tie goes on, so the smaller id can still be found.

A block's lists are sorted once; the queries then pass by one after the other, so neither side is gathered in a task. One
block is searched first: a query's k-th best score there is the least that counts in the others, where reading stops as
soon as the bound is below it. Each block gives at most k rows a query; these are ranked once more. An exact search
sends every query to every block; blocks grow with the table, up to a bound, so there are few.

Defined results: vectors that are null, or hold a null or a non-finite component, take no part; vectors of different
length are never compared; a query is not compared with rows of its own id; equal scores are ranked by the smaller id. A
row that repeats is as many candidates, and as many queries, whose results are ranked together by the id, as are those
of one id with several vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tasks, written


class Block:
    """The lists of a block's candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")  # column j has the rows from the least component j on
        self.levels = np.take_along_axis(vectors, self.order, 0)

    def search(self, qid: int, q: np.ndarray, k: int, floor: int | None = None, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best for a query; with a ``floor``, of those at or above it."""
        ids, vectors, order, levels, n = self.ids, self.vectors, self.order, self.levels, len(self.ids)
        used = np.flatnonzero(q)
        down = q[used] > 0
        high, low = used[down], used[~down]
        seen = np.zeros(n, bool)
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, stretch = 0, step
        while at < n:
            to = min(n, at + stretch)
            if len(used):
                new = np.zeros(n, bool)
                new[order[n - to : n - at, high].ravel()] = True
                new[order[at:to, low].ravel()] = True
                rows = np.flatnonzero(new & ~seen)
            else:
                rows, to = np.arange(n), n
            seen[rows] = True
            rows = rows[ids[rows] != qid]
            best_s, best_i = np.concatenate([best_s, vectors[rows] @ q]), np.concatenate([best_i, rows])
            keep = np.lexsort((ids[best_i], -best_s))[:k]
            best_s, best_i = best_s[keep], best_i[keep]
            if to == n or seen.all():
                break
            bound = int(levels[n - to, high] @ q[high]) + int(levels[to - 1, low] @ q[low])
            if (len(best_s) == k and bound < best_s[-1]) or (floor is not None and bound < floor):
                break
            at, stretch = to, stretch * 2
        if floor is not None:
            best_i, best_s = best_i[best_s >= floor], best_s[best_s >= floor]
        return best_i, best_s


def _searched(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, times) from rows (block, width, vec_id, e, copies), queries with a floor besides."""
    both = candidates.select("block", "width", F.lit(0).alias("side"), "vec_id", "e", "copies", F.lit(None).cast("long").alias("floor"))
    both = both.unionByName(queries.select("block", "width", F.lit(1).alias("side"), "vec_id", "e", "copies", "floor"))
    both = both.repartition(tasks(candidates.sparkSession), "block", "width").sortWithinPartitions("block", "width", "side", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, copies, block = None, [], [], [], None
        for batch in batches:  # sorted: of each block first the candidates, then the queries
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "width", "side")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                number, width, side = key[a].tolist()
                own = part.column("vec_id").to_numpy()
                dense = part.column("e").flatten().to_numpy().reshape(len(own), width)
                if now != (number, width):
                    now, ids, vectors, copies, block = (number, width), [], [], [], None
                times = part.column("copies").to_numpy()
                if side == 0:
                    ids.append(own.copy())
                    vectors.append(dense.copy())
                    copies.append(times.copy())
                elif ids:
                    if block is None:
                        block, copies, vectors = Block(np.concatenate(ids), np.concatenate(vectors)), [np.concatenate(copies)], []
                    found = [block.search(i, q, k, f) for i, q, f in zip(own.tolist(), dense, part.column("floor").to_pylist(), strict=True)]
                    n, at = [len(x[0]) for x in found], np.concatenate([x[0] for x in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(block.ids[at]), pa.array(np.concatenate([x[1] for x in found])), pa.array(np.minimum(np.repeat(times, n) * copies[0][at], k).astype(np.int32))], ["query_id", "vec_id", "score", "times"])

    return both.mapInArrow(run, "query_id long, vec_id long, score long, times int")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, candidates: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of ``vectors`` (vec_id, embedding) for each row whose id is
    divisible by ``every``. ``candidates``: rows of a block; if not told, a 256th of all, from 4,096 to 65,536."""
    x = F.transform("e", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    bad = F.exists("e", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(~bad)
    # Rows that repeat are one until the end; they are summed up before they are shuffled.
    rows = written(rows.select("vec_id", F.size("e").alias("width"), x.alias("e")).groupBy("vec_id", "width", "e").agg(F.count("*").alias("copies")), vectors.sparkSession)
    n = rows.count()
    blocks = max(1, -(-n // (candidates or max(4096, min(65536, n // 256)))))
    left = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "e"), F.lit(blocks)))
    right = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    none = F.lit(None).cast("long").alias("floor")
    found = written(_searched(left.where("block = 0"), right.select("*", F.lit(0).cast("long").alias("block"), none), k), vectors.sparkSession)
    if blocks > 1:
        # Of an id with several vectors, too, k rows are at or above the least of its rows here.
        floors = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")).withColumnRenamed("query_id", "vec_id")
        others = right.join(floors, "vec_id", "left").withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(blocks - 1).cast("long"))))
        found = found.unionByName(_searched(left.where("block > 0"), others, k))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
