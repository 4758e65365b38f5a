"""Exact top-k inner products by the three-phase uniform threshold.

A vector's dimensions are cut into ``lists`` slices; the score of a row is the
sum of its slice scores. For one block of queries at a time (a bounded
broadcast), over all rows where they lie:

1. Each task gathers, for every query and slice, its local list of the best
   slice scores (4k), and reports the k best exact totals among those rows and the
   greatest score of each slice.
2. The k-th best reported total, tau, is a safe cutoff: k rows reach it. It is
   broadcast with the slices' greatest scores. A task computes the first slice
   only and collects the pairs of row and query whose score is at least the
   threshold of that slice, tau less what the other slices can add at most.
3. The remaining scores of the collected pairs are resolved where the rows lie,
   slice by slice, and pairs that can't reach tau any more go. So do rows that k
   rows of the same task beat: a vector with many copies sends k of them.

All arithmetic is on integers: in float64 while every sum stays below 2**53,
else with Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

RESULT = "query_id bigint, vec_id bigint, score bigint"
REPORT = "query_id bigint, salt int, best array<bigint>, most array<bigint>"
_CHUNK_ROWS = 1024
#: A product of whole matrices is so many times as fast for a pair as a sum for that pair alone.
_DENSE = 40
#: A local list has so many times k rows: the longer, the higher the cutoff.
_DEPTH = 4
_LONG = 2**63 - 1


def _clipped(x) -> int:
    return max(-_LONG - 1, min(_LONG, int(x)))


def quantised(rows: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * component) of the rows whose key and components are all present and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(key).cast("bigint").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v")
    )


def _matrix(values, width: int, exact: bool) -> np.ndarray:
    """Rows as a matrix; shorter vectors end in zeros."""
    out = np.zeros((len(values), width), dtype=np.float64 if exact else object)
    if exact and isinstance(values, pa.Array):
        sizes = np.diff(values.offsets.to_numpy())
        flat = values.flatten().to_numpy(zero_copy_only=False)
        if len(sizes) and (sizes == width).all():
            return flat.reshape(len(values), width).astype(np.float64)
        at = 0
        for i, n in enumerate(sizes):
            out[i, :n] = flat[at : at + n]
            at += n
        return out
    for i, v in enumerate(values.to_pylist() if isinstance(values, pa.Array) else values):
        out[i, : len(v)] = v
    return out


class _Block:
    """A block of queries, as tasks see it."""

    def __init__(self, ids: list[int], vectors: list[list[int]], width: int, exact: bool, k: int, lists: int):
        order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
        self.ids = np.array(ids, dtype=np.int64)[order]
        self.q = _matrix([vectors[i] for i in order], width, exact)
        self.k, self.exact, self.width = k, exact, width
        cuts = np.linspace(0, width, max(1, min(lists, width)) + 1).astype(int)
        self.slices = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.low = -np.inf if exact else -(10**60)

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, the rows' matrix and the mask of rows that are a query's own."""
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
            for a in range(0, len(ids), _CHUNK_ROWS):
                own_ids = ids[a : a + _CHUNK_ROWS]
                yield own_ids, _matrix(vectors.slice(a, _CHUNK_ROWS), self.width, self.exact), own_ids[:, None] == self.ids[None, :]

    def scores(self, v: np.ndarray, j: int) -> np.ndarray:
        """The scores of slice j: rows x queries."""
        return v[:, self.slices[j]].dot(self.q[:, self.slices[j]].T)

    def pair_scores(self, v: np.ndarray, j: int, r: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The scores of slice j of the pairs (r, q), r ascending."""
        rows, at = np.unique(r, return_inverse=True)
        if len(r) * _DENSE >= len(rows) * len(self.ids):
            return self.scores(v[rows], j)[at, q]
        return (v[r, self.slices[j]] * self.q[q, self.slices[j]]).sum(axis=1)

    def local_lists(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1, a task's part."""
        n, k, m = len(self.ids), self.k, len(self.slices)
        long = _DEPTH * k
        dtype = np.float64 if self.exact else object
        top = [np.full((0, n), self.low, dtype=dtype) for _ in range(m)]
        total = [np.full((0, n), self.low, dtype=dtype) for _ in range(m)]
        row = [np.zeros((0, n), dtype=np.int64) for _ in range(m)]
        most, seen = [np.full(n, self.low, dtype=dtype) for _ in range(m)], 0
        for ids, v, own in self.chunks(batches):
            scores = [self.scores(v, j) for j in range(m)]
            sums = sum(scores[1:], scores[0]).copy()
            sums[own] = self.low
            rows = np.broadcast_to(np.arange(seen, seen + len(ids))[:, None], sums.shape)
            seen += len(ids)
            for j, s in enumerate(scores):
                s[own] = self.low
                most[j] = np.maximum(most[j], s.max(axis=0))
                all_top, all_total, all_row = np.vstack([top[j], s]), np.vstack([total[j], sums]), np.vstack([row[j], rows])
                if len(all_top) > long:
                    keep = np.argpartition(all_top, len(all_top) - long, axis=0)[-long:] if self.exact else np.argsort(all_top, axis=0)[-long:]
                    all_top, all_total, all_row = (np.take_along_axis(x, keep, axis=0) for x in (all_top, all_total, all_row))
                top[j], total[j], row[j] = all_top, all_total, all_row
        if not seen:
            return
        rows, totals = np.vstack(row), np.vstack(total)
        order = np.argsort(rows, axis=0, kind="stable")
        rows, totals = np.take_along_axis(rows, order, axis=0), np.take_along_axis(totals, order, axis=0)
        totals[1:][rows[1:] == rows[:-1]] = self.low
        totals = -np.sort(-totals, axis=0)[:k]
        best = [[_clipped(x) for x in totals[:, i] if x != self.low] for i in range(n)]
        salt = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays(
            [pa.array(self.ids), pa.array([salt] * n, pa.int32()), pa.array(best, pa.list_(pa.int64())), pa.array([[None if x[i] == self.low else _clipped(x[i]) for x in most] for i in range(n)], pa.list_(pa.int64()))],
            names=["query_id", "salt", "best", "most"],
        )

    def collected(self, cutoff: dict[int, tuple[int | None, list[int | None]]]):
        """Phases 2 and 3, a task's part. cutoff: tau and the greatest slice scores of each query."""
        m = len(self.slices)
        dtype = np.float64 if self.exact else object
        tau, rest = np.full(len(self.ids), self.low, dtype=dtype), np.zeros((m, len(self.ids)), dtype=dtype)
        for i, q in enumerate(self.ids.tolist()):
            t, most = cutoff.get(q, (None, None))
            if t is None or None in most or max(t, *most) >= _LONG or min(t, *most) < -_LONG:  # too few rows, or clipped: no safe cutoff
                continue
            tau[i] = t
            for j in range(m):
                rest[j, i] = sum(most[j + 1 :])  # what the slices after this one add at most

        def best(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            q, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((ids, -score, q))
            q, ids, score = q[order], ids[order], score[order]
            starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
            return tuple(x[place < self.k] for x in (q, ids, score))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, held = [], 0
            for ids, v, own in self.chunks(batches):
                score = self.scores(v, 0)
                r, q = np.nonzero((score >= tau - rest[0]) & ~own)
                score = score[r, q]
                for j in range(1, m):
                    score = score + self.pair_scores(v, j, r, q)
                    open_ = (score >= tau[q] - rest[j, q]).astype(bool)
                    r, q, score = r[open_], q[open_], score[open_]
                if len(r):
                    found.append((q, ids[r], score))
                    held += len(r)
                if held > 1_000_000:
                    found = [best(found)]
                    held = min(held, len(found[0][0])) // 2
            if found:
                q, ids, score = best(found)
                score = [_clipped(x) for x in score]
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

        return run


def _cutoffs(reports: DataFrame, k: int, lists: int) -> dict[int, tuple[int | None, list[int | None]]]:
    """The k-th best reported total and greatest slice scores of each query; merged in two levels, so no list is long."""
    merged = reports
    for keys in (["query_id", "salt"], ["query_id"]):
        merged = merged.groupBy(*keys).agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best"),
            F.array(*[F.max(F.col("most")[j]) for j in range(lists)]).alias("most"),
        )
    return {r.query_id: (r.best[k - 1] if len(r.best) >= k else None, r.most) for r in merged.collect()}


def top_k_inner(
    spark: SparkSession, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024, lists: int = 2, block: int = 2048
) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score.

    Queries are the rows whose key is divisible by ``every``, in blocks of about
    ``block`` (the only vectors that reach the driver or are broadcast);
    candidates are all rows with another key. Ties go to the smaller key. Fewer
    than k candidates: all of them. Rows with a null key or vector, or null, NaN
    or infinite components, take no part; shorter vectors count as ending in
    zeros. Repeated rows are candidates each; a repeated query key is asked once,
    with its smallest vector. Components are saturated to 64 bits, scores too.
    No queries or an empty table: no rows. Other columns are ignored.
    """
    work = Workspace(spark, "topk")
    vectors = quantised(rows, key, vector, scale)
    queries = work.stage(vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    facts = vectors.select(F.size("v").alias("n"), F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))).alias("a")).agg(F.max("n"), F.max("a")).first()
    width, largest = facts[0] or 0, facts[1] or 0.0
    exact = largest * largest * max(width, 1) < 2**53
    blocks = -(-queries.count() // block)
    result = work.at("result")
    spark.createDataFrame([], RESULT).write.parquet(result)
    for b in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if not asked:
            continue
        held = spark.sparkContext.broadcast(_Block([r.vec_id for r in asked], [r.v for r in asked], width, exact, k, lists))
        n_lists = len(held.value.slices)
        cutoff = _cutoffs(vectors.mapInArrow(lambda it, held=held: held.value.local_lists(it), REPORT), k, n_lists)
        limits = spark.sparkContext.broadcast(cutoff)
        vectors.mapInArrow(lambda it, held=held, limits=limits: held.value.collected(limits.value)(it), RESULT).write.mode("append").parquet(result)
        held.unpersist()
        limits.unpersist()
    work.drop("queries")
    found = spark.read.schema(RESULT).parquet(result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
