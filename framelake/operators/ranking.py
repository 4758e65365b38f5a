"""Exact ranking: filter first, score what is left, keep the best k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, literal
from .filters import KEY
from .sequence import numbered

RRF_K = 60


def top_k(rows: DataFrame, k: int, score: str = "score", key: Sequence[str] = KEY) -> DataFrame:
    """The k best rows, ties by key; plans as TakeOrderedAndProject."""
    return rows.orderBy(F.desc(score), *key).limit(k)


def rank_vectors(vectors: DataFrame, query: Sequence[float] | Column, k: int, candidates: DataFrame | None = None, key: Sequence[str] = KEY, vector: str = "vec", digits: int | None = None) -> DataFrame:
    """Exact top-k by inner product: over all rows (candidates None), or over the candidates alone, which are joined first.

    Candidates are never a filter after a pool was cut, so k rows come back if
    the candidates have as many.
    """
    rows = vectors if candidates is None else vectors.join(candidates, list(key), "left_semi")
    score = dot(F.col(vector), query if isinstance(query, Column) else literal(query))
    return top_k(rows.withColumn("score", score if digits is None else F.round(score, digits)), k, key=key)


def ranks(rows: DataFrame, score: str = "score", key: Sequence[str] = KEY, by: Sequence[str] = ()) -> DataFrame:
    """rank from 1 in the order of top_k. Without ``by`` the rows must be a bounded pool (they meet in one task)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *key)))


def reciprocal_rank_fusion(pools: Sequence[DataFrame], k: int, key: Sequence[str] = KEY, constant: int = RRF_K, digits: int | None = None) -> DataFrame:
    """Sum of 1 / (constant + rank) over ranked pools, best k first.

    Other columns come from the first pool that has the row. Ties: first pool,
    rank in it, key. Pools are top-k results, so bounded.
    """
    tagged = [ranks(p, key=key).withColumn("pool", F.lit(i)) for i, p in enumerate(pools)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    others = [c for c in rows.columns if c not in (*key, "score", "rank", "pool")]
    score = F.sum(F.lit(1.0) / (constant + F.col("rank")))
    fused = rows.groupBy(*key).agg(
        (score if digits is None else F.round(score, digits)).alias("score"),
        F.min(F.struct("pool", "rank")).alias("first"),
        *[F.min_by(c, F.struct("pool", "rank")).alias(c) for c in others],
    )
    return fused.orderBy(F.desc("score"), "first.pool", "first.rank", *key).limit(k).drop("first")


def backfill(filtered: DataFrame, unfiltered: DataFrame, k: int, score: str = "score", key: Sequence[str] = KEY) -> DataFrame:
    """At most k rows: the filtered ones, then the best unfiltered ones that aren't among them, marked is_backfill.

    Backfilled rows stay behind the others whatever is boosted later.
    """
    own = top_k(filtered, k, score, key).withColumn("is_backfill", F.lit(False))
    more = top_k(unfiltered, k, score, key).join(own.select(*key), list(key), "left_anti").withColumn("is_backfill", F.lit(True))
    return own.unionByName(more, allowMissingColumns=True).orderBy("is_backfill", F.desc(score), *key).limit(k)


def max_per_group(rows: DataFrame, group: Sequence[str], k: int, order: Sequence[Column | str]) -> DataFrame:
    """The first k rows of each group."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def calibrated(rows: DataFrame, columns: Sequence[str], how: str = "minmax") -> DataFrame:
    """Scores on one scale: ``minmax`` or ``percent_rank``, as c_name. Least and greatest values are scalar subqueries; percent ranks come from numbered values."""
    for c in columns:
        if how == "minmax":
            low, high = rows.agg(F.min(c)).scalar(), rows.agg(F.max(c)).scalar()
            rows = rows.withColumn(f"c_{c}", F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0))
        else:
            first = numbered(rows.select(F.col(c).alias("_v")), ["_v"]).groupBy("_v").agg(F.min("position").alias("_first"))
            others = rows.agg(F.count("*") - 1).scalar()
            placed = rows.join(first, F.col(c).eqNullSafe(F.col("_v")), "left")
            rows = placed.withColumn(f"c_{c}", F.when(others > 0, F.col("_first") / others).otherwise(0.0)).drop("_v", "_first")
    return rows


def combined(columns: Sequence[str], weight: float = 0.7) -> Column:
    """(1 - weight) * mean + weight * min: a frame has to meet all parts."""
    parts = F.array(*columns)
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / len(columns)
    return mean * (1 - weight) + F.array_min(parts) * weight


def combine_and(columns: Sequence[str], how: str, weight: float = 0.7, temperature: float = 10.0) -> Column:
    """Other ways to ask for all parts: product, min, softmin, penalty (mean - weight * (1 - min))."""
    parts = F.array(*columns)
    if how == "product":
        return F.aggregate(parts, F.lit(1.0), lambda a, x: a * x)
    if how == "min":
        return F.array_min(parts)
    if how == "softmin":
        return -F.log(F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.exp(-x * temperature))) / temperature
    if how == "penalty":
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / len(columns) - weight * (1 - F.array_min(parts))
    raise ValueError(how)


def by_parts(rows: DataFrame, parts: Sequence[str], k: int, key: Sequence[str] = KEY) -> DataFrame:
    """Rows that are among the k best of any part (a score column), for a closer look at all their parts.

    Each part's pool is a top-k of its own, so what one part misses another may bring.
    """
    pools = [top_k(rows.select(*key, F.col(p).alias("score")), k, key=key).select(*key) for p in parts]
    return rows.join(reduce(lambda a, b: a.unionByName(b), pools).distinct(), list(key), "left_semi")


def grounded_options(rows: DataFrame, k: int, vector: str = "vec", seed: int = 11, key: Sequence[str] = KEY) -> DataFrame:
    """(key, option, likeness): rows in k clusters of their vectors, most like its centre first in each: options to choose from that all exist."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    held = rows.select(*key, vector, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="option").fit(held)
    centres = F.array(*[literal([float(x) for x in c]) for c in model.clusterCenters()])
    placed = model.transform(held)
    return placed.withColumn("likeness", dot(F.col(vector), F.element_at(centres, F.col("option") + 1))).select(*key, "option", "likeness")


def comb_sum(pools: Sequence[tuple[str, DataFrame]], key: Sequence[str] = KEY, times_sources: bool = False) -> DataFrame:
    """CombSUM, or CombMNZ with ``times_sources``; source_scores maps each source to its part."""
    rows = reduce(lambda a, b: a.unionByName(b), [p.select(*key, "score").withColumn("source", F.lit(n)) for n, p in pools])
    score = F.sum("score") * (F.count("*") if times_sources else F.lit(1))
    return rows.groupBy(*key).agg(score.alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "score")))).alias("source_scores"))


def beliefs(rows: DataFrame, score: str = "score") -> DataFrame:
    """belief: each row's share of all scores."""
    return rows.withColumn("belief", F.col(score) / rows.agg(F.sum(score)).scalar())


def entropy(belief: str = "belief") -> Column:
    """An aggregate: the entropy of beliefs in bits."""
    p = F.col(belief)
    return -F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def diverse(rows: DataFrame, k: int, vector: str = "vec", score: str = "score", mu: float = 0.7, pool: int = 1000, key: Sequence[str] = ()) -> list:
    """Maximal marginal relevance over the ``pool`` best rows, on the driver: the chosen rows in order.

    Each turn updates one number a row (its likeness to the chosen), so the work is k * pool.
    """
    import numpy as np

    found = top_k(rows, pool, score, key).collect()
    if not found:
        return []
    vectors, scores = np.array([r[vector] for r in found], dtype=float), np.array([r[score] for r in found], dtype=float)
    chosen, nearest, free = [], np.zeros(len(found)), np.ones(len(found), dtype=bool)
    while free.any() and len(chosen) < k:
        value = np.where(free, mu * scores - (1 - mu) * (nearest if chosen else 0), -np.inf)
        best = int(value.argmax())
        free[best] = False
        alike = vectors @ vectors[best]
        nearest = alike if not chosen else np.maximum(nearest, alike)
        chosen.append(found[best])
    return chosen
