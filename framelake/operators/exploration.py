"""Operators around a search: finding what splits results, neighbourhood scores, two-stage search, bindings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, literal
from .filters import KEY
from .ranking import top_k
from .sequence import numbered


def zip_by_position(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """Rows of two tables side by side, by their places in their orders; ends with the shorter one."""
    return numbered(a, order_a).join(numbered(b, order_b), "position")


def require_same_keys(one: DataFrame, other: DataFrame, key: Sequence[str] = KEY) -> None:
    """An error that names a key if one table has keys that the other lacks."""
    for a, b in ((one, other), (other, one)):
        lost = a.select(*key).join(b.select(*key), list(key), "left_anti").first()
        if lost is not None:
            raise ValueError(f"only one of the tables has {tuple(lost)}")


def pilot_frames(pairs: DataFrame, rare: Sequence[str], n: int, order: Column, done: DataFrame | None = None) -> DataFrame:
    """n frames to try a model on: up to half of them allow a rare relation, the rest come in ``order`` (a hash)."""
    rows = pairs if done is None else pairs.join(done, KEY, "left_anti")
    frames = rows.groupBy(*KEY).agg(F.max(F.arrays_overlap("allowed_relations", F.array(*map(F.lit, rare)))).alias("rare")).withColumn("_o", order)
    first = frames.where("rare").orderBy("_o", *KEY).limit(n // 2).withColumn("_turn", F.lit(0))
    rest = frames.join(first.select(*KEY), KEY, "left_anti").withColumn("_turn", F.lit(1))
    return first.unionByName(rest).orderBy("_turn", "_o", *KEY).limit(n).select(*KEY, "rare")


def z_scored(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z_sum: the columns' deviations from their means in units of their deviations, added; statistics are one small row."""
    stats = rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"d_{c}"))])
    z = [F.when(F.col(f"d_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}")).otherwise(0.0) for c in columns]
    return rows.join(F.broadcast(stats)).withColumn("z_sum", sum(z[1:], z[0])).drop(*[f"{p}_{c}" for c in columns for p in "md"])


def mean_vector(rows: DataFrame, vector: str = "vec") -> list[float]:
    """The mean of all vectors, one number per dimension."""
    found = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    return [r.m for r in found]


def shifted_query(query: Sequence[float], image_mean: Sequence[float], text_mean: Sequence[float]) -> list[float]:
    """A text's vector moved by the mean image less the mean text."""
    return [q + i - t for q, i, t in zip(query, image_mean, text_mean, strict=True)]


def sound_segments(segments: DataFrame, silence: float = 0.6, compression: float = 2.4) -> DataFrame:
    """Transcript segments that hold speech and don't repeat themselves."""
    return segments.where((F.coalesce("no_speech_prob", F.lit(0.0)) < silence) & (F.coalesce("compression_ratio", F.lit(0.0)) <= compression))


def with_neighbours(rows: DataFrame, reach: int, weight: float = 1.0, by: str = "video_id", order: str = "frame_idx", score: str = "score") -> DataFrame:
    """context_score: a row's score plus the best score within ``reach`` of it, before or after."""
    w = Window.partitionBy(by).orderBy(order)
    near = F.greatest(F.coalesce(F.max(score).over(w.rangeBetween(-reach, -1)), F.lit(0.0)), F.coalesce(F.max(score).over(w.rangeBetween(1, reach)), F.lit(0.0)))
    return rows.withColumn("context_score", F.col(score) + weight * near)


def two_stage(segments: DataFrame, frames: DataFrame, query: Sequence[float], n_segments: int, k: int, segment: Sequence[str], digits: int = 6) -> DataFrame:
    """The best frames inside the best segments: segments are ranked first, and only their frames are scored."""
    scored = segments.withColumn("segment_score", F.round(dot(F.col("vec"), literal(query)), digits))
    best = top_k(scored, n_segments, "segment_score", segment).select(*segment)
    inside = frames.join(best, list(segment), "left_semi").withColumn("score", F.round(dot(F.col("vec"), literal(query)), digits))
    return top_k(inside, k)


def facet_gains(rows: DataFrame, facets: Sequence[str], belief: str = "belief") -> DataFrame:
    """(facet, n_values, gain): how many bits an answer to each question is expected to give; facets are columns of a bounded pool."""
    flat = rows.select(belief, F.explode(F.create_map(*[x for f in facets for x in (F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("")))])).alias("facet", "value"))
    shares = flat.groupBy("facet", "value").agg(F.sum(belief).alias("p"))
    total = F.sum("p").over(Window.partitionBy("facet"))
    return shares.withColumn("p", F.col("p") / total).groupBy("facet").agg(F.count("*").alias("n_values"), (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0))).alias("gain"))


def reweighted(rows: DataFrame, likelihood: Column, belief: str = "belief") -> DataFrame:
    """Beliefs after an answer: times its likelihood, over their sum."""
    new = rows.withColumn(belief, F.col(belief) * likelihood)
    return new.withColumn(belief, F.col(belief) / new.agg(F.sum(belief)).scalar())


def grid_lists(objects: DataFrame, position: Column, k: int) -> DataFrame:
    """For every grid cell and label the number of frames and the k best objects: lists made before any query."""
    best = objects.withColumn("cell", position).groupBy("cell", "label", *KEY).agg(F.max("score").alias("score"))
    w = Window.partitionBy("cell", "label")
    ranked = best.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), *KEY))).withColumn("n_frames", F.count("*").over(w))
    return ranked.where(F.col("place") <= k)


def bindings(rows: DataFrame, group: Sequence[str], role: str, item: str, score: str) -> DataFrame:
    """Per group the best one-to-one binding of roles to items: (group, bound, total), null where some role can't be bound.

    A group is a frame: few roles, tens of items. Exact, by dynamic programming
    over subsets of roles; groups reach it as one row each.
    """
    packed = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(item).cast("string").alias("item"), F.col(role).cast("string").alias("role"), F.col(score).cast("double").alias("score")))).alias("options"))
    roles = sorted(str(r[0]) for r in rows.select(role).distinct().limit(13).collect())
    if len(roles) > 12:
        raise ValueError("at most 12 roles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, bound = [], []
            for options in batch.column("options").to_pylist():
                best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
                by_item: dict[str, list] = {}
                for o in options:
                    by_item.setdefault(o["item"], []).append(o)
                for name, choices in by_item.items():
                    new = dict(best)
                    for mask, (total, pairs) in best.items():
                        for o in choices:
                            bit = 1 << roles.index(o["role"])
                            if not mask & bit:
                                option = (total + o["score"], (*pairs, (o["role"], name)))
                                if mask | bit not in new or (option[0], new[mask | bit][1]) > (new[mask | bit][0], option[1]):
                                    new[mask | bit] = option
                    best = new
                total, pairs = best.get((1 << len(roles)) - 1, (None, None))
                totals.append(total)
                bound.append(None if pairs is None else ",".join(f"{r}={i}" for r, i in sorted(pairs)))
            yield pa.RecordBatch.from_arrays([*(batch.column(g) for g in group), pa.array(bound, pa.string()), pa.array(totals, pa.float64())], names=[*group, "bound", "total"])

    schema = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group)
    return packed.mapInArrow(run, f"{schema}, bound string, total double")
