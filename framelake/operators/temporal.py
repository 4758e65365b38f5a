"""Order in time: nearest frames, intervals, and chains of events inside a video."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(points: DataFrame, frames: DataFrame, point_time: str, frame_time: str, by: str = "video_id", frame: str = "frame_idx") -> DataFrame:
    """Each point with the frame nearest in time (the earlier one, then the smaller index, on ties); points of a video without frames have none.

    An as-of join in two windows over one shuffle: points and frames are
    united, sorted in time, and the last frame before and the first after are
    carried to each point. No pair is built, so a long video is a sort.
    """
    names = points.columns
    p = points.select(by, F.col(point_time).cast("double").alias("_t"), F.struct(*names).alias("_p"), F.lit(None).cast("struct<t:double,f:bigint>").alias("_f"))
    f = frames.select(by, F.col(frame_time).cast("double").alias("_t"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.struct(F.col(frame_time).cast("double").alias("t"), F.col(frame).cast("bigint").alias("f")).alias("_f"))
    w = Window.partitionBy(by)
    # of frames at one time the smallest index comes last going forward and first going back
    ahead = w.orderBy(F.asc("_t"), F.asc(F.col("_p").isNotNull()), F.desc("_f.f")).rowsBetween(Window.unboundedPreceding, 0)
    back = w.orderBy(F.desc("_t"), F.asc(F.col("_p").isNotNull()), F.desc("_f.f")).rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(f).withColumn("_a", F.last("_f", ignorenulls=True).over(ahead)).withColumn("_b", F.last("_f", ignorenulls=True).over(back)).where("_p is not null")
    before, after = F.col("_t") - F.col("_a.t"), F.col("_b.t") - F.col("_t")
    chosen = F.when(F.col("_a").isNull(), F.col("_b.f")).when(F.col("_b").isNull() | (before <= after), F.col("_a.f")).otherwise(F.col("_b.f"))
    return both.select("_p.*", chosen.alias(f"nearest_{frame}"))


def within(points: DataFrame, intervals: DataFrame, margin: int | Column, by: str = "video_id", at: str = "frame_idx", start: str = "frame_idx_start", end: str = "frame_idx_end", width: int = 256) -> DataFrame:
    """Points with each interval of their video that holds them, ``margin`` (a number, or a column of the intervals) to either side.

    Intervals are dealt over stretches of ``width`` frames and meet points by
    video and stretch: a long video is many small keys, and a point, which lies
    in one stretch, meets an interval once.
    """
    side = F.lit(margin) if isinstance(margin, int) else margin
    low, high = F.col(start) - side, F.col(end) + side
    dealt = intervals.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    dealt = dealt.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
    placed = points.withColumn("_stretch", F.floor(F.col(at) / width))
    return placed.join(dealt, [by, "_stretch"]).where(F.col(at).between(F.col("_low"), F.col("_high"))).drop("_stretch", "_low", "_high")


def chain_best(pools: Sequence[DataFrame], aggregate: str = "min", k: int | None = None, by: str = "video_id", time: str = "frame_idx") -> DataFrame:
    """Per video the chain with one row of each pool, strictly later each time, and the greatest min (or mean) of scores.

    Pools have (by, time, score). Dynamic programming: a row of pool i takes the
    best chain that ends in a strictly earlier row of pool i - 1. The pools are
    united first, so each step is a running maximum over the same partitions in
    the same order: one shuffle and one sort for any number of pools. Ties: the
    earlier predecessor, then the earlier last row. Returns (by, path, score),
    best score first when k is given.
    """
    if not pools:
        raise ValueError("a chain needs a pool")
    n = len(pools)
    first = F.when(F.col("anchor") == 0, F.struct(F.col("own").alias("dp"), (-F.col("t")).alias("late"), F.array("t").alias("path")))
    rows = union_pools([p.select(by, F.col(time).cast("bigint").alias("t"), F.col("score").cast("double").alias("own")) for p in pools]).withColumn("chain", first)
    earlier = Window.partitionBy(by).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    for i in range(1, n):
        best = F.max(F.when(F.col("anchor") == i - 1, F.col("chain"))).over(earlier)
        dp = F.least("own", "best.dp") if aggregate == "min" else F.col("own") + F.col("best.dp")
        longer = F.struct(dp.alias("dp"), (-F.col("t")).alias("late"), F.concat("best.path", F.array("t")).alias("path"))
        rows = rows.withColumn("best", best).withColumn("chain", F.when((F.col("anchor") == i) & F.col("best").isNotNull(), longer).otherwise(F.col("chain"))).drop("best")
    done = rows.where((F.col("anchor") == n - 1) & F.col("chain").isNotNull())
    last = F.max(F.struct("chain.dp", "chain.late", F.transform("chain.path", lambda x: -x).alias("paths"), F.col("chain.path").alias("path"))).alias("m")
    found = done.groupBy(by).agg(last).select(by, "m.path", (F.col("m.dp") if aggregate == "min" else F.col("m.dp") / n).alias("score"))
    return found if k is None else found.orderBy(F.desc("score"), by).limit(k)


def chain_greedy(pools: Sequence[DataFrame], aggregate: str = "min", by: str = "video_id", time: str = "frame_idx") -> DataFrame:
    """Per video the chain that takes the earliest row after the row before (of rows at one time, the one with the smaller score); (by, path, score)."""
    first = lambda rows: rows.groupBy(by).agg(F.min(F.struct(F.col(time).cast("bigint").alias("t"), F.col("score").cast("double").alias("score"))).alias("x"))
    chosen = first(pools[0]).select(by, F.col("x.t").alias("last"), F.array("x.t").alias("path"), F.array("x.score").alias("scores"))
    for pool in pools[1:]:
        step = first(pool.join(chosen.select(by, "last"), by).where(F.col(time) > F.col("last")))
        chosen = chosen.join(step, by).select(by, F.col("x.t").alias("last"), F.concat("path", F.array("x.t")).alias("path"), F.concat("scores", F.array("x.score")).alias("scores"))
    score = F.array_min("scores") if aggregate == "min" else F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / len(pools)
    return chosen.select(by, "path", score.alias("score"))


def wide_picks(chains: DataFrame, n: int, fps: DataFrame | None = None, by: str = "video_id", default_fps: float = 25.0) -> DataFrame:
    """A row per chain with anchor1_frame_id, anchor1_time, ... and its score."""
    rows = chains if fps is None else chains.join(fps, by, "left")
    rate = F.lit(default_fps) if fps is None else F.coalesce("fps", F.lit(default_fps))
    picks = [c for i in range(n) for c in (F.col("path")[i].alias(f"anchor{i + 1}_frame_id"), (F.col("path")[i] / rate).alias(f"anchor{i + 1}_time"))]
    return rows.select(by, *picks, "score")


def pair_scores(first: DataFrame, second: DataFrame, seconds: int, by: str = "video_id", time: str = "t") -> DataFrame:
    """Per video the best sum of two scores, the second event at most ``seconds`` after the first.

    A running maximum over a range of time, not a join of pairs.
    """
    rows = first.select(by, F.col(time).alias("t"), F.col("score").alias("a"), F.lit(None).cast("double").alias("b"))
    rows = rows.unionByName(second.select(by, F.col(time).alias("t"), F.lit(None).cast("double").alias("a"), F.col("score").alias("b")))
    recent = Window.partitionBy(by).orderBy("t").rangeBetween(-seconds, 0)
    return rows.withColumn("best", F.max("a").over(recent)).where("b is not null and best is not null").groupBy(by).agg(F.max(F.col("best") + F.col("b")).alias("pair_score"))


def neighbours(hits: DataFrame, frames: DataFrame, radius: int, by: str = "video_id", frame: str = "frame_idx") -> DataFrame:
    """All frames at most ``radius`` from a hit of their video, once."""
    near = hits.select(by, F.explode(F.sequence(F.col(frame) - radius, F.col(frame) + radius)).alias(frame)).distinct()
    return frames.join(near, [by, frame], "left_semi")


def likeness_to_previous(rows: DataFrame, vector: str = "vec", by: str = "video_id", order: str = "frame_idx", out: str = "alike") -> DataFrame:
    """The cosine of a row's vector and that of the row before it in its video; null for the first and for vectors without length."""
    before = F.lag(vector).over(Window.partitionBy(by).orderBy(order))
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("_before", before)
    length = F.sqrt(product(F.col(vector), F.col(vector))) * F.sqrt(product(F.col("_before"), F.col("_before")))
    return rows.withColumn(out, F.when(length > 0, product(F.col(vector), F.col("_before")) / length)).drop("_before")


def first_of_shots(rows: DataFrame, shot: str = "shot", by: str = "video_id", score: str = "score", order: str = "frame_idx") -> DataFrame:
    """The best row of each shot (ties: the earlier one)."""
    place = F.row_number().over(Window.partitionBy(by, shot).orderBy(F.desc(score), order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def shots(rows: DataFrame, similarity: str, least: float = 0.97, by: str = "video_id", order: str = "frame_idx") -> DataFrame:
    """shot: counts up where a row's similarity to the one before is under ``least``."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("shot", F.sum(F.when(F.coalesce(F.col(similarity), F.lit(0.0)) < least, 1).otherwise(0)).over(w))


def linear_chain(edges: Sequence[tuple[str, str]], nodes: Sequence[str]) -> list[str]:
    """The nodes that "before" edges order, as one chain.

    Of an event's edges the latest counts. Where exactly one edge begins at an
    event that none leads to, the chain goes from there along the edges, as long
    as events are new and known. Else the order of declaration stands: of the edges' first
    ends, then of the last edge's second end.
    """
    latest = dict(edges)
    waiting = Counter(latest.values())
    beginnings = [x for x, _ in edges if not waiting[x]]
    if len(beginnings) != 1:
        mentioned = [x for x, _ in edges] + [later for _, later in edges[-1:]]
        return sorted({x for x in mentioned if x in nodes}, key=mentioned.index)
    steps: list[str] = []
    ahead = beginnings
    while ahead and ahead[-1] in nodes and ahead[-1] not in steps:
        steps.append(ahead[-1])
        ahead = [latest[x] for x in steps[-1:] if x in latest]
    return steps


def union_pools(pools: Sequence[DataFrame]) -> DataFrame:
    """Pools with their place as anchor."""
    return reduce(lambda a, b: a.unionByName(b), [p.withColumn("anchor", F.lit(i)) for i, p in enumerate(pools)])
