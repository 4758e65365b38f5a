"""Operators along an order: runs, strides, segments, samples. All are windows within a key."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, by: Sequence[str], order: str, gap: int = 20) -> DataFrame:
    """run: counts up within ``by`` where the order leaps by more than ``gap``."""
    w = Window.partitionBy(*by).orderBy(order)
    leap = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_leap", leap).withColumn("run", F.sum("_leap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_leap")


def run_summary(rows: DataFrame, by: Sequence[str], order: str, text: str, score: str, gap: int = 20, boxes: Sequence[str] = ()) -> DataFrame:
    """A row per run: its first and last place, mean score and boxes, and the text of the best score (the first on ties)."""
    return runs(rows, by, order, gap).groupBy(*by, "run").agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"), F.avg(score).alias("score"),
        F.max_by(text, F.struct(F.col(score), -F.col(order))).alias(text), *[F.avg(b).alias(b) for b in boxes],
    )


def run_middle(rows: DataFrame, by: Sequence[str], order: str, gap: int = 20) -> DataFrame:
    """The middle row of each run (the later of two)."""
    w = Window.partitionBy(*by, "run")
    marked = runs(rows, by, order, gap).withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    return marked.where(F.col("_i") == F.floor(F.col("_n") / 2) + 1).drop("_i", "_n")


def skip_stride(rows: DataFrame, by: Sequence[str], order: str, skip: int = 5, stride: int = 15) -> DataFrame:
    """Within ``by``: without the first ``skip`` rows, each ``stride``-th."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return rows.withColumn("_n", n).where((F.col("_n") >= skip) & ((F.col("_n") - skip) % stride == 0)).drop("_n")


def numbered(rows: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """A global row number from 0, without one task for all rows.

    Rows are range-partitioned and sorted, and numbered within their partition
    by the upper and lower bits of Spark's own row ids; each partition's count
    (a few numbers on the driver) gives the next one its start. The numbered
    rows are checkpointed, as ranges are sampled anew each time they are made.
    """
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framelake-"))  # a session on one machine that names none
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33)).withColumn("_i", F.col("_id") - F.shiftleft("_part", 33)).drop("_id").checkpoint()
    starts, total = [], 0
    for part, n in sorted(dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        starts.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, "_part bigint, _start bigint"))  # a row per partition
    return dealt.join(offsets, "_part").withColumn(name, F.col("_start") + F.col("_i")).drop("_part", "_i", "_start")


def stride_sample(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Every (count // n)-th row of the whole order, n of them."""
    stride = max(1, rows.count() // n)
    return numbered(rows, order).where((F.col("position") % stride == 0) & (F.col("position") < stride * n)).drop("position")


def shard(rows: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """shard: the global row number modulo ``shards``."""
    return numbered(rows, order).withColumn("shard", (F.col("position") % shards).cast("int")).drop("position")


def lead_segments(frames: DataFrame, by: Sequence[str], time: str, duration: str, least: float = 0.1) -> DataFrame:
    """segment_start and segment_end: from each frame to the next, the last one to the video's end; at least ``least`` seconds."""
    following = F.lead(time).over(Window.partitionBy(*by).orderBy(time))
    end = F.coalesce(following, F.col(duration))
    return frames.withColumn("segment_start", F.col(time)).withColumn("segment_end", F.col(time) + F.greatest(F.lit(least), end - F.col(time)))


def around_segments(frames: DataFrame, time: str, duration: str, margin: float) -> DataFrame:
    """segment_start and segment_end: ``margin`` seconds to either side, inside the video."""
    return frames.withColumn("segment_start", F.greatest(F.lit(0.0), F.col(time) - margin)).withColumn("segment_end", F.least(F.col(duration), F.col(time) + margin))


def clip_key(video: Column, time: Column, pad: float = 3.0, digits: int = 1) -> Column:
    """A name for a clip in a cache: clips whose starts round alike share it."""
    return F.concat_ws("_", video, F.format_string(f"%.{digits}f", F.round(F.greatest(F.lit(0.0), time - pad), digits)))


def clip_window(time: Column, pad: float = 3.0) -> Column:
    """struct(start, length) of a clip round a moment."""
    return F.struct(F.greatest(F.lit(0.0), time - pad).alias("start"), F.lit(2 * pad).alias("length"))


def carry(rows: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), which: str = "last") -> DataFrame:
    """``value`` where null: the last known value before it in order, or the first of all."""
    w = Window.partitionBy(*by).orderBy(*order)
    if which == "first":
        return rows.withColumn(value, F.coalesce(value, F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def closest_in_video(rows: DataFrame, truth: DataFrame, k: int = 9, by: str = "video_id", order: str = "frame_idx") -> DataFrame:
    """For each truth row its k nearest other frames of the video, by distance, then by place.

    Frames are numbered in their video; a truth row meets the k numbers before
    its own frame's and the k after them, by number, and no others.
    """
    w = Window.partitionBy(by)
    number = F.row_number().over(w.orderBy(order))
    placed = rows.withColumn("_i", number)
    marks = truth.select(F.col(by), F.col(order), F.lit(0).alias("_row")).unionByName(rows.select(F.col(by), F.col(order), F.lit(1).alias("_row")))
    upto = F.sum("_row").over(w.orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    before = F.sum("_row").over(w.orderBy(order).rangeBetween(Window.unboundedPreceding, -1))
    t = marks.withColumns({"_upto": upto, "_under": F.coalesce(before, F.lit(0).cast("bigint"))}).where("_row = 0").select(F.col(by), F.col(order).alias("truth_idx"), "_upto", "_under")
    near = F.concat(F.sequence(F.col("_under") - (k - 1), F.col("_under")), F.sequence(F.col("_upto") + 1, F.col("_upto") + k))
    pairs = t.withColumn("_i", F.explode(near)).drop("_upto", "_under").join(placed, [by, "_i"]).drop("_i").withColumn("distance", F.abs(F.col(order) - F.col("truth_idx")))
    place = F.row_number().over(Window.partitionBy(by, "truth_idx").orderBy("distance", order))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def stratified(rows: DataFrame, stratum: str, n: int, order: Column, key: Sequence[str]) -> DataFrame:
    """From each stratum its share of n rows, rounded half to even, at least one; first in ``order`` (a hash, for a sample)."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size")).first()[0] or 1
    quota = sizes.withColumn("_take", F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_size") / F.lit(float(total))).cast("int"))).drop("_size")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(order, *key))
    return rows.join(quota, stratum).withColumn("_place", place).where("_place <= _take").drop("_place", "_take")


def without_ends(rows: DataFrame, by: Sequence[str], order: str, ends: int = 5, more_than: int = 15) -> DataFrame:
    """Without the first and last rows of keys that have more than ``more_than`` rows."""
    w = Window.partitionBy(*by)
    marked = rows.withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    return marked.where((F.col("_n") <= more_than) | ((F.col("_i") > ends) & (F.col("_i") <= F.col("_n") - ends))).drop("_i", "_n")


def sample_per_key(rows: DataFrame, by: Sequence[str], n: int, order: Column, key: Sequence[str]) -> DataFrame:
    """At most n rows of each key, first in ``order``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order, *key))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def portable_hash(value: Column, seed: int = 42) -> Column:
    """A number in [0, 1000003) that any SQL engine computes alike; for samples. Computed in 64 bits; the first remainder keeps any such value from overflowing."""
    return (value.cast("bigint") % 1000003000000 * 7919 + seed * 104729) % 1000003


def fixed_chunks(rows: DataFrame, total: str, seconds: float = 28.0) -> DataFrame:
    """chunk, chunk_start, chunk_end: a row per stretch of ``seconds``, the last one shorter; none for a length of 0."""
    last = F.ceil(F.col(total) / seconds).cast("int")
    cut = rows.where(F.col(total) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), last - 1)))
    return cut.withColumn("chunk_start", F.col("chunk") * seconds).withColumn("chunk_end", F.least((F.col("chunk") + 1) * seconds, F.col(total)))


def batches(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int = 8) -> DataFrame:
    """batch: rows with equal ``by`` in batches of ``size``."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("int"))
