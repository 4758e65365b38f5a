"""Soft boosts: score += weight * signal. None drops a row; each keeps the score before it.

A signal is a table (key..., signal). It is joined from the left, so frames
without one count 0; the pool of results is small and on the streamed side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, iou
from ..functions.text import contains_phrase, ordered_words, significant_tokens
from ..functions.vectors import dot, literal
from .filters import KEY
from .temporal import within

POSITION, AUDIO, REGION, SECONDARY, SPEECH, AGREEMENT = 0.15, 0.08, 0.5, 0.15, 0.08, 0.05


def boosted(results: DataFrame, signal: DataFrame, name: str, weight: float, key: Sequence[str] = KEY) -> DataFrame:
    """``results`` with name_boost, score_before_name and the new score."""
    with_signal = results.join(signal.select(*key, F.col("signal").alias(f"{name}_boost")), list(key), "left")
    value = F.coalesce(f"{name}_boost", F.lit(0.0))
    return with_signal.withColumn(f"{name}_boost", value).withColumn(f"score_before_{name}", F.col("score")).withColumn("score", F.col("score") + weight * value)


def mean_signal(signals: Sequence[DataFrame], n: int | None = None) -> DataFrame:
    """The mean over n signals; a frame without one counts 0 for it."""
    rows = reduce(lambda a, b: a.unionByName(b), [s.select(*KEY, "signal") for s in signals])
    return rows.groupBy(*KEY).agg((F.sum("signal") / (n or len(signals))).alias("signal"))


def clipped_sum(signals: Sequence[DataFrame]) -> DataFrame:
    """The sum of signals, at most 1."""
    rows = reduce(lambda a, b: a.unionByName(b), [s.select(*KEY, "signal") for s in signals])
    return rows.groupBy(*KEY).agg(F.least(F.lit(1.0), F.sum("signal")).alias("signal"))


def position_signal(objects: DataFrame, labels: Sequence[str], region: tuple[float, float, float, float]) -> DataFrame:
    """Per frame the best overlap of an object with one of the labels and the drawn region."""
    overlap = iou(Box.of(), Box.at(*region))
    return objects.where(F.col("label").isin(*labels)).groupBy(*KEY).agg(F.max(overlap).alias("signal"))


def text_position_signal(lines: DataFrame, needle: str, region: tuple[float, float, float, float]) -> DataFrame:
    """Per frame the best overlap of a line that has the needle's words and the drawn region."""
    hit = lines.where(ordered_words(F.col("text_norm"), needle)).withColumn("frame_idx", F.explode(F.sequence("frame_start", "frame_end")))
    return hit.groupBy(*KEY).agg(F.max(iou(Box.of(), Box.at(*region))).alias("signal"))


def spoken_signal(results: DataFrame, speech: DataFrame, term: str, fps: DataFrame | None = None, seconds: float = 3.0, default_fps: float = 25.0) -> DataFrame:
    """1 for results within ``seconds`` of a segment that says the term's words in order. Segments meet results by video and stretch of frames."""
    said = speech.where(ordered_words(F.col("text_norm"), term)).select("video_id", "frame_idx_start", "frame_idx_end")
    rate = F.lit(default_fps)
    if fps is not None:
        said = said.join(fps.select("video_id", "fps"), "video_id", "left")
        rate = F.coalesce("fps", F.lit(default_fps))
    said = said.withColumn("margin", F.bround(rate * seconds).cast("int"))
    return within(results.select(*KEY).distinct(), said, F.col("margin")).select(*KEY).distinct().withColumn("signal", F.lit(1.0))


def mentioned_signal(speech: DataFrame, phrase: str) -> DataFrame:
    """1 for the frames of segments that contain the phrase as whole words."""
    said = speech.where(contains_phrase(F.col("text_norm"), phrase))
    frames = said.select("video_id", F.explode(F.sequence("frame_idx_start", "frame_idx_end")).alias("frame_idx"))
    return frames.distinct().withColumn("signal", F.lit(1.0))


def secondary_signal(objects: DataFrame, labels: Sequence[str], use_suppression: bool = True) -> DataFrame:
    """Per frame the best detection score of some labels."""
    rows = objects.where(F.col("label").isin(*labels))
    if use_suppression and "suppressed" in objects.columns:
        rows = rows.where(~F.coalesce("suppressed", F.lit(False)))
    return rows.groupBy(*KEY).agg(F.max("score").alias("signal"))


def region_signal(objects: DataFrame, region_vectors: DataFrame, labels: Sequence[str], text_vector: Sequence[float]) -> DataFrame:
    """Per frame the best similarity of a crop with one of the labels and the attribute's text; frames without a crop are absent."""
    crops = objects.where(F.col("label").isin(*labels)).select("detection_id", *KEY).join(region_vectors, "detection_id")
    return crops.groupBy(*KEY).agg(F.max(dot(F.col("vec"), literal(text_vector))).alias("signal"))


def agreement_signal(results: DataFrame, lines: DataFrame, speech: DataFrame, window: int = 30) -> DataFrame:
    """Common significant tokens of the text on a frame and the speech within ``window`` frames of it, over the smaller set."""
    rows = results.select(*KEY).distinct()
    tokens = lambda found, name: found.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_set("tokens"))).alias(name))
    said = lambda table, *columns: table.select("video_id", *columns, significant_tokens(F.col("text_norm")).alias("tokens"))
    seen = tokens(within(rows, said(lines, "frame_start", "frame_end"), 0, start="frame_start", end="frame_end"), "seen")
    heard = tokens(within(rows, said(speech, "frame_idx_start", "frame_idx_end"), window), "heard")
    both = seen.join(heard, KEY).where((F.size("seen") > 0) & (F.size("heard") > 0))
    share = F.size(F.array_intersect("seen", "heard")) / F.least(F.size("seen"), F.size("heard"))
    return both.select(*KEY, share.alias("signal"))
