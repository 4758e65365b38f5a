"""Hard filters: each gives a table of keys (or None where nothing is asked), and they are joined by semi-joins.

None means "not filtered", an empty table "nothing matches". Keys are
(video_id, frame_idx), or video_id alone for filters on videos.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, iou
from ..functions.text import contains_phrase, ordered_words, strip_accents

KEY = ["video_id", "frame_idx"]


def by_metadata(videos: DataFrame, authors: Sequence[str] = (), date_from: str | None = None, date_to: str | None = None, keywords_any: Sequence[str] = ()) -> DataFrame | None:
    """Videos by author, date (both ends inclusive, at midnight; a null date fails) and any of some whole-word keywords.

    Keywords are looked for in title and keywords together, without accents.
    """
    conditions = []
    if authors:
        conditions.append(F.col("author").isin(*authors))
    if date_from:
        conditions.append(F.col("publish_date") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        conditions.append(F.col("publish_date") <= F.lit(date_to).cast("timestamp"))
    if keywords_any:
        text = strip_accents(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("keywords_text", F.lit(""))))
        conditions.append(reduce(lambda a, b: a | b, [contains_phrase(text, strip_accents(F.lit(k))) for k in keywords_any]))
    if not conditions:
        return None
    return videos.where(reduce(lambda a, b: a & b, conditions)).select("video_id").distinct()


def by_label_groups(objects: DataFrame, groups: Sequence[tuple[Sequence[str], int]], use_suppression: bool = True, sources: Sequence[str] | None = None) -> DataFrame | None:
    """Frames that have, for every group, at least ``count`` objects with one of its labels (relational division)."""
    if not groups:
        return None
    rows = objects
    if use_suppression and "suppressed" in objects.columns:
        rows = rows.where(~F.coalesce("suppressed", F.lit(False)))
    if sources is not None:
        rows = rows.where(F.col("source").isin(*sources))
    rows = rows.where(F.col("label").isin(*{label for labels, _ in groups for label in labels}))
    counts = [F.count(F.when(F.col("label").isin(*labels), 1)) >= max(1, need) for labels, need in groups]
    return rows.groupBy(*KEY).agg(reduce(lambda a, b: a & b, counts).alias("all_groups")).where("all_groups").select(*KEY)


def by_labels(objects: DataFrame, labels: Sequence[str], min_count: dict[str, int] | None = None, **options) -> DataFrame | None:
    """Frames that have every label at least as often as asked (once, if nothing is asked)."""
    need = min_count or {}
    return by_label_groups(objects, [((label,), need.get(label, 1)) for label in dict.fromkeys(labels)], **options)


def by_text(lines: DataFrame | None, needle: str, region: tuple[float, float, float, float] | None = None, overlap: float = 0.05) -> DataFrame | None:
    """Frames in the interval of a line that has the needle's words in order, and a box that overlaps the region by more than ``overlap``."""
    if not needle and region is None:
        return None
    if lines is None:
        raise ValueError("there is no table of on-screen text")
    hit = lines.where(ordered_words(F.col("text_norm"), needle.lower())) if needle else lines
    if region is not None:
        hit = hit.where(iou(Box.of(), Box.at(*region)) > overlap)
    return hit.select("video_id", F.explode(F.sequence("frame_start", "frame_end")).alias("frame_idx")).distinct()


def by_drawn_box(objects: DataFrame, lines: DataFrame | None, box: dict) -> DataFrame:
    """Frames that match one drawn box, wherever it was drawn: a text, or any of some labels at least ``min_count`` times in all."""
    if box["type"] == "ocr":
        found = by_text(lines, box.get("text") or "", None)
        if found is not None:
            return found
        if lines is None:
            raise ValueError("there is no table of on-screen text")
        return lines.select("video_id", F.explode(F.sequence("frame_start", "frame_end")).alias("frame_idx")).distinct()
    return by_label_groups(objects, [(tuple(box.get("labels") or ("",)), box.get("min_count", 1))], use_suppression=False)


def by_drawn_boxes(objects: DataFrame, lines: DataFrame | None, boxes: Sequence[dict], op: str = "and") -> DataFrame | None:
    """All boxes (``and``) or any of them (``or``)."""
    found = [by_drawn_box(objects, lines, b) for b in boxes]
    if not found:
        return None
    return union_keys(found) if op == "or" else intersect_keys(found)


def intersect_keys(keys: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, KEY, "left_semi"), keys)


def union_keys(keys: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), keys).distinct()


def combine(frames: DataFrame, videos: DataFrame | None, frame_keys: Sequence[DataFrame | None]) -> DataFrame | None:
    """Frames that pass all filters; filters on videos alone give all their frames; no filter at all gives None."""
    asked = [k for k in frame_keys if k is not None]
    if videos is None and not asked:
        return None
    keys = intersect_keys(asked) if asked else frames.select(*KEY)
    return keys if videos is None else keys.join(videos, "video_id", "left_semi")


def in_scope(objects: DataFrame, label_types: DataFrame, categories: Sequence[str], least: float = 0.25, open_vocabulary: Sequence[str] = ()) -> DataFrame:
    """Objects whose label has one of some categories and whose score is high enough, and all from open-vocabulary sources."""
    fits = label_types.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories)))).select("label")
    typed = objects.where(F.col("score") >= least).join(fits, "label", "left_semi")
    if not open_vocabulary:
        return typed
    kinds = F.col("source").isin(*open_vocabulary)
    return typed.where(~kinds).unionByName(objects.where(kinds))
