"""Aggregates and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import KEY


def label_frames(objects: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, label, n_frames): frames whose best score of the label reaches the threshold."""
    best = objects.groupBy(*KEY, "label").agg(F.max("score").alias("best"))
    reached = best.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where("best >= threshold")
    return reached.groupBy("threshold", "label").agg(F.count("*").alias("n_frames"))


def labels_per_frame(objects: DataFrame, frames: int, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, labels_per_frame): distinct labels that reach the threshold, over all frames."""
    return label_frames(objects, thresholds).groupBy("threshold").agg((F.sum("n_frames") / F.lit(float(frames))).alias("labels_per_frame"))


def crowd(objects: DataFrame) -> DataFrame:
    """One row: median number of objects in a frame that has any, and the frame with the most (ties: the first by key)."""
    counts = objects.groupBy(*KEY).agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), *KEY)
    return counts.agg(F.expr("percentile(n, 0.5)").alias("median"), F.min_by("video_id", order).alias("video_id"), F.min_by("frame_idx", order).alias("frame_idx"), F.max("n").alias("most"))


def vocabulary(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values in order."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def commonest(rows: DataFrame, column: str, k: int) -> DataFrame:
    """(column, n) of the k commonest values; ties in their order."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def percentiles(rows: DataFrame, column: str, points: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99), by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles, interpolated, as p50, p75, ..."""
    return rows.groupBy(*by).agg(*[F.expr(f"percentile({column}, {p})").alias(f"p{round(p * 100)}") for p in points])


def spread(rows: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """mean, sample deviation and count per key, the lowest mean first."""
    return rows.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.count("*").alias("n"))


def phrase_frequency(rows: DataFrame, phrases: str, key: Sequence[str] = KEY, least: int = 3, per_frame: bool = True) -> DataFrame:
    """(phrase, n): trimmed lower-case phrases in at least ``least`` frames; with per_frame=False every mention counts."""
    phrase = F.lower(F.trim(F.regexp_replace(F.col("_p"), r"\s+", " ")))
    flat = rows.select(*key, F.explode(phrases).alias("_p")).select(*key, phrase.alias("phrase")).where("phrase <> ''")
    n = F.count_distinct(F.struct(*key)) if per_frame else F.count("*")
    return flat.groupBy("phrase").agg(n.alias("n")).where(F.col("n") >= least)


def relation_histogram(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """(name, n): how many pairs allow each relation; those that none allows have 0."""
    counted = pairs.select(F.explode("allowed_relations").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return relations.select("name").join(counted, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def mean_by(rows: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(column).alias("mean"), F.count("*").alias("n"))


def mean_by_tag(rows: DataFrame, tags: str, column: str) -> DataFrame:
    """The mean over the rows that have each tag."""
    return mean_by(rows.withColumn("tag", F.explode(tags)), ["tag"], column)


def first_rows(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def last_rows(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in order, as where later shards win."""
    return first_rows(rows, key, [F.desc(c) for c in order])


def compare_detectors(one: DataFrame, other: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Objects per frame of two detectors side by side; 0 where one has none."""
    a = one.groupBy(*key).agg(F.count("*").alias("n_one"))
    b = other.groupBy(*key).agg(F.count("*").alias("n_other"))
    return a.join(b, list(key), "full_outer").select(*key, F.coalesce("n_one", F.lit(0)).alias("n_one"), F.coalesce("n_other", F.lit(0)).alias("n_other"))


def compare_labels(one: DataFrame, other: DataFrame) -> DataFrame:
    """(label, side): labels of both detectors or of one only."""
    a, b = one.select("label").distinct().withColumn("a", F.lit(1)), other.select("label").distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNull(), "other").when(F.col("b").isNull(), "one").otherwise("both")
    return a.join(b, "label", "full_outer").select("label", side.alias("side"))


def cooccurrence(objects: DataFrame, least: int = 1) -> DataFrame:
    """(label_a, label_b, n_frames) of labels that share frames, a before b."""
    present = objects.select(*KEY, "label").distinct()
    labels = present.groupBy(*KEY).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    a = labels.select("labels", F.posexplode("labels").alias("i", "label_a"))
    pairs = a.select("label_a", F.explode(F.slice("labels", F.col("i") + 2, F.size("labels"))).alias("label_b"))
    return pairs.groupBy("label_a", "label_b").agg(F.count("*").alias("n_frames")).where(F.col("n_frames") >= least)


def concatenated(rows: DataFrame, by: Sequence[str], order: Sequence[str], text: str, separator: str = " ") -> DataFrame:
    """The texts of each key in order, joined; nulls are left out."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.where(F.col(text).isNotNull()).groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x[text]), separator).alias(text))


def axis_statistics(rows: DataFrame, column: str) -> DataFrame:
    """entropy in bits, number of values and share of the commonest: whether a column can split results."""
    counts = value_counts(rows.where(F.col(column).isNotNull()), column)
    p = counts.select((F.col("n") / counts.agg(F.sum("n")).scalar()).alias("p"))
    return p.agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.count("*").alias("n_values"), F.max("p").alias("top_share"))


def bm25(documents: DataFrame, terms: Sequence[str], key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the rows that have any of the terms, as blank-separated words."""
    rows = documents.select(key, F.col(text).alias("_t"), F.regexp_count(F.col(text), F.lit(r"\S+")).alias("size"))
    facts = rows.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()

    def count(term: str) -> Column:
        whole = F.regexp_count(F.col("_t"), F.lit(rf"(?<!\S)\Q{term}\E(?!\S)"))
        return F.struct(F.lit(term).alias("term"), F.when(F.contains(F.col("_t"), F.lit(term)), whole).otherwise(0).cast("double").alias("tf"))

    found = rows.select(key, "size", F.filter(F.array(*map(count, dict.fromkeys(terms))), lambda x: x["tf"] > 0).alias("found"))
    hits = found.select(key, "size", F.explode("found").alias("x")).select(key, "size", "x.*")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(facts.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.lit(float(facts.mean or 1))))
    return hits.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(idf * weight).alias("score"))  # a row per asked term
