"""Scores of answers and of retrieval."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import answers_match
from ..functions.vectors import dot
from .sequence import sample_per_key

CUTOFFS = (1, 5, 20, 50, 100)


def kis_score() -> Column:
    """1 for a frame of the right video inside the right range (gt_start to gt_end)."""
    hit = (F.col("video_id") == F.col("gt_video_id")) & F.col("frame_id").between(F.col("gt_start"), F.col("gt_end"))
    return F.coalesce(hit, F.lit(False)).cast("double")


def qa_score() -> Column:
    """The same, if the answer matches too; an empty answer never does."""
    return F.when(answers_match(F.col("answer"), F.col("gt_answer")), kis_score()).otherwise(0.0)


def chain_score(n: int) -> Column:
    """The share of n moments whose frame is in its range (gt_ranges: array of struct(s, e)), in the right video."""
    hits = [F.coalesce(F.col(f"frame_id_{i + 1}").between(F.col("gt_ranges")[i]["s"], F.col("gt_ranges")[i]["e"]), F.lit(False)).cast("double") for i in range(n)]
    return F.when(F.col("video_id") == F.col("gt_video_id"), sum(hits[1:], hits[0]) / n).otherwise(0.0)


@dataclass(frozen=True)
class Task:
    """One question of a benchmark: what answers it (video_id, frame_id, rank and, for questions, answer), and its truths as (video, first frame, last frame)."""

    name: str
    kind: str
    tags: tuple[str, ...]
    answer: Callable[[], DataFrame]
    truths: Sequence[tuple[str, int, int]]
    said: str | None = None


def run_tasks(spark: SparkSession, tasks: Sequence[Task], scores: Mapping[str, Callable[[], Column]], cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """(name, type, tags, score, error) of each task: the mean over cutoffs of the best score so far, by its type's score; a task that fails has 0 and its error."""
    out = []
    for task in tasks:
        try:
            truth = spark.createDataFrame([(*t, task.said) for t in task.truths], "gt_video_id string, gt_start bigint, gt_end bigint, gt_answer string")
            answers = task.answer().where(F.col("rank") <= max(cutoffs))
            judged = answers.join(F.broadcast(truth)).withColumn("_s", scores[task.kind]()).withColumn("_q", F.lit(task.name))  # a few truths
            best = final_scores(judged, "_q", "rank", "_s", cutoffs).first()
            out.append((task.name, task.kind, list(task.tags), float(best.final_score) if best else 0.0, None))
        except Exception as error:  # a task's search may fail in any way; the others are run
            out.append((task.name, task.kind, list(task.tags), 0.0, f"{type(error).__name__}: {error}"[:500]))
    return spark.createDataFrame(out, "name string, type string, tags array<string>, score double, error string")


def report(spark: SparkSession, results: DataFrame) -> DataFrame:
    """(kind, name, score, n, failed): means over all tasks, by type and by tag."""
    facts = F.array(
        F.struct(F.lit("all").alias("kind"), F.lit("all").alias("name")), F.struct(F.lit("type").alias("kind"), F.col("type").alias("name"))
    )
    tags = F.transform("tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("name")))
    rows = results.select("score", "error", F.explode(F.concat(facts, tags)).alias("x"))
    return rows.groupBy("x.kind", "x.name").agg(F.avg("score").alias("score"), F.count("*").cast("int").alias("n"), F.count("error").cast("int").alias("failed"))


def final_scores(rows: DataFrame, query: str, rank: str, score: str, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """Per query r_at_k, the best score in the first k answers, and final_score, their mean."""
    best = [F.coalesce(F.max(F.when(F.col(rank) <= k, F.col(score))), F.lit(0.0)).alias(f"r_at_{k}") for k in cutoffs]
    scored = rows.groupBy(query).agg(*best)
    return scored.withColumn("final_score", sum([F.col(f"r_at_{k}") for k in cutoffs], F.lit(0.0)) / len(cutoffs))


def truth_ranges(manifest: DataFrame, frames: DataFrame, margin: int = 150, key: Sequence[str] = ("video_id", "local_idx")) -> DataFrame:
    """The manifest with gt_start and gt_end round each item's frame, from 0 on."""
    return manifest.join(frames.select(*key, "frame_idx"), list(key)).withColumn("gt_start", F.greatest(F.lit(0), F.col("frame_idx") - margin)).withColumn("gt_end", F.col("frame_idx") + margin)


def truth_ranks(similarities: DataFrame, query: str = "query_id", is_truth: str = "is_truth", sim: str = "sim") -> DataFrame:
    """(query, rank): one more than the items that are more alike than the truth."""
    truth = F.max(F.when(F.col(is_truth), F.col(sim)))
    return similarities.withColumn("_t", truth.over(Window.partitionBy(query))).groupBy(query).agg((F.sum(F.when(F.col(sim) > F.col("_t"), 1).otherwise(0)) + 1).alias("rank"))


def recall(ranked: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """One row: recall_at_k for each k and median_rank."""
    return ranked.agg(*[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_at_{k}") for k in cutoffs], F.expr("percentile(rank, 0.5)").alias("median_rank"))


def margins(similarities: DataFrame, query: str = "query_id", is_truth: str = "is_truth", sim: str = "sim") -> DataFrame:
    """(query, margin): how much more alike the truth is than the best other item."""
    return similarities.groupBy(query).agg((F.max(F.when(F.col(is_truth), F.col(sim))) - F.max(F.when(~F.col(is_truth), F.col(sim)))).alias("margin"))


def margin_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg("margin").alias("mean"), F.expr("percentile(margin, 0.5)").alias("median"), F.avg((F.col("margin") < 0).cast("double")).alias("negative_share"))


def ranking_metrics(rows: DataFrame, query: str, rank: str, gain: str, k: int) -> DataFrame:
    """Per query: reciprocal rank, average precision and nDCG over the first k answers; gain > 0 is relevant."""
    top = rows.where(F.col(rank) <= k).withColumn("_rel", (F.col(gain) > 0).cast("int"))
    w = Window.partitionBy(query)
    seen = top.withColumn("_hits", F.sum("_rel").over(w.orderBy(rank))).withColumn("_ideal", F.row_number().over(w.orderBy(F.desc(gain), rank)))
    dcg = F.sum(F.col(gain) / F.log2(F.col(rank) + 1))
    ideal = F.sum(F.col(gain) / F.log2(F.col("_ideal") + 1))
    return seen.groupBy(query).agg(
        F.coalesce(F.max(F.when(F.col("_rel") == 1, 1 / F.col(rank))), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.sum(F.when(F.col("_rel") == 1, F.col("_hits") / F.col(rank))) / F.sum("_rel"), F.lit(0.0)).alias("average_precision"),
        F.coalesce(F.when(ideal > 0, dcg / ideal), F.lit(0.0)).alias("ndcg"),
    )


def same_results(one: DataFrame, other: DataFrame, key: Sequence[str], k: int) -> float:
    """The Jaccard likeness of two top-k lists (at most 2k keys reach the driver)."""
    a, b = ({tuple(r) for r in d.limit(k).select(*key).collect()} for d in (one, other))
    return len(a & b) / len(a | b) if a | b else 1.0


def monitor(one: DataFrame, before: DataFrame | None = None, key: Sequence[str] = ("video_id", "frame_idx"), score: str = "score", k: int = 20, same: float = 0.9, flat: float = 0.05, took: float = 0.0, budget: float | None = None, used: float = 0.7) -> DataFrame:
    """One row on a step's ranked results: n, jaccard with the step before, spread of the k best scores, and the flags empty, unchanged, is_flat, late.

    Both lists are top-k results. The spread is (best - last) / best.
    """
    top = one.orderBy(F.desc(score), *key).limit(k)
    facts = top.agg(F.count("*").alias("n"), ((F.max(score) - F.min(score)) / F.when(F.max(score) != 0, F.max(score))).alias("spread"))
    if before is None:
        alike = F.lit(None).cast("double")
    else:
        other = before.orderBy(F.desc(score), *key).limit(k).select(*key)
        both = top.select(*key).withColumn("a", F.lit(1)).join(other.withColumn("b", F.lit(1)), list(key), "full")
        alike = both.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)) / F.greatest(F.count("*"), F.lit(1))).scalar()
    late = budget is not None and took > used * budget
    rows = facts.withColumn("jaccard", alike)
    return rows.select("n", "jaccard", "spread", (F.col("n") == 0).alias("empty"), F.coalesce(F.col("jaccard") > same, F.lit(False)).alias("unchanged"), F.coalesce(F.col("spread") < flat, F.lit(False)).alias("is_flat"), F.lit(late).alias("late"))


def expected_share(frames: DataFrame, filtered: Mapping[str, DataFrame], key: Sequence[str] = ("video_id", "frame_idx")) -> DataFrame:
    """(step, share): how much of the corpus each filter leaves, by keys alone: 0 is a dead end, near 1 a useless filter."""
    every = frames.agg(F.count("*")).scalar()
    shares = [keys.select(*key).distinct().agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), (F.col("n") / every).alias("share")) for step, keys in filtered.items()]
    return reduce(lambda a, b: a.unionByName(b), shares)


def label_audit(objects: DataFrame, region_vectors: DataFrame, label_vectors: DataFrame, n: int, order: Column) -> DataFrame:
    """(label, mean, std, n) of how alike the crops of a label and its own text are, over at most ``n`` crops a label, the least alike first."""
    chosen = sample_per_key(objects.select("label", "detection_id"), ["label"], n, order, ["detection_id"])
    pairs = chosen.join(region_vectors.select("detection_id", "vec"), "detection_id").join(label_vectors.select("label", F.col("vec").alias("text_vec")), "label")
    alike = pairs.withColumn("alike", dot(F.col("vec"), F.col("text_vec")))
    return alike.groupBy("label").agg(F.avg("alike").alias("mean"), F.stddev("alike").alias("std"), F.count("*").alias("n")).orderBy("mean", "label")
