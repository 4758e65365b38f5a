"""Statistics, comparisons, deduplication, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, literal
from ..operators import evaluation, filters, statistics
from .proxies import frames, moments, objects, query_vector, sql, table


def q_label_stats(spark, d):
    return statistics.label_frames(objects(spark, d), (0.9, 0.93, 0.97))


def q_labels_per_frame(spark, d):
    o = objects(spark, d)
    n = o.select("video_id", "frame_idx").distinct().count()
    return statistics.labels_per_frame(o, n, (0.9, 0.93, 0.97)).select("threshold", F.round("labels_per_frame", 6).alias("labels_per_frame"))


def q_percentiles(spark, d):
    found = statistics.percentiles(table(spark, d, "lineitem"), "l_extendedprice", by=["l_returnflag"])
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in found.columns[1:]])


def q_spread(spark, d):
    found = statistics.spread(objects(spark, d), ["label"], "score")
    return found.select("label", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


def q_value_counts(spark, d):
    return statistics.value_counts(table(spark, d, "customer"), "c_mktsegment")


def q_dedupe_first(spark, d):
    rows = moments(spark, d)
    return statistics.first_rows(rows, ["video_id", "event_type"], ["event_id"]).select("video_id", "event_type", "event_id", "score")


def q_dedupe_last(spark, d):
    rows = moments(spark, d).withColumn("shard", F.col("event_id") % 4)
    return statistics.last_rows(rows, ["video_id", "event_type"], ["shard", "event_id"]).select("video_id", "event_type", "event_id", "score")


def q_detector_cmp(spark, d):
    o = objects(spark, d)
    return statistics.compare_detectors(o.where("source = 'closed' and label <> 'AF'"), o.where("source = 'open'"))


def q_label_cmp(spark, d):
    o = objects(spark, d)
    return statistics.compare_labels(o.where("label < 'NP'"), o.where("label > 'AO'"))


def q_cooccurrence(spark, d):
    return statistics.cooccurrence(objects(spark, d), 10)


def q_axis_statistics(spark, d):
    found = statistics.axis_statistics(table(spark, d, "customer"), "c_mktsegment")
    return found.select(F.round("entropy", 6).alias("entropy"), "n_values", F.round("top_share", 6).alias("top_share"))


def q_in_scope(spark, d):
    from .proxies import label_types

    return filters.in_scope(objects(spark, d), label_types(spark), ["person", "animal"], 0.93, ["open"]).select("detection_id", "label")


def q_tag_report(spark, d):
    rows = table(spark, d, "documents").select(F.array("lang", "source").alias("tags"), F.col("n_chars").cast("double").alias("score"))
    found = statistics.mean_by_tag(rows, "tags", "score")
    return found.select("tag", F.round("mean", 4).alias("mean"), "n")


def _answers(spark, d):
    """Events as ranked answers: a user is a query, event ids are ranks and frames."""
    rows = moments(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy("event_id")))
    return rows.select(
        F.col("video_id").alias("query"), "rank", (F.col("event_id") % 10).alias("video_id"), F.col("event_id").alias("frame_id"), F.col("event_type").alias("answer"),
        F.lit(3).cast("bigint").alias("gt_video_id"), (F.col("video_id") * 30).alias("gt_start"), (F.col("video_id") * 30 + 4000).alias("gt_end"), F.lit("View click").alias("gt_answer"), "score",
    )


def q_rscore(spark, d):
    return _answers(spark, d).select("query", F.col("frame_id"), evaluation.kis_score().alias("kis"), evaluation.qa_score().alias("qa"))


def q_chain_rscore(spark, d):
    ranges = F.array(*[F.struct(F.lit(a).cast("bigint").alias("s"), F.lit(b).cast("bigint").alias("e")) for a, b in ((0, 4000), (3000, 7000))])
    rows = _answers(spark, d).withColumn("frame_id_1", F.col("frame_id")).withColumn("frame_id_2", F.col("frame_id") + 500).withColumn("gt_ranges", ranges)
    return rows.select("query", "frame_id", evaluation.chain_score(2).alias("score"))


def q_final_score(spark, d):
    found = evaluation.final_scores(_answers(spark, d).withColumn("kis", evaluation.kis_score()), "query", "rank", "kis")
    return found.select("query", "r_at_1", "r_at_20", "r_at_100", F.round("final_score", 6).alias("final_score"))


def _similar(spark, d):
    """Each frame against the query's slices: the label is a query, its least frame the truth."""
    rows = frames(spark, d).select("label", "frame_idx", F.round(dot(F.col("vec"), literal(query_vector(spark, d))), 6).alias("sim"))
    first = F.min("frame_idx").over(Window.partitionBy("label"))
    return rows.select(F.col("label").alias("query_id"), (F.col("frame_idx") == first).alias("is_truth"), "sim")


def q_recall_ranks(spark, d):
    return evaluation.truth_ranks(_similar(spark, d))


def q_recall(spark, d):
    return evaluation.recall(evaluation.truth_ranks(_similar(spark, d)), (1, 10, 50))


def q_margin(spark, d):
    return evaluation.margins(_similar(spark, d)).select("query_id", F.round("margin", 6).alias("margin"))


def q_metrics(spark, d):
    rows = _answers(spark, d).withColumn("gain", F.when(F.col("score") > 10, F.col("score")).otherwise(0.0))
    found = evaluation.ranking_metrics(rows, "query", "rank", "gain", 20)
    return found.select("query", *[F.round(c, 6).alias(c) for c in ("reciprocal_rank", "average_precision", "ndcg")])


def q_truth_ranges(spark, d):
    rows = frames(spark, d).select("video_id", F.col("frame_idx").alias("local_idx"), (F.col("frame_idx") * 3).alias("frame_idx"), "label")
    manifest = rows.where("label < 2").select("video_id", "local_idx")
    return evaluation.truth_ranges(manifest, rows).select("video_id", "local_idx", F.col("gt_start").cast("bigint").alias("gt_start"), F.col("gt_end").cast("bigint").alias("gt_end"))


_ANSWERS = """, a AS (SELECT video_id AS query, row_number() OVER (PARTITION BY video_id ORDER BY event_id) AS rank, event_id % 10 AS vid, event_id AS frame_id, event_type AS answer,
        video_id * 30 AS lo, video_id * 30 + 4000 AS hi, score FROM moments)"""
_KIS = "CASE WHEN vid = 3 AND frame_id BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END"
_SIMILAR = """, s AS (SELECT label AS query_id, frame_idx = min(frame_idx) OVER (PARTITION BY label) AS is_truth, round(list_dot_product(vec, qv), 6) AS sim FROM frames, q)"""
_RANKS = ", r AS (SELECT query_id, count(*) FILTER (WHERE sim > t) + 1 AS rank FROM (SELECT *, max(sim) FILTER (WHERE is_truth) OVER (PARTITION BY query_id) AS t FROM s) GROUP BY query_id)"

ORACLE = {
    "q_label_stats": sql("objects", """, b AS (SELECT video_id, frame_idx, label, max(score) AS best FROM objects GROUP BY ALL)
        SELECT t.threshold, label, count(*) AS n_frames FROM b JOIN (VALUES (9e-1), (93e-2), (97e-2)) t(threshold) ON best >= t.threshold GROUP BY ALL"""),
    "q_labels_per_frame": sql("objects", """, b AS (SELECT video_id, frame_idx, label, max(score) AS best FROM objects GROUP BY ALL)
        SELECT t.threshold, round(count(*) / CAST((SELECT count(DISTINCT frame_idx) FROM objects) AS DOUBLE), 6) AS labels_per_frame FROM b JOIN (VALUES (9e-1), (93e-2), (97e-2)) t(threshold) ON best >= t.threshold GROUP BY ALL"""),
    "q_percentiles": "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS p{round(p * 100)}" for p in (0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM lineitem GROUP BY l_returnflag",
    "q_spread": sql("objects", " SELECT label, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, count(*) AS n FROM objects GROUP BY label"),
    "q_value_counts": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL",
    "q_dedupe_first": sql("moments", " SELECT video_id, event_type, event_id, score FROM moments QUALIFY row_number() OVER (PARTITION BY video_id, event_type ORDER BY event_id) = 1"),
    "q_dedupe_last": sql("moments", " SELECT video_id, event_type, event_id, score FROM moments QUALIFY row_number() OVER (PARTITION BY video_id, event_type ORDER BY event_id % 4 DESC, event_id DESC) = 1"),
    "q_detector_cmp": sql("objects", """, a AS (SELECT video_id, frame_idx, count(*) AS n FROM objects WHERE source = 'closed' AND label <> 'AF' GROUP BY ALL), b AS (SELECT video_id, frame_idx, count(*) AS n FROM objects WHERE source = 'open' GROUP BY ALL)
        SELECT coalesce(a.video_id, b.video_id) AS video_id, coalesce(a.frame_idx, b.frame_idx) AS frame_idx, coalesce(a.n, 0) AS n_one, coalesce(b.n, 0) AS n_other FROM a FULL JOIN b ON a.frame_idx = b.frame_idx"""),
    "q_label_cmp": sql("objects", " SELECT label, CASE WHEN label >= 'NP' THEN 'other' WHEN label <= 'AO' THEN 'one' ELSE 'both' END AS side FROM (SELECT DISTINCT label FROM objects)"),
    "q_cooccurrence": sql("objects", """, p AS (SELECT DISTINCT frame_idx, label FROM objects) SELECT a.label AS label_a, b.label AS label_b, count(*) AS n_frames FROM p a JOIN p b ON a.frame_idx = b.frame_idx AND a.label < b.label GROUP BY ALL HAVING n_frames >= 10"""),
    "q_axis_statistics": """WITH p AS (SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)
        SELECT round(-sum(p * log2(p)), 6) AS entropy, count(*) AS n_values, round(max(p), 6) AS top_share FROM p""",
    "q_in_scope": sql("objects", " SELECT detection_id, label FROM objects WHERE source = 'open' OR (label IN ('AF', 'AO') AND score >= 93e-2)"),
    "q_tag_report": "SELECT tag, round(avg(n_chars), 4) AS mean, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag, n_chars FROM documents) GROUP BY tag",
    "q_rscore": sql("moments", _ANSWERS + f" SELECT query, frame_id, {_KIS} AS kis, CASE WHEN answer IN ('view', 'click') THEN {_KIS} ELSE 0e0 END AS qa FROM a"),
    "q_chain_rscore": sql("moments", _ANSWERS + " SELECT query, frame_id, CASE WHEN vid = 3 THEN (CAST(frame_id BETWEEN 0 AND 4000 AS INTEGER) + CAST(frame_id + 500 BETWEEN 3000 AND 7000 AS INTEGER)) / 2e0 ELSE 0e0 END AS score FROM a"),
    "q_final_score": sql("moments", _ANSWERS + f", k AS (SELECT *, {_KIS} AS s FROM a), m AS (SELECT query, " + ", ".join(f"coalesce(max(s) FILTER (WHERE rank <= {k}), 0e0) AS r{k}" for k in evaluation.CUTOFFS)
        + " FROM k GROUP BY query) SELECT query, r1 AS r_at_1, r20 AS r_at_20, r100 AS r_at_100, round((r1 + r5 + r20 + r50 + r100) / 5, 6) AS final_score FROM m"),
    "q_recall_ranks": sql("frames q", _SIMILAR + _RANKS + " SELECT * FROM r"),
    "q_recall": sql("frames q", _SIMILAR + _RANKS + " SELECT " + ", ".join(f"avg(CAST(rank <= {k} AS INTEGER)) AS recall_at_{k}" for k in (1, 10, 50)) + ", quantile_cont(CAST(rank AS DOUBLE), 0.5) AS median_rank FROM r"),
    "q_margin": sql("frames q", _SIMILAR + " SELECT query_id, round(max(sim) FILTER (WHERE is_truth) - max(sim) FILTER (WHERE NOT is_truth), 6) AS margin FROM s GROUP BY query_id"),
    "q_metrics": sql("moments", _ANSWERS + """, g AS (SELECT query, rank, CASE WHEN score > 10 THEN score ELSE 0 END AS gain FROM a WHERE rank <= 20),
        h AS (SELECT *, sum(CAST(gain > 0 AS INTEGER)) OVER (PARTITION BY query ORDER BY rank) AS hits, row_number() OVER (PARTITION BY query ORDER BY gain DESC, rank) AS ideal FROM g)
        SELECT query, round(coalesce(max(1e0 / rank) FILTER (WHERE gain > 0), 0), 6) AS reciprocal_rank, round(coalesce(sum(hits / CAST(rank AS DOUBLE)) FILTER (WHERE gain > 0) / count(*) FILTER (WHERE gain > 0), 0), 6) AS average_precision,
               round(coalesce(sum(gain / log2(rank + 1)) / nullif(sum(gain / log2(ideal + 1)), 0), 0), 6) AS ndcg FROM h GROUP BY query"""),
    "q_truth_ranges": sql("frames", " SELECT video_id, frame_idx AS local_idx, CAST(greatest(0, frame_idx * 3 - 150) AS BIGINT) AS gt_start, CAST(frame_idx * 3 + 150 AS BIGINT) AS gt_end FROM frames WHERE label < 2"),
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
