"""Positions, pilots, calibrations, neighbourhoods, two-stage search, facets, bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import Box, grid_position
from ..functions.vectors import dot, literal
from ..operators import exploration, ranking, relations, sequence
from . import relations as shapes
from .proxies import frames, label_types, moments, objects, query_vector, sql, table

_KEY = ["video_id", "frame_idx"]


def q_zip_by_position(spark, d):
    a, b = table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return exploration.zip_by_position(a, b, ["s_suppkey"], ["c_acctbal", "c_custkey"]).select("s_suppkey", "c_custkey")


def q_pilot_frames(spark, d):
    pairs = relations.gate_pairs(objects(spark, d), label_types(spark), relations.registry(spark), budget=6)
    return exploration.pilot_frames(pairs, ["feeding", "part_of"], 40, sequence.portable_hash(F.col("frame_idx")))


def q_z_scores(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return exploration.z_scored(rows, ["size", "price"]).select("p_partkey", F.round("z_sum", 6).alias("z_sum"))


def q_mean_shift(spark, d):
    rows, q = frames(spark, d), query_vector(spark, d)
    moved = exploration.shifted_query(q, exploration.mean_vector(rows.where("label < 5")), exploration.mean_vector(rows.where("label >= 5")))
    return ranking.rank_vectors(rows, moved, 12, digits=6).select(*_KEY, "score")


def q_sound_segments(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("value") / 20).alias("no_speech_prob"), (F.col("event_id") % 40 / 10).alias("compression_ratio"))
    return exploration.sound_segments(rows).select("event_id")


def q_with_neighbours(spark, d):
    return exploration.with_neighbours(moments(spark, d), 7200, 0.5, order="t").select("video_id", "event_id", F.round("context_score", 6).alias("context_score"))


def q_two_stage(spark, d):
    rows = frames(spark, d)
    numbered = rows.withColumn("segment", F.floor(F.col("frame_idx") / 10).cast("int"))
    segments = numbered.groupBy("segment").agg(F.min_by("vec", "frame_idx").alias("vec"))
    inside = rows.withColumn("segment", F.floor(F.col("frame_idx") / 10).cast("int"))
    return exploration.two_stage(segments, inside, query_vector(spark, d), 8, 20, ["segment"]).select(*_KEY, "score")


def q_facet_gains(spark, d):
    rows = frames(spark, d).withColumn("score", F.round(dot(F.col("vec"), literal(query_vector(spark, d))), 6)).where("score > 0")
    found = exploration.facet_gains(ranking.beliefs(rows), ["video_id", "label"])
    return found.select("facet", "n_values", F.round("gain", 6).alias("gain"))


def q_grid_lists(spark, d):
    found = exploration.grid_lists(objects(spark, d), grid_position(Box.of()), 5)
    return found.select("cell", "label", *_KEY, "score", F.col("place").cast("bigint").alias("place"), "n_frames")


def q_bindings(spark, d):
    """Roles AF and NO, each object of a frame an item for both: its score for its own label, half of it for the other."""
    o = objects(spark, d).where("label in ('AF', 'NO')")
    both = o.withColumn("role", F.explode(F.array(F.lit("AF"), F.lit("NO")))).withColumn("s", F.when(F.col("role") == F.col("label"), F.col("score")).otherwise(F.col("score") / 2))
    return exploration.bindings(both, _KEY, "role", "detection_id", "s").select(*_KEY, F.round("total", 6).alias("total"))


_MEANS = """, m AS (SELECT i, avg(vec[i]) FILTER (WHERE label < 5) - avg(vec[i]) FILTER (WHERE label >= 5) AS x FROM frames, range(1, 65) r(i) GROUP BY i),
        w AS (SELECT list(qv[i] + x ORDER BY i) AS qv FROM q, m)"""

ORACLE = {
    "q_zip_by_position": """WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer)
        SELECT s_suppkey, c_custkey FROM a JOIN b USING (i)""",
    "q_z_scores": """SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () + (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS z_sum FROM part""",
    "q_mean_shift": sql("frames q", _MEANS + """ SELECT video_id, frame_idx, round(list_dot_product(vec, w.qv), 6) AS score FROM frames, w ORDER BY score DESC, video_id, frame_idx LIMIT 12"""),
    "q_sound_segments": "SELECT event_id FROM events WHERE value / 20 < 6e-1 AND event_id % 40 / 1e1 <= 24e-1",
    "q_with_neighbours": sql("moments", """ SELECT a.video_id, a.event_id, round(a.score + 5e-1 * greatest(coalesce(max(b.score), 0), 0), 6) AS context_score
        FROM moments a LEFT JOIN moments b ON a.video_id = b.video_id AND abs(b.t - a.t) BETWEEN 1 AND 7200 GROUP BY a.video_id, a.event_id, a.score"""),
    "q_two_stage": sql("frames q", """, s AS (SELECT segment, round(list_dot_product(v, qv), 6) AS score FROM (SELECT frame_idx // 10 AS segment, arg_min(vec, frame_idx) AS v FROM frames GROUP BY ALL), q ORDER BY score DESC, segment LIMIT 8)
        SELECT video_id, frame_idx, round(list_dot_product(vec, qv), 6) AS score FROM frames, q WHERE frame_idx // 10 IN (SELECT segment FROM s) ORDER BY score DESC, video_id, frame_idx LIMIT 20"""),
    "q_facet_gains": sql("frames q", """, s AS (SELECT video_id, CAST(label AS VARCHAR) AS label, round(list_dot_product(vec, qv), 6) AS score FROM frames, q), b AS (SELECT *, score / sum(score) OVER () AS p FROM s WHERE score > 0),
        u AS (SELECT 'video_id' AS facet, video_id AS v, sum(p) AS p FROM b GROUP BY ALL UNION ALL SELECT 'label', label, sum(p) FROM b GROUP BY ALL)
        SELECT facet, count(*) AS n_values, round(-sum(p * log2(p)), 6) AS gain FROM u GROUP BY facet"""),
    "q_grid_lists": sql("objects", """, p AS (SELECT *, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM objects), g AS (
            SELECT *, CASE WHEN x < 1e0 / 3 THEN 'left' WHEN x < 2e0 / 3 THEN 'center' ELSE 'right' END AS h, CASE WHEN y < 1e0 / 3 THEN 'top' WHEN y < 2e0 / 3 THEN 'middle' ELSE 'bottom' END AS v FROM p),
        c AS (SELECT CASE WHEN h = 'center' AND v = 'middle' THEN 'center' WHEN v = 'middle' THEN h WHEN h = 'center' THEN v ELSE v || '-' || h END AS cell, label, video_id, frame_idx, max(score) AS score FROM g GROUP BY ALL)
        SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY cell, label) AS n_frames FROM c WINDOW w AS (PARTITION BY cell, label ORDER BY score DESC, video_id, frame_idx) QUALIFY row_number() OVER w <= 5"""),
    "q_bindings": sql("objects", """, o AS (SELECT video_id, frame_idx, detection_id, CASE WHEN label = 'AF' THEN score ELSE score / 2 END AS af, CASE WHEN label = 'NO' THEN score ELSE score / 2 END AS no FROM objects WHERE label IN ('AF', 'NO'))
        SELECT a.video_id, a.frame_idx, round(max(a.af + b.no), 6) AS total FROM o a LEFT JOIN o b ON a.frame_idx = b.frame_idx AND a.detection_id <> b.detection_id GROUP BY ALL"""),
    "q_pilot_frames": sql("objects label_types", f""", {shapes._REGISTRY}, {shapes._PAIRS.format(budget=6)}, n AS (SELECT video_id, frame_idx, bool_or(list_has_any(allowed, ['feeding', 'part_of'])) AS rare,
            (frame_idx * 7919 + 42 * 104729) % 1000003 AS o FROM kept GROUP BY ALL),
        f AS (SELECT *, CASE WHEN rare AND row_number() OVER (PARTITION BY rare ORDER BY o, video_id, frame_idx) <= 20 THEN 0 ELSE 1 END AS turn FROM n)
        SELECT video_id, frame_idx, rare FROM f ORDER BY turn, o, video_id, frame_idx LIMIT 40"""),
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
