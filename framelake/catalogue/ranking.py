"""Filters, exact ranking, fusion, boosts, backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import dot, literal
from ..operators import boosts, filters, ranking
from .proxies import frames, lines, objects, query_vector, speech, sql, videos

_DOT = "round(list_dot_product(vec, qv), 6)"
_SLICES = ((1, 21), (22, 21), (43, 22))
_KEY = ["video_id", "frame_idx"]


def _space(rows, i):
    a, n = _SLICES[i]
    return rows.withColumn("vec", F.slice("vec", a, n))


def q_topk_dot(spark, d):
    return ranking.rank_vectors(frames(spark, d), query_vector(spark, d), 10, digits=6).select(*_KEY, "score")


def q_filtered_topk(spark, d):
    rows = frames(spark, d)
    keys = rows.where(F.col("label").isin(1, 3)).select(*_KEY)
    return ranking.rank_vectors(rows, query_vector(spark, d), 15, keys, digits=6).select(*_KEY, "score")


def _scored(spark, d):
    return frames(spark, d).select(*_KEY, "label", F.round(dot(F.col("vec"), literal(query_vector(spark, d))), 6).alias("score"))


def q_backfill(spark, d):
    rows = _scored(spark, d)
    return ranking.backfill(rows.where("label = 2 and score > 0.05"), rows, 40).select(*_KEY, "score", "is_backfill")


def q_rrf(spark, d):
    q, rows = query_vector(spark, d), frames(spark, d)
    pools = [ranking.rank_vectors(_space(rows, i), q[a - 1 : a - 1 + n], 50, digits=6).select(*_KEY, "score") for i, (a, n) in enumerate(_SLICES)]
    return ranking.reciprocal_rank_fusion(pools, 20, digits=9).select(*_KEY, "score")


def q_comb_mnz(spark, d):
    q, rows = query_vector(spark, d), frames(spark, d)
    pools = [(f"s{i}", ranking.rank_vectors(_space(rows, i), q[a - 1 : a - 1 + n], 50, digits=6)) for i, (a, n) in enumerate(_SLICES)]
    return ranking.comb_sum(pools, times_sources=True).select(*_KEY, F.round("score", 4).alias("score"), F.size("source_scores").cast("bigint").alias("n_sources"))


def q_meta_filter(spark, d):
    return filters.by_metadata(videos(spark, d), ["BUILDING", "MACHINERY"], "1996-01-01", "1999-06-30", ["ring", "blue", "1-urgent"])


def q_label_and_counts(spark, d):
    return filters.by_labels(objects(spark, d), ["AF", "NO"], {"AF": 2})


def q_label_or_groups(spark, d):
    return filters.by_label_groups(objects(spark, d), [(("AF", "AO"), 2), (("RF",), 1)], sources=("closed",))


_BOXES = [{"type": "object", "labels": ["AF", "RF"], "min_count": 3}, {"type": "object", "labels": ["NO"], "min_count": 2}]


def q_box_and(spark, d):
    return filters.by_drawn_boxes(objects(spark, d), None, _BOXES, "and")


def q_box_or(spark, d):
    return filters.by_drawn_boxes(objects(spark, d), None, _BOXES, "or")


def q_combine(spark, d):
    o = objects(spark, d)
    allowed = filters.by_metadata(videos(spark, d), ["BUILDING", "HOUSEHOLD", "MACHINERY"])
    return filters.combine(frames(spark, d), allowed, [filters.by_labels(o, ["AF"]), filters.by_labels(o, ["NO"])])


def q_iou_filter(spark, d):
    return filters.by_text(lines(spark, d), "the", (0.1, 0.1, 0.5, 0.6))


def q_iou_boost(spark, d):
    pool = ranking.rank_vectors(frames(spark, d), query_vector(spark, d), 200, digits=6).select(*_KEY, "score")
    signal = boosts.mean_signal([boosts.position_signal(objects(spark, d), ["AF", "NO"], (0.2, 0.2, 0.6, 0.6)), boosts.position_signal(objects(spark, d), ["RF"], (0.0, 0.0, 0.4, 0.4))])
    out = boosts.boosted(pool, signal, "position", boosts.POSITION)
    return out.select(*_KEY, F.round("position_boost", 6).alias("position_boost"), "score_before_position", F.round("score", 6).alias("score"))


def q_interval_boost(spark, d):
    pool = ranking.rank_vectors(frames(spark, d), query_vector(spark, d), 200, digits=6).select(*_KEY, "score")
    said = speech(spark, d)
    signal = boosts.clipped_sum([boosts.spoken_signal(pool, said, t, default_fps=2.0) for t in ("the of", "der die", "les")])
    return boosts.boosted(pool, signal, "audio", boosts.AUDIO).select(*_KEY, "audio_boost", F.round("score", 6).alias("score"))


def q_mentioned_boost(spark, d):
    pool = ranking.rank_vectors(frames(spark, d), query_vector(spark, d), 200, digits=6).select(*_KEY, "score")
    signal = boosts.clipped_sum([boosts.mentioned_signal(speech(spark, d), t) for t in ("of the", "les")])
    return boosts.boosted(pool, signal, "speech", boosts.SPEECH).select(*_KEY, "speech_boost", F.round("score", 6).alias("score"))


def q_secondary_boost(spark, d):
    pool = ranking.rank_vectors(frames(spark, d), query_vector(spark, d), 100, digits=6).select(*_KEY, "score")
    signal = boosts.mean_signal([boosts.secondary_signal(objects(spark, d), [label]) for label in ("AF", "RO")])
    return boosts.boosted(pool, signal, "secondary", boosts.SECONDARY).select(*_KEY, F.round("secondary_boost", 6).alias("secondary_boost"), F.round("score", 6).alias("score"))


def q_region_rerank(spark, d):
    q = query_vector(spark, d)
    pool = ranking.rank_vectors(frames(spark, d), q, 100, digits=6).select(*_KEY, "score")
    o = objects(spark, d)
    crops = frames(spark, d).select(F.col("frame_idx").alias("i"), "vec")
    regions = o.select("detection_id", (F.floor(F.col("detection_id") / 10000) % 500).cast("int").alias("i")).join(crops, "i").select("detection_id", "vec")
    signal = boosts.mean_signal([boosts.region_signal(o, regions, labels, q) for labels in (["AF"], ["NO", "RF"])])
    return boosts.boosted(pool, signal, "region", boosts.REGION).select(*_KEY, F.round("region_boost", 6).alias("region_boost"), F.round("score", 6).alias("score"))


def q_agreement(spark, d):
    pool = ranking.rank_vectors(frames(spark, d), query_vector(spark, d), 300, digits=6).select(*_KEY, "score")
    return boosts.agreement_signal(pool, lines(spark, d), speech(spark, d), 30).select(*_KEY, F.round("signal", 6).alias("agreement"))


def q_calibrated_combine(spark, d):
    q, rows = query_vector(spark, d), frames(spark, d)
    for i, (a, n) in enumerate(_SLICES):
        rows = rows.withColumn(f"s{i}", F.round(dot(F.slice("vec", a, n), literal(q[a - 1 : a - 1 + n])), 6))
    pool = ranking.calibrated(rows.where("label in (0, 1, 2)"), ["s0", "s1", "s2"])
    return pool.select(*_KEY, F.round(ranking.combined(["c_s0", "c_s1", "c_s2"]), 6).alias("combined"), F.round(ranking.combine_and(["c_s0", "c_s1", "c_s2"], "penalty"), 6).alias("penalty"))


def q_entropy(spark, d):
    pool = _scored(spark, d).where("score > 0")
    return ranking.beliefs(pool).groupBy("label").agg(F.round(F.sum("belief"), 6).alias("belief"), F.round(ranking.entropy(), 6).alias("entropy"))


def q_one_per_video(spark, d):
    return ranking.max_per_group(_scored(spark, d), ["video_id"], 2, [F.desc("score"), "frame_idx"]).select(*_KEY, "score")


_POOL = f"pool AS (SELECT video_id, frame_idx, {_DOT} AS score FROM frames, q ORDER BY score DESC, video_id, frame_idx LIMIT {{k}})"
_TOP = "SELECT video_id, frame_idx, score FROM s ORDER BY score DESC, video_id, frame_idx LIMIT {k}"


def _pool(names: str, k: int, body: str) -> str:
    return sql(f"frames q {names}".strip(), ",\n" + _POOL.format(k=k) + body)


_PARTS = ",\n".join(
    f"p{i} AS (SELECT video_id, frame_idx, score, row_number() OVER (ORDER BY score DESC, video_id, frame_idx) AS rank, {i} AS pool FROM "
    f"(SELECT video_id, frame_idx, round(list_dot_product(vec[{a}:{a + n - 1}], qv[{a}:{a + n - 1}]), 6) AS score FROM frames, q ORDER BY score DESC, video_id, frame_idx LIMIT 50))"
    for i, (a, n) in enumerate(_SLICES)
)
_ALL = "u AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)"
_IOU = """CASE WHEN ar + {area} - i > 0 THEN i / (ar + {area} - i) ELSE 0 END"""


def _overlap(y0, x0, y1, x1) -> str:
    inter = f"greatest(0e0, least(ymax, {y1}e0) - greatest(ymin, {y0}e0)) * greatest(0e0, least(xmax, {x1}e0) - greatest(xmin, {x0}e0))"
    own = "greatest(0e0, ymax - ymin) * greatest(0e0, xmax - xmin)"
    area = f"({y1}e0 - {y0}e0) * ({x1}e0 - {x0}e0)"
    return f"(CASE WHEN {own} + {area} - {inter} > 0 THEN {inter} / ({own} + {area} - {inter}) ELSE 0 END)"


ORACLE = {
    "q_topk_dot": sql("frames q", f", s AS (SELECT video_id, frame_idx, {_DOT} AS score FROM frames, q) " + _TOP.format(k=10)),
    "q_filtered_topk": sql("frames q", f", s AS (SELECT video_id, frame_idx, {_DOT} AS score FROM frames, q WHERE label IN (1, 3)) " + _TOP.format(k=15)),
    "q_backfill": sql("frames q", f""", s AS (SELECT video_id, frame_idx, label, {_DOT} AS score FROM frames, q),
        own AS (SELECT video_id, frame_idx, score, false AS is_backfill FROM s WHERE label = 2 AND score > 5e-2 ORDER BY score DESC, video_id, frame_idx LIMIT 40),
        more AS (SELECT video_id, frame_idx, score, true AS is_backfill FROM s WHERE frame_idx NOT IN (SELECT frame_idx FROM own))
        SELECT * FROM (SELECT * FROM own UNION ALL SELECT * FROM more) ORDER BY is_backfill, score DESC, video_id, frame_idx LIMIT 40"""),
    "q_rrf": sql("frames q", f", {_PARTS}, {_ALL} SELECT video_id, frame_idx, round(sum(1e0 / (60 + rank)), 9) AS score FROM u GROUP BY ALL ORDER BY score DESC, min(pool * 1000 + rank), video_id, frame_idx LIMIT 20"),
    "q_comb_mnz": sql("frames q", f", {_PARTS}, {_ALL} SELECT video_id, frame_idx, round(sum(score) * count(*), 4) AS score, count(*) AS n_sources FROM u GROUP BY ALL"),
    "q_meta_filter": sql("videos", """ SELECT DISTINCT video_id FROM videos WHERE author IN ('BUILDING', 'MACHINERY') AND publish_date >= TIMESTAMP '1996-01-01' AND publish_date <= TIMESTAMP '1999-06-30'
        AND (contains(' ' || coalesce(title, '') || ' ' || keywords_text || ' ', ' ring ') OR contains(' ' || coalesce(title, '') || ' ' || keywords_text || ' ', ' blue ') OR contains(' ' || coalesce(title, '') || ' ' || keywords_text || ' ', ' 1-urgent '))"""),
    "q_label_and_counts": sql("objects", " SELECT video_id, frame_idx FROM objects GROUP BY ALL HAVING count(*) FILTER (WHERE label = 'AF') >= 2 AND count(*) FILTER (WHERE label = 'NO') >= 1"),
    "q_label_or_groups": sql("objects", " SELECT video_id, frame_idx FROM objects WHERE source = 'closed' GROUP BY ALL HAVING count(*) FILTER (WHERE label IN ('AF', 'AO')) >= 2 AND count(*) FILTER (WHERE label = 'RF') >= 1"),
    "q_box_and": sql("objects", " SELECT video_id, frame_idx FROM objects GROUP BY ALL HAVING count(*) FILTER (WHERE label IN ('AF', 'RF')) >= 3 AND count(*) FILTER (WHERE label = 'NO') >= 2"),
    "q_box_or": sql("objects", " SELECT video_id, frame_idx FROM objects GROUP BY ALL HAVING count(*) FILTER (WHERE label IN ('AF', 'RF')) >= 3 OR count(*) FILTER (WHERE label = 'NO') >= 2"),
    "q_combine": sql("objects videos", """ SELECT video_id, frame_idx FROM objects WHERE video_id IN (SELECT video_id FROM videos WHERE author IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY'))
        GROUP BY ALL HAVING count(*) FILTER (WHERE label = 'AF') >= 1 AND count(*) FILTER (WHERE label = 'NO') >= 1"""),
    "q_iou_filter": sql("lines", f""" SELECT DISTINCT video_id, CAST(unnest(range(frame_start, frame_end + 1)) AS INTEGER) AS frame_idx FROM lines
        WHERE contains(' ' || text_norm || ' ', ' the ') AND {_overlap(0.1, 0.1, 0.5, 0.6)} > 5e-2"""),
    "q_iou_boost": _pool("objects", 200, f""", a AS (SELECT video_id, frame_idx, max({_overlap(0.2, 0.2, 0.6, 0.6)}) AS x FROM objects WHERE label IN ('AF', 'NO') GROUP BY ALL),
        b AS (SELECT video_id, frame_idx, max({_overlap(0.0, 0.0, 0.4, 0.4)}) AS y FROM objects WHERE label = 'RF' GROUP BY ALL)
        SELECT video_id, frame_idx, round((coalesce(x, 0) + coalesce(y, 0)) / 2, 6) AS position_boost, score AS score_before_position, round(score + 15e-2 * (coalesce(x, 0) + coalesce(y, 0)) / 2, 6) AS score
        FROM pool LEFT JOIN a USING (video_id, frame_idx) LEFT JOIN b USING (video_id, frame_idx)"""),
    "q_interval_boost": _pool("speech", 200, r""", h AS (SELECT video_id, frame_idx_start - 6 AS lo, frame_idx_end + 6 AS hi, regexp_matches(text_norm, '(^|\s)the\s(.*\s)?of(\s|$)', 's') AS a,
            regexp_matches(text_norm, '(^|\s)der\s(.*\s)?die(\s|$)', 's') AS b, regexp_matches(text_norm, '(^|\s)les(\s|$)', 's') AS c FROM speech)
        SELECT p.video_id, p.frame_idx, CAST(coalesce(max(CASE WHEN a OR b OR c THEN 1 ELSE 0 END), 0) AS DOUBLE) AS audio_boost,
               round(p.score + 8e-2 * coalesce(max(CASE WHEN a OR b OR c THEN 1 ELSE 0 END), 0), 6) AS score
        FROM pool p LEFT JOIN h ON p.video_id = h.video_id AND p.frame_idx BETWEEN lo AND hi GROUP BY p.video_id, p.frame_idx, p.score"""),
    "q_mentioned_boost": _pool("speech", 200, """ SELECT p.video_id, p.frame_idx, CAST(count(s.video_id) > 0 AS INTEGER) * 1e0 AS speech_boost, round(p.score + 8e-2 * CAST(count(s.video_id) > 0 AS INTEGER), 6) AS score
        FROM pool p LEFT JOIN (SELECT * FROM speech WHERE contains(' ' || text_norm || ' ', ' of the ') OR contains(' ' || text_norm || ' ', ' les ')) s
        ON p.video_id = s.video_id AND p.frame_idx BETWEEN frame_idx_start AND frame_idx_end GROUP BY p.video_id, p.frame_idx, p.score"""),
    "q_secondary_boost": _pool("objects", 100, """, a AS (SELECT video_id, frame_idx, coalesce(max(score) FILTER (WHERE label = 'AF'), 0) + coalesce(max(score) FILTER (WHERE label = 'RO'), 0) AS x FROM objects GROUP BY ALL)
        SELECT video_id, frame_idx, round(coalesce(x, 0) / 2, 6) AS secondary_boost, round(pool.score + 15e-2 * coalesce(x, 0) / 2, 6) AS score FROM pool LEFT JOIN a USING (video_id, frame_idx)"""),
    "q_region_rerank": _pool("objects", 100, """, c AS (SELECT o.video_id, o.frame_idx, o.label, list_dot_product(f.vec, qv) AS sim FROM objects o JOIN frames f ON f.frame_idx = o.detection_id // 10000 % 500, q),
        m AS (SELECT video_id, frame_idx, (coalesce(max(sim) FILTER (WHERE label = 'AF'), 0) + coalesce(max(sim) FILTER (WHERE label IN ('NO', 'RF')), 0)) / 2 AS x FROM c GROUP BY ALL)
        SELECT video_id, frame_idx, round(coalesce(x, 0), 6) AS region_boost, round(score + 5e-1 * coalesce(x, 0), 6) AS score FROM pool LEFT JOIN m USING (video_id, frame_idx)"""),
    "q_agreement": _pool("lines speech", 300, r""", a AS (SELECT p.video_id, p.frame_idx, list_distinct(flatten(list(list_filter(string_split(text_norm, ' '), lambda w: length(w) >= 3 OR regexp_matches(w, '^[0-9]+$'))))) AS seen
            FROM pool p JOIN lines l ON p.video_id = l.video_id AND p.frame_idx BETWEEN frame_start AND frame_end GROUP BY ALL),
        b AS (SELECT p.video_id, p.frame_idx, list_distinct(flatten(list(list_filter(string_split(text_norm, ' '), lambda w: length(w) >= 3 OR regexp_matches(w, '^[0-9]+$'))))) AS heard
            FROM pool p JOIN speech s ON p.video_id = s.video_id AND p.frame_idx BETWEEN frame_idx_start - 30 AND frame_idx_end + 30 GROUP BY ALL)
        SELECT video_id, frame_idx, round(len(list_intersect(seen, heard)) / CAST(least(len(seen), len(heard)) AS DOUBLE), 6) AS agreement FROM a JOIN b USING (video_id, frame_idx) WHERE len(seen) > 0 AND len(heard) > 0"""),
    "q_calibrated_combine": sql("frames q", ", s AS (SELECT video_id, frame_idx, " + ", ".join(f"round(list_dot_product(vec[{a}:{a + n - 1}], qv[{a}:{a + n - 1}]), 6) AS s{i}" for i, (a, n) in enumerate(_SLICES))
        + " FROM frames, q WHERE label IN (0, 1, 2)), c AS (SELECT video_id, frame_idx, " + ", ".join(f"(s{i} - min(s{i}) OVER ()) / (max(s{i}) OVER () - min(s{i}) OVER ()) AS c{i}" for i in range(3))
        + """ FROM s) SELECT video_id, frame_idx, round((c0 + c1 + c2) / 3 * (1 - 7e-1) + least(c0, c1, c2) * 7e-1, 6) AS combined, round((c0 + c1 + c2) / 3 - 7e-1 * (1 - least(c0, c1, c2)), 6) AS penalty FROM c"""),
    "q_entropy": sql("frames q", f""", s AS (SELECT label, {_DOT} AS score FROM frames, q), b AS (SELECT label, score / sum(score) OVER () AS p FROM s WHERE score > 0)
        SELECT label, round(sum(p), 6) AS belief, round(-sum(p * log2(p)), 6) AS entropy FROM b GROUP BY label"""),
    "q_one_per_video": sql("frames q", f", s AS (SELECT video_id, frame_idx, {_DOT} AS score FROM frames, q) SELECT video_id, frame_idx, score FROM s QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx) <= 2"),
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
