"""Smaller operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, text, vectors
from ..operators import boosts, dictionary, evaluation, exploration, filters, ranking, sequence, statistics, temporal
from ..plans import planner, search
from ..sources import readers
from .proxies import frames, lines, moments, objects, query_vector, sql, table

_KEY = ["video_id", "frame_idx"]


def q_text_region(spark, d):
    """any text in a region."""
    return filters.by_text(lines(spark, d), "", (0.1, 0.1, 0.3, 0.3), 0.3)


def q_text_box(spark, d):
    """a drawn text box, met wherever it is."""
    return filters.by_drawn_boxes(objects(spark, d), lines(spark, d), [{"type": "ocr", "text": "of the"}, {"type": "object", "labels": ["AF"]}], "and")


def q_text_position(spark, d):
    """The overlap of texts with a drawn region."""
    found = boosts.text_position_signal(lines(spark, d), "of the", (0.1, 0.1, 0.5, 0.5))
    return found.select(*_KEY, F.round("signal", 6).alias("signal"))


def q_boxes_from_pixels(spark, d):
    """Corners in any order and polygons in pixels as boxes; a box's pixels."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 900).cast("double").alias("a"), (F.col("l_suppkey") % 700 - 30).cast("double").alias("b"), F.col("l_quantity").alias("c"))
    size = (F.lit(1000.0), F.lit(1000.0))
    two = geometry.from_pixels(F.col("a"), F.col("b"), F.col("c"), F.col("a"), *size)
    points = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("a", "b"), ("c", "a"), ("b", "c"))])
    ring = geometry.around_polygon(points, *size)
    pixels = geometry.crop_pixels(two, *size)
    sides = lambda box, p: [F.round(getattr(box, c), 6).alias(f"{p}_{c}") for c in ("ymin", "xmin", "ymax", "xmax")]
    return rows.select("l_orderkey", "l_linenumber", *sides(two, "two"), *sides(ring, "ring"), pixels["top"].alias("top"), pixels["right"].alias("right")).distinct()


def q_speech_frames(spark, d):
    """Segments in seconds as ranges of frames, the best of their texts."""
    rows = table(spark, d, "events").select(
        F.concat(F.lit("V"), (F.col("event_id") % 40).cast("string")).alias("video_id"), F.col("value").alias("start"), (F.col("value") + F.col("event_id") % 7).alias("end"), F.col("event_type").alias("text_raw"),
        F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).alias("text_itn"), F.when(F.col("event_id") % 5 == 0, "Đã Xem").alias("text_refined"),
    )
    fps = table(spark, d, "nation").select(F.concat(F.lit("V"), F.col("n_nationkey").cast("string")).alias("video_id"), F.when(F.col("n_nationkey") % 2 == 0, 25.0).otherwise(30.0).alias("fps"))
    return readers.speech_on_frames(rows, fps).groupBy("video_id", "text_raw", "text_norm").agg(F.count("*").alias("n"), F.sum("frame_idx_start").alias("starts"), F.sum("frame_idx_end").alias("ends"))


def q_unit_vectors(spark, d):
    """Vectors over their norms, for the corpus and for queries."""
    rows = frames(spark, d)
    return rows.select(*_KEY, F.round(vectors.unit(F.col("vec"))[1], 6).alias("own"), F.round(vectors.unit_query(F.col("vec"))[1], 6).alias("query"), F.round(vectors.nudge(F.col("vec"), vectors.literal(query_vector(spark, d)))[1], 6).alias("nudged"))


def q_clips(spark, d):
    """A clip round each moment, and its name in a cache."""
    rows = moments(spark, d).select("event_id", F.col("score").alias("at"))
    clip = sequence.clip_window(F.col("at"))
    return rows.select("event_id", F.round(clip["start"], 6).alias("start"), clip["length"].alias("length"), sequence.clip_key(F.lit("v"), F.col("at"), digits=2).alias("name"))


def q_best_chains(spark, d):
    """T5: the k videos with the best chains."""
    pools = [moments(spark, d).where(F.col("event_type") == k).select("video_id", "t", "score") for k in ("view", "click")]
    return temporal.chain_best(pools, "min", 10, time="t").select("video_id", F.round("score", 6).alias("score"))


def q_suggest(spark, d):
    """The labels nearest to a query."""
    rows = frames(spark, d).groupBy("label").agg(F.min_by("vec", "frame_idx").alias("vec"))
    return dictionary.suggest(rows, query_vector(spark, d), 4).select("label", F.round("score", 6).alias("score"))


def q_commonest(spark, d):
    """The commonest names."""
    return statistics.commonest(table(spark, d, "part"), "p_name", 20)


def q_vocabulary(spark, d):
    """Z6."""
    return statistics.vocabulary(table(spark, d, "part"), "p_type")


def q_labels_in_order(spark, d):
    """Labels in the order of their composed lower-case form."""
    names = [r[0] for r in statistics.vocabulary(table(spark, d, "nation"), "n_name").collect()]
    return spark.createDataFrame(list(enumerate(planner.labels_in_order([*names, "Đ", "a"]))), "place bigint, label string")


def q_crowd(spark, d):
    """A18."""
    return statistics.crowd(objects(spark, d))


def q_missing(spark, d):
    """Labels without an entry; errors don't count as done."""
    parts = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("label"), "p_size")
    done = parts.where("p_size > 10 and p_size < 40").select("label")
    parts = parts.select("label")
    return dictionary.missing(parts.distinct(), done.distinct())


def q_same_keys(spark, d):
    """An error names a key that only one table has."""
    rows = frames(spark, d)
    exploration.require_same_keys(rows, rows.select(*_KEY))
    try:
        exploration.require_same_keys(rows, rows.where("frame_idx <> 3"))
        said = "none"
    except ValueError as error:
        said = str(error)
    return spark.createDataFrame([(said,)], "said string")


def _parts(spark, d):
    q, rows = query_vector(spark, d), frames(spark, d)
    for i, (a, n) in enumerate(((1, 21), (22, 21), (43, 22))):
        rows = rows.withColumn(f"s{i}", F.round(vectors.dot(F.slice("vec", a, n), vectors.literal(q[a - 1 : a - 1 + n])), 6))
    return rows.drop("vec")


def q_percent_ranks(spark, d):
    """Scores as percent ranks."""
    found = ranking.calibrated(_parts(spark, d), ["s0", "s1"], "percent_rank")
    return found.select(*_KEY, F.round("c_s0", 6).alias("c_s0"), F.round("c_s1", 6).alias("c_s1"))


def q_combiners(spark, d):
    """Product, least, soft least."""
    found = ranking.calibrated(_parts(spark, d), ["s0", "s1", "s2"])
    names = ["c_s0", "c_s1", "c_s2"]
    return found.select(*_KEY, *[F.round(ranking.combine_and(names, how), 6).alias(how) for how in ("product", "min", "softmin")])


def q_by_parts(spark, d):
    """What is good in some part, judged by all parts."""
    found = ranking.by_parts(_parts(spark, d), ["s0", "s1", "s2"], 15)
    return found.select(*_KEY, F.round(F.least("s0", "s1", "s2"), 6).alias("least"))


def q_likeness_shots(spark, d):
    """Shots by the cosine of neighbours, the best row of each."""
    rows = frames(spark, d).withColumn("score", F.round(vectors.dot(F.col("vec"), vectors.literal(query_vector(spark, d))), 6))
    cut = temporal.shots(temporal.likeness_to_previous(rows), "alike", 0.0)
    return temporal.first_of_shots(cut).select(*_KEY, F.col("shot").cast("bigint").alias("shot"))


def q_options(spark, d):
    """Clusters of frames as options; every frame is in one."""
    found = ranking.grounded_options(frames(spark, d), 6)
    return found.groupBy("option").agg(F.count("*").alias("n"), F.max("likeness").alias("likeness"))


def q_negation(spark, d):
    """Frames with some label and without another."""
    lib = search.Library(frames=frames(spark, d).select(*_KEY), vectors={}, objects=objects(spark, d))
    return search.candidates(lib, search.Filters(groups=[(("NO",), 1)], without=[["AF"]]))


def q_reweighted(spark, d):
    """Beliefs after an answer."""
    rows = ranking.beliefs(frames(spark, d).withColumn("score", F.col("frame_idx") + 1.0))
    return exploration.reweighted(rows, F.when(F.col("label") == 2, 0.9).otherwise(0.1)).groupBy("label").agg(F.round(F.sum("belief"), 6).alias("belief"))


def q_diverse(spark, d):
    """The best frames that differ."""
    rows = frames(spark, d).withColumn("score", F.round(vectors.dot(F.col("vec"), vectors.literal(query_vector(spark, d))), 6))
    return spark.createDataFrame([(i, r.video_id, r.frame_idx) for i, r in enumerate(ranking.diverse(rows, 5, key=_KEY))], "place int, video_id string, frame_idx int")


def q_margin_summary(spark, d):
    """A26."""
    rows = moments(spark, d).select(F.col("video_id").alias("query_id"), (F.col("event_type") == "purchase").alias("is_truth"), F.col("score").alias("sim"))
    found = evaluation.margin_summary(evaluation.margins(rows))
    return found.select(*[F.round(c, 6).alias(c) for c in ("mean", "median", "negative_share")])


def q_monitor(spark, d):
    """Two steps' results compared: unchanged, flat, empty, late."""
    q, rows = query_vector(spark, d), frames(spark, d)
    first = ranking.rank_vectors(rows, q, 20, digits=6)
    second = ranking.rank_vectors(rows.where("label <> 2"), q, 20, digits=6)
    none = rows.where("label < 0").withColumn("score", F.lit(0.0))
    steps = [evaluation.monitor(first, first), evaluation.monitor(second, first, took=8.0, budget=10.0), evaluation.monitor(none, first)]
    out = steps[0].unionByName(steps[1]).unionByName(steps[2])
    return out.select("n", F.round("jaccard", 6).alias("jaccard"), F.round("spread", 6).alias("spread"), "empty", "unchanged", "is_flat", "late")


def q_expected_share(spark, d):
    """What each filter of a plan leaves."""
    rows, o = frames(spark, d), objects(spark, d)
    asked = {"label": rows.where("label = 3"), "dead": rows.where("label > 99"), "objects": rows.join(filters.by_labels(o, ["AF"]), _KEY, "left_semi")}
    return evaluation.expected_share(rows, asked).select("step", F.round("share", 6).alias("share"))


def q_label_audit(spark, d):
    """Labels whose crops are least like their text first."""
    o, rows = objects(spark, d), frames(spark, d)
    regions = o.select("detection_id", ((F.col("detection_id") / 10).cast("bigint") % 500).cast("int").alias("i")).join(rows.select(F.col("frame_idx").alias("i"), "vec"), "i")
    texts = o.groupBy("label").agg(F.min("frame_idx").alias("_m")).select("label", (F.length("label") + F.ascii("label")).alias("i")).join(rows.select(F.col("frame_idx").alias("i"), "vec"), "i")
    found = evaluation.label_audit(o, regions, texts, 40, sequence.portable_hash(F.col("detection_id") % 1000003))
    return found.select("label", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


def q_resolve_frames(spark, d):
    """results' frames as moments of their videos."""
    rows = frames(spark, d).select(*_KEY, (F.col("frame_idx") / 25.0).alias("pts_time"))
    return ranking.rank_vectors(frames(spark, d), query_vector(spark, d), 10).select(*_KEY).join(rows, _KEY)


def q_event_chain(spark, d):
    """Nations ordered by "before" edges."""
    names = [r[0] for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]
    graph = planner.QueryGraph([planner.Node(n) for n in names], [planner.Edge(a, b, "before", "temporal") for a, b in reversed(list(zip(names, names[1:], strict=False)))])
    return spark.createDataFrame([(i, n.id) for i, n in enumerate(graph.events())], "place bigint, name string")


def q_step_log(spark, d):
    """Steps and how long they took, as rows."""
    log = planner.StepLog()
    log.run("frames", lambda: frames(spark, d).count(), str)
    log.run("caption", lambda: planner.distilled("một con chó", {"chó": "Dog"}, lambda sentence, known: f"{sorted(known.values())}"), str)
    return log.table(spark).select("step", "detail", (F.col("seconds") >= 0).alias("timed"))


def q_phrases_composed(spark, d):
    """Decomposed letters meet composed ones."""
    rows = table(spark, d, "documents").select("doc_id", F.replace(F.col("text"), F.lit("é"), F.lit("e\u0301")).alias("text"))
    return rows.select("doc_id", F.length(text.normalize(F.col("text"))).cast("bigint").alias("n"))


_PARTS = ", p AS (SELECT video_id, frame_idx, " + ", ".join(f"round(list_dot_product(vec[{a}:{b}], qv[{a}:{b}]), 6) AS s{i}" for i, (a, b) in enumerate(((1, 21), (22, 42), (43, 64)))) + " FROM frames, q)"
_SCALED = _PARTS + ", c AS (SELECT video_id, frame_idx, " + ", ".join(f"(s{i} - min(s{i}) OVER ()) / (max(s{i}) OVER () - min(s{i}) OVER ()) AS c{i}" for i in range(3)) + " FROM p)"

ORACLE = {
    "q_text_region": sql("lines", """, b AS (SELECT *, greatest(0e0, least(ymax, 3e-1) - greatest(ymin, 1e-1)) * greatest(0e0, least(xmax, 3e-1) - greatest(xmin, 1e-1)) AS c, (ymax - ymin) * (xmax - xmin) AS a FROM lines)
        SELECT DISTINCT video_id, unnest(range(frame_start, frame_end + 1)) AS frame_idx FROM b WHERE c / (a + (3e-1 - 1e-1) * (3e-1 - 1e-1) - c) > 3e-1"""),
    "q_text_box": sql("lines objects", """, t AS (SELECT DISTINCT video_id, unnest(range(frame_start, frame_end + 1)) AS frame_idx FROM lines WHERE regexp_matches(text_norm, '(^|\\s)of\\s(.*\\s)?the(\\s|$)', 's'))
        SELECT t.* FROM t SEMI JOIN objects o ON t.video_id = o.video_id AND t.frame_idx = o.frame_idx AND o.label = 'AF'"""),
    "q_text_position": sql("lines", """, b AS (SELECT *, greatest(0e0, least(ymax, 5e-1) - greatest(ymin, 1e-1)) * greatest(0e0, least(xmax, 5e-1) - greatest(xmin, 1e-1)) AS c, (ymax - ymin) * (xmax - xmin) AS a FROM lines
            WHERE regexp_matches(text_norm, '(^|\\s)of\\s(.*\\s)?the(\\s|$)', 's')), x AS (SELECT video_id, unnest(range(frame_start, frame_end + 1)) AS frame_idx, c / (a + 4e-1 * 4e-1 - c) AS s FROM b)
        SELECT video_id, frame_idx, round(max(s), 6) AS signal FROM x GROUP BY ALL"""),
    "q_boxes_from_pixels": """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_partkey % 900 AS DOUBLE) AS a, CAST(l_suppkey % 700 - 30 AS DOUBLE) AS b, CAST(l_quantity AS DOUBLE) AS c FROM lineitem),
        t AS (SELECT *, least(1e0, greatest(0e0, least(a, c) / 1e3)) AS y0, least(1e0, greatest(0e0, least(b, a) / 1e3)) AS x0, least(1e0, greatest(0e0, greatest(a, c) / 1e3)) AS y1, least(1e0, greatest(0e0, greatest(b, a) / 1e3)) AS x1 FROM r)
        SELECT DISTINCT l_orderkey, l_linenumber, round(y0, 6) AS two_ymin, round(x0, 6) AS two_xmin, round(y1, 6) AS two_ymax, round(x1, 6) AS two_xmax,
            round(least(1e0, greatest(0e0, least(b, a, c) / 1e3)), 6) AS ring_ymin, round(least(1e0, greatest(0e0, least(a, c, b) / 1e3)), 6) AS ring_xmin,
            round(least(1e0, greatest(0e0, greatest(b, a, c) / 1e3)), 6) AS ring_ymax, round(least(1e0, greatest(0e0, greatest(a, c, b) / 1e3)), 6) AS ring_xmax,
            CAST(floor(y0 * 1e3) AS BIGINT) AS top, CAST(greatest(floor(x0 * 1e3) + 1, ceil(x1 * 1e3)) AS BIGINT) AS "right" FROM t""",
    "q_speech_frames": """WITH e AS (SELECT event_id % 40 AS v, value AS s, value + event_id % 7 AS e, CASE WHEN event_id % 5 = 0 THEN 'Đã Xem' WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS t FROM events),
        f AS (SELECT e.*, CASE WHEN n_nationkey % 2 = 0 THEN 25e0 ELSE 30e0 END AS fps FROM e JOIN nation ON v = n_nationkey)
        SELECT 'V' || CAST(v AS VARCHAR) AS video_id, t AS text_raw, CASE WHEN t = 'Đã Xem' THEN 'da xem' ELSE lower(t) END AS text_norm, count(*) AS n, CAST(sum(round_even(s * fps, 0)) AS BIGINT) AS starts, CAST(sum(round_even(e * fps, 0)) AS BIGINT) AS ends FROM f GROUP BY ALL""",
    "q_unit_vectors": sql("frames q", " SELECT video_id, frame_idx, round(vec[2] / sqrt(list_dot_product(vec, vec)), 6) AS own, round(vec[2] / (sqrt(list_dot_product(vec, vec)) + 1e-8), 6) AS query, round(vec[2] * 7e-1 + qv[2] * 3e-1, 6) AS nudged FROM frames, q"),
    "q_clips": "SELECT event_id, round(greatest(0e0, value - 3), 6) AS start, 6e0 AS length, 'v_' || printf('%.2f', round(greatest(0e0, value - 3), 2)) AS name FROM events",
    "q_best_chains": sql("moments", """ SELECT a.video_id, round(max(least(a.score, b.score)), 6) AS score FROM moments a JOIN moments b ON a.video_id = b.video_id AND a.event_type = 'view' AND b.event_type = 'click' AND a.t < b.t
        GROUP BY a.video_id ORDER BY max(least(a.score, b.score)) DESC, a.video_id LIMIT 10"""),
    "q_suggest": sql("frames q", ", v AS (SELECT label, arg_min(vec, frame_idx) AS vec FROM frames GROUP BY label) SELECT label, round(list_dot_product(vec, qv), 6) AS score FROM v, q ORDER BY list_dot_product(vec, qv) DESC, label LIMIT 4"),
    "q_commonest": "SELECT p_name, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_name LIMIT 20",
    "q_vocabulary": "SELECT DISTINCT p_type FROM part",
    "q_labels_in_order": "SELECT row_number() OVER (ORDER BY lower(n)) - 1 AS place, n AS label FROM (SELECT n_name AS n FROM nation UNION ALL SELECT unnest(['Đ', 'a']))",
    "q_crowd": sql("objects", ", c AS (SELECT video_id, frame_idx, count(*) AS n FROM objects GROUP BY ALL) SELECT (SELECT quantile_cont(CAST(n AS DOUBLE), 0.5) FROM c) AS median, video_id, frame_idx, n AS most FROM c ORDER BY n DESC, video_id, frame_idx LIMIT 1"),
    "q_missing": "WITH p AS (SELECT p_name || ' ' || p_brand AS label, p_size FROM part) SELECT DISTINCT label FROM p WHERE label NOT IN (SELECT label FROM p WHERE p_size > 10 AND p_size < 40)",
    "q_same_keys": "SELECT 'only one of the tables has (''V3'', 3)' AS said",
    "q_percent_ranks": sql("frames q", _PARTS + " SELECT video_id, frame_idx, round(percent_rank() OVER (ORDER BY s0), 6) AS c_s0, round(percent_rank() OVER (ORDER BY s1), 6) AS c_s1 FROM p"),
    "q_combiners": sql("frames q", _SCALED + """ SELECT video_id, frame_idx, round(c0 * c1 * c2, 6) AS product, round(least(c0, c1, c2), 6) AS "min", round(-ln(exp(-1e1 * c0) + exp(-1e1 * c1) + exp(-1e1 * c2)) / 1e1, 6) AS softmin FROM c"""),
    "q_by_parts": sql("frames q", _PARTS + ", r AS (SELECT *, " + ", ".join(f"row_number() OVER (ORDER BY s{i} DESC, video_id, frame_idx) AS r{i}" for i in range(3)) + " FROM p) SELECT video_id, frame_idx, round(least(s0, s1, s2), 6) AS least FROM r WHERE least(r0, r1, r2) <= 15"),
    "q_likeness_shots": sql("frames q", """, l AS (SELECT *, round(list_dot_product(vec, qv), 6) AS score, list_cosine_similarity(vec, lag(vec) OVER (PARTITION BY video_id ORDER BY frame_idx)) AS alike FROM frames, q),
        s AS (SELECT *, sum(CASE WHEN coalesce(alike, 0) < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_idx) AS shot FROM l)
        SELECT video_id, frame_idx, CAST(shot AS BIGINT) AS shot FROM s QUALIFY row_number() OVER (PARTITION BY video_id, shot ORDER BY score DESC, frame_idx) = 1"""),
    "q_negation": sql("frames objects", " SELECT video_id, frame_idx FROM (SELECT DISTINCT video_id, frame_idx FROM objects WHERE label = 'NO') a ANTI JOIN (SELECT video_id, frame_idx FROM objects WHERE label = 'AF') b USING (video_id, frame_idx)"),
    "q_reweighted": sql("frames", ", w AS (SELECT label, (frame_idx + 1) * CASE WHEN label = 2 THEN 9e-1 ELSE 1e-1 END AS b FROM frames) SELECT label, round(sum(b) / (SELECT sum(b) FROM w), 6) AS belief FROM w GROUP BY label"),
    "q_margin_summary": sql("moments", """, m AS (SELECT video_id, max(score) FILTER (WHERE event_type = 'purchase') - max(score) FILTER (WHERE event_type <> 'purchase') AS m FROM moments GROUP BY ALL)
        SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.5), 6) AS median, round(avg(CAST(m < 0 AS INTEGER)), 6) AS negative_share FROM m"""),
    "q_monitor": sql("frames q", """, s AS (SELECT video_id, frame_idx, label, round(list_dot_product(vec, qv), 6) AS score FROM frames, q), a AS (SELECT * FROM s ORDER BY score DESC, video_id, frame_idx LIMIT 20),
        b AS (SELECT * FROM s WHERE label <> 2 ORDER BY score DESC, video_id, frame_idx LIMIT 20), x AS (SELECT count(*) AS n FROM a SEMI JOIN b USING (video_id, frame_idx)),
        f AS (SELECT count(*) AS n, 1e0 AS jaccard, (max(score) - min(score)) / max(score) AS spread, false AS late FROM a UNION ALL
              SELECT count(*), (SELECT n / CAST((SELECT count(*) FROM a) + (SELECT count(*) FROM b) - n AS DOUBLE) FROM x), (max(score) - min(score)) / max(score), true FROM b UNION ALL SELECT 0, 0e0, NULL, false)
        SELECT n, round(jaccard, 6) AS jaccard, round(spread, 6) AS spread, n = 0 AS empty, jaccard > 9e-1 AS unchanged, coalesce(spread < 5e-2, false) AS is_flat, late FROM f"""),
    "q_expected_share": sql("frames objects", """, t AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM frames) SELECT 'label' AS step, round(count(*) / any_value(t), 6) AS share FROM frames, t WHERE label = 3
        UNION ALL SELECT 'dead', 0e0 UNION ALL SELECT 'objects', round((SELECT count(*) FROM frames f SEMI JOIN (SELECT * FROM objects WHERE label = 'AF') o ON f.video_id = o.video_id AND f.frame_idx = o.frame_idx) / t, 6) FROM t"""),
    "q_label_audit": sql("objects frames", """, c AS (SELECT label, detection_id FROM objects QUALIFY row_number() OVER (PARTITION BY label ORDER BY (detection_id % 1000003 * 7919 + 42 * 104729) % 1000003, detection_id) <= 40),
        p AS (SELECT c.label, list_dot_product(f.vec, g.vec) AS s FROM c JOIN frames f ON f.frame_idx = c.detection_id // 10 % 500 JOIN frames g ON g.frame_idx = length(c.label) + ascii(c.label))
        SELECT label, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, count(*) AS n FROM p GROUP BY label"""),
    "q_resolve_frames": sql("frames q", " SELECT video_id, frame_idx, frame_idx / 25e0 AS pts_time FROM frames, q ORDER BY list_dot_product(vec, qv) DESC, video_id, frame_idx LIMIT 10"),
    "q_event_chain": "SELECT n_nationkey AS place, n_name AS name FROM nation",
    "q_step_log": "SELECT 'frames' AS step, CAST(count(*) AS VARCHAR) AS detail, true AS timed FROM embeddings UNION ALL SELECT 'caption', '[''Dog'']', true",
    "q_phrases_composed": "SELECT doc_id, length(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS n FROM documents",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
