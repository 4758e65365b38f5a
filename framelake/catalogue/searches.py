"""Searches end to end: one lazy plan of filters, ranking, boosts, backfill, chains, questions and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, relations
from ..operators.ranking import rank_vectors
from ..plans import planner, search
from ..sources import sinks
from .proxies import frames, lines, objects, query_vector, speech, sql
from .relations import _EDGES

_KEY = ["video_id", "frame_idx"]
ENTRIES = {"xe máy": "NF", "người": "AF", "chó": "AO", "chó con": "AO", "bàn tay": "Human hand", "bát ăn cơm": "RO", "bát canh": "RO", "bát bóng chày": "RF"}


def _library(spark, d, edges=False):
    rows, o = frames(spark, d), objects(spark, d)
    q = query_vector(spark, d)
    lib = search.Library(
        frames=rows.select(*_KEY), vectors={"s": rows, "t": rows.withColumn("vec", F.slice("vec", 1, 32))}, objects=o, lines=lines(spark, d), speech=speech(spark, d),
        region_vectors=o.select("detection_id", (F.col("detection_id") / 10).cast("bigint").alias("i")).withColumn("i", (F.col("i") % 500).cast("int")).join(rows.select(F.col("frame_idx").alias("i"), "vec"), "i").select("detection_id", "vec"),
        edges=relations.spatial_edges(o) if edges else None,
    )
    return lib, q


def _out(rows):
    return rows.select(*_KEY, F.round("score", 6).alias("score"), "is_backfill")


def q_search_dense(spark, d):
    """Labels and a text as filters, exact ranking, backfill."""
    lib, q = _library(spark, d)
    return _out(search.search(lib, {"s": q}, 40, search.Filters(groups=[(("AF", "NO"), 2)], texts=["of"])))


def q_search_fused(spark, d):
    """Two spaces fused by reciprocal ranks."""
    lib, q = _library(spark, d)
    found = search.search(lib, {"s": q, "t": q[:32]}, 25)
    return found.select(*_KEY, F.round("score", 9).alias("score"), "is_backfill")


def q_search_boosted(spark, d):
    """Speech, attributes, secondary labels and a drawn region over a pool of 4k."""
    lib, q = _library(spark, d)
    box = {"type": "object", "labels": ["AF"], "min_count": 1, "region": (0.2, 0.2, 0.6, 0.6)}
    return _out(search.search(lib, {"s": q}, 30, search.Filters(boxes=[box]), ["the of"], [["NF"], ["RO"]], [(["NO"], q)], with_backfill=False))


def q_search_plan(spark, d):
    """A sentence's plan, its terms resolved, as a search."""
    lib, q = _library(spark, d)
    plan = planner.resolved(planner.rule_based("Hai người và chó, bàn tay", ENTRIES), ENTRIES)
    return _out(search.search_plan(lib, plan, lambda _: {"s": q}, lambda _: ["RF"], 30))


def _temporal(spark, d, k=15):
    lib, q = _library(spark, d)
    anchors = [search.Anchor.of({"text": "x", "groups": [((label,), 1)]}, lambda _: {"s": q}) for label in ("AF", "NO")]
    return search.search_temporal(lib, anchors, k, pool=150)


def q_search_temporal(spark, d):
    """Two moments in strict order in a video."""
    return _temporal(spark, d).select("video_id", "anchor1_frame_id", "anchor2_frame_id", F.round("score", 6).alias("score"))


def q_answer_question(spark, d):
    """The first results are asked, with what is said round them; later ranks carry an answer on."""
    lib, q = _library(spark, d)
    results = search.search(lib, {"s": q}, 12)
    ask = lambda rows: rows.withColumn("answer", F.concat_ws(":", "rank", F.coalesce(F.length("context"), F.lit(0))))
    return search.answer_question(results, lib.speech, ask, n=4, margin=20)


def _graph():
    nodes = [planner.Node("s", scene="x"), planner.Node("a", label="AF", count=2), planner.Node("b", label="NO")]
    return planner.QueryGraph(nodes, [planner.Edge("a", "b", "left_of", "spatial"), planner.Edge("a", "b", "chasing", "semantic"), planner.Edge("a", "b", "before", "temporal")])


def q_run_graph(spark, d):
    """Scenes, counts and edges as filters; an edge is checked on a short list."""
    lib, q = _library(spark, d, edges=True)
    check = lambda short, edge: short.select(*_KEY, (F.col("frame_idx") % 10 / 10.0).alias("edge_score"))
    found, left = search.run_graph(lib, _graph(), lambda _: {"s": q}, 50, check_edge=check, most_checked=10**6)
    return found.select(*_KEY, F.round("score", 6).alias("score"), F.lit(len(left)).alias("unverified"))


def q_run_graph_budget(spark, d):
    """More rows than may be checked: the edge stays unverified."""
    lib, q = _library(spark, d, edges=True)
    found, left = search.run_graph(lib, _graph(), lambda _: {"s": q}, 50, check_edge=lambda short, edge: short, most_checked=0)
    return found.select(*_KEY, F.round("score", 6).alias("score"), F.lit(len(left)).alias("unverified"))


def q_submission_kis(spark, d):
    """K8."""
    lib, q = _library(spark, d)
    return sinks.kis_submission(search.search(lib, {"s": q}, 40, search.Filters(groups=[(("AF", "NO"), 2)])), 35)


def q_submission_qa(spark, d):
    """K8."""
    lib, q = _library(spark, d)
    ask = lambda rows: rows.withColumn("answer", F.concat(F.lit("a"), F.col("rank").cast("string")))
    return sinks.qa_submission(search.answer_question(search.search(lib, {"s": q}, 12), None, ask, n=3), 10)


def q_submission_chain(spark, d):
    """K8."""
    found = _temporal(spark, d).withColumn("path", F.array("anchor1_frame_id", "anchor2_frame_id"))
    return sinks.chain_submission(found, 2, 12)


def q_speech_context(spark, d):
    """What is said near each of the best frames."""
    lib, q = _library(spark, d)
    rows = rank_vectors(lib.vectors["s"], q, 30).select(*_KEY, "score")
    return search.speech_context(rows, lib.speech, 10).select(*_KEY, F.length("context").cast("bigint").alias("length"))


def q_evaluate_searches(spark, d):
    """V3: tasks by type, a failing one scored 0, reports by type and by tag."""
    lib, q = _library(spark, d)
    truth = lib.frames.where("frame_idx = 0").select("video_id").first()

    def kis():
        return sinks.kis_submission(search.search(lib, {"s": q}, 10)).withColumn("rank", F.lit(1)).select("video_id", "frame_id", "rank")

    def broken():
        raise OSError("no model")

    tasks = [
        evaluation.Task("one", "kis", ("easy", "dense"), kis, [(truth.video_id, 0, 5)]),
        evaluation.Task("two", "kis", ("hard",), broken, [(truth.video_id, 0, 5)]),
        evaluation.Task("three", "kis", ("easy",), kis, [("nowhere", 0, 5)]),
    ]
    by = evaluation.report(spark, evaluation.run_tasks(spark, tasks, {"kis": evaluation.kis_score}))
    return by.select("kind", "name", F.round("score", 6).alias("score"), "n", "failed")


_POOL = ", s AS (SELECT video_id, frame_idx, list_dot_product(vec, qv) AS score FROM frames, q)"
_NEED = ", need AS (SELECT video_id, frame_idx FROM objects WHERE label IN ('AF', 'NO') GROUP BY ALL HAVING count(*) >= 2)"
_TOP = "SELECT * FROM {t} ORDER BY score DESC, video_id, frame_idx LIMIT {k}"
_FILL = """, own AS ({own}), more AS ({all}), u AS (SELECT *, false AS is_backfill FROM own UNION ALL SELECT *, true FROM more m WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.video_id = m.video_id AND o.frame_idx = m.frame_idx)),
        final AS (SELECT * FROM u ORDER BY is_backfill, score DESC, video_id, frame_idx LIMIT {k})"""
_KEPT = ", f AS (SELECT s.* FROM s SEMI JOIN {keys} k ON s.video_id = k.video_id AND s.frame_idx = k.frame_idx)"


def _filled(keys: str, k: int) -> str:
    return _KEPT.format(keys=keys) + _FILL.format(own=_TOP.format(t="f", k=k), all=_TOP.format(t="s", k=k), k=k)


_LABEL = "(SELECT DISTINCT video_id, frame_idx FROM objects WHERE label = '{}')"
_CHAIN = _POOL + "".join(
    f", p{i} AS (SELECT s.* FROM s SEMI JOIN {_LABEL.format(label)} k ON s.video_id = k.video_id AND s.frame_idx = k.frame_idx ORDER BY score DESC, video_id, frame_idx LIMIT 150)" for i, label in ((1, "AF"), (2, "NO"))
) + """, b AS (SELECT p2.video_id, p2.frame_idx AS t2, p2.score AS s2, max(p1.score) AS s1, arg_max(p1.frame_idx, struct_pack(s := p1.score, t := -p1.frame_idx)) AS t1
            FROM p2 JOIN p1 ON p1.video_id = p2.video_id AND p1.frame_idx < p2.frame_idx GROUP BY ALL),
        c AS (SELECT *, least(s1, s2) AS score FROM b QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY least(s1, s2) DESC, t2, s1 DESC) = 1 ORDER BY score DESC, video_id LIMIT 15)"""
_RANKED = _POOL + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, video_id, frame_idx) AS rank FROM s QUALIFY rank <= 12)"""
_GRAPH = f""", {_EDGES}, k AS (SELECT video_id, frame_idx FROM objects WHERE label = 'AF' GROUP BY ALL HAVING count(*) >= 2 INTERSECT SELECT video_id, frame_idx FROM edges WHERE relation = 'left_of' AND subj_label = 'AF' AND obj_label = 'NO')""" + _POOL + _KEPT.format(keys="k")

ORACLE = {
    "q_search_dense": sql("frames objects lines q", _POOL + _NEED + ", said AS (SELECT DISTINCT video_id, unnest(range(frame_start, frame_end + 1)) AS frame_idx FROM lines WHERE contains(' ' || text_norm || ' ', ' of ')), both_keys AS (SELECT n.* FROM need n JOIN said t ON n.video_id = t.video_id AND n.frame_idx = t.frame_idx)"
        + _filled("both_keys", 40) + " SELECT video_id, frame_idx, round(score, 6) AS score, is_backfill FROM final"),
    "q_search_fused": sql("frames q", """, a AS (SELECT video_id, frame_idx, row_number() OVER (ORDER BY list_dot_product(vec, qv) DESC, video_id, frame_idx) AS ra, row_number() OVER (ORDER BY list_dot_product(vec[1:32], qv[1:32]) DESC, video_id, frame_idx) AS rb FROM frames, q)
        SELECT video_id, frame_idx, round(CASE WHEN ra <= 200 THEN 1e0 / (60 + ra) ELSE 0 END + CASE WHEN rb <= 200 THEN 1e0 / (60 + rb) ELSE 0 END, 9) AS score, false AS is_backfill FROM a
        ORDER BY CASE WHEN ra <= 200 THEN 1e0 / (60 + ra) ELSE 0 END + CASE WHEN rb <= 200 THEN 1e0 / (60 + rb) ELSE 0 END DESC, CASE WHEN ra <= 200 THEN 0 ELSE 1 END, CASE WHEN ra <= 200 THEN ra ELSE rb END LIMIT 25"""),
    "q_search_boosted": sql("frames objects speech q", _POOL + _KEPT.format(keys=_LABEL.format("AF")) + """, p AS (SELECT * FROM f ORDER BY score DESC, video_id, frame_idx LIMIT 120),
        pos AS (SELECT video_id, frame_idx, max(c / (sa + 4e-1 * 4e-1 - c)) AS x FROM (SELECT *, greatest(0e0, least(ymax, 6e-1) - greatest(ymin, 2e-1)) * greatest(0e0, least(xmax, 6e-1) - greatest(xmin, 2e-1)) AS c, (ymax - ymin) * (xmax - xmin) AS sa FROM objects WHERE label = 'AF') GROUP BY ALL),
        aud AS (SELECT DISTINCT p.video_id, p.frame_idx FROM p JOIN speech t ON p.video_id = t.video_id AND p.frame_idx BETWEEN t.frame_idx_start - 75 AND t.frame_idx_end + 75 WHERE regexp_matches(text_norm, '(^|\\s)the\\s(.*\\s)?of(\\s|$)', 's')),
        reg AS (SELECT o.video_id, o.frame_idx, max(list_dot_product(g.vec, qv)) AS x FROM objects o JOIN frames g ON g.frame_idx = o.detection_id // 10 % 500, q WHERE o.label = 'NO' GROUP BY ALL),
        sec AS (SELECT video_id, frame_idx, sum(x) / 2 AS x FROM (SELECT video_id, frame_idx, label, max(score) AS x FROM objects WHERE label IN ('NF', 'RO') GROUP BY ALL) GROUP BY ALL)
        SELECT p.video_id, p.frame_idx, round(p.score + 15e-2 * coalesce(pos.x, 0) + 8e-2 * CASE WHEN aud.video_id IS NULL THEN 0 ELSE 1 END + 5e-1 * coalesce(reg.x, 0) + 15e-2 * coalesce(sec.x, 0), 6) AS score, false AS is_backfill
        FROM p LEFT JOIN pos ON p.video_id = pos.video_id AND p.frame_idx = pos.frame_idx LEFT JOIN aud ON p.video_id = aud.video_id AND p.frame_idx = aud.frame_idx
        LEFT JOIN reg ON p.video_id = reg.video_id AND p.frame_idx = reg.frame_idx LEFT JOIN sec ON p.video_id = sec.video_id AND p.frame_idx = sec.frame_idx
        ORDER BY p.score + 15e-2 * coalesce(pos.x, 0) + 8e-2 * CASE WHEN aud.video_id IS NULL THEN 0 ELSE 1 END + 5e-1 * coalesce(reg.x, 0) + 15e-2 * coalesce(sec.x, 0) DESC, p.video_id, p.frame_idx LIMIT 30"""),
    "q_search_plan": sql("frames objects q", _POOL + """, keys AS (SELECT video_id, frame_idx FROM objects GROUP BY ALL HAVING count(*) FILTER (WHERE label = 'AF') >= 2 AND count(*) FILTER (WHERE label = 'AO') >= 1)""" + _KEPT.format(keys="keys")
        + """, sec AS (SELECT video_id, frame_idx, max(score) AS x FROM objects WHERE label = 'RF' GROUP BY ALL), p AS (SELECT * FROM f ORDER BY score DESC, video_id, frame_idx LIMIT 120),
        g AS (SELECT p.video_id, p.frame_idx, p.score + 15e-2 * coalesce(x, 0) AS score FROM p LEFT JOIN sec ON p.video_id = sec.video_id AND p.frame_idx = sec.frame_idx)"""
        + _FILL.format(own=_TOP.format(t="g", k=30), all=_TOP.format(t="s", k=30), k=30) + " SELECT video_id, frame_idx, round(score, 6) AS score, is_backfill FROM final"),
    "q_search_temporal": sql("frames objects q", _CHAIN + " SELECT video_id, t1 AS anchor1_frame_id, t2 AS anchor2_frame_id, round(score, 6) AS score FROM c"),
    "q_answer_question": sql("frames speech q", _RANKED + """, t AS (SELECT rank, sum(length(text_raw)) + count(text_raw) - 1 AS n FROM r JOIN speech p ON p.video_id = r.video_id AND r.frame_idx BETWEEN p.frame_idx_start - 20 AND p.frame_idx_end + 20 WHERE rank <= 4 GROUP BY rank)
        SELECT r.rank, video_id, frame_idx AS frame_id, CAST(least(r.rank, 4) AS VARCHAR) || ':' || CAST(coalesce((SELECT n FROM t WHERE t.rank = least(r.rank, 4)), 0) AS VARCHAR) AS answer FROM r"""),
    "q_run_graph": sql("frames objects q", _GRAPH + " SELECT video_id, frame_idx, round(least(score, frame_idx % 10 / 1e1), 6) AS score, 0 AS unverified FROM (SELECT * FROM f ORDER BY score DESC, video_id, frame_idx LIMIT 400) ORDER BY least(score, frame_idx % 10 / 1e1) DESC, video_id, frame_idx LIMIT 50"),
    "q_run_graph_budget": sql("frames objects q", _GRAPH + " SELECT video_id, frame_idx, round(score, 6) AS score, 1 AS unverified FROM f ORDER BY f.score DESC, video_id, frame_idx LIMIT 50"),
    "q_submission_kis": sql("frames objects q", _POOL + _NEED + _filled("need", 40) + " SELECT video_id, frame_idx AS frame_id FROM final ORDER BY is_backfill, score DESC, video_id, frame_idx LIMIT 35"),
    "q_submission_qa": sql("frames q", _RANKED + " SELECT video_id, frame_idx AS frame_id, 'a' || CAST(least(rank, 3) AS VARCHAR) AS answer FROM r WHERE rank <= 10"),
    "q_submission_chain": sql("frames objects q", _CHAIN + " SELECT video_id, t1 AS frame_id_1, t2 AS frame_id_2 FROM c ORDER BY score DESC, video_id LIMIT 12"),
    "q_speech_context": sql("frames speech q", _POOL + """, r AS (SELECT * FROM s ORDER BY score DESC, video_id, frame_idx LIMIT 30)
        SELECT r.video_id, r.frame_idx, CASE WHEN count(p.video_id) > 0 THEN sum(length(text_raw)) + count(text_raw) - 1 END AS length FROM r LEFT JOIN speech p ON p.video_id = r.video_id AND r.frame_idx BETWEEN p.frame_idx_start - 10 AND p.frame_idx_end + 10 GROUP BY ALL"""),
    "q_evaluate_searches": "SELECT * FROM (VALUES ('type', 'kis', round(1e0 / 3, 6), 3, 1), ('tag', 'easy', 5e-1, 2, 0), ('tag', 'dense', 1e0, 1, 0), ('tag', 'hard', 0e0, 1, 1), ('all', 'all', round(1e0 / 3, 6), 3, 1)) v(kind, name, score, n, failed)",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
