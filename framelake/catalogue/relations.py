"""Objects of a frame: suppression, spatial edges, gates, claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import Box, grid_position
from ..operators import relations
from .proxies import label_types, objects, sql


def q_suppress(spark, d):
    o = objects(spark, d)
    found = relations.suppress(o.where("source = 'closed'"), o.where("source = 'open'"), label_types(spark))
    return found.select("detection_id", "label", "source", "suppressed")


def q_spatial_edges(spark, d):
    return relations.spatial_edges(objects(spark, d))


def q_pair_gate(spark, d):
    found = relations.gate_pairs(objects(spark, d), label_types(spark), relations.registry(spark), budget=6)
    return found.select("video_id", "frame_idx", "subj_id", "obj_id", F.array_join("allowed_relations", ",").alias("allowed_relations"), F.round("normalized_gap", 6).alias("normalized_gap"))


def _claims(spark, d):
    """A claim per object and its frame's first object: the relation, confidence and kind come from numbers of the line."""
    o = objects(spark, d)
    first = o.groupBy("video_id", "frame_idx").agg(F.min("detection_id").alias("obj_id"))
    n = F.col("detection_id") % 7
    names = F.element_at(F.array(*map(F.lit, ("riding", "sitting_on", "holding", "standing_on", "wearing", ""))), (n % 6 + 1).cast("int"))
    return o.join(first, ["video_id", "frame_idx"]).where("detection_id <> obj_id").select(
        "video_id", "frame_idx", F.col("detection_id").alias("subj_id"), "obj_id", names.alias("relation"),
        F.when(n == 3, F.col("score") * 100).otherwise(F.col("score") - 0.3).alias("conf"), (F.col("detection_id") % 2 == 0).alias("inferred"),
    )


def q_relation_p2p3(spark, d):
    checked = relations.crosscheck_objects(relations.confidence_gate(_claims(spark, d)), objects(spark, d))
    return checked.select("video_id", "frame_idx", "subj_id", "obj_id", "relation", F.round("conf", 6).alias("conf"), "inferred", "spatial_checked")


def q_by_relations(spark, d):
    o = objects(spark, d)
    return relations.by_relations(o.select("video_id", "frame_idx").distinct(), relations.spatial_edges(o), [("left_of", "AF", None), ("above", None, "NO")])


def q_relation_hist(spark, d):
    from ..operators.statistics import relation_histogram

    return relation_histogram(relations.gate_pairs(objects(spark, d), label_types(spark), relations.registry(spark)), relations.registry(spark))


def q_grid_position(spark, d):
    return objects(spark, d).groupBy("label", grid_position(Box.of()).alias("position")).agg(F.count("*").alias("n"))


def _box(p: str) -> str:
    return f"greatest(0e0, {p}.ymax - {p}.ymin) * greatest(0e0, {p}.xmax - {p}.xmin)"


_COMMON = "greatest(0e0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) * greatest(0e0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin))"
_EDGES = f"""x AS (
        SELECT a.video_id, a.frame_idx, a.detection_id AS ai, a.label AS al, b.detection_id AS bi, b.label AS bl, {_box('a')} AS sa, {_box('b')} AS sb, {_COMMON} AS c,
               (a.xmin + a.xmax) / 2 - (b.xmin + b.xmax) / 2 AS dx, (a.ymin + a.ymax) / 2 - (b.ymin + b.ymax) / 2 AS dy
        FROM objects a JOIN objects b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.detection_id < b.detection_id
    ), y AS (
        SELECT *, CASE WHEN sa <= 0 OR sb <= 0 THEN NULL WHEN c / sa >= 75e-2 AND sa <= 85e-2 * sb THEN 'inside1' WHEN c / sb >= 75e-2 AND sb <= 85e-2 * sa THEN 'inside0'
               WHEN c / (sa + sb - c) > 2e-1 THEN NULL WHEN abs(dx) >= abs(dy) THEN CASE WHEN abs(dx) < 3e-2 THEN NULL WHEN dx < 0 THEN 'left_of1' ELSE 'left_of0' END
               WHEN abs(dy) < 3e-2 THEN NULL WHEN dy < 0 THEN 'above1' ELSE 'above0' END AS r FROM x
    ), edges AS (
        SELECT video_id, frame_idx, CASE WHEN r LIKE '%1' THEN ai ELSE bi END AS subj_detection_id, CASE WHEN r LIKE '%1' THEN al ELSE bl END AS subj_label,
               CASE WHEN r LIKE '%1' THEN bi ELSE ai END AS obj_detection_id, CASE WHEN r LIKE '%1' THEN bl ELSE al END AS obj_label, r[1:length(r) - 1] AS relation
        FROM y WHERE r IS NOT NULL
    )"""
_REGISTRY = "registry AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {list(s)}, {list(o)}, '{g}', '{c}')" for n, s, o, g, c in relations.REGISTRY) + ") v(name, subjects, objects, gate, kind))"
_SIDE = "CASE WHEN least(greatest(0e0, {p}.ymax - {p}.ymin), greatest(0e0, {p}.xmax - {p}.xmin)) = 0 THEN 1e-6 ELSE least(greatest(0e0, {p}.ymax - {p}.ymin), greatest(0e0, {p}.xmax - {p}.xmin)) END"
_PAIRS = f"""typed AS (SELECT o.*, CASE WHEN list_has_any(categories, ['person', 'animal']) THEN list_filter(categories, lambda c: c <> 'object') ELSE categories END AS cats FROM objects o JOIN label_types USING (label)),
    g AS (
        SELECT a.video_id, a.frame_idx, a.detection_id AS subj_id, b.detection_id AS obj_id, a.cats AS ac, b.cats AS bc,
               sqrt(greatest(b.xmin - a.xmax, a.xmin - b.xmax, 0e0) * greatest(b.xmin - a.xmax, a.xmin - b.xmax, 0e0) + greatest(b.ymin - a.ymax, a.ymin - b.ymax, 0e0) * greatest(b.ymin - a.ymax, a.ymin - b.ymax, 0e0))
               / least({_SIDE.format(p='a')}, {_SIDE.format(p='b')}) AS gap
        FROM typed a JOIN typed b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.detection_id <> b.detection_id
    ), h AS (
        SELECT video_id, frame_idx, subj_id, obj_id, list_sort(list_distinct(list(name))) AS allowed, min(gap) AS gap FROM g JOIN registry
        ON list_has_any(ac, subjects) AND list_has_any(bc, registry.objects) AND (gate = 'orientation' OR gap <= 5e-1) AND (kind <> 'interaction' OR list_has_any(ac, ['person', 'animal'])) GROUP BY ALL
    ), kept AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY gap, subj_id, obj_id) <= {{budget}})"""

ORACLE = {
    "q_suppress": sql("objects label_types", f""", o AS (SELECT o.*, list_has_any(t.categories, ['person', 'clothing_accessory']) AS safe FROM objects o JOIN label_types t USING (label))
        SELECT a.detection_id, a.label, a.source, a.source = 'closed' AND NOT a.safe AND EXISTS (SELECT 1 FROM o b WHERE b.source = 'open' AND a.video_id = b.video_id AND a.frame_idx = b.frame_idx
            AND {_COMMON} / ({_box('a')} + {_box('b')} - {_COMMON}) > 5e-1) AS suppressed FROM o a"""),
    "q_spatial_edges": sql("objects", f", {_EDGES} SELECT * FROM edges"),
    "q_pair_gate": sql("objects label_types", f", {_REGISTRY}, {_PAIRS.format(budget=6)} SELECT video_id, frame_idx, subj_id, obj_id, array_to_string(allowed, ',') AS allowed_relations, round(gap, 6) AS normalized_gap FROM kept"),
    "q_relation_p2p3": sql("objects", f""", {_EDGES}, f AS (SELECT video_id, frame_idx, min(detection_id) AS obj_id FROM objects GROUP BY ALL),
        c AS (SELECT o.video_id, o.frame_idx, detection_id AS subj_id, obj_id, ['riding', 'sitting_on', 'holding', 'standing_on', 'wearing', ''][CAST(detection_id % 7 % 6 + 1 AS INTEGER)] AS relation,
                CASE WHEN detection_id % 7 = 3 THEN score * 100 ELSE score - 3e-1 END AS conf, detection_id % 2 = 0 AS inferred FROM objects o JOIN f ON o.video_id = f.video_id AND o.frame_idx = f.frame_idx WHERE detection_id <> obj_id),
        k AS (SELECT * REPLACE (CASE WHEN conf > 1 THEN conf / 100 ELSE conf END AS conf) FROM c WHERE relation <> ''),
        l AS (SELECT subj_detection_id AS s, obj_detection_id AS o FROM edges UNION SELECT obj_detection_id, subj_detection_id FROM edges),
        m AS (SELECT k.*, relation IN ('riding', 'sitting_on', 'standing_on') AND l.s IS NULL AS doubtful FROM k LEFT JOIN l ON subj_id = l.s AND obj_id = l.o WHERE conf >= CASE WHEN inferred THEN 7e-1 ELSE 55e-2 END)
        SELECT video_id, frame_idx, subj_id, obj_id, relation, round(CASE WHEN doubtful THEN conf * 5e-1 ELSE conf END, 6) AS conf, inferred, NOT doubtful AS spatial_checked FROM m"""),
    "q_by_relations": sql("objects", f""", {_EDGES} SELECT DISTINCT video_id, frame_idx FROM edges WHERE relation = 'left_of' AND subj_label = 'AF'
        AND frame_idx IN (SELECT frame_idx FROM edges WHERE relation = 'above' AND obj_label = 'NO')"""),
    "q_relation_hist": sql("objects label_types", f", {_REGISTRY}, {_PAIRS.format(budget=25)}, n AS (SELECT unnest(allowed) AS name FROM kept) SELECT name, count(n.name) AS n FROM registry LEFT JOIN n USING (name) GROUP BY name"),
    "q_grid_position": sql("objects", """, p AS (SELECT label, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM objects), g AS (
        SELECT label, CASE WHEN x < 1e0 / 3 THEN 'left' WHEN x < 2e0 / 3 THEN 'center' ELSE 'right' END AS h, CASE WHEN y < 1e0 / 3 THEN 'top' WHEN y < 2e0 / 3 THEN 'middle' ELSE 'bottom' END AS v FROM p)
        SELECT label, CASE WHEN h = 'center' AND v = 'middle' THEN 'center' WHEN v = 'middle' THEN h WHEN h = 'center' THEN v ELSE v || '-' || h END AS position, count(*) AS n FROM g GROUP BY ALL"""),
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
