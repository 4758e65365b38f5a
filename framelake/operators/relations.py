"""Relations between objects of one frame: suppression, geometry, gates and edges.

Pairs are made by an equi-join on the frame first; a frame has tens of objects.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, classified, iou, normalized_gap, relation_name
from .filters import KEY

# Relation, subject categories, object categories, gate, kind.
REGISTRY = (
    ("holding", ("person",), ("object",), "proximity", "interaction"),
    ("riding", ("person",), ("vehicle", "animal"), "proximity", "interaction"),
    ("wearing", ("person",), ("clothing_accessory",), "proximity", "interaction"),
    ("carrying", ("person",), ("object",), "proximity", "interaction"),
    ("sitting_on", ("person", "animal"), ("surface", "object"), "proximity", "interaction"),
    ("standing_on", ("person", "animal"), ("surface", "object"), "proximity", "interaction"),
    ("pushing", ("person",), ("object", "vehicle"), "proximity", "interaction"),
    ("pulling", ("person",), ("object", "vehicle"), "proximity", "interaction"),
    ("feeding", ("person",), ("animal",), "proximity", "interaction"),
    ("looking_at", ("person",), ("person", "object"), "orientation", "interaction"),
    ("talking_to", ("person",), ("person", "object"), "orientation", "interaction"),
    ("inside", ("object",), ("object", "container"), "proximity", "containment"),
    ("on_top_of", ("object",), ("object", "container"), "proximity", "containment"),
    ("part_of", ("object",), ("object",), "proximity", "containment"),
)
AGENTS = ("person", "animal")
NEEDS_GEOMETRY = ("riding", "sitting_on", "standing_on")
PROTECTED = ("person", "clothing_accessory")


def registry(spark: SparkSession) -> DataFrame:
    """The 14 relations as a table."""
    rows = [(n, list(s), list(o), g, c) for n, s, o, g, c in REGISTRY]
    return spark.createDataFrame(rows, "name string, subject_categories array<string>, object_categories array<string>, gate_type string, category string")


def effective_categories(categories: Column) -> Column:
    """A label's categories: ``object`` where there are none; without it where the label is a person or an animal."""
    known = F.coalesce(categories, F.array(F.lit("object")))
    agent = F.arrays_overlap(known, F.array(*map(F.lit, AGENTS)))
    return F.when(agent, F.array_remove(known, "object")).otherwise(known)


def with_categories(objects: DataFrame, label_types: DataFrame) -> DataFrame:
    typed = label_types.select("label", "categories")
    return objects.join(typed, "label", "left").withColumn("categories", effective_categories(F.col("categories")))


def suppress(closed: DataFrame, open_vocabulary: DataFrame, label_types: DataFrame | None = None, overlap: float = 0.5) -> DataFrame:
    """Both tables united; a closed-vocabulary object is marked suppressed if an open-vocabulary one of its frame overlaps it by more than ``overlap``.

    Labels of people and clothing are never suppressed.
    """
    box = F.struct("ymin", "xmin", "ymax", "xmax")
    others = open_vocabulary.groupBy(*KEY).agg(F.collect_list(box).alias("_others"))  # a frame has tens of objects
    known = closed.join(others, KEY, "left")
    hit = F.exists("_others", lambda o: iou(Box.of(), Box(o["ymin"], o["xmin"], o["ymax"], o["xmax"])) > overlap)
    if label_types is not None:
        safe = label_types.where(F.arrays_overlap("categories", F.array(*map(F.lit, PROTECTED)))).select("label", F.lit(True).alias("_safe")).distinct()
        known = known.join(safe, "label", "left")
        hit = hit & F.col("_safe").isNull()
    marked = known.withColumn("suppressed", F.coalesce(hit, F.lit(False))).select(*closed.columns, "suppressed")
    return marked.unionByName(open_vocabulary.withColumn("suppressed", F.lit(False)), allowMissingColumns=True)


def _sides(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    columns = [c for c in objects.columns if c not in KEY]
    side = lambda p: objects.select(*KEY, *[F.col(c).alias(f"{p}{c}") for c in columns])
    return side("a_"), side("b_")


def spatial_edges(objects: DataFrame) -> DataFrame:
    """inside, left_of and above between objects of a frame, each unordered pair once, from subject to object."""
    a, b = _sides(objects.select(*KEY, "detection_id", "label", "ymin", "xmin", "ymax", "xmax"))
    pairs = classified(a.join(b, KEY).where("a_detection_id < b_detection_id")).where("code is not null")
    take = lambda n: (F.when(F.col("code") > 0, F.col(f"a_{n}")).otherwise(F.col(f"b_{n}")), F.when(F.col("code") > 0, F.col(f"b_{n}")).otherwise(F.col(f"a_{n}")))
    (subject, object_), (subject_label, object_label) = take("detection_id"), take("label")
    return pairs.select(
        *KEY, subject.alias("subj_detection_id"), subject_label.alias("subj_label"), object_.alias("obj_detection_id"), object_label.alias("obj_label"), relation_name(F.col("code")).alias("relation")
    )


def gate_pairs(objects: DataFrame, label_types: DataFrame, relations: DataFrame, gap: float = 0.5, budget: int = 25) -> DataFrame:
    """Ordered pairs of a frame that some relation allows: by categories, by gap (not for orientations), by agent; the ``budget`` closest per frame.

    Columns: key, subj_id, subj_label, obj_id, obj_label, allowed_relations (in name order), normalized_gap.

    An object's roles are two bit masks over the registry (at most 62
    relations). Unordered pairs are made where some bit allows either order;
    their gap is computed once, and both orders are read from the masks.
    """
    asked = sorted(relations.limit(63).collect(), key=lambda r: r.name)
    if len(asked) > 62:
        raise ValueError("at most 62 relations")
    bits = lambda fits: sum((F.when(fits(r), 1 << i).otherwise(0).cast("bigint") for i, r in enumerate(asked)), F.lit(0).cast("bigint"))
    has = lambda words: F.arrays_overlap("categories", F.array(*map(F.lit, words)))
    masks = label_types.select("label", effective_categories(F.col("categories")).alias("categories"))
    masks = masks.withColumn("as_subject", bits(lambda r: has(r.subject_categories) & (has(AGENTS) if r.category == "interaction" else F.lit(True))))
    masks = masks.withColumn("as_object", bits(lambda r: has(r.object_categories))).drop("categories")
    # what a label without a type is: an object, so no agent
    untyped = [sum(1 << i for i, r in enumerate(asked) if "object" in words(r)) for words in (lambda r: () if r.category == "interaction" else r.subject_categories, lambda r: r.object_categories)]
    typed = objects.select(*KEY, "detection_id", "label", "ymin", "xmin", "ymax", "xmax").join(masks, "label", "left")
    typed = typed.withColumn("as_subject", F.coalesce("as_subject", F.lit(untyped[0]).cast("bigint"))).withColumn("as_object", F.coalesce("as_object", F.lit(untyped[1]).cast("bigint")))
    anywhere = sum(1 << i for i, r in enumerate(asked) if r.gate_type == "orientation")
    a, b = _sides(typed)
    both = (F.col("a_as_subject").bitwiseAND(F.col("b_as_object")) != 0) | (F.col("b_as_subject").bitwiseAND(F.col("a_as_object")) != 0)
    pairs = a.join(b, KEY).where("a_detection_id < b_detection_id").where(both)
    pairs = pairs.withColumn("normalized_gap", F.when(F.monotonically_increasing_id() >= 0, normalized_gap(Box.of("a_"), Box.of("b_"))))
    near = F.when(F.col("normalized_gap") <= gap, F.lit(-1).cast("bigint")).otherwise(F.lit(anywhere).cast("bigint"))

    def order(x: str, y: str) -> Column:
        mask = F.col(f"{x}_as_subject").bitwiseAND(F.col(f"{y}_as_object")).bitwiseAND(near)
        return F.struct(F.col(f"{x}_detection_id").alias("subj_id"), F.col(f"{x}_label").alias("subj_label"), F.col(f"{y}_detection_id").alias("obj_id"), F.col(f"{y}_label").alias("obj_label"), mask.alias("mask"))

    ways = pairs.select(*KEY, "normalized_gap", F.explode(F.array(order("a", "b"), order("b", "a"))).alias("p")).select(*KEY, "p.*", "normalized_gap").where("mask <> 0")
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("normalized_gap", "subj_id", "obj_id"))
    kept = ways.withColumn("place", place).where(F.col("place") <= budget)
    names = F.filter(F.array(*[F.lit(r.name) for r in asked]), lambda _, i: F.getbit("mask", i) == 1)
    return kept.select(*KEY, "subj_id", "subj_label", "obj_id", "obj_label", names.alias("allowed_relations"), "normalized_gap")


def confidence_gate(claims: DataFrame, direct: float = 0.55, inferred: float = 0.70) -> DataFrame:
    """Claims with a relation and enough confidence; confidences over 1 are percentages."""
    conf = F.coalesce(F.when(F.col("conf") > 1, F.col("conf") / 100).otherwise(F.col("conf")), F.lit(0.0))
    kept = claims.where(F.col("relation").isNotNull() & (F.col("relation") != "")).withColumn("conf", conf)
    return kept.where(F.col("conf") >= F.when(F.coalesce("inferred", F.lit(False)), inferred).otherwise(direct))


def linked_pairs(edges: DataFrame) -> DataFrame:
    """(key, subj_id, obj_id) of all edges, both ways."""
    way = lambda x, y: F.struct(F.col(f"{x}_detection_id").alias("subj_id"), F.col(f"{y}_detection_id").alias("obj_id"))
    return edges.select(*KEY, F.explode(F.array(way("subj", "obj"), way("obj", "subj"))).alias("p")).select(*KEY, "p.*").distinct()


def _checked(rows: DataFrame, doubtful: Column) -> DataFrame:
    return rows.withColumn("spatial_checked", ~doubtful).withColumn("conf", F.when(~F.col("spatial_checked"), F.col("conf") * 0.5).otherwise(F.col("conf")))


def spatial_crosscheck(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations that need contact keep half their confidence, and spatial_checked is false, where no edge joins the pair in its frame."""
    rows = claims.join(linked_pairs(edges).withColumn("linked", F.lit(True)), [*KEY, "subj_id", "obj_id"], "left")
    return _checked(rows, F.col("relation").isin(*NEEDS_GEOMETRY) & F.col("linked").isNull()).drop("linked")


def crosscheck_objects(claims: DataFrame, objects: DataFrame) -> DataFrame:
    """As :func:`spatial_crosscheck`, with the objects in place of a table of edges.

    A claim meets its two objects, and that one pair is classified: no other
    pairs are made.
    """
    box = lambda p, n: objects.select(*KEY, F.col("detection_id").alias(n), *[F.col(c).alias(f"{p}{c}") for c in ("ymin", "xmin", "ymax", "xmax")])
    asked = F.col("relation").isin(*NEEDS_GEOMETRY)
    rows = claims.join(box("a_", "subj_id"), [*KEY, "subj_id"], "left").join(box("b_", "obj_id"), [*KEY, "obj_id"], "left")
    return _checked(classified(rows), asked & F.col("code").isNull()).select(*claims.columns, "spatial_checked")


def by_relations(candidates: DataFrame, edges: DataFrame, relations: Sequence[tuple[str, str | None, str | None]]) -> DataFrame:
    """Candidates that have an edge for every (relation, subject label, object label); None stands for any label.

    All relations are asked in one pass over the edges.
    """
    if not relations:
        return candidates

    def fits(relation: str, subject: str | None, object_: str | None) -> Column:
        both = [F.col("subj_label") == subject] * (subject is not None) + [F.col("obj_label") == object_] * (object_ is not None)
        return F.coalesce(reduce(lambda a, b: a & b, both, F.col("relation") == relation), F.lit(False))

    met = edges.where(F.col("relation").isin(*{r for r, *_ in relations})).groupBy(*KEY).agg(*[F.max(fits(*r)).alias(f"met{i}") for i, r in enumerate(relations)])
    every = reduce(lambda a, b: a & b, [F.col(f"met{i}") for i in range(len(relations))])
    return candidates.join(met.where(every).select(*KEY), KEY, "left_semi")
