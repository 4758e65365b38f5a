"""The plans are the ones that hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from framelake.operators import boosts, filters, ranking, relations, sequence, temporal


@pytest.fixture
def plain(spark):
    """Plans as they are before runtime changes, with no table small enough to broadcast by itself."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.set(k, v)


def count(plan, word):
    return len(re.findall(rf"{word}\b", plan))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    n = spark.range(200)
    video = F.concat(F.lit("v"), (F.col("id") % 9).cast("string"))
    box = [((F.col("id") % k) / 100).alias(c) for c, k in (("ymin", 30), ("xmin", 40))] + [(0.5 + (F.col("id") % k) / 100).alias(c) for c, k in (("ymax", 30), ("xmax", 40))]
    label = F.element_at(F.array(F.lit("Dog"), F.lit("Cat")), (F.col("id") % 2 + 1).cast("int"))
    n.select(video.alias("video_id"), F.col("id").cast("int").alias("frame_idx"), F.rand(1).alias("score"), F.array(F.rand(2), F.rand(3)).alias("vec"), F.lit("x").alias("path")).write.parquet(f"{root}/frames")
    n.select(F.col("id").alias("detection_id"), video.alias("video_id"), (F.col("id") % 50).cast("int").alias("frame_idx"), label.alias("label"), F.rand(4).alias("score"), *box).write.parquet(f"{root}/objects")
    return spark.read.parquet(f"{root}/frames"), spark.read.parquet(f"{root}/objects")


def test_top_k_is_a_scan(plain, tables):
    plan = plain(ranking.rank_vectors(tables[0].select("video_id", "frame_idx", "vec"), [1.0, 0.0], 5))
    assert count(plan, "TakeOrderedAndProject") == 1 and count(plan, "Exchange") == 0
    assert re.search(r"ReadSchema: struct<video_id:string,frame_idx:int,vec:array<double>>", plan)


def test_filters_reach_the_scan(plain, tables):
    plan = plain(filters.by_labels(tables[1], ["Dog"], {"Dog": 2}))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(label,Dog\)", plan) and re.search(r"ReadSchema: struct<video_id:string,frame_idx:int,label:string>", plan)
    assert count(plan, "Exchange") == 1


def test_groups_are_one_pass(plain, tables):
    plan = plain(filters.by_label_groups(tables[1], [(("Dog",), 1), (("Cat",), 1), (("Dog", "Cat"), 2)]))
    assert count(plan, "FileScan") == 1 and count(plan, "Exchange") == 1 and "Join" not in plan


def test_candidates_are_joined_before_scores(plain, tables):
    plan = plain(ranking.rank_vectors(tables[0], [1.0, 0.0], 5, filters.by_labels(tables[1], ["Dog"])))
    assert "LeftSemi" in plan and plan.index("TakeOrderedAndProject") < plan.index("LeftSemi") and "Cartesian" not in plan


@pytest.mark.parametrize("n", [2, 4])
def test_chains_shuffle_once(plain, tables, n):
    plan = plain(temporal.chain_best([tables[0].where(f"frame_idx % 4 = {i}") for i in range(n)]))
    assert count(plan, "Exchange") == 1 and count(plan, "Sort") == 1 and "Join" not in plan


def test_nearest_shuffles_once(plain, tables):
    points, frames = tables[0].select("video_id", F.col("score").alias("t")), tables[0].select("video_id", "frame_idx", F.col("score").alias("ft"))
    plan = plain(temporal.nearest(points, frames, "t", "ft"))
    assert count(plan, "Exchange") == 1 and "Join" not in plan


def test_pairs_meet_inside_a_frame(plain, tables):
    plan = plain(relations.spatial_edges(tables[1]))
    assert count(plan, "SortMergeJoin") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_boosts_shuffle_signals_only(plain, tables):
    pool = ranking.rank_vectors(tables[0], [1.0, 0.0], 5).select("video_id", "frame_idx", "score")
    plan = plain(boosts.boosted(pool, boosts.secondary_signal(tables[1], ["Dog"]), "x", 0.1))
    assert "LeftOuter" in plan and "Cartesian" not in plan


def test_windows_have_a_key(plain, tables):
    for df in (sequence.runs(tables[0], ["video_id"], "frame_idx"), sequence.skip_stride(tables[0], ["video_id"], "frame_idx"), sequence.lead_segments(tables[0], ["video_id"], "score", "frame_idx")):
        plan = plain(df)
        assert "SinglePartition" not in plan and count(plan, "Exchange") == 1


def test_no_python_in_plans(plain, tables):
    for df in (relations.spatial_edges(tables[1]), temporal.chain_best([tables[0]] * 2), filters.by_labels(tables[1], ["Dog"])):
        assert not re.search("Python|Pandas|Arrow", plain(df))


#: Queries whose rows meet in one task because they are a bounded pool (a top-k, ranks in it).
BOUNDED = {"q_rrf", "q_monitor", "q_search_fused", "q_answer_question", "q_submission_qa", "q_comb_mnz"}


def one_task(plan):
    """Exchanges to one partition that carry rows, not an aggregate's or a limit's."""
    lines = plan.splitlines()
    found = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and not line.strip().startswith(("(", "Arguments")):
            above = " ".join(lines[max(0, i - 3) : i])
            if "Window" in above or re.search(r"Sort \[", above):
                found.append(above.strip()[:200])
    return found


def test_no_window_without_a_key(plain, spark, sf_dir):
    from framelake.catalogue import QUERIES

    bad = {n: x for n, q in QUERIES.items() if n not in BOUNDED and (x := one_task(plain(q(spark, sf_dir))))}
    assert not bad, bad


def test_one_join_makes_pairs(plain, tables, spark):
    types = spark.createDataFrame([("Dog", ["animal"]), ("Cat", ["animal"])], "label string, categories array<string>")
    registry = relations.registry(spark)
    for df in (relations.spatial_edges(tables[1]), relations.gate_pairs(tables[1], types, registry)):
        plan = plain(df)
        assert len(re.findall(r"Join \[video_id#\d+, frame_idx#\d+\]", plan)) == 1 and "Cartesian" not in plan and "NestedLoop" not in plan
    assert plain(relations.spatial_edges(tables[1])).count("greatest(") <= 40  # geometry is written once
    claims = spark.createDataFrame([("v1", 1, 1, 2, "riding", 0.9)], "video_id string, frame_idx int, subj_id bigint, obj_id bigint, relation string, conf double")
    plan = plain(relations.crosscheck_objects(claims, tables[1]))
    assert not re.search(r"Join \[video_id#\d+, frame_idx#\d+\]", plan)
