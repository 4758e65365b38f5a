import itertools
import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import boosts, dictionary, evaluation, exploration, filters, ranking, relations, sequence, statistics, temporal

KEYS = "video_id string, frame_idx int"


def keys(df):
    return sorted((r.video_id, r.frame_idx) for r in df.collect())


# --- chains ---


def pools(spark, data):
    return [spark.createDataFrame(p, "video_id string, frame_idx int, score double") if p else spark.createDataFrame([], "video_id string, frame_idx int, score double") for p in data]


def best_chain(data, aggregate):
    out = {}
    for v in {r[0] for p in data for r in p}:
        own = [[(f, s) for x, f, s in p if x == v] for p in data]
        for pick in itertools.product(*own):
            if all(a[0] < b[0] for a, b in zip(pick, pick[1:], strict=False)):
                score = min(s for _, s in pick) if aggregate == "min" else sum(s for _, s in pick) / len(pick)
                out[v] = max(out.get(v, -9e9), score)
    return out


@pytest.mark.parametrize("aggregate", ["min", "mean"])
@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_best_chain_against_all_chains(spark, aggregate, n):
    rng = random.Random(n)
    data = [[(f"v{rng.randint(0, 3)}", f, rng.choice([0.1, 0.4, 0.5, rng.random()])) for f in rng.sample(range(25), 9)] for _ in range(n)]
    data[0] = [r for r in data[0] if r[0] != "v3"] or data[0]
    got = temporal.chain_best(pools(spark, data), aggregate).collect()
    expected = best_chain(data, aggregate)
    assert {r.video_id: pytest.approx(r.score) for r in got} == expected
    scores = [{(v, f): s for v, f, s in p} for p in data]
    for r in got:
        assert all(a < b for a, b in zip(r.path, r.path[1:], strict=False)) and len(r.path) == n
        own = [scores[i][r.video_id, f] for i, f in enumerate(r.path)]
        assert r.score == pytest.approx(min(own) if aggregate == "min" else sum(own) / n)


def test_chain_examples(spark):
    toy = [[("ok", 46, 0.79), ("bad", 155, 0.71)], [("ok", 138, 0.74), ("bad", 52, 0.77), ("none", 10, 0.6)]]
    for chain in (temporal.chain_best, temporal.chain_greedy):
        (row,) = chain(pools(spark, toy)).collect()
        assert (row.video_id, row.path, row.score) == ("ok", [46, 138], 0.74)
        assert chain(pools(spark, [[("v", 10, 1.0)], [("v", 10, 1.0)]])).collect() == []
    wide = temporal.wide_picks(temporal.chain_best(pools(spark, toy)), 2).first()
    assert (wide.anchor1_frame_id, wide.anchor2_time) == (46, 138 / 25)


def test_greedy_can_miss_the_best(spark):
    data = [[("v", 1, 0.1), ("v", 5, 0.9)], [("v", 3, 0.2), ("v", 8, 0.8)]]
    assert temporal.chain_greedy(pools(spark, data)).first().path == [1, 3]
    assert temporal.chain_best(pools(spark, data)).first().path == [5, 8]


def test_nearest_against_all(spark):
    rng = random.Random(5)
    frames = [(f"v{rng.randint(0, 2)}", i, float(rng.randint(0, 30))) for i in range(25)]
    points = [(f"v{rng.randint(0, 3)}", i, rng.randint(0, 60) / 2) for i in range(60)]
    got = temporal.nearest(spark.createDataFrame(points, "video_id string, id int, t double"), spark.createDataFrame(frames, "video_id string, frame_idx int, ft double"), "t", "ft").collect()
    assert len(got) == 60
    for r in got:
        near = [(abs(ft - r.t), ft, i) for v, i, ft in frames if v == r.video_id]
        assert r.nearest_frame_idx == (min(near)[2] if near else None)


def test_linear_chain():
    assert temporal.linear_chain([("a", "b"), ("b", "c")], "abc") == ["a", "b", "c"]
    assert temporal.linear_chain([("a", "c"), ("b", "c")], "abc") == ["a", "b", "c"]
    assert temporal.linear_chain([], "abc") == []


# --- filters and ranking ---


def test_none_and_empty_differ(spark):
    frames = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], KEYS)
    nothing = frames.where("frame_idx > 9")
    assert filters.combine(frames, None, [None]) is None
    assert keys(filters.combine(frames, None, [nothing])) == []
    videos = spark.createDataFrame([("a",)], "video_id string")
    assert keys(filters.combine(frames, videos, [])) == [("a", 1), ("a", 2)]
    assert keys(filters.combine(frames, videos, [frames.where("frame_idx = 1")])) == [("a", 1)]
    with pytest.raises(ValueError):
        filters.by_text(None, "x")


def test_label_groups_and_suppression(spark):
    rows = [("a", 1, "Dog", False, "c"), ("a", 1, "Dog", True, "c"), ("a", 2, "Dog", False, "c"), ("a", 2, "Cat", False, "o"), ("a", 2, "Dog", False, "c")]
    o = spark.createDataFrame(rows, KEYS + ", label string, suppressed boolean, source string")
    assert keys(filters.by_labels(o, ["Dog"], {"Dog": 2})) == [("a", 2)]
    assert keys(filters.by_labels(o, ["Dog"], {"Dog": 2}, use_suppression=False)) == [("a", 1), ("a", 2)]
    assert keys(filters.by_label_groups(o, [(("Cat", "Bird"), 1)])) == [("a", 2)] and keys(filters.by_labels(o, ["Cat"], sources=["c"])) == []


def test_metadata_dates_and_accents(spark):
    v = spark.createDataFrame([("a", "X", "Phố cổ", "2024-01-02", "hà nội"), ("b", "X", "bphố", None, None), ("c", "Y", "pho", "2024-01-01", "x")], "video_id string, author string, title string, d string, keywords_text string")
    v = v.withColumn("publish_date", F.col("d").cast("date"))
    found = lambda **k: sorted(r.video_id for r in filters.by_metadata(v, **k).collect())
    assert found(date_from="2024-01-01", date_to="2024-01-01") == ["c"] and found(keywords_any=["pho"]) == ["a", "c"] and found(keywords_any=["Cổ Hà"]) == ["a"] and found(authors=["X"]) == ["a", "b"]


def test_fusion_and_backfill(spark):
    p = [spark.createDataFrame(x, KEYS + ", score double") for x in ([("a", 1, 0.9), ("a", 2, 0.8)], [("a", 1, 0.5)], [("a", 3, 0.1)])]
    got = ranking.reciprocal_rank_fusion(p, 5).collect()
    assert got[0].score == pytest.approx(2 / 61) and [r.frame_idx for r in got] == [1, 3, 2]
    every = spark.createDataFrame([("a", i, 1.0 - i / 10) for i in range(8)], KEYS + ", score double")
    rows = ranking.backfill(every.where("frame_idx >= 6"), every, 5).collect()
    assert [(r.frame_idx, r.is_backfill) for r in rows] == [(6, False), (7, False), (0, True), (1, True), (2, True)]


def test_boosts_keep_rows(spark):
    results = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.4)], KEYS + ", score double")
    signal = spark.createDataFrame([("a", 2, 1.0)], KEYS + ", signal double")
    rows = {r.frame_idx: r for r in boosts.boosted(results, signal, "x", 0.2).collect()}
    assert rows[2].score == pytest.approx(0.6) and rows[1].x_boost == 0.0 and rows[2].score_before_x == 0.4
    assert boosts.clipped_sum([signal, signal]).first().signal == 1.0 and boosts.mean_signal([signal, signal.limit(0)]).first().signal == 0.5


def test_diverse(spark):
    rows = spark.createDataFrame([(1, 0.9, [1.0, 0.0]), (2, 0.89, [1.0, 0.0]), (3, 0.5, [0.0, 1.0])], "id int, score double, vec array<double>")
    assert [r.id for r in ranking.diverse(rows, 2)] == [1, 3]


# --- relations ---


def test_categories_and_gate(spark):
    types = spark.createDataFrame([("Person", ["person", "object"]), ("Bike", ["vehicle", "object"])], "label string, categories array<string>")
    o = spark.createDataFrame([("v", 1, i, lb, y, x, y + 0.2, x + 0.2) for i, lb, y, x in ((1, "Person", 0.0, 0.0), (2, "Bike", 0.1, 0.1), (3, "Thing", 0.7, 0.7))], KEYS + ", detection_id int, label string, ymin double, xmin double, ymax double, xmax double")
    got = {(r.subj_id, r.obj_id): r.allowed_relations for r in relations.gate_pairs(o, types, relations.registry(spark)).collect()}
    assert got[1, 2] == sorted(["holding", "riding", "carrying", "sitting_on", "standing_on", "pushing", "pulling", "looking_at", "talking_to"])
    assert got[1, 3] == ["looking_at", "talking_to"] and (3, 1) not in got
    assert relations.gate_pairs(o, types, relations.registry(spark), budget=1).count() == 1


def test_confidence(spark):
    rows = [(1, 2, "riding", 100.0, False), (1, 2, "riding", 0.6, True), (1, 2, None, 0.9, False), (1, 2, "riding", 0.55, None), (1, 2, "riding", None, False)]
    got = relations.confidence_gate(spark.createDataFrame(rows, "subj_id int, obj_id int, relation string, conf double, inferred boolean")).collect()
    assert [r.conf for r in got] == [1.0, 0.55]


# --- sequences ---


def test_runs_and_middles(spark):
    rows = spark.createDataFrame([("v", i, s) for i, s in ((0, 0.1), (15, 0.5), (40, 0.5), (41, 0.2))], "video_id string, idx int, score double").withColumn("text", F.col("idx").cast("string"))
    got = sequence.run_summary(rows, ["video_id"], "idx", "text", "score").orderBy("start").collect()
    assert [(r.start, r.end, r.text) for r in got] == [(0, 15, "15"), (40, 41, "40")]
    assert sorted(r.idx for r in sequence.run_middle(rows, ["video_id"], "idx").collect()) == [15, 41]


def test_strides_shards_and_chunks(spark):
    rows = spark.range(40).select(F.lit("v").alias("video_id"), F.col("id").cast("int").alias("idx"))
    assert sorted(r.idx for r in sequence.skip_stride(rows, ["video_id"], "idx").collect()) == [5, 20, 35]
    assert sorted(r.idx for r in sequence.stride_sample(rows, ["idx"], 4).collect()) == [0, 10, 20, 30]
    assert {r.idx % 3 == r.shard for r in sequence.shard(rows, ["idx"], 3).collect()} == {True}
    got = sequence.fixed_chunks(spark.createDataFrame([(60.0,), (28.0,), (0.0,)], "total double"), "total").collect()
    assert [(r.chunk_start, r.chunk_end) for r in got] == [(0.0, 28.0), (28.0, 56.0), (56.0, 60.0), (0.0, 28.0)]


def test_portable_hash_of_large_numbers(spark):
    values = [0, 1, 270626, 270627, 675667, 2**31 - 1, -5, -(2**31)]
    small = spark.createDataFrame([(v,) for v in values], "v int").select("v", sequence.portable_hash(F.col("v")).alias("h"))
    large = spark.createDataFrame([(v,) for v in (*values, 2**40, 2**63 - 1)], "v bigint").select("v", sequence.portable_hash(F.col("v")).alias("h"))
    exact = lambda v: (abs(v * 7919 + 42 * 104729) % 1000003) * (1 if v * 7919 + 42 * 104729 >= 0 else -1)
    for rows in (small, large):
        assert all(r.h == exact(r.v) for r in rows.collect())


def test_pilot_frames_of_long_archives(spark):
    rows = [("v", i, ["feeding"] if i % 2 else ["holding"]) for i in range(300_000, 300_020)]
    pairs = spark.createDataFrame(rows, "video_id string, frame_idx int, allowed_relations array<string>")
    got = exploration.pilot_frames(pairs, ["feeding"], 6, sequence.portable_hash(F.col("frame_idx"))).collect()
    order = lambda i: (i * 7919 + 42 * 104729) % 1000003
    first = sorted((i for _, i, _ in rows if i % 2), key=order)[:3]
    rest = sorted((i for _, i, _ in rows if i not in first), key=order)[:3]
    assert [r.frame_idx for r in got] == first + rest and [r.rare for r in got] == [i % 2 == 1 for i in first + rest]


def test_carry(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, None)], "rank int, answer string").withColumn("k", F.lit(1))
    values = lambda **k: [r.answer for r in sequence.carry(rows, "answer", ["rank"], ["k"], **k).orderBy("rank").collect()]
    assert values() == [None, "a", "b", "b"] and values(which="first") == [None, "a", "b", "a"]


# --- dictionaries and reports ---


def test_known_terms():
    entries = {"bàn": "Table", "tay": "Hand", "bàn tay": "Human hand", "xe": "Car"}
    assert dictionary.find_known_terms("một bàn tay và bàn xe", entries) == {"bàn tay": "Human hand", "bàn": "Table"}
    assert dictionary.find_known_terms("", entries) == {} and dictionary.find_known_terms("x", {}) == {}


def test_synonyms(spark):
    canonical = spark.createDataFrame([("Dog", "chó"), ("Cat", "mèo")], "label string, name string")
    rows = [("Dog", "cún"), ("Dog", "mèo cỏ"), ("Cat", "miu"), ("Dog", "pet"), ("Cat", "pet"), ("Cat", "mèo")]
    got = dictionary.valid_synonyms(spark.createDataFrame(rows, "label string, synonym string"), canonical).collect()
    assert sorted(map(tuple, got)) == [("Cat", "miu"), ("Cat", "mèo"), ("Dog", "cún")]


def test_recall_and_metrics(spark):
    rows = spark.createDataFrame([(1, True, 0.5), (1, False, 0.9), (1, False, 0.1), (2, True, 0.7), (2, False, 0.7)], "query_id int, is_truth boolean, sim double")
    ranked = evaluation.truth_ranks(rows)
    assert {(r.query_id, r["rank"]) for r in ranked.collect()} == {(1, 2), (2, 1)}
    assert evaluation.recall(ranked, (1, 3)).first().recall_at_1 == 0.5
    summary = evaluation.margin_summary(evaluation.margins(rows)).first()
    assert summary.negative_share == 0.5 and summary["mean"] == pytest.approx(-0.2)
    assert evaluation.same_results(rows, rows, ["query_id", "sim"], 9) == 1.0


def test_phrases_by_frame_or_mention(spark):
    rows = spark.createDataFrame([("v", 1, ["A b", "a  b", "c"]), ("v", 2, ["a b"])], KEYS + ", phrases array<string>")
    assert [tuple(r) for r in statistics.phrase_frequency(rows, "phrases", least=2).collect()] == [("a b", 2)]
    assert [tuple(r) for r in statistics.phrase_frequency(rows, "phrases", least=2, per_frame=False).collect()] == [("a b", 3)]
