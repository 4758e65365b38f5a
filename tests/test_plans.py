import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import models
from framelake.plans import planner, search
from framelake.plans.planner import Edge, Node, QueryGraph

ENTRIES = {"xe máy": "Motorcycle", "người": "Person", "bàn tay": "Human hand", "chó": "Dog", "chó con": "Dog", "bát ăn cơm": "Bowl", "bát canh": "Bowl", "bát bóng chày": "Baseball bat"}


def test_rule_based_plan():
    plan = planner.resolved(planner.rule_based('Hai người trên xe máy, một bàn tay; MC nhắc tới "Pháp"', ENTRIES), ENTRIES)
    assert plan.groups == [(("Person",), 2), (("Motorcycle",), 1)]
    assert plan.secondary_entities == [{"term": "bàn tay"}] and plan.audio_mentions == [{"term": "pháp"}]


def test_terms():
    assert planner.resolve_term("Chó", ENTRIES) == ["Dog"] and planner.resolve_term("bát", ENTRIES) == ["Bowl"] and planner.resolve_term("xe", ENTRIES) == [] and planner.resolve_term("zzz", ENTRIES) == []


def test_model_answers():
    plan = planner.from_model('```json\n{"entities": [{"term": "chó", "min_count": 2}], "clip_text": "dogs"}\n```', "x")
    assert plan.clip_text == "dogs" and plan.entities == [{"term": "chó", "min_count": 2}]
    assert planner.from_model("no json", "x") == planner.Plan("x")
    assert planner.merged_groups([(("a",), 1)], [(("a",), 3), (("b",), 1)]) == [(("a",), 3), (("b",), 1)]


def test_step_log():
    times = iter([0.0, 2.0])
    log = planner.StepLog(now=lambda: next(times))
    assert log.run("a", lambda: 5, str) == 5
    assert log.rows == [("a", "5", 2.0)] and log.seconds() == 2.0


def test_retry():
    seen, waits = [], []

    def call():
        seen.append(1)
        if len(seen) < 4:
            raise OSError
        return 7

    assert models.with_retry(call, wait=waits.append) == 7 and waits == pytest.approx([1, 1.8, 3.24])


@pytest.fixture(scope="module")
def lib(spark):
    key = "video_id string, frame_idx int"
    vectors = [("a", i, [1.0 - i / 20, i / 20]) for i in range(10)] + [("b", i, [i / 20, 1.0 - i / 20]) for i in range(10)]
    vec = spark.createDataFrame(vectors, key + ", vec array<double>")
    box = "ymin double, xmin double, ymax double, xmax double"
    objects = [(i, "a", i, "Dog", 0.9, 0.1, 0.1, 0.3, 0.3) for i in range(4)] + [(9, "b", 2, "Dog", 0.5, 0.6, 0.6, 0.9, 0.9), (10, "a", 3, "Cat", 0.8, 0.5, 0.5, 0.9, 0.9)]
    lines = spark.createDataFrame([("a", 2, 4, "ban tin thoi su 24", 0.0, 0.0, 0.2, 0.5)], f"video_id string, frame_start int, frame_end int, text_norm string, {box}")
    speech = spark.createDataFrame([("a", 3, 3, "Thời sự 24", "thoi su 24"), ("a", 1, 2, "Trước", "truoc")], "video_id string, frame_idx_start int, frame_idx_end int, text_raw string, text_norm string")
    o = spark.createDataFrame(objects, f"detection_id int, {key}, label string, score double, {box}")
    from framelake.operators.relations import spatial_edges

    return search.Library(
        frames=vec.select("video_id", "frame_idx"), vectors={"s": vec, "t": vec}, objects=o, lines=lines, speech=speech, edges=spatial_edges(o),
        fps=spark.createDataFrame([("a", 1.0), ("b", 1.0)], "video_id string, fps double"), videos=spark.createDataFrame([("a", "X", "t", None, "k")], "video_id string, author string, title string, publish_date timestamp, keywords_text string"),
        region_vectors=spark.createDataFrame([(3, [0.0, 1.0])], "detection_id int, vec array<double>"),
    )


Q = {"s": [1.0, 0.0]}


def places(df):
    return [(r.video_id, r.frame_idx) for r in df.collect()]


def test_search(spark, lib):
    assert places(search.search(lib, Q, 3)) == [("a", 0), ("a", 1), ("a", 2)]
    rows = search.search(lib, Q, 4, search.Filters(groups=[(("Dog",), 1)], texts=["thoi su"])).collect()
    assert [(r.frame_idx, r.is_backfill) for r in rows] == [(2, False), (3, False), (0, True), (1, True)]
    fused = search.search(lib, {"s": [1.0, 0.0], "t": [1.0, 0.0]}, 2).collect()
    assert fused[0].score == pytest.approx(2 / 61)
    assert places(search.search(lib, Q, 2, search.Filters(authors=["X"]))) == [("a", 0), ("a", 1)]
    boosted = search.search(lib, Q, 2, mentions=["thoi"], secondary=[["Cat"]], attributes=[(["Dog"], [0.0, 1.0])], agreement=True).collect()
    # seen: ban tin thoi 24; heard within 30 frames: thoi 24 truoc
    assert (boosted[0].frame_idx, boosted[0].region_boost, boosted[0].agreement_boost) == (3, 1.0, 2 / 3)
    box = {"type": "object", "labels": ["Dog"], "min_count": 1, "region": (0.6, 0.6, 0.9, 0.9)}
    assert places(search.search(lib, Q, 1, search.Filters(boxes=[box])))[0] == ("a", 0)
    both = search.Filters(boxes=[{"type": "object", "labels": ["Cat"]}, {"type": "ocr", "text": "ban tin"}], box_op="or")
    assert sorted(places(search.search(lib, Q, 9, both, with_backfill=False))) == [("a", 2), ("a", 3), ("a", 4)]


def test_search_of_a_plan(lib):
    plan = planner.resolved(planner.rule_based("một chó", ENTRIES), ENTRIES)
    rows = search.search_plan(lib, plan, lambda text: Q, lambda term: planner.resolve_term(term, ENTRIES), 5).collect()
    assert [(r.video_id, r.frame_idx) for r in rows if not r.is_backfill] == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 2)]


def test_temporal_search(lib):
    anchors = [search.Anchor(Q), search.Anchor({"s": [0.0, 1.0]})]
    rows = {r.video_id: r for r in search.search_temporal(lib, anchors).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].anchor1_frame_id < rows["a"].anchor2_frame_id
    only_dogs = [search.Anchor(Q, search.Filters(groups=[(("Dog",), 1)])), search.Anchor(Q, search.Filters(groups=[(("Cat",), 1)]))]
    assert [r.video_id for r in search.search_temporal(lib, only_dogs).collect()] == ["a"]
    with pytest.raises(ValueError):
        search.search_temporal(lib, anchors[:1])


def test_questions(lib):
    results = search.search(lib, Q, 6)

    def ask(rows):
        return rows.withColumn("answer", F.concat_ws(":", "rank", F.coalesce("context", F.lit("-"))))

    rows = search.answer_question(results, lib.speech, ask, n=2, margin=0).orderBy("rank").collect()
    assert [r.answer for r in rows] == ["1:-", "2:Trước", "2:Trước", "2:Trước", "2:Trước", "2:Trước"]


def test_graphs(lib):
    g = QueryGraph([Node("s", scene="x"), Node("d", label="Dog", count=1), Node("c", label="Cat")], [Edge("d", "c", "left_of", "spatial"), Edge("d", "c", "chasing", "semantic")])
    rows, unverified = search.run_graph(lib, g, lambda text: Q)
    assert places(rows) == [("a", 3)] and [e.relation for e in unverified] == ["chasing"]
    rows, unverified = search.run_graph(lib, g, lambda text: Q, check_edge=lambda short, e: short.select("video_id", "frame_idx", F.lit(0.25).alias("edge_score")))
    assert rows.first().score == 0.25 and unverified == []
    order = QueryGraph([Node("a"), Node("b"), Node("c")], [Edge("b", "c", "before", "temporal"), Edge("a", "b", "before", "temporal")])
    assert [n.id for n in order.events()] == ["a", "b", "c"] and g.labels() == {"s": None, "d": "Dog", "c": "Cat"} and list(g.edges_by_kind()) == ["spatial", "semantic"]
    rows, unverified = search.run_graph(lib, g, lambda text: Q, check_edge=lambda short, e: short, seconds=0.0)
    assert rows.count() == 1 and [e.relation for e in unverified] == ["chasing"]


def test_chains_of_events():
    from framelake.operators.temporal import linear_chain

    assert linear_chain([], ["a"]) == []
    assert linear_chain([("b", "c"), ("a", "b")], "abc") == ["a", "b", "c"]
    assert linear_chain([("a", "b"), ("b", "a")], "ab") == ["a", "b"]  # no start: as declared
    assert linear_chain([("a", "c"), ("b", "c")], "abc") == ["a", "b", "c"]
    assert linear_chain([("x", "a"), ("a", "b"), ("a", "c"), ("b", "d")], "xabcd") == ["x", "a", "b", "d"]
    assert linear_chain([("x", "a"), ("a", "b")], "x") == ["x"]


def test_steps_that_fail_are_noted(spark):
    log = planner.StepLog()
    with pytest.raises(ZeroDivisionError):
        log.run("bad", lambda: 1 / 0)
    assert log.table(spark).select("place", "step", "detail").collect() == [(0, "bad", "failed")]


def test_number_words_of_two_words():
    assert planner.rule_based("một số người và một vài chó", ENTRIES).entities == [{"term": "người", "min_count": 2}, {"term": "chó", "min_count": 2}]


def test_anchors(lib):
    a = search.Anchor.of({"text": "x", "groups": [(("Dog",), 1)]}, lambda t: Q)
    assert a.queries == Q and a.filters.groups == [(("Dog",), 1)] and search.Anchor.of("x", lambda t: Q).queries == Q and search.Anchor.of(a, None) is a


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "red car"), (2, ""), (3, "red car")], "id int, text string")
    got = models.encoded(rows, "text", models.HashEncoder("x", 8)).orderBy("id").collect()
    assert got[0].vec == got[2].vec and np.linalg.norm(got[0].vec) == pytest.approx(1, abs=1e-6) and set(got[1].vec) == {0.0}
    images = spark.createDataFrame([("v", 1, b"x")], "video_id string, frame_idx int, content binary")
    box = {"label": "Dog", "score": 0.5, "ymin": 0.0, "xmin": 0.0, "ymax": 1.0, "xmax": 1.0}
    assert models.detected(images, lambda batch: [[box, box | {"score": 0.1}] for _ in batch]).count() == 1


def test_models_of_many_rows(spark):
    rows = spark.createDataFrame([(1, "c", "p1"), (2, None, "p2"), (3, "", None)], "id int, context string, path string")
    got = models.answered(rows, "what?", lambda prompts, images: [f"{p}|{i}" for p, i in zip(prompts, images, strict=True)], batch=2).orderBy("id").collect()
    assert [r.answer for r in got] == ["what?\nc|p1", "what?|p2", "what?|None"]
    images = spark.createDataFrame([("v", 1, b"ab"), ("v", 2, b"")], "video_id string, frame_idx int, content binary")
    line = {"text": "x", "score": 0.9, "ymin": 0.0, "xmin": 0.0, "ymax": 1.0, "xmax": 1.0}
    got = models.read_lines(images, lambda batch: [[line | {"text": chr(c)} for c in x] for x in batch]).collect()
    assert [(r.frame_idx, r.text_raw) for r in got] == [(1, "a"), (1, "b")]
    sounds = spark.createDataFrame([("v", 28.0, b"xy")], "video_id string, chunk_start double, content binary")
    got = models.transcribed(sounds, lambda batch: [[{"start": 1.0, "end": 2.0, "text": "hi"}, {"start": 2.0, "end": 3.0, "text": " "}] for _ in batch]).collect()
    assert [tuple(r) for r in got] == [("v", 29.0, 30.0, "hi")]
    objects = spark.createDataFrame([(7, "v", 1, 0.0, 0.0, 0.5, 0.5), (8, "w", 1, 0.0, 0.0, 0.5, 0.5)], "detection_id int, video_id string, frame_idx int, ymin double, xmin double, ymax double, xmax double")
    got = models.encoded_regions(objects, images, lambda content, box: content + str(box[2]).encode(), models.HashEncoder("x", 4)).collect()
    assert [r.detection_id for r in got] == [7] and len(got[0].vec) == 4
