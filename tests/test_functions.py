import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from framelake.functions import geometry as g
from framelake.functions import text as t
from framelake.functions import vectors as v


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("needle, text, expected", [
    ("gia vang tang", "gia vang nhan sang 13/8 tang", True), ("tang gia vang", "gia vang nhan sang 13/8 tang", False), ("ao", "bao dong", False), ("", "anything", True), ("a a", "a", False),
])
def test_ordered_words(spark, needle, text, expected):
    assert one(spark, t.ordered_words(F.lit(text), needle)) is expected
    assert one(spark, F.lit(text).rlike(t.ordered_words_pattern(needle)) if needle else F.lit(True)) is expected
    if needle:
        assert one(spark, t.ordered_words_of(F.lit(text), F.lit(needle))) is expected


def test_ordered_words_at_random(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choice("abc") for _ in range(rng.randint(1, 9))), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))) for _ in range(300)]

    def slow(text, needle):
        words = iter(text.split())
        return all(w in words for w in needle.split())

    got = spark.createDataFrame(rows, "text string, needle string").select("text", "needle", t.ordered_words_of(F.col("text"), F.col("needle")).alias("x")).collect()
    assert all(r.x == slow(r.text, r.needle) == bool(re.search(t.ordered_words_pattern(r.needle), r.text)) for r in got)


def test_strip_accents(spark):
    texts = ["Đường Phố Hà Nội", "éèê ÑANDÚ", unicodedata.normalize("NFD", "Tiếng Việt"), "ß 日本 123", None]

    def slow(s):
        return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn").replace("đ", "d")

    got = spark.createDataFrame([(x,) for x in texts], "x string").select(t.strip_accents(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [None if x is None else slow(x) for x in texts]


def test_words_and_answers(spark):
    assert one(spark, t.contains_phrase(F.lit("an ao dai"), "ao dai")) and not one(spark, t.contains_phrase(F.lit("bao dai"), "ao dai"))
    assert one(spark, t.significant_tokens(F.lit("bao so 3 la la bao"))) == ["bao", "3"]
    assert one(spark, t.prompt(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == "a. b."
    assert not one(spark, t.answers_match(F.lit(""), F.lit("x"))) and one(spark, t.answers_match(F.lit(" Red car "), F.lit("red")))
    default = F.struct(F.lit("none").alias("answer"))
    assert one(spark, t.parse_answer(F.lit('```json\n{"answer": "x"}\n```'), "answer string", default)).answer == "x"
    assert one(spark, t.parse_answer(F.lit("no"), "answer string", default)).answer == "none"
    assert one(spark, t.normalize(F.lit("  A \n b  "))) == "a b"


def test_boxes(spark):
    at = g.Box.at
    assert one(spark, g.iou(at(0, 0, 1, 1), at(0, 0, 0.5, 1))) == 0.5
    assert one(spark, g.iou(at(0, 0, 0, 0), at(0, 0, 0, 0))) == 0.0
    inside = one(spark, g.classify_pair(at(0.1, 0.1, 0.2, 0.2), at(0, 0, 0.5, 0.5)))
    assert (inside.relation, inside.a_is_subject) == ("inside", True)
    other = one(spark, g.classify_pair(at(0, 0, 0.5, 0.5), at(0.1, 0.1, 0.2, 0.2)))
    assert (other.relation, other.a_is_subject) == ("inside", False)
    left = one(spark, g.classify_pair(at(0, 0, 0.2, 0.2), at(0.05, 0.7, 0.3, 0.9)))
    assert (left.relation, left.a_is_subject) == ("left_of", True)
    assert one(spark, g.classify_pair(at(0, 0, 0.2, 0.2), at(0, 0.01, 0.2, 0.21))) is None
    assert one(spark, g.normalized_gap(at(0, 0, 0.1, 0.1), at(0, 0.2, 0.1, 0.3))) == pytest.approx(1.0)
    assert one(spark, g.normalized_gap(at(0, 0, 0.1, 0.1), at(0.05, 0.05, 0.3, 0.3))) == 0.0
    assert one(spark, g.grid_position(at(0, 0, 0.1, 0.1))) == "top-left" and one(spark, g.grid_position(at(0.4, 0.4, 0.6, 0.6))) == "center"
    crop = one(spark, g.crop_pixels(at(0.5, 0.5, 0.5, 0.5), F.lit(10), F.lit(10)))
    assert (crop.bottom - crop.top, crop.right - crop.left) == (1, 1)
    box = g.from_pixels(F.lit(30.0), F.lit(90.0), F.lit(-10.0), F.lit(10.0), F.lit(100.0), F.lit(80.0))
    assert [one(spark, c) for c in (box.ymin, box.xmin, box.ymax, box.xmax)] == [0.0, 0.125, 0.3, 1.0]


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, v.dot(a, v.literal([1, 2]))) == 11.0 and one(spark, v.unit(a)) == [0.6, 0.8] and one(spark, v.unit(v.literal([0, 0]))) == [0.0, 0.0]
    assert one(spark, v.nudge(a, v.literal([1, 1]), 0.5)) == [2.0, 2.5]


def test_ordered_words_are_whole_words_in_order(spark):
    from framelake.functions import text

    texts = ["a b c", "b a", "ab c", "a\tb\n\nc", "a a b", " a  b ", "", None, "c b a b", "a.b", "xa b", "A b", "é a é b"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def slow(t, words):
        at = iter(t.split())
        return all(any(w == x for x in at) for w in words)

    for needle in ("a b", "a", "a a", "a b c", "b", "é b", "a.b"):
        got = {r.i: r.hit for r in frame.select("i", text.ordered_words(frame["t"], needle).alias("hit")).collect()}
        assert got == {i: None if t is None else slow(t, needle.split()) for i, t in enumerate(texts)}, needle
