import random
import zlib

import numpy as np
import pytest

from framelake.llm.quality import Attention, FEATURES, fit, held_out, passages, quality_scores, scored, train  # noqa: I001

DOCS, LABELS = "doc_id bigint, text string, quality string, score string", "doc_id bigint, quality int, text string, toxic int"


def corpus(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioutrnsdl") for _ in range(rng.randint(2, 9)))
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = " ".join(word() for _ in range(rng.randint(5, 400))).capitalize() + "."
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 2 else " ".join(w for w in text.split() for _ in range(9))
        docs.append((i, text, "q", "s"))
        labels.append((i, int(good), "t", 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(600)
    got = quality_scores(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), per_class=300).collect()
    truth = {i: q for i, q, *_ in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    own = [r.predicted == truth[r.doc_id] for r in got if r.held_out]
    assert len(own) > 150 and np.mean(own) > 0.97


def test_labels_of_the_held_out_third_do_not_matter(spark):
    docs, labels = corpus(150)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t, x) for i, q, t, x in labels]
    scores = [quality_scores(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(x, LABELS), 50).collect() for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    shapes = [(FEATURES, 5), (5,), (5, 3), (5, 3), (3,), (5,), (1,)]
    model = Attention(np.zeros(FEATURES), np.ones(FEATURES), [rng.standard_normal(s) * 0.3 for s in shapes])
    x, counts, y = rng.standard_normal((7, FEATURES)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, counts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in enumerate(model.gradients(x, counts, y)):
        flat, gf = model.weights[k].reshape(-1), g.reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            at = flat[i]
            flat[i] = at + 1e-5
            up = loss()
            flat[i] = at - 1e-5
            down = loss()
            flat[i] = at
            assert gf[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_passages_do_not_depend_on_their_neighbours():
    texts = ["Hello world! " * 100, "", None, "é" * 700, "x", "ab ab ab cd"]
    together, counts = passages(texts)
    alone = [passages([t])[0] for t in texts]
    assert counts.tolist() == [len(a) for a in alone] == [3, 1, 1, 3, 1, 1]
    assert np.allclose(together, np.concatenate(alone))


def test_edges(spark):
    docs, labels = corpus(60)
    rows = docs + [(1000, None, "q", "s"), (1001, "", "q", "s"), (None, "some text here", "q", "s"), (5, docs[5][1], "q", "s"), (1002, "long " * 100_000, "q", "s")]
    known = labels + [(5, labels[5][1], "t", 0), (6, 1 - labels[6][1], "t", 0), (None, 1, "t", 0), (7, None, "t", 0), (9999, 0, "t", 0)]
    got = quality_scores(spark, spark.createDataFrame(rows, DOCS), spark.createDataFrame(known, LABELS), 20).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    frame = spark.createDataFrame(docs, DOCS)
    empty = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality_scores(spark, frame, empty).collect()} == {0.5}
    assert fit(frame.select("doc_id", "text"), spark.createDataFrame([x for x in labels if x[1] == 1], LABELS)) == 1.0
    assert quality_scores(spark, frame.limit(0), empty).count() == 0


def test_same_bags_same_model():
    docs, labels = corpus(40)
    bags, y = [passages([d[1]])[0] for d in docs], np.array([x[1] for x in labels], dtype=float)
    a, b = (train(bags, y, steps=5) for _ in range(2))
    assert all((x == z).all() for x, z in zip(a.weights, b.weights, strict=True))


def test_scored_keeps_columns(spark):
    docs, _ = corpus(10)
    frame = spark.createDataFrame(docs, DOCS).drop("score")
    assert scored(spark, frame, 0.25).columns == ["doc_id", "text", "quality", "score"] and held_out() is not None


def test_a_repeated_document_is_gathered_once_and_whole(spark):
    from framelake.llm.quality import PASSAGE, _bags, sampled

    docs, labels = corpus(12)
    long = "some words " * 5000
    rows = [d[:2] for d in docs if d[0] != 1] + [(1, long)] * 1000 + [(1, "zz later")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    sample, chosen = sampled(frame, spark.createDataFrame(labels, LABELS), 50, 10_000)
    got = sample.mapInArrow(_bags, "doc_id bigint, quality int, bag binary").collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in chosen) and len({r.doc_id for r in got}) == len(got)
    if zlib.crc32(b"1") % 3 != 1:
        (own,) = [r for r in got if r.doc_id == 1]
        assert len(own.bag) == 2 * FEATURES * round(len(long) / PASSAGE)
    few, chosen = sampled(frame, spark.createDataFrame(labels, LABELS), 50, 1)
    assert sorted(q for _, q in chosen) == [0, 1] and few.count() == 2


def slow_score(model, text):
    """One document's score with plain loops over passages and units."""
    x, counts = passages([text])
    we, be, v, u, w, c, c0 = model.weights
    encoded, weights = [], []
    for row in x:
        z = np.clip((row - model.mean) / model.scale, -4, 4) * row[-1]
        h = np.array([np.tanh(sum(z[i] * we[i, j] for i in range(len(z))) + be[j]) for j in range(we.shape[1])])
        gate = [np.tanh(sum(h[i] * v[i, j] for i in range(len(h)))) / (1 + np.exp(-sum(h[i] * u[i, j] for i in range(len(h))))) for j in range(v.shape[1])]
        encoded.append(h)
        weights.append(np.exp(sum(g * k for g, k in zip(gate, w, strict=True))))
    pooled = sum(a * h for a, h in zip(weights, encoded, strict=True)) / sum(weights)
    return 1 / (1 + np.exp(-(float(pooled @ c) + c0[0])))


def test_scores_are_those_of_a_slow_scorer(spark):
    docs, labels = corpus(40)
    model = train([passages([d[1]])[0] for d in docs], np.array([x[1] for x in labels], dtype=float), steps=30, hidden=6, gate=3)
    texts = [docs[0][1], docs[1][1], "", None, "x " * 2000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in scored(spark, frame, model).collect()}
    assert all(got[i] == pytest.approx(slow_score(model, t), abs=1e-6) for i, t in enumerate(texts))
