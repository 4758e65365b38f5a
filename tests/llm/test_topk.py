import math
import random

import pytest

from framelake.llm.topk import top_k_inner

SCHEMA = "vec_id bigint, embedding array<float>, rank int, score string"


def brute(rows, every, k):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = set()
    for q, qv in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def run(spark, rows, parts=3, **kw):
    return {tuple(r) for r in top_k_inner(spark, spark.createDataFrame(rows, SCHEMA).repartition(parts), **kw).collect()}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("lists", [1, 2, 5])
def test_random_vectors(spark, seed, lists):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(7)], 0, "") for i in range(120)]
    assert run(spark, rows, every=10, k=4, lists=lists, block=5) == brute(rows_as_float(rows), 10, 4)


def rows_as_float(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], *rest) for i, v, *rest in rows]


def test_copies_ties_and_bad_rows(spark):
    same = [0.25, 0.5]
    rows = [(i, same, 0, "") for i in range(40)] + [(100, None, 0, ""), (101, [None, 1.0], 0, ""), (102, [float("nan"), 1.0], 0, ""), (103, [float("inf"), 1.0], 0, ""), (None, same, 0, "")]
    got = run(spark, rows, every=10, k=5)
    assert got == brute(rows_as_float(rows), 10, 5)
    assert {(r, v) for q, r, v, _ in got if q == 0} == {(n, n) for n in range(1, 6)}


def test_few_candidates_ragged_and_repeated(spark):
    rows = [(0, [1.0, 2.0], 0, ""), (0, [1.0, 2.0], 0, ""), (1, [1.0], 0, ""), (2, [], 0, "")]
    assert run(spark, rows, every=100, k=10) == {(0, 1, 1, 1024 * 1024), (0, 2, 2, 0)}
    assert run(spark, [], every=100) == set()
    assert run(spark, [(100, [1.0], 0, "")], every=100) == set()


def test_sums_beyond_doubles_stay_exact(spark):
    big = 2.0e6
    rows = [(0, [big, 1.0], 0, ""), (1, [big, 1.0], 0, ""), (2, [big, 2.0], 0, ""), (3, [-big, 2.0], 0, "")]
    assert run(spark, rows, every=100, k=2) == brute(rows, 100, 2)


def test_scores_beyond_64_bits_are_clipped(spark):
    rows = [(0, [1e30, 0.0], 0, ""), (1, [1e30, 0.0], 0, ""), (2, [-1e30, 5.0], 0, ""), (3, [0.0, 5.0], 0, "")]
    assert run(spark, rows, every=100, k=3) == {(0, 1, 1, 2**63 - 1), (0, 2, 3, 0), (0, 3, 2, -(2**63))}


def test_only_what_the_cutoff_leaves_is_resolved(spark, monkeypatch):
    """The second slice is computed for the pairs that the first one's threshold lets through, and the result is whole."""
    import numpy as np
    import pyarrow as pa

    from framelake.llm.topk import _Block

    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(0, 200, (3000, 32))).astype(int)
    block = _Block(list(range(0, 3000, 100)), [vectors[i].tolist() for i in range(0, 3000, 100)], 32, True, 10, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(vectors.tolist(), pa.list_(pa.int64()))], names=["vec_id", "v"])
    monkeypatch.setattr("framelake.llm.topk.TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    (report,) = list(block.local_lists([batch]))
    cutoff = {q: (best[9], most) for q, best, most in zip(*(report.column(c).to_pylist() for c in ("query_id", "best", "most")), strict=True)}
    asked = []
    pair_scores = _Block.pair_scores
    monkeypatch.setattr(_Block, "pair_scores", lambda self, v, j, r, q: asked.append(len(r)) or pair_scores(self, v, j, r, q))
    (out,) = list(block.collected(cutoff)([batch]))
    assert sum(asked) < 0.55 * 3000 * 30
    exact = vectors @ vectors.T
    for q in range(0, 3000, 100):
        own = sorted(((-int(exact[q, i]), i) for i in range(3000) if i != q))[:10]
        got = sorted((-s, v) for a, v, s in zip(*(out.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True) if a == q)
        assert got == own
