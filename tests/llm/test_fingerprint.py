import hashlib
import random

import numpy as np
import pytest

from framelake.llm.fingerprint import LEAST, MOST, as_text, chunk_ends, chunk_set, edited, fingerprints, from_text, gear_hashes, likeness
from framelake.llm import fingerprint  # noqa: I001

SCHEMA = "doc_id bigint, text string, part string, n_chars string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9))) for _ in range(n))


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        new = edited(text, after)
        a, b, c = chunk_set(text), chunk_set(new), chunk_set(after)
        out.append((r[0], len(text), hashlib.sha256(new.encode()).hexdigest(), as_text(a), as_text(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def run(spark, rows, n="4"):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        return sorted((tuple(r) for r in fingerprints(spark, spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n", ["1", "3", "9"])
def test_rows(spark, n):
    rng = random.Random(2)
    rows = [(rng.choice([i, i * 1000, -i]), prose(rng, rng.randint(0, 60)), "p", "c") for i in range(1, 80)]
    rows = list({r[0]: r for r in rows}.values())
    assert run(spark, rows, n) == brute(rows)


def test_edges(spark):
    rows = [(1, None, "p", "c"), (2, "", "p", "c"), (None, "last of all", "p", "c"), (3, "ab", "p", "c"), (3, "ab", "p", "c"), (3, "another with the same key", "p", "c"), (4, "word " * 60_000, "p", "c")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(7, "alone in here", "p", "c")]) == brute([(7, "alone in here", "p", "c")])
    assert run(spark, []) == []


def test_gear_hash_is_a_window_of_16_bytes():
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(80)), dtype=np.uint8)
    h = gear_hashes(data)
    for i in range(80):
        slow = sum(int(fingerprint._GEAR[data[i - k]]) << k for k in range(16) if i >= k) % 65536
        assert h[i] == slow


def test_chunks_cover_the_text_within_limits():
    data = np.frombuffer(prose(random.Random(3), 3000).encode(), dtype=np.uint8)
    ends = chunk_ends(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= MOST and sizes[:-1].min() >= LEAST and 25 < sizes.mean() < 70


def test_likeness_survives_a_shift():
    rng = random.Random(4)
    text = prose(rng, 800)
    other = prose(rng, 800)
    assert likeness(chunk_set(text), chunk_set("a new start, " + text[:2000] + "inserted" + text[2000:])) > 0.95
    assert likeness(chunk_set(text), chunk_set(other)) < 0.05 and likeness(chunk_set(text), chunk_set(text)) == 1.0
    assert 0.4 < likeness(chunk_set(text), chunk_set(edited(text, other))) < 0.6
    assert likeness(chunk_set(text[1000:2000]), chunk_set(text)) > 0.9  # containment, not resemblance
    assert (from_text(as_text(chunk_set(text))) == chunk_set(text)).all()


@pytest.mark.parametrize("n", ["2", "5"])
def test_keys_of_many_rows_are_split(spark, monkeypatch, n):
    monkeypatch.setattr(fingerprint, "REPEATED", 20)
    rng = random.Random(8)
    rows = [(i, prose(rng, 20), "p", "c") for i in range(60)] + [(30, prose(rng, 15), "p", "c") for _ in range(150)] + [(30, "the same text again " * 3, "p", "c")] * 90
    rows += [(None, prose(rng, 10), "p", "c") for _ in range(80)] + [(None, None, "p", "c")] * 40 + [(None, "", "p", "c")] * 2
    assert run(spark, rows, n) == brute(rows)


def test_a_table_of_one_row_many_times(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "REPEATED", 20)
    rows = [(5, "one row only, many times over", "p", "c")] * 300
    assert run(spark, rows) == brute(rows)
