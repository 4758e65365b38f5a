import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framelake.llm import mixing
from framelake.llm.mixing import expected_copies, replicated

SCHEMA = "doc_id bigint, text string, source string, mix_copy string"


def u(seed, doc, text):
    joined = "|".join([str(seed), "-" if doc is None else str(doc), "-" if text is None else text])
    return int(hashlib.md5(joined.encode()).hexdigest()[:13], 16) / 2**52


def brute(rows, exponent=0.7, weights=None, size=1.0, seed=17):
    n = Counter(r[2] for r in rows)
    target = {s: c**exponent if weights is None else weights.get(s, 0.0) for s, c in n.items()}
    total = sum(target.values())
    rate = {s: target[s] / total * size * len(rows) / n[s] if total else 0.0 for s in n}
    out = Counter()
    for doc, text, source, *_ in rows:
        draws = max(1, math.ceil(rate[source] / 200))
        first = hashlib.md5("|".join([str(seed), "-" if doc is None else str(doc), "-" if text is None else text]).encode()).hexdigest()
        numbers = [u(seed, doc, text)] + [int(hashlib.md5(f"draw|{first}|{j}".encode()).hexdigest()[:13], 16) / 2**52 for j in range(1, draws)]
        for i in range(sum(expected_copies(rate[source] / draws, x) for x in numbers)):
            out[doc, text, source, i] += 1
    return out


def run(spark, rows, **kw):
    got = replicated(spark, spark.createDataFrame(rows, SCHEMA), **kw)
    return Counter((r.doc_id, r.text, r.source, r.mix_copy) for r in got.collect())


def rows():
    out = [(i, f"text {i}", "big" if i % 3 else f"s{i % 7}", "x") for i in range(300)]
    return out + [(None, None, None, "x"), (1000, "", None, "x"), (5, "text 5", "big", "x"), (5, "text 5", "big", "x")]


@pytest.mark.parametrize("kw", [{}, {"exponent": 0.0}, {"weights": {"big": 1.0, "s1": 3.0}, "size": 2.5}, {"weights": {}}, {"size": 40.0, "seed": 3}, {"weights": {"s1": 1.0}, "size": 30.0}])
def test_counts(spark, kw):
    assert run(spark, rows(), **kw) == brute(rows(), **kw)


def test_many_sources_use_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert run(spark, rows()) == brute(rows())


def test_shares_and_order(spark):
    many = [(i, f"t{i}", "a" if i % 10 else "b", "") for i in range(5000)]
    got = replicated(spark, spark.createDataFrame(many, SCHEMA), weights={"a": 1.0, "b": 1.0}).collect()
    share = sum(r.source == "b" for r in got) / len(got)
    assert abs(share - 0.5) < 0.05 and abs(len(got) - 5000) < 400
    assert sum(a.source == b.source for a, b in zip(got, got[1:], strict=False)) / len(got) < 0.6  # well mixed


def test_empty(spark):
    assert run(spark, []) == Counter()


def test_high_rates_are_met(spark):
    many = [(i, f"t{i}", "rare" if i < 40 else "big", "") for i in range(400)]
    got = replicated(spark, spark.createDataFrame(many, SCHEMA), weights={"rare": 1.0}, size=65.0)  # a rate of 650 in four draws
    found = {r.doc_id: r for r in got.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("mix_copy").alias("copies"), F.max("mix_copy").alias("last"), F.max("mix_rate").alias("rate")).collect()}
    expected = {}
    for i in range(40):
        first = hashlib.md5(f"17|{i}|t{i}".encode()).hexdigest()
        own = [u(17, i, f"t{i}")] + [int(hashlib.md5(f"draw|{first}|{j}".encode()).hexdigest()[:13], 16) / 2**52 for j in (1, 2, 3)]
        expected[i] = sum(expected_copies(162.5, x) for x in own)
    assert {i: r.n for i, r in found.items()} == expected
    assert all(r.rate == 650.0 and r.copies == r.n == r.last + 1 for r in found.values())
    mean = sum(expected.values()) / 40
    assert abs(mean - 650) < 20 and 300 < sum((n - mean) ** 2 for n in expected.values()) / 39 < 1200  # a Poisson count's variance is its mean


def test_one_rare_document_makes_half(spark):
    many = spark.range(100_000).selectExpr("id as doc_id", "concat('t', id) as text", "if(id = 77, 'rare', 'big') as source", "'' as mix_copy")
    got = replicated(spark, many, weights={"big": 0.5, "rare": 0.5}).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in got}
    assert abs(n["rare"] - 50_000) < 1500 and abs(n["big"] - 50_000) < 1500


def test_a_very_long_text(spark):
    rows = [(1, "word " * 400_000, "a", ""), (2, "short", "a", "")]
    assert run(spark, rows, size=3.0, exponent=1.0) == brute(rows, size=3.0, exponent=1.0)


def test_the_statement_splits_high_rates_too(spark, tmp_path):
    """SQL and query agree where a rate is over 200."""
    import duckdb

    from framelake.llm.oracle import OP9

    rows = [(i, f"t{i}", "en", "big", 3) for i in range(2000)] + [(-1, "rare", "en", "one", 4), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    names = "source, text, mix_copy, mix_order"
    want = db.execute(f"select {names}, round(mix_rate, 6) from ({OP9.replace('0.7)', '0.0)')})").fetchall()
    got = replicated(spark, spark.read.parquet(str(tmp_path / "d")), exponent=0.0).select(*names.split(", "), F.round("mix_rate", 6)).collect()
    assert Counter(map(str, want)) == Counter(str(tuple(r)) for r in got)
    assert max(r[4] for r in got) > 600
