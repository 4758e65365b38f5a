import re
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from framelake.llm.quality import fit
from tests.llm import test_mixing, test_neardup


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    tables, docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")], None
    docs = tables[0]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(root / str(i)))
        docs = spark.read.parquet(str(root / str(i)))
        tables.append(docs)
    return tables


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_columns_stay(stages):
    assert all(sorted(t.columns) == sorted(stages[0].columns) for t in stages[:5])


def test_quality_keeps_what_the_model_accepts(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(stages[0].select("doc_id", "text"), labels.select("doc_id", F.col("quality").cast("int").alias("quality")))
    every = rows(stages[0])
    scores = model.score([r[1] for r in every])
    assert Counter(rows(stages[1])) == Counter(r for r, s in zip(every, scores, strict=True) if s >= 0.5)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    left = {r[0] for r in rows(stages[1])}
    good = [i for i, q in truth.items() if q == 1]
    assert sum(i in left for i in good) >= 0.97 * len(good)


def test_one_document_of_each_group_stays(stages):
    before = rows(stages[1])
    kept = {i for i, _, _, keep in test_neardup.brute(before, percent=80) if keep}
    assert Counter(rows(stages[2])) == Counter(r for r in before if r[0] in kept)


def test_private_data_goes_and_clean_documents_stay(stages):
    before, after = {r[0]: r for r in rows(stages[2])}, {r[0]: r for r in rows(stages[3])}
    assert before.keys() == after.keys()
    private = r"\S+@\S+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|\b4\d{15}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|AKIA[0-9A-Z]{16}|password=\w+|token = \"\w+\""
    changed = 0
    for i, (_, text, *_) in before.items():
        found = re.findall(private, text)
        if found:
            changed += 1
            assert not any(x in after[i][1] for x in found) and after[i][4] == len(after[i][1])
        else:
            assert after[i] == before[i]
    assert changed


def test_mixing_counts(stages):
    before = [(r[0], r[1], r[3]) for r in rows(stages[3])]
    expected = Counter()
    for (doc, text, source, _), n in test_mixing.brute(before).items():
        expected[doc, text, source] += n
    assert Counter((r[0], r[1], r[3]) for r in rows(stages[4])) == expected


def test_token_ids(stages):
    reference = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    expected = Counter((r[0], tuple(reference.encode(r[1]))) for r in rows(stages[4]))
    got = stages[5].collect()
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in got) == expected
    assert all(r.parity and r.round_trip for r in got)


def test_run_is_the_stages(spark, sf_dir, stages):
    key = lambda df: Counter((r.doc_id, tuple(r.token_ids)) for r in df.collect())
    assert key(cp.run(spark, sf_dir)) == key(stages[5])


def test_repeated_rows_and_null_ids(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11)] * 2 + [(None, "a b c d e f", "en", "s", 11), (None, None, None, None, None), (2, "", "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = cp.near_duplicate(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, ""), (0, "a b c d e f"), (1, "a b c d e f"), (2, "")]


def test_columns_with_the_operators_names_stay(spark, sf_dir, stages):
    own = {"score": 7, "n_entities": 8, "mix_rate": 9, "mix_copy": 10, "source_key": 11, "cdf": 12, "_values": 13, "_n": 14, "label": 15, "__quality_": 16}
    docs = stages[0].limit(60).withColumns({k: F.lit(v) for k, v in own.items()})
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[k] == v for r in found for k, v in own.items())


@pytest.mark.parametrize("i", range(5))
def test_empty_tables(spark, sf_dir, stages, i):
    assert cp.STAGES[i][1](spark, stages[0].limit(0), sf_dir).count() == 0


def test_hard_rows_go_through_all_stages(spark, sf_dir, stages, tmp_path):
    """Null and very long texts, repeated rows and missing ids, from end to end."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    long = " ".join(f"word{i}" for i in range(120_000))
    hard = [(None, None, None, None, None), (900_001, None, "en", None, None), (900_002, "", "en", "s", 0), (900_003, long, "en", "s", len(long)), (900_003, long, "en", "s", len(long)), (None, "no id here, mail a.b@c.org", "en", "s", 26)]
    hard += [(900_004, "b." * 50_000 + " x@" + "b." * 50_000, "en", "s", 200_003)]
    docs = stages[0].limit(50).unionByName(spark.createDataFrame(hard, schema))
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    got = docs.collect()
    assert got and all(r.parity and r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
