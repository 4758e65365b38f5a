"""The dictionary of q_known_terms is whole."""

import pytest

from framelake.catalogue import QUERIES, texts


def test_all_names_are_looked_up(spark, tmp_path, monkeypatch):
    names = [f"name{i}" for i in range(6000)]
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(list(enumerate(names)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["q_known_terms"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(i, n, n.upper()) for i, n in enumerate(names)]
    monkeypatch.setattr(texts, "MOST_TERMS", 5999)
    with pytest.raises(ValueError):
        QUERIES["q_known_terms"](spark, str(tmp_path))
