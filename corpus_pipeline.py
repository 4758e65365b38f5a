"""A training corpus from ``documents``: five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import Workspace, table
from framelake.llm.mixing import replicated
from framelake.llm.neardup import near_duplicates
from framelake.llm.pieces import encode_documents
from framelake.llm.pii import surrogate_key, with_surrogates
from framelake.llm.quality import fit, scored
from framelake.llm.queries import TOKENIZERS


#: From this likeness in percent on, two documents are near-duplicates.
LIKENESS = 80


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """Columns of the documents that have the name of an operator's own are renamed while it runs."""
    return docs.withColumnsRenamed({n: f"__own_{n}" for n in names if n in docs.columns})


def _back(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return done.select(*[F.col(f"__own_{c}").alias(c) if f"__own_{c}" in done.columns else F.col(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on those among them that have labels, scores 0.5 or more.

    Null and empty texts are scored as one empty passage; all passages of a long
    text are read. Rows without a doc_id are scored, and repeated rows get one
    score: all or none stay. Without labels every row stays.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    model = fit(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), labels)
    return scored(spark, docs, model, out="__quality").where("__quality >= 0.5").drop("__quality")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of each component with the least doc_id, as one row (of rows with one doc_id the one whose text sorts first); rows without a doc_id stay.

    Documents whose sets of five-word shingles are alike by ``LIKENESS`` percent
    or more are linked, whole texts read. Null and empty texts link nothing and stay.
    """
    kept = near_duplicates(spark, docs, percent=LIKENESS).where("kept and doc_id is not null").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy("text", "source", "lang")
    one = docs.join(kept, "doc_id", "left_semi").withColumn("__place", F.row_number().over(first)).where("__place = 1").select(docs.columns)
    return one.unionByName(docs.where("doc_id is null"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, entities replaced by surrogates; n_chars follows the text.

    Null and empty texts, and those without an entity, stay as they are. A
    repeated row gets equal surrogates, and so does an entity in any text. Time
    is linear in a text's length. The key is the session's (``surrogate_key``).
    """
    done = with_surrogates(spark, _aside(docs, "n_entities"), surrogate_key(spark))
    length = F.when(F.col("n_entities") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return _back(done.withColumn("n_chars", length), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate has it, shuffled.

    A null source is a source. Null and empty texts count as others do; repeated
    rows get equal counts; no rate is too high.
    """
    return _back(replicated(spark, _aside(docs, "mix_rate", "mix_copy", "mix_order")), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, parity, round_trip of each copy.

    Null and empty texts have no tokens; long texts are encoded whole; rows without a doc_id and repeated rows stay.
    """
    return encode_documents(spark, docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [("quality", quality), ("near_duplicate", near_duplicate), ("pii", pii), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Training, surrogates and encoding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.stage(docs, name)
    return docs
