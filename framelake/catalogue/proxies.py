"""The stand-in tables, in DataFrames and in SQL (as common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, strip_accents

SQL = {
    "frames": "frames AS (SELECT 'V' || CAST(vec_id % 20 AS VARCHAR) AS video_id, CAST(vec_id AS INTEGER) AS frame_idx, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)",
    "objects": """objects AS (
        SELECT ((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber AS detection_id, 'V' || CAST(l_orderkey % 20 AS VARCHAR) AS video_id,
               CAST(l_orderkey AS INTEGER) AS frame_idx, l_returnflag || l_linestatus AS label, 1 - l_discount AS score,
               (l_suppkey % 70) / 100e0 AS ymin, (l_partkey % 70) / 100e0 AS xmin, (l_suppkey % 70) / 100e0 + 5e-2 + l_quantity / 200e0 AS ymax,
               (l_partkey % 70) / 100e0 + 5e-2 + l_linenumber / 40e0 AS xmax, CASE WHEN l_linenumber <= 4 THEN 'closed' ELSE 'open' END AS source
        FROM lineitem)""",
    "videos": """videos AS (
        SELECT 'V' || CAST(o_orderkey AS VARCHAR) AS video_id, c_mktsegment AS author, p_name AS title, o_orderdate AS publish_date, lower(o_orderpriority) AS keywords_text
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON p_partkey = o_custkey)""",
    "lines": """lines AS (
        SELECT 'V' || CAST(doc_id % 20 AS VARCHAR) AS video_id, CAST(doc_id * 7 % 500 AS INTEGER) AS frame_start, CAST(doc_id * 7 % 500 + doc_id % 9 AS INTEGER) AS frame_end,
               lower(trim(regexp_replace(replace(lower(strip_accents(text)), 'đ', 'd'), '\\s+', ' ', 'g'))) AS text_norm,
               (n_chars % 70) / 100e0 AS ymin, (doc_id % 70) / 100e0 AS xmin, (n_chars % 70) / 100e0 + 2e-1 AS ymax, (doc_id % 70) / 100e0 + 3e-1 AS xmax, doc_id
        FROM documents)""",
    "speech": """speech AS (
        SELECT 'V' || CAST(doc_id % 20 AS VARCHAR) AS video_id, CAST(doc_id * 11 % 500 AS INTEGER) AS frame_idx_start, CAST(doc_id * 11 % 500 + doc_id % 13 AS INTEGER) AS frame_idx_end,
               text AS text_raw, lower(trim(regexp_replace(replace(lower(strip_accents(text)), 'đ', 'd'), '\\s+', ' ', 'g'))) AS text_norm, doc_id
        FROM documents)""",
    "moments": "moments AS (SELECT user_id AS video_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id, value AS score FROM events)",
    "label_types": """label_types AS (SELECT * FROM (VALUES ('AF', ['person']), ('AO', ['animal', 'object']), ('NF', ['vehicle']), ('NO', ['object']), ('RF', ['surface', 'object']), ('RO', ['container'])) v(label, categories))""",
    "q": "q AS (SELECT vec AS qv FROM frames WHERE frame_idx = 0)",
}
LABEL_TYPES = [("AF", ["person"]), ("AO", ["animal", "object"]), ("NF", ["vehicle"]), ("NO", ["object"]), ("RF", ["surface", "object"]), ("RO", ["container"])]


def sql(names: str, body: str, recursive: bool = False) -> str:
    """A statement over some of the stand-in tables."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names.split()) + body


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _video(number, n: int = 20):
    return F.concat(F.lit("V"), (number % n).cast("string"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(_video(F.col("vec_id")).alias("video_id"), F.col("vec_id").cast("int").alias("frame_idx"), "label", F.col("embedding").alias("vec"))


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of frame 0."""
    row = frames(spark, d).where("frame_idx = 0").select("vec").first()
    return list(row.vec) if row else [0.0] * 64


def objects(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        (((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("detection_id"), _video(F.col("l_orderkey")).alias("video_id"),
        F.col("l_orderkey").cast("int").alias("frame_idx"), F.concat("l_returnflag", "l_linestatus").alias("label"), (1 - F.col("l_discount")).alias("score"),
        ((F.col("l_suppkey") % 70) / 100.0).alias("ymin"), ((F.col("l_partkey") % 70) / 100.0).alias("xmin"),
        ((F.col("l_suppkey") % 70) / 100.0 + 0.05 + F.col("l_quantity") / 200.0).alias("ymax"), ((F.col("l_partkey") % 70) / 100.0 + 0.05 + F.col("l_linenumber") / 40.0).alias("xmax"),
        F.when(F.col("l_linenumber") <= 4, "closed").otherwise("open").alias("source"),
    )


def videos(spark: SparkSession, d: str) -> DataFrame:
    o, c, p = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "part").select("p_partkey", "p_name")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(p, o.o_custkey == p.p_partkey, "left")
    return joined.select(
        F.concat(F.lit("V"), F.col("o_orderkey").cast("string")).alias("video_id"), F.col("c_mktsegment").alias("author"), F.col("p_name").alias("title"),
        F.col("o_orderdate").alias("publish_date"), F.lower("o_orderpriority").alias("keywords_text"),
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    at = F.col("doc_id") * 7 % 500
    top, left = (F.col("n_chars") % 70) / 100.0, (F.col("doc_id") % 70) / 100.0
    return docs.select(
        _video(F.col("doc_id")).alias("video_id"), at.cast("int").alias("frame_start"), (at + F.col("doc_id") % 9).cast("int").alias("frame_end"),
        normalize(strip_accents(F.col("text"))).alias("text_norm"), top.alias("ymin"), left.alias("xmin"), (top + 0.2).alias("ymax"), (left + 0.3).alias("xmax"), "doc_id",
    )


def speech(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    at = F.col("doc_id") * 11 % 500
    return docs.select(
        _video(F.col("doc_id")).alias("video_id"), at.cast("int").alias("frame_idx_start"), (at + F.col("doc_id") % 13).cast("int").alias("frame_idx_end"), F.col("text").alias("text_raw"),
        normalize(strip_accents(F.col("text"))).alias("text_norm"), "doc_id",
    )


def moments(spark: SparkSession, d: str) -> DataFrame:
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("bigint")
    return table(spark, d, "events").select(F.col("user_id").alias("video_id"), "event_type", t.alias("t"), "event_id", F.col("value").alias("score"))


def label_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABEL_TYPES, "label string, categories array<string>")
