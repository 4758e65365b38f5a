"""Round trips: a table goes through a sink to files and comes back through a reader."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import relations
from ..sources import readers, sinks
from ..streaming import sessions
from .proxies import frames, label_types, moments, objects, sql, table


def q_read_table(spark, d):
    """Objects by the swapped table and the checked reader."""
    path = sinks.scratch(spark, "objects")
    sinks.replace_table(objects(spark, d).withColumn("suppressed", F.lit(False)), f"{path}/t", ["label"])
    return readers.table(spark, f"{path}/t", "objects").select("detection_id", "video_id", "frame_idx", "label", F.round("score", 6).alias("score"), "suppressed")


def q_catalog(spark, d):
    """A folder of tables; one that isn't there is None."""
    path = sinks.scratch(spark, "catalog")
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("V"), F.col("l_orderkey").cast("string")).alias("video_id"), F.col("l_linenumber").alias("frame_idx"), F.lit(1).alias("shot_idx"), F.lit("p").alias("path"), F.lit(25.0).alias("fps"))
    sinks.replace_table(rows, f"{path}/frames.parquet")
    held = readers.Catalog(spark, path)
    return held.get("frames").groupBy("video_id").agg(F.count("*").alias("n"), F.lit(held.get("ocr_text") is None).alias("no_text"))


def _matrices(batches):
    """A NumPy file's bytes for each video."""
    import io

    import numpy as np

    for batch in batches:
        out = []
        for rows in batch.column("rows").to_pylist():
            held = io.BytesIO()
            np.save(held, np.array([r["vec"] for r in rows], dtype=np.float32))
            out.append(held.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], names=["path", "content"])


def q_vectors_npy(spark, d):
    """S3: vectors as <video>.npy and frame numbers as <video>.csv; a video whose numbers differ is left out."""
    path, rows = sinks.scratch(spark, "vectors"), frames(spark, d)
    files = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "vec"))).alias("rows"))
    sinks.write_files(files.select(F.concat("video_id", F.lit(".npy")).alias("path"), "rows").mapInArrow(_matrices, "path string, content binary"), f"{path}/npy")
    said = F.transform("rows", lambda r, i: F.concat_ws(",", (i + 1).cast("string"), (r["frame_idx"] / 25.0).cast("string"), F.lit("25.0"), r["frame_idx"].cast("string")))
    short = F.when(F.col("video_id") == "V7", F.slice(said, 2, 1_000_000)).otherwise(said)
    sinks.write_files(files.select(F.concat("video_id", F.lit(".csv")).alias("path"), F.concat(F.lit("n,pts_time,fps,frame_idx\n"), F.array_join(short, "\n")).alias("content")), f"{path}/csv")
    found = readers.with_vectors(readers.frame_numbers(spark, f"{path}/csv"), readers.vectors_npy(spark, f"{path}/npy"))
    return found.select("video_id", "frame_idx", F.round("pts_time", 4).alias("pts_time"), F.round(F.col("vec")[0].cast("double"), 4).alias("first"))


def q_detections(spark, d):
    """<video>/<number>.json of parallel arrays."""
    path, o = sinks.scratch(spark, "detections"), objects(spark, d)
    box = F.array("ymin", "xmin", "ymax", "xmax")
    packed = o.groupBy("video_id", (F.col("detection_id") / 10).cast("bigint").alias("k") % 5).agg(F.collect_list(F.struct("score", "label", box.alias("box"))).alias("x")).toDF("video_id", "k", "x")
    pick = lambda n: F.transform("x", lambda r: r[n])
    said = F.to_json(F.struct(pick("score").alias("detection_scores"), pick("label").alias("detection_class_entities"), pick("box").alias("detection_boxes")))
    sinks.write_files(packed.select(F.concat("video_id", F.lit("/"), F.lpad((F.col("k") + 1).cast("string"), 3, "0"), F.lit(".json")).alias("path"), said.alias("content")), path)
    return readers.detections(spark, path, 0.95).groupBy("video_id", "local_idx", "label").agg(F.count("*").alias("n"), F.round(F.sum("ymin"), 4).alias("ymin"))


def q_video_metadata(spark, d):
    """A JSON file for each supplier as a video."""
    path, rows = sinks.scratch(spark, "metadata"), table(spark, d, "supplier")
    date = F.when(F.col("s_nationkey") > 20, F.lit("soon")).otherwise(F.concat(F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0"), F.lit("/03/2024")))
    said = F.to_json(F.struct(F.lit("A").alias("author"), F.col("s_name").alias("title"), date.alias("publish_date"), F.array(F.lit("Tin"), F.col("s_nationkey").cast("string")).alias("keywords")))
    sinks.write_files(rows.select(F.concat(F.lit("V"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("path"), said.alias("content")), path)
    return readers.video_metadata(spark, path).select("video_id", "title", "publish_date", "keywords_text")


def q_done_log(spark, d):
    """A log of events as JSON lines, with errors and broken lines."""
    path, rows = sinks.scratch(spark, "log"), table(spark, d, "events")
    good = F.to_json(F.struct("event_id", "event_type", F.when(F.col("event_type") == "error", "lost").alias("error")))
    rows.select(F.when(F.col("value") > 60, F.lit('{"event_id": ')).otherwise(good).alias("value")).write.mode("overwrite").text(path)
    return readers.done_log(spark, path, "event_id bigint, event_type string")


def q_keyframe_images(spark, d):
    """Images by name; other files are left out."""
    path, rows = sinks.scratch(spark, "images"), table(spark, d, "nation")
    name = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("/shot"), F.col("n_nationkey").cast("string"), F.lit("_f"), (F.col("n_nationkey") * 30).cast("string"), F.when(F.col("n_regionkey") == 4, ".png").otherwise(".JPG"))
    sinks.write_files(rows.select(name.alias("path"), F.col("n_name").alias("content")), path)
    return readers.keyframe_images(spark, path, content=True).select("video_id", "shot_idx", "frame_idx", F.col("content").cast("string").alias("content"))


def _shards(batches):
    """A ZIP file's bytes for each shard."""
    import io
    import zipfile

    for batch in batches:
        out = []
        for members in batch.column("members").to_pylist():
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                for m in members:
                    z.writestr(m["member"], m["content"])
            out.append(held.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], names=["path", "content"])


def _archives(spark, d):
    path = sinks.scratch(spark, "shards")
    rows = table(spark, d, "supplier").select(F.concat(F.when(F.col("s_nationkey") < 9, "L26_V").otherwise("L21_V"), F.lpad((F.col("s_suppkey") % 500).cast("string"), 3, "0")).alias("video_id"), (F.col("s_nationkey") % 5).cast("int").alias("local_idx"), "s_name")
    rows = rows.groupBy("video_id", "local_idx").agg(F.min("s_name").alias("content"))
    named = rows.select(readers.archive_name(F.col("video_id")).alias("path"), F.struct(readers.member_name(F.col("video_id"), F.col("local_idx")).alias("member"), "content").alias("m"))
    sinks.write_files(named.groupBy("path").agg(F.array_sort(F.collect_list("m")).alias("members")).mapInArrow(_shards, "path string, content binary"), path)
    return path, rows


def q_zip_members(spark, d):
    """All members of all shards."""
    path, _ = _archives(spark, d)
    return readers.zip_members(spark, path).select("member", F.col("content").cast("string").alias("content"))


def q_keyframe_bytes(spark, d):
    """The members of some frames, some of which no shard has."""
    path, rows = _archives(spark, d)
    wanted = rows.where("local_idx < 2").select("video_id", "local_idx").unionByName(rows.select("video_id", F.lit(77).alias("local_idx")))
    return readers.keyframe_bytes(spark, path, wanted, 3).select("member", F.col("content").cast("string").alias("content"))


def q_fps(spark, d):
    """One frame rate for each video that has any."""
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("V"), F.col("l_suppkey").cast("string")).alias("video_id"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("fps"))
    return readers.fps_by_video(rows)


def q_find_video(spark, d):
    """A video by its own file, its group's folder, or its shard."""
    path = sinks.scratch(spark, "videos")
    names = [("V1.mp4",), ("L21/L21_V002.mp4",), ("Videos_L26_c.zip",)]
    sinks.write_files(spark.createDataFrame([(n, "x") for (n,) in names], "path string, content string"), path)
    asked = ["V1", "L21_V002", "L26_V250", "L26_V001"]
    found = [(v, readers.find_video(spark, [f"{path}/none", path], v)) for v in asked]
    return spark.createDataFrame([(v, p and p.rsplit(path + "/", 1)[-1]) for v, p in found], "video_id string, found string")


def q_append_new(spark, d):
    """K2: appending again, and overlapping rows, adds each key once."""
    path, rows = f"{sinks.scratch(spark, 'append')}/t", moments(spark, d).select("event_id", "score")
    for part in (rows.where("score < 20"), rows, rows.where("score > 10")):
        sinks.append_new(part, path, ["event_id"])
    return spark.read.parquet(path)


def q_stream_ingest(spark, d):
    """K3, K4: a stream that is run, and run again, without repeats."""
    path = sinks.scratch(spark, "stream")
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    rows.unionByName(rows.where("value > 30")).repartition(4).write.parquet(f"{path}/in")
    for _ in range(2):
        stream = sessions.file_stream(spark, f"{path}/in", "event_id bigint, user_id bigint, ts timestamp_ntz, value double")
        kept = sessions.without_repeats(stream.withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], late="400 days")
        sessions.run_to_end(kept.select("event_id", "user_id", "value"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


def q_vector_table(spark, d):
    """K5: vectors as Parquet, by model."""
    path = f"{sinks.scratch(spark, 'vectors')}/t"
    sinks.replace_table(frames(spark, d).select("video_id", "frame_idx", F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"), "vec"), path, ["model"])
    found = readers.table(spark, path, "vectors").where("model = 'm3'")
    return found.select("video_id", "frame_idx", "model", F.size("vec").cast("bigint").alias("width"))


def q_audit(spark, d):
    """K6: suppressed objects go to a table of their own."""
    path, o = f"{sinks.scratch(spark, 'audit')}/t", objects(spark, d)
    kept = sinks.audit(relations.suppress(o.where("source = 'closed'"), o.where("source = 'open'"), label_types(spark)), path)
    out = spark.read.parquet(path)
    return kept.groupBy("label").agg(F.count("*").alias("n")).withColumn("kept", F.lit(True)).unionByName(out.groupBy("label").agg(F.count("*").alias("n")).withColumn("kept", F.lit(False)))


def q_report(spark, d):
    """K7: a report as one file."""
    path = f"{sinks.scratch(spark, 'report')}/r"
    sinks.report(objects(spark, d).groupBy("label").agg(F.count("*").alias("n")).orderBy("label"), path, "csv")
    return spark.read.schema("label string, n bigint").csv(path, header=True)


def q_bucketed(spark, d):
    """K1: a bucketed table, whose grouping needs no shuffle."""
    name = "framelake_bucketed"
    sinks.bucketed_table(moments(spark, d).select("video_id", "score"), name, 4, ["video_id"])
    return spark.table(name).groupBy("video_id").agg(F.round(F.sum("score"), 4).alias("score"))


_SHARDS = """WITH r AS (SELECT CASE WHEN s_nationkey < 9 THEN 'L26_V' ELSE 'L21_V' END || lpad(CAST(s_suppkey % 500 AS VARCHAR), 3, '0') AS v, s_nationkey % 5 AS i, min(s_name) AS content FROM supplier GROUP BY ALL)
        SELECT 'keyframes/' || v || '/' || lpad(CAST(i + 1 AS VARCHAR), 3, '0') || '.jpg' AS member, content FROM r"""
ORACLE = {
    "q_read_table": sql("objects", " SELECT detection_id, video_id, frame_idx, label, round(score, 6) AS score, false AS suppressed FROM objects"),
    "q_catalog": "SELECT 'V' || CAST(l_orderkey AS VARCHAR) AS video_id, count(*) AS n, true AS no_text FROM lineitem GROUP BY ALL",
    "q_vectors_npy": sql("frames", " SELECT video_id, frame_idx, round(frame_idx / 25e0, 4) AS pts_time, round(vec[1] / sqrt(list_dot_product(vec, vec)), 4) AS first FROM frames WHERE video_id <> 'V7'"),
    "q_detections": sql("objects", " SELECT video_id, CAST(detection_id // 10 % 5 AS INTEGER) AS local_idx, label, count(*) AS n, round(sum(ymin), 4) AS ymin FROM objects WHERE score >= 95e-2 GROUP BY ALL"),
    "q_video_metadata": "SELECT 'V' || CAST(s_suppkey AS VARCHAR) AS video_id, s_name AS title, CASE WHEN s_nationkey <= 20 THEN DATE '2024-03-01' + CAST(s_nationkey AS INTEGER) END AS publish_date, 'tin ' || CAST(s_nationkey AS VARCHAR) AS keywords_text FROM supplier",
    "q_done_log": "SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND value <= 60",
    "q_keyframe_images": "SELECT 'R' || CAST(n_regionkey AS VARCHAR) AS video_id, CAST(n_nationkey AS INTEGER) AS shot_idx, CAST(n_nationkey * 30 AS INTEGER) AS frame_idx, n_name AS content FROM nation WHERE n_regionkey <> 4",
    "q_zip_members": _SHARDS,
    "q_keyframe_bytes": _SHARDS + " WHERE i < 2",
    "q_fps": "SELECT 'V' || CAST(l_suppkey AS VARCHAR) AS video_id, min(l_quantity) AS fps FROM lineitem WHERE l_quantity > 10 GROUP BY ALL",
    "q_find_video": "SELECT * FROM (VALUES ('V1', 'V1.mp4'), ('L21_V002', 'L21/L21_V002.mp4'), ('L26_V250', 'Videos_L26_c.zip'), ('L26_V001', NULL)) v(video_id, found)",
    "q_append_new": "SELECT event_id, value AS score FROM events",
    "q_stream_ingest": "SELECT event_id, user_id, value FROM events",
    "q_vector_table": sql("frames", " SELECT video_id, frame_idx, 'm3' AS model, len(vec) AS width FROM frames WHERE label = 3"),
    "q_audit": sql("objects label_types", """, o AS (SELECT o.*, list_has_any(t.categories, ['person', 'clothing_accessory']) AS safe FROM objects o JOIN label_types t USING (label)),
        m AS (SELECT a.label, NOT (a.source = 'closed' AND NOT a.safe AND EXISTS (SELECT 1 FROM o b WHERE b.source = 'open' AND a.frame_idx = b.frame_idx AND {c} / ({a} + {b} - {c}) > 5e-1)) AS kept FROM o a)
        SELECT label, kept, count(*) AS n FROM m GROUP BY ALL""".format(
        c="(greatest(0e0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) * greatest(0e0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)))",
        a="(a.ymax - a.ymin) * (a.xmax - a.xmin)", b="(b.ymax - b.ymin) * (b.xmax - b.xmin)")),
    "q_report": sql("objects", " SELECT label, count(*) AS n FROM objects GROUP BY label"),
    "q_bucketed": sql("moments", " SELECT video_id, round(sum(score), 4) AS score FROM moments GROUP BY video_id"),
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
