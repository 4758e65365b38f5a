"""Readers: files to the engine's tables. Parsing is done by Spark's sources and expressions."""

from __future__ import annotations

from collections.abc import Mapping
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..functions.vectors import unit
from ..schemas import checked, schema


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table, its columns checked against the schema of ``name``."""
    return checked(spark.read.parquet(path), name)


class Catalog:
    """Tables under one folder, read when first asked for; a table that isn't there is None."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._held = spark, root, {}

    def get(self, name: str) -> DataFrame | None:
        if name not in self._held:
            path = f"{self.root}/{name}.parquet"
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            there = target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(target)
            self._held[name] = table(self.spark, path, name) if there else None
        return self._held[name]


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def video_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per video: author, title, publish_date (dd/MM/yyyy, else null), keywords, and keywords_text in lower case."""
    raw = spark.read.schema("author string, title string, publish_date string, keywords array<string>").json(path, multiLine=True)
    keywords = F.coalesce("keywords", F.array().cast("array<string>"))
    return raw.select(
        file_stem(F.col("_metadata.file_path")).alias("video_id"), "author", "title", F.try_to_timestamp("publish_date", F.lit("dd/MM/yyyy")).cast("date").alias("publish_date"),
        keywords.alias("keywords"), F.lower(F.array_join(keywords, " ")).alias("keywords_text"),
    )


def detections(spark: SparkSession, path: str, least: float = 0.3) -> DataFrame:
    """JSON files <video>/<number>.json of parallel arrays as a row per detection; local_idx is the number less 1."""
    fields = "detection_scores array<double>, detection_class_entities array<string>, detection_boxes array<array<double>>"
    raw = spark.read.schema(fields).json(path, multiLine=True, recursiveFileLookup=True).withColumn("_path", F.col("_metadata.file_path"))
    each = raw.select("_path", F.explode(F.arrays_zip("detection_scores", "detection_class_entities", "detection_boxes")).alias("d")).where(F.col("d.detection_scores") >= least)
    box = F.col("d.detection_boxes")
    return each.select(
        F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1).alias("video_id"), (file_stem(F.col("_path")).cast("int") - 1).alias("local_idx"), F.col("d.detection_class_entities").alias("label"),
        F.col("d.detection_scores").alias("score"), box[0].alias("ymin"), box[1].alias("xmin"), box[2].alias("ymax"), box[3].alias("xmax"),
    )


def frame_numbers(spark: SparkSession, path: str) -> DataFrame:
    """CSV files <video>.csv with n, pts_time, fps, frame_idx; local_idx is n less 1."""
    raw = spark.read.schema("n int, pts_time double, fps double, frame_idx int").csv(path, header=True)
    return raw.select(file_stem(F.col("_metadata.file_path")).alias("video_id"), (F.col("n") - 1).alias("local_idx"), "frame_idx", "pts_time", "fps")


def with_vectors(frames: DataFrame, vectors: DataFrame) -> DataFrame:
    """Frames with their unit vectors by (video_id, local_idx); videos whose numbers of frames and vectors differ are left out."""
    a, b = frames.groupBy("video_id").agg(F.count("*").alias("n")), vectors.groupBy("video_id").agg(F.count("*").alias("n"))
    whole = a.join(b, ["video_id", "n"]).select("video_id")
    return frames.join(vectors, ["video_id", "local_idx"]).join(whole, "video_id", "left_semi").withColumn("vec", unit(F.col("vec")))


def vectors_npy(spark: SparkSession, path: str) -> DataFrame:
    """NumPy files <video>.npy of float matrices as (video_id, local_idx, vec); a file is one video's and is read by one task."""
    import io

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("video_id").to_pylist(), batch.column("content"), strict=True):
                m = np.atleast_2d(np.load(io.BytesIO(content.as_py()), allow_pickle=False)).astype(np.float32)
                m = m.reshape(len(m), -1)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(m)), pa.array(np.arange(len(m), dtype=np.int32)), vec], names=["video_id", "local_idx", "vec"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select(file_stem(F.col("path")).alias("video_id"), "content").mapInArrow(run, "video_id string, local_idx int, vec array<float>")


def done_log(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A JSON-lines log without its bad lines and its records of errors."""
    raw = spark.read.schema(f"{fields}, error string").json(path, mode="DROPMALFORMED")
    return raw.where(F.col("error").isNull()).drop("error")


def keyframe_images(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Images .../<video>/shot<n>_f<n>.jpg as frames; others are left out. Without content only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = r"(?i)shot(\d+)_f(\d+)\.jpg$"
    kept = files.where(F.col("path").rlike(name))
    return kept.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video_id"), F.regexp_extract("path", name, 1).cast("int").alias("shot_idx"),
        F.regexp_extract("path", name, 2).cast("int").alias("frame_idx"), "path", *(["content"] if content else []),
    )


def archive_name(video: Column, kind: str = "Keyframes") -> Column:
    """The ZIP shard that holds a video: group L26 is cut into a to e by hundreds; other groups have one shard (for videos: part a)."""
    group, number = F.split_part(video, F.lit("_"), F.lit(1)), F.regexp_extract(video, r"_V(\d+)", 1).cast("int")
    part = F.when(number <= 99, "a").when(number <= 199, "b").when(number <= 299, "c").when(number <= 399, "d").otherwise("e")
    plain = F.concat(F.lit(f"{kind}_"), group, F.lit("_a.zip" if kind == "Videos" else ".zip"))
    return F.when(group == "L26", F.concat(F.lit(f"{kind}_L26_"), part, F.lit(".zip"))).otherwise(plain)


def member_name(video: Column, local_idx: Column) -> Column:
    """A frame's name inside its shard."""
    return F.concat(F.lit("keyframes/"), video, F.lit("/"), F.lpad((local_idx + 1).cast("string"), 3, "0"), F.lit(".jpg"))


def zip_members(spark: SparkSession, path: str, pattern: str = r"\.jpg$", slices: int = 16) -> DataFrame:
    """(archive, member, content) of ZIP files.

    An archive is opened in place (its directory and the members asked for are
    read, not the file as a whole) by as many as ``slices`` tasks, each with its
    share of the members.
    """
    import re

    def asked(batch):
        for archive, part in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist(), strict=True):
            yield archive, lambda names, part=part: [n for n in names if re.search(pattern, n) and crc32(n.encode()) % slices == part]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    dealt = files.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition("path", "part")
    return dealt.mapInArrow(_members(asked), "archive string, member string, content binary")


def keyframe_bytes(spark: SparkSession, root: str, wanted: DataFrame, per_task: int = 500) -> DataFrame:
    """(archive, member, content) of the frames (video_id, local_idx) that are wanted, from the shards under ``root``.

    Which shard and member holds a frame follows from its key; each task opens
    one shard and reads its members there. Frames that a shard lacks are left out.
    """
    video = F.col("video_id")
    keyed = wanted.select(F.concat(F.lit(root.rstrip("/") + "/"), archive_name(video)).alias("path"), member_name(video, F.col("local_idx")).alias("member")).distinct()
    place = F.floor((F.row_number().over(Window.partitionBy("path").orderBy("member")) - 1) / per_task)
    lists = keyed.withColumn("part", place).groupBy("path", "part").agg(F.collect_list("member").alias("members"))

    def asked(batch):
        for archive, members in zip(batch.column("path").to_pylist(), batch.column("members").to_pylist(), strict=True):
            yield archive, lambda names, members=members: sorted(set(members) & set(names))

    return lists.select("path", "members").mapInArrow(_members(asked), "archive string, member string, content binary")


def video_bytes(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(archive, member, content) of whole videos (video_id) from the video shards under ``root``."""
    keyed = wanted.select(F.concat(F.lit(root.rstrip("/") + "/"), archive_name(F.col("video_id"), "Videos")).alias("path"), "video_id").distinct()

    def asked(batch):
        for archive, video in zip(batch.column("path").to_pylist(), batch.column("video_id").to_pylist(), strict=True):
            yield archive, lambda names, video=video: [n for n in names if n.rsplit("/", 1)[-1] == f"{video}.mp4"]

    return keyed.repartition("path", "video_id").mapInArrow(_members(asked), "archive string, member string, content binary")


def _members(asked):
    """A function for mapInArrow: the members that ``asked`` chooses from each archive's names, one at a time; archives that aren't there have none."""
    import zipfile

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for archive, choose in asked(batch):
                files, place = file_system(archive)
                try:
                    source = files.open_input_file(place)
                except FileNotFoundError:
                    continue
                with source, zipfile.ZipFile(source) as z:
                    for member in choose(z.namelist()):
                        yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([member]), pa.array([z.read(member)], pa.binary())], names=["archive", "member", "content"])

    return run


def file_system(path: str):
    """(Arrow's file system, the path inside it) of a path or URI; a path without a scheme is a local one."""
    import re

    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


def mapped_path(path: Column, roots: Mapping[str, str]) -> Column:
    """A local path as a volume's: its root folder (all but the last three parts) replaced through a map; an unknown root is an error."""
    flat = F.translate(path, "\\", "/")
    root, rest = F.regexp_extract(flat, r"^(.*?)/([^/]+/[^/]+/[^/]+)$", 1), F.regexp_extract(flat, r"^(.*?)/([^/]+/[^/]+/[^/]+)$", 2)
    target = F.lit(None).cast("string")
    for local, volume in roots.items():
        target = F.when(root == local.replace("\\", "/"), volume).otherwise(target)
    return F.when(target.isNull(), F.raise_error(F.concat(F.lit("no volume for "), path)).cast("string")).otherwise(F.concat(target, F.lit("/"), rest))


def fps_by_video(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("fps").isNotNull()).groupBy("video_id").agg(F.min("fps").alias("fps"))


def speech_on_frames(segments: DataFrame, fps: DataFrame) -> DataFrame:
    """Transcript segments in seconds as ranges of frames (rounded half to even); videos without a frame rate are left out."""
    from ..functions.text import best_text, strip_accents

    rows = segments.join(fps, "video_id")
    text = best_text(F.col("text_refined"), F.col("text_itn"), F.col("text_raw"))
    at = lambda c: F.bround(F.col(c) * F.col("fps")).cast("int")
    return rows.select("video_id", at("start").alias("frame_idx_start"), at("end").alias("frame_idx_end"), "start", "end", text.alias("text_raw"), normalize(strip_accents(text)).alias("text_norm"))


def dedupe_key_order(frames: DataFrame) -> DataFrame:
    """local_idx: a frame's place in its video."""
    return frames.withColumn("local_idx", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")) - 1)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def find_video(spark: SparkSession, roots: list[str], video: str) -> str | None:
    """The first of <root>/<video>.mp4, <root>/<group>/<video>.mp4 and the video's shard under <root> that exists."""
    group = video.split("_")[0]
    shard = spark.range(1).select(archive_name(F.lit(video), "Videos")).first()[0]
    jvm = spark._jvm
    for root in roots:
        for name in (f"{root}/{video}.mp4", f"{root}/{group}/{video}.mp4", f"{root}/{shard}"):
            target = jvm.org.apache.hadoop.fs.Path(name)
            if target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
                return name
    return None
