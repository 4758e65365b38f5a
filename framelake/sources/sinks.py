"""Writers: whole tables, increments, reports and submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fs(df: DataFrame, path: str):
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()), target


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write beside the table and swap the folders, so readers see the old table or the new one."""
    staging, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(staging)
    fs, target = _fs(df, path)
    jvm = df.sparkSession._jvm
    fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)
    if fs.exists(target):
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(old))
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"{staging} can't be moved to {path}")
    fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def append_new(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Append rows whose key isn't in the table: running a job again adds nothing."""
    fs, target = _fs(df, path)
    rows = df.dropDuplicates(list(key))
    if fs.exists(target):
        rows = rows.join(df.sparkSession.read.parquet(path).select(*key), list(key), "left_anti")
    rows.write.mode("append").parquet(path)


def bucketed_table(df: DataFrame, name: str, buckets: int, key: Sequence[str]) -> None:
    """A table whose joins and groupings on ``key`` need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)


def write_files(files: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Write each row's content (text or bytes) to the file ``root``/path, by tasks; how many. Run again, files are replaced."""
    import pyarrow as pa

    from .readers import file_system

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                fs, place = file_system(f"{root}/{name}")
                fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(place) as out:
                    out.write(data.encode() if isinstance(data, str) else data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    done = files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, "n bigint").agg(F.sum("n")).first()
    return done[0] or 0


def audit(marked: DataFrame, path: str) -> DataFrame:
    """The rows marked as suppressed as a table of their own; the others are returned, unmarked."""
    marked.where("suppressed").write.mode("overwrite").parquet(path)
    return marked.where(~F.col("suppressed")).drop("suppressed")


def scratch(spark, name: str) -> str:
    """A new folder's path under the session's spark.checkpoint.dir; a session on one machine that names none gets a temporary one."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="framelake-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


def report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A small report as one JSON or CSV file."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", "true").csv(path)


def kis_submission(results: DataFrame, k: int = 100) -> DataFrame:
    """(video_id, frame_id) in order."""
    frame = "frame_id" if "frame_id" in results.columns else "frame_idx"
    order = ["is_backfill"] if "is_backfill" in results.columns else []
    return results.orderBy(*order, F.desc("score"), "video_id", frame).limit(k).select("video_id", F.col(frame).alias("frame_id"))


def qa_submission(results: DataFrame, k: int = 100) -> DataFrame:
    return results.orderBy("rank").limit(k).select("video_id", "frame_id", "answer")


def chain_submission(results: DataFrame, n: int, k: int = 100) -> DataFrame:
    """(video_id, frame_id_1, ..., frame_id_n), best chain first."""
    return results.orderBy(F.desc("score"), "video_id").limit(k).select("video_id", *[F.col("path")[i].alias(f"frame_id_{i + 1}") for i in range(n)])
