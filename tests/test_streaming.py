from pyspark.sql import functions as F

from framelake.streaming import sessions


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").limit(600)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = events(spark, sf_dir)
    # a last event far in the future lets the watermark close all sessions before it
    late = rows.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.expr("ts + interval 30 days")).withColumn("user_id", F.lit(-1).cast("bigint"))
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows.write.parquet(source)
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    stream = lambda: sessions.sessions(sessions.file_stream(spark, source, schema), gap="6 hours")
    sessions.run_to_end(stream(), target, checkpoint)
    late.write.mode("append").parquet(source)
    sessions.run_to_end(stream(), target, checkpoint)
    sessions.run_to_end(stream(), target, checkpoint)
    got = {(r.user_id, r.session_start, r.n_events) for r in spark.read.parquet(target).collect()}
    expected = {(r.user_id, r.session_start, r.n_events) for r in sessions.sessions(rows, gap="6 hours").collect()}
    assert got == expected


def test_repeats_and_windows(spark, sf_dir, tmp_path):
    rows = events(spark, sf_dir)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows.unionByName(rows).coalesce(1).write.parquet(source)
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    stream = sessions.without_repeats(sessions.file_stream(spark, source, schema), ["event_id"], late="60 days")
    sessions.run_to_end(stream, target, str(tmp_path / "check"))
    assert spark.read.parquet(target).count() == rows.count()
    assert sessions.without_repeats(rows.unionByName(rows), ["event_id"]).count() == rows.count()
    assert sessions.windows(rows, "1 day", "12 hours").agg(F.sum("n_events")).first()[0] == 2 * rows.count()
