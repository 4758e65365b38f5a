import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import schemas
from framelake.sources import readers, sinks


def test_metadata_files(spark, tmp_path):
    (tmp_path / "L21_V001.json").write_text(json.dumps({"author": "A", "title": "T", "publish_date": "02/01/2024", "keywords": ["Hà Nội", "B"]}))
    (tmp_path / "L21_V002.json").write_text(json.dumps({"author": "A", "publish_date": "2024-01-02"}))
    a, b = readers.video_metadata(spark, str(tmp_path)).orderBy("video_id").collect()
    assert (a.video_id, str(a.publish_date), a.keywords_text) == ("L21_V001", "2024-01-02", "hà nội b")
    assert (b.publish_date, b.keywords, b.keywords_text) == (None, [], "")


def test_detection_files(spark, tmp_path):
    (tmp_path / "V1").mkdir()
    one = {"detection_scores": [0.9, 0.1], "detection_class_entities": ["Dog", "Cat"], "detection_boxes": [[0, 0.1, 0.2, 0.3], [0, 0, 1, 1]]}
    (tmp_path / "V1" / "012.json").write_text(json.dumps(one))
    (row,) = readers.detections(spark, str(tmp_path)).collect()
    assert tuple(row) == ("V1", 11, "Dog", 0.9, 0.0, 0.1, 0.2, 0.3)


def test_frames_and_vectors(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "npy").mkdir()
    for v, n in (("V1", 2), ("V2", 3)):
        (tmp_path / "csv" / f"{v}.csv").write_text("n,pts_time,fps,frame_idx\n1,0.0,25.0,0\n2,2.0,25.0,50\n")
        np.save(tmp_path / "npy" / f"{v}.npy", np.array([[3.0, 4.0]] * n))
    frames, vectors = readers.frame_numbers(spark, str(tmp_path / "csv")), readers.vectors_npy(spark, str(tmp_path / "npy"))
    got = readers.with_vectors(frames, vectors).orderBy("local_idx").collect()
    assert [(r.video_id, r.local_idx, r.frame_idx) for r in got] == [("V1", 0, 0), ("V1", 1, 50)]
    assert got[0].vec == pytest.approx([0.6, 0.8])
    assert readers.fps_by_video(frames).count() == 2


def test_logs_images_and_archives(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"video_id": "a"}\nbroken\n{"video_id": "b", "error": "x"}\n')
    assert [r.video_id for r in readers.done_log(spark, str(tmp_path / "log.jsonl"), "video_id string").collect()] == ["a"]
    (tmp_path / "img" / "V9").mkdir(parents=True)
    for name in ("shot0012_f0000345.jpg", "shot2_f7.JPG", "cover.jpg"):
        (tmp_path / "img" / "V9" / name).write_bytes(b"x")
    got = readers.keyframe_images(spark, str(tmp_path / "img")).collect()
    assert sorted((r.video_id, r.shot_idx, r.frame_idx) for r in got) == [("V9", 2, 7), ("V9", 12, 345)]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("keyframes/V9/001.jpg", b"abc")
        z.writestr("readme.txt", b"")
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips" / "Keyframes_L21.zip").write_bytes(data.getvalue())
    (row,) = readers.zip_members(spark, str(tmp_path / "zips")).collect()
    assert row.member == "keyframes/V9/001.jpg" and bytes(row.content) == b"abc"


def test_unknown_root_is_an_error(spark):
    bad = spark.range(1).select(readers.mapped_path(F.lit("E:\\x\\a\\b\\c.jpg"), {"D:\\x": "v"}).alias("p"))
    with pytest.raises(Exception, match="no volume"):
        bad.collect()


def test_speech_on_frames(spark):
    rows = spark.createDataFrame([("a", 0.1, 1.0, "Xin CHÀO", None, None), ("b", 0.0, 1.0, "x", None, None)], "video_id string, start double, end double, text_raw string, text_itn string, text_refined string")
    (row,) = readers.speech_on_frames(rows, spark.createDataFrame([("a", 25.0)], "video_id string, fps double")).collect()
    assert (row.frame_idx_start, row.frame_idx_end, row.text_norm) == (2, 25, "xin chao")


def test_schemas_and_catalog(spark, tmp_path):
    with pytest.raises(ValueError, match="lacks shot_idx"):
        schemas.checked(spark.createDataFrame([("a", 1)], "video_id string, frame_idx int"), "frames")
    readers.empty(spark, "frames").write.parquet(str(tmp_path / "frames.parquet"))
    catalog = readers.Catalog(spark, str(tmp_path))
    assert catalog.get("frames").count() == 0 and catalog.get("ocr_text") is None


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.new").exists() and not (tmp_path / "t.old").exists()
    for _ in range(2):
        sinks.append_new(spark.range(4, 8), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(8))
    sinks.report(spark.range(2), str(tmp_path / "r"), "csv")
    assert len(list((tmp_path / "r").glob("part-*"))) == 1
    results = spark.createDataFrame([("a", 1, 0.5, False), ("b", 2, 0.9, True), ("c", 3, 0.7, False)], "video_id string, frame_idx int, score double, is_backfill boolean")
    assert [tuple(r) for r in sinks.kis_submission(results).collect()] == [("c", 3), ("a", 1), ("b", 2)]
    chains = spark.createDataFrame([("a", [1, 2], 0.5)], "video_id string, path array<int>, score double")
    assert tuple(sinks.chain_submission(chains, 2).first()) == ("a", 1, 2)
