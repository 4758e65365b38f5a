"""Model calls as interfaces, with deterministic stand-ins that need no network.

A stand-in is no model: it gives every input a fixed, arbitrary answer, so that
plans and tests run. Real models plug in as callables on batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TextEncoder(Protocol):
    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEncoder:
    """Stand-in for text and image encoders: unit vectors from words' or bytes' hashes."""

    def __init__(self, name: str, width: int = 64):
        self.name, self.width = name, width

    def _vector(self, part: bytes) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(self.name.encode() + part).digest()[:8], "little")
        return np.random.default_rng(seed).standard_normal(self.width)

    def __call__(self, items: Sequence[str | bytes]) -> np.ndarray:
        out = np.zeros((len(items), self.width))
        for i, x in enumerate(items):
            parts = x.lower().encode().split() if isinstance(x, str) else [x]
            for p in parts:
                out[i] += self._vector(p)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


def encoded(rows: DataFrame, column: str, encoder: Callable[[Sequence], np.ndarray], out: str = "vec", batch: int = 64) -> DataFrame:
    """``rows`` with a vector per item: batches go to the encoder inside tasks, one loaded encoder per task."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                vectors = np.asarray(encoder(part.column(column).to_pylist()), dtype=np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, flat], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, {out} array<float>")


def detected(images: DataFrame, detector: Callable[[list[bytes]], list[list[dict]]], batch: int = 64, least: float = 0.15) -> DataFrame:
    """Rows of detections from (video_id, frame_idx, content); the detector gives dicts of label, score, ymin, xmin, ymax, xmax."""
    fields = ("label", "score", "ymin", "xmin", "ymax", "xmax")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch).to_pylist()
                rows = [(r["video_id"], r["frame_idx"], *(d[f] for f in fields)) for r, ds in zip(part, detector([r["content"] for r in part]), strict=True) for d in ds if d["score"] >= least]
                if rows:
                    types = [pa.string(), pa.int32(), pa.string(), *[pa.float64()] * 5]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["video_id", "frame_idx", *fields])

    schema = "video_id string, frame_idx int, label string, score double, ymin double, xmin double, ymax double, xmax double"
    return images.select("video_id", "frame_idx", "content").mapInArrow(run, schema)


def answered(rows: DataFrame, question: str, model: Callable[[list[str], list[str | None]], list[str]], context: str = "context", image: str = "path", batch: int = 8) -> DataFrame:
    """``rows`` with an answer from a visual model, which takes prompts and images in batches of ``batch``."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                prompts = [question if not c else f"{question}\n{c}" for c in part.column(context).to_pylist()]
                answers = list(model(prompts, part.column(image).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers, pa.string())], names=[*names, "answer"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, answer string")


def read_lines(images: DataFrame, reader: Callable[[list[bytes]], list[list[dict]]], batch: int = 32, least: float = 0.5) -> DataFrame:
    """On-screen text, a row a line: the reader gives dicts of text, score, ymin, xmin, ymax, xmax for each image. Lines under ``least`` go."""
    fields = ("text", "score", "ymin", "xmin", "ymax", "xmax")
    found = _unfolded(images.select("video_id", "frame_idx", "content"), "content", ["video_id", "frame_idx"], reader, fields, batch, "text string, score double, ymin double, xmin double, ymax double, xmax double")
    return found.where(F.col("score") >= least).withColumnRenamed("text", "text_raw")


def transcribed(sounds: DataFrame, listener: Callable[[list[bytes]], list[list[dict]]], batch: int = 4) -> DataFrame:
    """Speech, a row a segment in seconds of the video: the listener gives dicts of start, end and text for each chunk of sound, whose chunk_start is added."""
    found = _unfolded(sounds.select("video_id", "chunk_start", "content"), "content", ["video_id", "chunk_start"], listener, ("start", "end", "text"), batch, "start double, end double, text string")
    moved = found.withColumn("start", F.col("start") + F.col("chunk_start")).withColumn("end", F.col("end") + F.col("chunk_start"))
    return moved.where(F.trim("text") != "").select("video_id", "start", "end", F.col("text").alias("text_raw"))


def _unfolded(rows: DataFrame, content: str, key: list[str], model: Callable[[list[bytes]], list[list[dict]]], fields: Sequence[str], batch: int, ddl: str) -> DataFrame:
    """A row for each dict that a batch model gives for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                answers = model(part.column(content).to_pylist())
                at = [i for i, found in enumerate(answers) for _ in found]
                columns = [pa.array([d.get(f) for found in answers for d in found]) for f in fields]
                if at:
                    typed = [c.cast(pa.string() if t.split()[1] == "string" else pa.float64()) for c, t in zip(columns, ddl.split(", "), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(at)) for k in key), *typed], names=[*key, *fields])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key) + f", {ddl}")


def encoded_regions(objects: DataFrame, images: DataFrame, crop: Callable[[bytes, tuple[float, float, float, float]], bytes], encoder: Callable[[Sequence], np.ndarray], batch: int = 64) -> DataFrame:
    """(detection_id, vec): each object's crop of its frame's image, encoded; objects without an image are left out.

    ``crop`` cuts bytes of an image at a box in [0, 1]; the pixels are
    ``functions.geometry.crop_pixels``.
    """
    joined = objects.select("video_id", "frame_idx", "detection_id", "ymin", "xmin", "ymax", "xmax").join(images.select("video_id", "frame_idx", "content"), ["video_id", "frame_idx"])
    cut = lambda parts: encoder([crop(p["content"], (p["ymin"], p["xmin"], p["ymax"], p["xmax"])) for p in parts])
    packed = joined.select("detection_id", F.struct("content", "ymin", "xmin", "ymax", "xmax").alias("part"))
    return encoded(packed, "part", cut, batch=batch).select("detection_id", "vec")


def with_retry(call: Callable[[], object], tries: int = 5, first: float = 1.0, factor: float = 1.8, most: float = 30.0, wait: Callable[[float], None] | None = None):
    """The call's result; failures are tried again after growing waits."""
    import time

    delay = first
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i == tries - 1:
                raise
            (wait or time.sleep)(delay)
            delay = min(most, delay * factor)
