"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of about 512 bytes. Each passage is described by
rates of byte classes, pairs of classes, hashed byte pairs and word statistics,
and encoded by a small layer. Gated attention, learned from labels of whole
documents only, weighs the passages; the weighted sum gives the score. The model
is trained on the driver, on a bounded sample of labelled rows; scoring reads
every passage of every text.
"""

from __future__ import annotations

import ctypes
import glob
import os
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, releasing

PASSAGE = 512
_MARKS = b".,!*$&%#|:;\"'"
CLASSES = 6 + len(_MARKS) + 1
PAIRS = 96
WORD_FEATURES = 6
#: The last one is how far the others can be trusted: length / (length + 40).
FEATURES = CLASSES + CLASSES * CLASSES + PAIRS + WORD_FEATURES + 1


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES - 1, dtype=np.int64)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[[9, 11, 12, 13, 32]], table[10], table[128:] = 3, 4, 5
    for i, mark in enumerate(_MARKS):
        table[mark] = 6 + i
    return table


_CLASS = _class_table()
_RNG = np.random.default_rng(41)
_WORD_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_PLACE = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, dtype=np.uint64))


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages per text); an empty text is one empty passage, a short last passage joins the one before."""
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) for b in blobs], dtype=np.int64)
    counts = np.maximum(1, (sizes + PASSAGE // 2) // PASSAGE)
    first = np.r_[0, np.cumsum(counts)[:-1]]
    m, n = int(counts.sum()), int(sizes.sum())
    out = np.zeros((m, FEATURES), dtype=np.float32)
    if not n:
        return out, counts
    data = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    text_of = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(n) - begins[text_of]
    at = first[text_of] + np.minimum(place // PASSAGE, counts[text_of] - 1)
    filled = np.bincount(at, minlength=m)
    length = np.maximum(filled, 1)[:, None]
    out[:, -1] = filled / (filled + 40)
    kind = _CLASS[data]
    a = 0
    out[:, a : a + CLASSES] = np.bincount(at * CLASSES + kind, minlength=m * CLASSES).reshape(m, -1) / length
    a += CLASSES
    inside = np.flatnonzero(text_of[1:] == text_of[:-1])
    here = at[inside]
    steps = here * (CLASSES * CLASSES) + kind[inside] * CLASSES + kind[inside + 1]
    out[:, a : a + CLASSES * CLASSES] = np.sqrt(np.bincount(steps, minlength=m * CLASSES * CLASSES).reshape(m, -1) / length)
    a += CLASSES * CLASSES
    letters = data.astype(np.int64) | (32 * (kind == 1))
    hashed = (letters[inside] * 257 + letters[inside + 1]) * 2654435761 % 4294967296 % PAIRS
    out[:, a : a + PAIRS] = np.sqrt(np.bincount(here * PAIRS + hashed, minlength=m * PAIRS).reshape(m, -1) / length)
    a += PAIRS
    space = (kind == 3) | (kind == 4)
    starts = np.flatnonzero(~space & np.r_[True, space[:-1] | (text_of[1:] != text_of[:-1])])
    if len(starts):
        word = np.cumsum(np.bincount(starts, minlength=n)) - 1  # of each byte; -1 before the first
        since = np.arange(n) - starts[np.maximum(word, 0)]
        value = np.where(space, np.uint64(0), _WORD_BYTE[letters] * _WORD_PLACE[np.minimum(since, 63)])
        digest = np.add.reduceat(value, starts)
        size = np.add.reduceat((~space).astype(np.int64), starts)
        where = at[starts]
        found = np.bincount(where, minlength=m)
        words = np.maximum(found, 1)
        same = np.r_[False, (digest[1:] == digest[:-1]) & (text_of[starts[1:]] == text_of[starts[:-1]])]
        pair = np.unique(digest ^ (where.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        columns = (
            found / length[:, 0] * 6, np.bincount(where, size, m) / words / 10, np.bincount(where[same], minlength=m) / words,
            np.bincount(where[pair], minlength=m) / words, np.bincount(where[kind[starts] == 1], minlength=m) / words, np.bincount(where[size > 14], minlength=m) / words,
        )
        for i, c in enumerate(columns):
            out[:, a + i] = c
    return out, counts


@dataclass
class Attention:
    """The model. Features are deviations from the mean of good documents, shrunk where a passage is short: little evidence is none against it.

    ``weights`` are: encoder, its bias, attention's tanh and gate layers, attention's vector, output vector, output bias.
    """

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        we, be, v, u, w, c, c0 = self.weights
        z = np.clip((x - self.mean) / self.scale, -4, 4) * x[:, -1:]
        starts = np.r_[0, np.cumsum(counts)[:-1]]
        h = np.tanh(z @ we + be)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * s) @ w
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        pooled = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"z": z, "h": h, "t": t, "s": s, "a": a, "pooled": pooled, "p": 1 / (1 + np.exp(-np.clip(pooled @ c + c0[0], -30, 30))), "starts": starts}

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.forward(*passages(texts))["p"].astype(np.float64)

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        we, be, v, u, w, c, c0 = self.weights
        f = self.forward(x, counts)
        h, t, s, a = f["h"], f["t"], f["s"], f["a"]
        d = (f["p"] - y) / len(y)
        d_pooled = np.repeat(d[:, None] * c[None, :], counts, axis=0)
        d_a = (h * d_pooled).sum(axis=1)
        d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, f["starts"]), counts))
        d_gate = d_e[:, None] * w[None, :]
        d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
        d_h = (a[:, None] * d_pooled + d_t @ v.T + d_s @ u.T) * (1 - h * h)
        return [f["z"].T @ d_h, d_h.sum(axis=0), h.T @ d_t, h.T @ d_s, (t * s).T @ d_e, f["pooled"].T @ d, np.array([d.sum()])]


@contextmanager
def _one_blas_thread() -> Iterator[None]:
    """Products of small matrices, where NumPy's OpenBLAS loses more to its threads than it gains. Without that library nothing changes."""
    found = glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*"))
    library = ctypes.CDLL(found[0]) if found else None
    count, limit = (getattr(library, f"scipy_openblas_{x}_num_threads64_", None) for x in ("get", "set"))
    before = count() if count and limit else 0
    if before:
        limit(1)
    try:
        yield
    finally:
        if before:
            limit(before)


def train(bags: list[np.ndarray], labels: np.ndarray, steps: int = 1200, hidden: int = 24, gate: int = 12, batch: int = 64, rate: float = 4e-3, decay: float = 1e-2, seed: int = 5) -> Attention:
    """``steps`` batches of Adam on the cross-entropy of the documents' labels; the same bags in the same order give the same model.

    The decay was chosen within the two thirds of the test tables that may be learned from (one third against the other).
    """
    rng = np.random.default_rng(seed)
    good = [b for b, y in zip(bags, labels, strict=True) if y == 1] or bags
    # moments by sums over bags: no copy of all of them is made
    moment = lambda own, power: sum((b.astype(np.float64) ** power).sum(axis=0) for b in own) / sum(map(len, own))
    mean, scale = moment(good, 1), np.sqrt(np.maximum(moment(bags, 2) - moment(bags, 1) ** 2, 0)) + 1e-3
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
    model = Attention(mean, scale, [draw(FEATURES, hidden), np.zeros(hidden), draw(hidden, gate), draw(hidden, gate), draw(gate), draw(hidden), np.zeros(1)])
    m1, m2 = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]
    left = np.empty(0, dtype=np.int64)
    for step in range(1, steps + 1):
        if not len(left):
            left = rng.permutation(len(bags))
        chosen, left = left[:batch], left[batch:]
        pace = rate * (0.5 + 0.5 * np.cos(np.pi * step / steps))
        own = [bags[j] for j in chosen]
        grads = model.gradients(np.concatenate(own).astype(np.float64), np.array([len(b) for b in own]), labels[chosen])
        for k, g in enumerate(grads):
            g = g + decay * model.weights[k] * (model.weights[k].ndim == 2)
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            model.weights[k] = model.weights[k] - pace * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


# --- on tables ---------------------------------------------------------------


def held_out(key: str = "doc_id"):
    """True for the third of all documents whose labels are never learned from; a null key is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's passages, all of them."""
    for batch in batches:
        for i in range(batch.num_rows):
            bag = passages([batch.column("text")[i].as_py()])[0].astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), batch.column("quality").slice(i, 1), pa.array([bag.tobytes()], pa.binary())], names=["doc_id", "quality", "bag"])


def sampled(docs: DataFrame, labels: DataFrame, per_class: int, passages_per_class: int) -> tuple[DataFrame | None, list]:
    """(doc_id, quality, text) of the documents to train on, each once, and their (doc_id, quality) in order."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.where("quality = other").join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "quality")
    order = [F.xxhash64("doc_id", F.lit(7)), "doc_id"]
    first = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(*order).limit(per_class).collect()]
    if not first:
        return None, []
    spark = docs.sparkSession
    place = spark.createDataFrame([(r.doc_id, r.quality, i) for i, r in enumerate(first)], "doc_id bigint, quality int, place int")
    # one row for an id, before anything is gathered: of repeated rows the text that sorts first
    once = docs.join(F.broadcast(place), "doc_id").groupBy("doc_id", "quality", "place").agg(F.min("text").alias("text"))  # at most 2 * per_class ids
    once = Workspace(spark, "quality").stage(once, "sample")
    sizes = once.select("doc_id", "quality", "place", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy("place").collect()
    chosen, used = [], {0: 0, 1: 0}
    for r in sizes:
        n = max(1, (r["size"] + PASSAGE // 2) // PASSAGE)
        if used[r.quality] == 0 or used[r.quality] + n <= passages_per_class:
            chosen.append((r.doc_id, r.quality))
        used[r.quality] += n
    ids = spark.createDataFrame(chosen, "doc_id bigint, quality int").select("doc_id")
    return once.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "quality", "text"), chosen


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, passages_per_class: int = 60_000) -> Attention | float:
    """Train on the labelled documents outside the held-out third.

    The bound is on rows: of each label, the ``per_class`` documents whose id
    hashes lowest, and of these only as many as have ``passages_per_class``
    passages together (at least one). A document in training has all its
    passages there. Repeated rows of an id are one document. Labels other than 0
    and 1 are ignored, and so is a document with both. With one label only, or
    none, the result is a constant score.
    """
    sample, chosen = sampled(docs, labels, per_class, passages_per_class)
    if len({q for _, q in chosen}) < 2:
        return float(chosen[0][1]) if chosen else 0.5
    rows = sample.mapInArrow(_bags, "doc_id bigint, quality int, bag binary").collect()
    found = {r.doc_id: np.frombuffer(r.bag, dtype=np.float16).reshape(-1, FEATURES) for r in rows}
    with _one_blas_thread():
        return train([found[i] for i, _ in sorted(chosen)], np.array([q for _, q in sorted(chosen)], dtype=np.float64))


def scored(spark: SparkSession, rows: DataFrame, model: Attention | float, text: str = "text", out: str = "score") -> DataFrame:
    """``rows`` with a column ``out``, which they mustn't have yet; a map without a shuffle."""
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, chunk, size = [], [], 0

            def done(chunk: list[str | None]) -> None:
                if isinstance(held.value, float):
                    scores.append(np.full(len(chunk), held.value))
                elif chunk:
                    scores.append(held.value.score(chunk))

            for t in batch.column(text):
                chunk.append(t.as_py())
                size += len(chunk[-1] or "")
                if size > 200_000:
                    done(chunk)
                    chunk, size = [], 0
            done(chunk)
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(releasing(run), f"{schema}, `{out}` double")


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Only the text is scored. Null and empty texts are one empty passage. A null
    doc_id is scored and not held out; repeated rows get equal scores; an empty
    table gives no rows. No labels: every score is 0.5. Other columns, also of
    ``labels``, are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(narrow, labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")), per_class)
    return scored(spark, narrow, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
