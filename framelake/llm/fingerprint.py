"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes ends a chunk where its top bits are zero:
seven bits before a chunk has its normal size, four after it (normalised
chunking), so sizes gather round the normal one and an insertion moves only the
ends near it. A fingerprint is the set of a text's chunk digests with their
lengths; likeness is the length of the common chunks over the smaller total.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST, NORMAL, MOST = 16, 40, 160
HARD_BITS, EASY_BITS = 7, 4

_RNG = np.random.default_rng(97)
_GEAR = _RNG.integers(0, 2**16, 256, dtype=np.uint16)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(MOST, 0x9E3779B97F4A7C15, dtype=np.uint64))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gear values of the 16 bytes up to it, each shifted by its distance, in 16 bits."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << np.uint16(width))
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where chunks end (exclusive), the last one at the end of the data."""
    n, ends, start = len(data), [], 0
    h = gear_hashes(data)
    easy = np.flatnonzero(h < (1 << (16 - EASY_BITS)))
    hard = (easy[h[easy] < (1 << (16 - HARD_BITS))] + 1).tolist()
    easy = (easy + 1).tolist()
    while n - start > LEAST:
        i = bisect_left(hard, start + LEAST)
        if i < len(hard) and hard[i] <= start + NORMAL:
            end = hard[i]
        else:
            i = bisect_left(easy, start + NORMAL)
            end = easy[i] if i < len(easy) and easy[i] <= start + MOST else start + MOST
        if end >= n:
            break
        ends.append(end)
        start = end
    if n:
        ends.append(n)
    return ends


def chunk_set(text: str) -> np.ndarray:
    """The sorted distinct chunks: 48 bits of digest, then 8 bits of length in bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    ends = np.array(chunk_ends(data), dtype=np.int64)
    starts = np.r_[0, ends[:-1]]
    sizes = ends - starts
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    digest = np.add.reduceat(_BYTE[data] * _POWERS[place], starts)
    digest = (digest ^ (digest >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.unique((digest >> np.uint64(16) << np.uint64(8)) | sizes.astype(np.uint64))


def as_text(chunks: np.ndarray) -> str:
    """Fourteen hexadecimal digits a chunk: its digest (12) and its length (2)."""
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint[i : i + 14], 16) for i in range(0, len(fingerprint), 14)], dtype=np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Length of the common chunks over that of the smaller set: how far one contains the other. Two empty sets: 1; one: 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    length = lambda x: int((x & np.uint64(255)).sum())
    return length(np.intersect1d(a, b, assume_unique=True)) / min(length(a), length(b))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many (or all) of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprinted(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows come in order; a row is done when the next one of its part, or the part's sentinel, is there. ``times``: rows that a result stands for."""
    part, row, out, held = None, None, [], 0

    def flush() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[key, *(f.split()[0] for f in FIELDS.split(", ")), "times"])

    def finish(text: str, chunks: np.ndarray, times: int) -> None:
        """The row's results before a text."""
        before, before_text, before_chunks, _ = row
        new = edited(before_text, text)
        new_chunks = chunk_set(new)
        out.append((
            before, len(before_text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_text(before_chunks), as_text(new_chunks),
            likeness(before_chunks, new_chunks), likeness(before_chunks, chunks), times,
        ))

    for batch in batches:
        for own, sentinel, doc, text, copies in zip(*(batch.column(c) for c in ("part", "sentinel", "doc", "text", "copies")), strict=True):
            own, sentinel, text = own.as_py(), sentinel.as_py(), text.as_py() or ""
            if own != part:
                part, row = own, None
            if sentinel and row is None:
                continue
            chunks = chunk_set(text)
            if row is not None:
                if row[3] > 1:  # each copy but the last comes before a copy
                    finish(row[1], row[2], row[3] - 1)
                finish(text, chunks, 1)
                held += len(row[1])
                if held > 4_000_000 or len(out) >= 2000:
                    yield flush()
                    out, held = [], 0
            row = None if sentinel else (doc.as_py(), text, chunks, copies.as_py())
    if out:
        yield flush()


#: An id is dealt over several parts, and its repeated rows are counted, if it has more rows than a range has and than this.
REPEATED = 1000
PIECES = 64


def fingerprints(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and :data:`FIELDS`; "next" is the row with the next smaller key (after the last: the first).

    Rows are dealt by ranges of the key, found as quantiles of the keys alone;
    each range also gets a copy of the row that follows it. So texts move once
    and no task holds more than a range. Null texts are empty. Null keys come
    last in the order, equal keys are ordered by text (nulls first); one row is
    its own next. A key of more rows than a range has (or null) is cut into up
    to 64 ranges of its texts, and of its equal rows one is dealt, with their
    number. An empty table gives no rows; other columns are left out.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * n
    schema = f"`{key}` bigint, {FIELDS}"
    counts = rows.groupBy("doc").agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    if not total:
        return spark.createDataFrame([], schema)
    # fewer than ``ranges`` keys have so many rows; keys that doubles don't tell apart stay whole
    hot = [r.doc for r in counts.where(F.col("n") > max(total // ranges, REPEATED)).collect() if r.doc is None or abs(r.doc) < 2**53] if most > max(total // ranges, REPEATED) else []
    ids = rows.select(F.col("doc").cast("double").alias("at"))
    bounds = set(ids.approxQuantile("at", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))
    bounds = sorted(bounds | {x for d in hot if d is not None for x in (float(d), float(np.nextafter(float(d), np.inf)))})
    cut = Bucketizer(splits=[-float("inf"), *(bounds or [0.0]), float("inf")], inputCol="at", outputCol="bucket")
    rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    piece = F.lit(0)
    if hot:
        is_hot = F.coalesce(F.col("doc").isin(*[d for d in hot if d is not None]), F.lit(None in hot))
        packed = rows.where(is_hot).groupBy("doc", "text").agg(F.sum("copies").alias("copies"))
        rows = rows.where(~is_hot).unionByName(packed)
        place = Window.partitionBy("doc").orderBy(F.xxhash64("text"), "text")
        cuts = packed.withColumn("i", F.row_number().over(place)).where(F.col("i") < PIECES).groupBy("doc").agg(F.array_sort(F.collect_set(F.substring(F.coalesce("text", F.lit("")), 1, 300))).alias("cuts"))
        own = spark.createDataFrame(cuts.collect(), "hot_doc bigint, cuts array<string>")  # fewer rows than ranges, of at most 63 beginnings of texts
        rows = rows.join(F.broadcast(own), is_hot & F.col("doc").eqNullSafe(F.col("hot_doc")), "left").drop("hot_doc")
        piece = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.coalesce("text", F.lit("")))), F.lit(0))

    def dealt(frame: DataFrame) -> DataFrame:
        low = frame.withColumn("at", F.coalesce(F.col("doc").cast("double"), F.lit(-float("inf"))))
        range_ = F.when(F.col("doc").isNull(), len(bounds) + 3).otherwise(len(bounds) + 2 - F.col("bucket").cast("int"))
        return cut.transform(low).withColumn("part", (range_ * (PIECES + 1) + piece).cast("int")).drop("at", "bucket", "cuts")

    heads = dealt(rows if hot else rows.select("doc")).groupBy("part").agg(F.max("doc").alias("head"))
    if most > 1:  # of rows with one key the first goes to the range before
        heads = spark.createDataFrame(heads.collect(), "head_part int, head bigint")
        begins = dealt(rows).join(F.broadcast(heads), (F.col("part") == F.col("head_part")) & F.col("doc").eqNullSafe(F.col("head")))
        heads = begins.groupBy("part", "head").agg(F.xxhash64(F.min(F.coalesce("text", F.lit("")))).alias("hash"))
    heads = sorted(map(tuple, heads.collect()))  # a row for each range
    follows = [(*h, heads[i - 1][0]) for i, h in enumerate(heads)]
    follows = spark.createDataFrame(follows, "head_part int, head bigint, " + "head_hash bigint, " * (most > 1) + "goes_to int")
    is_head = (F.col("part") == F.col("head_part")) & F.col("doc").eqNullSafe(F.col("head"))
    if most > 1:
        is_head &= F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("head_hash")
    placed = dealt(rows).join(F.broadcast(follows), is_head, "left")
    own = F.struct("part", F.lit(False).alias("sentinel"))
    copy = F.struct(F.col("goes_to").alias("part"), F.lit(True).alias("sentinel"))
    both = placed.withColumn("to", F.explode(F.when(F.col("goes_to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    both = both.select("to.part", "to.sentinel", "doc", "text", "copies").repartitionByRange(n, "part")
    ordered = both.sortWithinPartitions("part", "sentinel", F.desc_nulls_last("doc"), F.asc_nulls_first("text"))
    found = ordered.mapInArrow(lambda it: _fingerprinted(it, key), f"{schema}, times bigint")
    if hot:
        found = found.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).drop("__turn")
    return found.drop("times")
