"""SentencePiece models run by the tokenizers library.

The model file's protobuf is parsed here (its wire format, no generated
classes); normaliser, metaspace marker, scores or merges and byte fallback are
rebuilt from it. Batches of whole texts are encoded on several threads; the ids
are this tokenizer's, and every text's are compared with the sentencepiece
library's.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing

SPACE = "▁"
# Piece types and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A score that any other path beats.
NEVER = -1e5


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers for varints, bytes for the rest."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                if kind != 2:
                    raise ValueError(f"wire type {kind} in a model file")
                size = varint()
            if at + size > end:
                raise ValueError("the model file ends inside a field")
            yield number, data[at : at + size]
            at += size


@dataclass
class Model:
    """What a model file says: pieces as (text, score, type), and the settings that matter for encoding."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_space: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_extra: bool = True
    escape: bool = True

    @property
    def unk_id(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode("utf-8")
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            model.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 24:
                    model.suffix_space = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.strip_extra = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """All ways to join two pieces into a third, the best-scored results first."""
    vocabulary = {p: i for i, (p, _, t) in enumerate(model.pieces) if t in (NORMAL, USER_DEFINED)}
    found = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind == NORMAL and len(piece) > 1:
            halves = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
            found += [(-score, i, vocabulary[a], vocabulary[b], a, b) for a, b in halves if a in vocabulary and b in vocabulary]
    return [(a, b) for *_, a, b in sorted(found)]


def _words_apart(model: Model) -> bool:
    """Whether no piece has the space mark after another character: then words can be encoded by themselves."""
    return not model.suffix_space and not any(t == NORMAL and SPACE in p.lstrip(SPACE) for p, _, t in model.pieces)


def build_tokenizer(model: Model):
    """A tokenizers-library tokenizer that encodes as the model says. A text is one sequence to it, as it is to the model: no cutting into words, no cache of them."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        # names of control, unknown and byte pieces that stand in a text are no pieces there: no best path has them
        core = models.Unigram([(p, s if t in (NORMAL, USER_DEFINED) else NEVER) for p, s, t in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0)
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.strip_extra:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])]
    )
    own = [AddedToken(p, normalized=False, special=False) for p, _, t in model.pieces if t == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


def _reference(data: bytes):
    """The sentencepiece library with the model, to compare with; None where it isn't installed."""
    try:
        import sentencepiece
    except ImportError:
        return None
    return sentencepiece.SentencePieceProcessor(model_proto=data)


class Codec:
    """The rebuilt tokenizer, whose ids are the result, beside the sentencepiece library, which they are compared with.

    Whole texts are encoded in batches on ``threads`` threads. Where no piece
    crosses from one word into the next, a text of more than ``LONG`` characters
    is encoded in parts, cut at single blanks: the blank is the mark that each
    part gets at its beginning, so the ids are those of the whole.
    """

    LONG = 1_000_000

    def __init__(self, data: bytes, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        model = parse_model(data)
        self.tokenizer, self.reference, self.threads = build_tokenizer(model), _reference(data), threads
        self.exact = not model.charsmap and not model.strip_extra
        self.prefix = model.dummy_prefix
        self.bytes = pa.array([bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, _, t in model.pieces], pa.binary())
        self.sizes = np.array([len(b) for b in self.bytes.to_pylist()], dtype=np.int64)
        self.cuts = _words_apart(model) and self.exact and model.escape and model.dummy_prefix

    def parts(self, text: str) -> list[str]:
        if len(text) <= self.LONG or not self.cuts:
            return [text]
        out, at = [], 0
        for m in re.finditer(r"(?<=[^ ▁]) (?=[^ ▁])", text):
            if m.start() - at >= self.LONG:
                out.append(text[at : m.start()])
                at = m.end()
        return [*out, text[at:]]

    def normalised(self, text: str) -> bytes:
        """The bytes of the pieces that a text's ids stand for."""
        if self.exact:
            return (" " + text if self.prefix and text else text).encode("utf-8", "surrogatepass")
        return self.tokenizer.normalizer.normalize_str(text).replace(SPACE, " ").encode("utf-8", "surrogatepass")

    def come_back(self, ids: np.ndarray, counts: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether each text's pieces, joined, are the text as normalised: a look-up of all ids at once, which :meth:`decode` agrees with."""
        joined = memoryview(self.bytes.take(pa.array(ids)).buffers()[2] or b"").cast("B")
        ends = np.r_[0, np.cumsum(self.sizes[ids])][np.r_[0, np.cumsum(counts)]].tolist()
        return [joined[a:b] == self.normalised(t) for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)]

    def checked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool | None], list[bool]]:
        """(ids of all texts, ids per text, equal to the reference's, decoded to the normalised text)."""
        cut = [self.parts(t) for t in texts]
        flat = [p for parts in cut for p in parts]
        own = [x.ids for x in self.tokenizer.encode_batch_fast(flat, add_special_tokens=False)]
        if self.reference is None:
            same = [None] * len(flat)
        else:
            same = [a == b for a, b in zip(own, self.reference.encode(flat, num_threads=self.threads), strict=True)]
        counts = np.array([len(x) for x in own], dtype=np.int64)
        ids = np.concatenate([np.array(x, dtype=np.int32) for x in own]) if own else np.empty(0, np.int32)
        back = self.come_back(ids, counts, flat)
        ends = np.cumsum([0, *map(len, cut)])
        every = lambda x: [None if None in x[a:b] else all(x[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return ids, np.add.reduceat(counts, ends[:-1]) if texts else counts, every(same), every(back)

    def encode(self, texts: list[str]) -> list[list[int]]:
        flat, sizes, _, _ = self.checked(texts)
        return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] if texts else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def _codec(data: bytes) -> Codec:
    return Codec(data)


_CHUNK_CHARS, _CHUNK_TEXTS = 500_000, 1000
FIELDS = "n_tokens bigint, token_ids array<int>, parity boolean, round_trip boolean"


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        if chunk and (size + len(t) > _CHUNK_CHARS or len(chunk) == _CHUNK_TEXTS):
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t)
    if chunk:
        yield chunk


def encode_documents(spark: SparkSession, docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_tokens, token_ids (the rebuilt tokenizer's), parity with the reference library (null without it), and round_trip (the ids decode to the text as normalised).

    A map without a shuffle; the model file is broadcast. Null and empty texts
    have no tokens and are at parity. Null keys stay, repeated rows stay
    repeated, an empty table gives no rows, other columns are left out. Long
    texts are encoded whole, a chunk of few texts at a time.
    """
    with open(model_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for batch in batches:
            at = 0
            for chunk in _chunks([t.as_py() or "" for t in batch.column("text")]):
                flat, sizes, parity, back = codec.checked(chunk)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, len(chunk)), pa.array(sizes), ids, pa.array(parity, pa.bool_()), pa.array(back, pa.bool_())], names=[key, "n_tokens", "token_ids", "parity", "round_trip"])
                at += len(chunk)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(releasing(run), f"`{key}` {kind}, {FIELDS}")


def decode_documents(spark: SparkSession, encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """The key and the text of each row's ids; null ids give a null text."""
    with open(model_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for batch in batches:
            for a in range(0, batch.num_rows, _CHUNK_TEXTS):
                part = batch.slice(a, _CHUNK_TEXTS)
                rows = part.column("ids").to_pylist()
                texts = codec.decode([r or [] for r in rows])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([None if r is None else t for r, t in zip(rows, texts, strict=True)], pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")
