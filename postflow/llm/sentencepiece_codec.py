"""SentencePiece encoding and decoding with the tokenizers library, rebuilt from the model's protobuf.

The protobuf is read field by field: pieces with scores and kinds, the model type, the normaliser. From these a tokenizers model is
made: Unigram from the scores, or BPE with the merges that the scores imply, with byte fallback; the metaspace marker stands for a space
and is put before a text where the model says so. If no piece holds a marker after another character and the normaliser changes nothing
but spaces, merges never reach over a space, so texts are encoded by their distinct chunks (spaces and the word after them), in
multithreaded batches; otherwise whole texts are encoded. Each distinct chunk is also encoded by the SentencePiece library, and a
document's parity flag says whether all its chunks agree; ids that differ are never silently kept: the flag is false.

Decoding turns ids to the bytes of their pieces (markers to spaces, byte pieces to bytes, the dummy prefix off).

Defined cases: a null or empty text has no ids; ids that the model lacks decode to nothing; bytes that are not UTF-8 after decoding become
U+FFFD; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ranges, segment_hash, slices, utf8
from .word_ids import WordIds

#: Kinds of pieces and model types in the protobuf. Fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
ENCODED = "doc_id bigint, n_ids bigint, ids_crc32 bigint, n_byte_ids bigint, parity boolean, round_trip boolean, ids binary"
_WORKER: dict[bytes, "Codec"] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def proto_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message: varints as int, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass
class Model:
    """What the protobuf says."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        m = cls()
        for number, value in proto_fields(raw):
            if number == 1:
                piece = dict(proto_fields(value))
                m.pieces.append(piece[1].decode())
                m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                m.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(proto_fields(value))
                m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(proto_fields(value))
                m.charsmap, m.dummy_prefix, m.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return m

    def by_chunks(self) -> bool:
        """Whether ids never depend on more than a chunk: the spaces before a word and the word."""
        return not self.charsmap and not self.squeeze and not any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER_DEFINED))

    def merges(self) -> list[tuple[str, str]]:
        """All ways to put a piece together from two, the best-scored pieces first."""
        usable = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER_DEFINED)}
        found = [(-self.scores[i], i, usable[p[:c]], usable[p[c:]], p[:c], p[c:]) for p, i in usable.items() for c in range(1, len(p)) if p[:c] in usable and p[c:] in usable]
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self, prefix: bool):
        from tokenizers import Regex, Tokenizer, models, normalizers

        unk = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), None)
        if self.kind == UNIGRAM:
            model = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), unk, self.byte_fallback)
        elif self.kind == BPE:
            model = models.BPE({p: i for i, p in enumerate(self.pieces)}, self.merges(), unk_token=None if unk is None else self.pieces[unk], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if prefix and self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        tok = Tokenizer(model)
        tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        return tok


class Codec:
    """Encodes and decodes buffers of texts."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = m = Model.parse(raw)
        self.chunked = m.by_chunks()
        self.tok = m.tokenizer(prefix=not self.chunked)
        self.check = sentencepiece.SentencePieceProcessor(model_proto=raw)
        table = [b"" if k in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]
        self.size = np.array([len(x) for x in table], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.is_byte = np.array(m.kinds) == BYTE
        self.differs: set[int] = set()
        self.words = WordIds(self._encode)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts (with the first dummy space written out, if chunked), and after them a 1 if the libraries differ."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"  # another operator may have turned it off in this worker
        found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        plain = [t[1:] if self.chunked and self.model.dummy_prefix else t for t in texts]
        want = self.check.encode(plain, num_threads=1)
        mark = [self.check.piece_to_id(MARK)]
        want = [mark if t == " " and not p else w for t, p, w in zip(texts, plain, want, strict=True)]  # SentencePiece gives an empty text no prefix
        return [[*f, int(f != w)] for f, w in zip(found, want, strict=True)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the offsets of the rows' ids, and the rows' parity."""
        buf, offs = utf8(column)
        n = len(offs) - 1
        if self.chunked:
            space = buf == 32
            cut = space.copy()
            cut[1:] &= ~space[:-1]
            heads = offs[:-1][np.diff(offs) > 0]
            cut[heads] = True
            starts = np.flatnonzero(cut)
            first = np.zeros(len(buf), bool)
            first[heads] = True
            first = first[starts]
        else:
            starts, first = offs[:-1][np.diff(offs) > 0], np.zeros(int((np.diff(offs) > 0).sum()), bool)
        ends = np.r_[starts[1:], len(buf)][: len(starts)]
        row = np.searchsorted(offs, starts, "right") - 1
        hashed = segment_hash(buf, starts, ends)
        if self.chunked and self.model.dummy_prefix:
            hashed = np.where(first, ~hashed, hashed)
        text = lambda i: (" " if self.chunked and self.model.dummy_prefix and first[i] else "") + buf[starts[i] : ends[i]].tobytes().decode()
        flat, count = self.words(hashed, text)
        last = np.cumsum(count) - 1
        bad = np.bincount(row, flat[last], n) if len(row) else np.zeros(n)
        keep = np.ones(len(flat), bool)
        keep[last] = False
        total = np.bincount(row, count - 1, n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
        return flat[keep], np.r_[0, np.cumsum(total)], bad == 0

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows and the offsets of each."""
        known = np.minimum(ids, len(self.size) - 1).astype(np.int64)
        size = np.where(ids < len(self.size), self.size[known], 0)
        start = self.start[known]
        if self.model.dummy_prefix:
            first = cut[:-1][np.diff(cut) > 0]
            prefixed = first[(size[first] > 0) & (self.bytes[np.minimum(start[first], len(self.bytes) - 1)] == 32)]
            start = start.copy()
            start[prefixed] += 1
            size[prefixed] -= 1
        offs = np.r_[0, np.cumsum(size)][cut]
        return self.bytes[ranges(start, size)], offs


def _codec(raw: bytes) -> Codec:
    if raw not in _WORKER:
        _WORKER[raw] = Codec(raw)
    return _WORKER[raw]


def encode(docs: DataFrame, model: str | None = None, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: counts, checksum and flags, and the ids (little-endian unsigned 32 bit) if wanted."""
    with open(model or default_model(), "rb") as f:
        raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, cut, parity = codec.encode(part.column("text"))
                back, b_offs = codec.decode(ids, cut)
                buf, offs = utf8(part.column("text"))
                same = np.diff(offs) == np.diff(b_offs)
                if same.all() and len(buf):
                    wrong = np.r_[0, np.cumsum(buf != back)]
                    same &= wrong[offs[1:]] == wrong[offs[:-1]]
                elif not same.all():
                    same &= [buf[a:b].tobytes() == back[c:d].tobytes() for a, b, c, d in zip(offs, offs[1:], b_offs, b_offs[1:], strict=False)]
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B") if len(ids) else memoryview(b"")
                cuts = [view[4 * a : 4 * b] for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
                bytes_ = np.r_[0, np.cumsum(codec.is_byte[ids])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_ids": pa.array(np.diff(cut)),
                        "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                        "n_byte_ids": pa.array(bytes_[cut[1:]] - bytes_[cut[:-1]]),
                        "parity": pa.array(parity),
                        "round_trip": pa.array(same),
                        "ids": pa.array([c.tobytes() for c in cuts] if with_ids else [None] * len(cuts), pa.binary()),
                    }
                )

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = own.mapInArrow(run, ENCODED)
    return found if with_ids else found.drop("ids")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids, as `encode` gives them."""
    with open(model or default_model(), "rb") as f:
        raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw)
        for batch in batches:
            blobs = [x or b"" for x in batch.column("ids").to_pylist()]
            back, offs = codec.decode(np.frombuffer(b"".join(blobs), "<u4"), np.r_[0, np.cumsum([len(b) // 4 for b in blobs])].astype(np.int64))
            texts = [back[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs, offs[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
