"""Byte-level BPE through sentencepiece: the vocabulary serialised as a sentencepiece BPE model.

Each token's bytes map to the characters U+0100 to U+01FF, one for each byte, which sentencepiece neither
normalises nor treats as space; its score is its negative rank, so the merge of least rank goes first;
normalisation is the identity. Pre-tokens of the public pattern are encoded one by one, a pre-token that is
itself in the vocabulary as that token. Decoding is the inverse map from ids to bytes.
"""

from __future__ import annotations

import base64
import os
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SegmentEncoder, disputed, slices, texts_of

_TO_CHARS = {b: 0x100 + b for b in range(256)}


def read_ranks(name: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank on each line."""
    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    with open(name, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes are length-delimited, floats 32-bit, integers (negative: 64-bit two's complement) varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value % (1 << 64))


def sentencepiece_model(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """The serialised model, and the rank of each of its ids (id 0 is the unknown piece, which no byte needs).

    Field numbers and enum values are those of sentencepiece's public model format.
    """
    order = sorted(ranks, key=ranks.get)
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, mapped(t).encode()) + _field(2, float(-ranks[t])) + _field(3, 1) for t in order]
    trainer = _field(3, 2) + _field(4, len(pieces)) + b"".join(_field(k, v) for k, v in ((40, 0), (41, -1), (42, -1), (43, -1)))
    normaliser = _field(1, b"identity") + _field(2, b"") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser), [-1, *(ranks[t] for t in order)]


class ByteBpe:
    """Encoder and decoder over one vocabulary; one for each Python worker."""

    _held: dict[str, ByteBpe] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece
        from tokenizers import Regex, pre_tokenizers

        model, rank_of = sentencepiece_model(ranks)
        self.ranks, self.find, self.rank_of = ranks, regex.compile(pattern).findall, rank_of
        self.split = pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str  # slower, but of the libraries' own age
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.segments = SegmentEncoder(self._encode)

    @classmethod
    def of(cls, vocabulary: str) -> ByteBpe:
        if vocabulary not in cls._held:
            import public_tokenizers

            cls._held[vocabulary] = cls(read_ranks(vocabulary), public_tokenizers.PATTERN)
        return cls._held[vocabulary]

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts = [[p.encode() for p in ([x for x, _ in self.split(t)] if disputed(t) else self.find(t))] for t in texts]
        new = list({p for p in chain.from_iterable(parts) if p not in self.ranks})
        rank_of = self.rank_of.__getitem__
        ids = dict(zip(new, ([*map(rank_of, x)] for x in self.model.encode([mapped(p) for p in new], num_threads=1)), strict=True)) if new else {}
        return [array("I", [i for p in some for i in ((self.ranks[p],) if p in self.ranks else ids[p])]).tobytes() for some in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ranks as little-endian unsigned 32-bit integers."""
        return self.segments(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; null or empty text: no ids. Other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids = bpe.encode(texts_of(part.column("text")))
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """encoded with decoded (binary), the bytes of the ids. Null ids: no bytes. An id outside the vocabulary fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(vocabulary)
        for batch in batches:
            size = 500
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                data = [bpe.decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(data, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
