"""Token-id files of shuffled planes.

Layout of a file (integers little-endian):

    magic "KPLN0001"
    chunks: each a block of `block` ids (the last may be shorter), transposed into planes, every plane a
        zstandard frame. Plane b of kind "byte" has byte b of every id, of kind "bit" bit b of every id.
        Planes above the block's largest id are all zero and aren't stored.
    index: one zstandard frame of JSON: kind, block, chunks [[offset, ids, [plane sizes]], ...], and the
        document table: doc_ids and token counts in file order
    trailer: index offset (8 bytes), index size (8 bytes), magic

The ids of all documents run on through the chunks, so a reader finds any id by its number in the file.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import atomic_output, id_table, open_input, run_uri, segment_ids, slices, task_each

MAGIC = b"KPLN0001"
MANIFEST = "path string, shard long, part long, docs long, tokens long, bytes long"
DOCS = "doc_id long, start long, n_tokens long, ids binary"


def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, least significant first, as far as the largest id needs them."""
    top = int(ids.max(initial=0)).bit_length()
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "byte":
        return [by_byte[b].tobytes() for b in range(max(1, -(-top // 8)))]
    if kind != "bit":
        raise ValueError(f"planes are bit or byte, not {kind}")
    return [np.packbits((by_byte[b // 8] >> (b % 8)) & 1, bitorder="little").tobytes() for b in range(max(1, top))]


def join_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        out = np.zeros((4, n), np.uint8)
        for b, plane in enumerate(planes):
            out[b] = np.frombuffer(plane, np.uint8)
        return np.ascontiguousarray(out.T).view("<u4").reshape(-1)
    ids = np.zeros(n, np.uint32)
    for b, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(b)
    return ids


class PlaneWriter:
    """Streams documents into one file; holds one block of ids and the document table."""

    def __init__(self, out, block: int, kind: str, level: int):
        self.out, self.block, self.kind, self.zstd = out, block, kind, zstandard.ZstdCompressor(level=level)
        self.at, self.chunks, self.doc_ids, self.counts, self.held, self.held_n = len(MAGIC), [], [], [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.held_n += len(ids) // 4
        if self.held_n >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(data) if last else len(data) - len(data) % self.block
        for at in range(0, whole, self.block):
            ids = data[at : at + self.block]
            planes = [self.zstd.compress(p) for p in split_planes(ids, self.kind)]
            self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
            for p in planes:
                self.out.write(p)
            self.at += sum(map(len, planes))
        self.held, self.held_n = ([data[whole:].tobytes()] if whole < len(data) else []), len(data) - whole

    def close(self) -> int:
        self._flush(True)
        index = zstandard.ZstdCompressor(level=3).compress(json.dumps({"kind": self.kind, "block": self.block, "chunks": self.chunks, "doc_ids": self.doc_ids, "counts": self.counts}).encode())
        self.out.write(index + struct.pack("<QQ", self.at, len(index)) + MAGIC)
        return self.at + len(index) + 24


class PlaneReader:
    """Reads the index, then chunks on demand."""

    def __init__(self, file, size: int):
        self.file, tail = file, 16 + len(MAGIC)
        file.seek(size - tail)
        trailer = file.read(tail)
        file.seek(0)
        if file.read(len(MAGIC)) != MAGIC or trailer[16:] != MAGIC:
            raise ValueError("not a plane file, or cut short")
        offset, length = struct.unpack("<QQ", trailer[:16])
        file.seek(offset)
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(file.read(length)))

    def chunk(self, k: int) -> np.ndarray:
        offset, n, sizes = self.index["chunks"][k]
        self.file.seek(offset)
        unpack = zstandard.ZstdDecompressor()
        return join_planes([unpack.decompress(self.file.read(s)) for s in sizes], n, self.index["kind"])

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, start in the file, ids) in file order; holds a chunk and a document at a time."""
        held, chunk, start = [], 0, 0
        have = 0
        for doc_id, n in zip(self.index["doc_ids"], self.index["counts"], strict=True):
            while have < n:
                held.append(self.chunk(chunk))
                have += len(held[-1])
                chunk += 1
            data = np.concatenate(held) if len(held) != 1 else held[0]
            yield doc_id, start, data[:n].tobytes()
            held, have, start = [data[n:]], have - n, start + n


def write_planes(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, block: int = 1 << 16, kind: str = "byte", level: int = 1, file_bytes: int = 256 << 20) -> DataFrame:
    """Encodes every document, appends end_id, and writes files for each range of doc_id, in ascending order over the
    files, the next one where one has file_bytes; returns the manifest (path, shard, part, docs, tokens, bytes), a row
    for each file.

    Null doc_ids come first; equal ones lie in the order of their texts; null text counts as empty. An empty
    table writes no file. Rows are dealt by sampled ranges of (doc_id, hash of the text), so that one doc_id
    with many rows is spread too. A task streams its rows into its file and renames it when complete, so a
    repeated attempt replaces the file by the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = id_table(vocabulary), int(end_id).to_bytes(4, "little")
        shard = TaskContext.get().partitionId()

        def encoded() -> Iterator[tuple]:
            for batch in batches:
                for part in slices(batch, "text", 2 << 20):
                    for doc_id, ids in zip(part.column("doc_id").to_pylist(), segment_ids(part.column("text"), table), strict=True):
                        yield doc_id, ids + end

        rows, part = encoded(), 0
        row = next(rows, None)
        while row is not None:
            name = f"{path}/shard-{shard:06d}-{part:06d}.planes"
            with atomic_output(name) as out:
                writer = PlaneWriter(out, block, kind, level)
                while row is not None and (not writer.counts or out.tell() < file_bytes):
                    writer.add(*row)
                    row = next(rows, None)
                size = writer.close()
            yield pa.RecordBatch.from_pylist([{"path": name, "shard": shard, "part": part, "docs": len(writer.counts), "tokens": sum(writer.counts), "bytes": size}])
            part += 1

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("part", F.xxhash64("text"))
    return keyed.repartitionByRange("doc_id", "part").sortWithinPartitions("doc_id", "part", "text").select("doc_id", "text").mapInArrow(run, MANIFEST)


def read_planes(spark: SparkSession, manifest: list) -> DataFrame:
    """The documents of the files in manifest (collected rows of write_planes; one for each file, so small):
    doc_id, start (ids of all documents before it, over all files), n_tokens, ids. A task for each file."""
    base, rows = 0, []
    for m in sorted(manifest, key=lambda m: (m["shard"], m["part"])):
        rows.append((m["path"], m["bytes"], base))
        base += m["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("id").to_pylist():
                path, length, base = rows[at]
                with open_input(path) as file:
                    held, size = [], 0
                    for doc_id, start, ids in PlaneReader(file, length).documents():
                        held.append((doc_id, base + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 8 << 20:
                            yield _batch(held)
                            held, size = [], 0
                    if held:
                        yield _batch(held)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    return task_each(spark, len(rows)).mapInArrow(run, DOCS)


def plane_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes docs to a new folder in the shared folder and reads the files back."""
    spark = docs.sparkSession
    manifest = write_planes(docs, run_uri(spark, "planes"), **options).collect()
    return read_planes(spark, manifest)
