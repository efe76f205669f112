"""Media columns: payloads kept as 8-bit mono WAV members of ZIP archives, read by a Spark data source.

Writing: each task streams its rows into one archive (deflated members, one member for each row). Reading:
the driver lists the folder's archives and plans byte ranges over them; a task reads the directory of its
archive, takes the members that begin in its range, and streams them in Arrow batches of bounded size.
A member is read by its offset and checked against the directory's size and CRC; a read that fails is tried
again for that member alone.
"""

from __future__ import annotations

import contextlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import atomic_output, filesystem, open_input, run_uri, slices, texts_of

RATE, BLOCK = 8000, 64
MEMBER = "doc_id long, n_bytes long, archive string, offset long, payload binary, media binary"
MANIFEST = "path string, members long, bytes long"


def padded(data: bytes) -> bytes:
    """data with bytes 0 appended up to a positive multiple of BLOCK."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def to_wav(payload: bytes) -> bytes:
    """A RIFF file of unsigned 8-bit mono samples; payload must have an even size, as all padded ones do."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of the data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def write_media(docs: DataFrame, path: str, level: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An archive for each task, a member for each row; returns the manifest. Null text counts as empty; the
    member's name holds its number, doc_id ("null" if there is none) and unpadded size. An empty task writes no
    archive. Archives appear complete or not at all, so a repeated task replaces its own by an equal one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name, members = f"{path}/part-{TaskContext.get().partitionId():06d}.zip", 0
        with atomic_output(name) as out:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as archive:
                for batch in (b for many in ([first], batches) for b in many):
                    for part in slices(batch, "text"):
                        for key, text in zip(part.column("doc_id").to_pylist(), texts_of(part.column("text")), strict=True):
                            data = text.encode()
                            info = zipfile.ZipInfo(f"{members}/{'null' if key is None else key}/{len(data)}.wav")
                            info.compress_type, info._compresslevel = zipfile.ZIP_DEFLATED, level
                            archive.writestr(info, to_wav(padded(data)))
                            members += 1
            size = out.tell()
        yield pa.RecordBatch.from_pylist([{"path": name, "members": members, "bytes": size}])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, MANIFEST)


# ---------------------------------------------------------------- the data source


class ByteRange(InputPartition):
    def __init__(self, archive: str, begin: int, end: int):
        super().__init__((archive, begin, end))
        self.archive, self.begin, self.end = archive, begin, end


class HeldFile:
    """Gives one open file for member after member, and a new one after an error."""

    def __init__(self, uri: str):
        self.uri, self.file = uri, None

    @contextlib.contextmanager
    def __call__(self) -> Iterator[pa.NativeFile]:
        if self.file is None:
            self.file = open_input(self.uri)
        try:
            yield self.file
        except BaseException:
            self.close()
            raise

    def close(self) -> None:
        held, self.file = self.file, None
        with contextlib.suppress(OSError):
            if held:
                held.close()


def read_member(open_file, offset: int, packed: int, size: int, crc: int, method: int, tries: int = 3, wait_s: float = 0.2) -> bytes:
    """The member whose local header is at offset. open_file: gives a file each time it is called, a new one after an error."""
    for attempt in range(tries):
        try:
            with open_file() as file:
                file.seek(offset)
                head = file.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise OSError(f"no member at {offset}")
                file.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                data = file.read(packed)
                data = zlib.decompress(data, -15) if method == zipfile.ZIP_DEFLATED else data
                if len(data) != size or zlib.crc32(data) != crc:
                    raise OSError(f"member at {offset} is damaged")
            return data
        except (OSError, zlib.error):
            if attempt + 1 == tries:
                raise
            time.sleep(wait_s * 2**attempt)
    raise AssertionError


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes, self.batch_bytes, self.tries = (int(options.get(k, v)) for k, v in (("rangeBytes", 8 << 20), ("batchBytes", 4 << 20), ("tries", 3)))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of every archive in the folder. The driver sees names and sizes only, not directories."""
        fs, folder = filesystem(self.path)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".zip"))
        root = self.path.rstrip("/")
        return [ByteRange(f"{root}/{path.rsplit('/', 1)[1]}", at, min(at + self.range_bytes, size)) for path, size in found for at in range(0, size, self.range_bytes)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, ByteRange):  # Spark's plan of an empty folder
            return
        with open_input(partition.archive) as file, zipfile.ZipFile(file) as archive:
            members = [m for m in archive.infolist() if partition.begin <= m.header_offset < partition.end]
        rows, held, file = [], 0, HeldFile(partition.archive)
        for m in members:
            media = read_member(file, m.header_offset, m.compress_size, m.file_size, m.CRC, m.compress_type, self.tries)
            key, n = m.filename.removesuffix(".wav").split("/")[1:]
            rows.append((None if key == "null" else int(key), int(n), partition.archive, m.header_offset, from_wav(media), media))
            held += 2 * len(media)
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        file.close()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "archive", "offset", "payload", "media"])


class ArchiveSource(DataSource):
    """Options: path (folder of archives), rangeBytes, batchBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every member of the folder's archives: doc_id, n_bytes, archive, offset, payload (samples), media (the file)."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def signal_feature(payload: bytes) -> str:
    """Mean, root mean square and zero crossings of the samples, and their histogram in 16 bins, to fixed digits."""
    units = np.frombuffer(payload, np.uint8)
    x = units.astype(np.float64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    bins = np.bincount(units >> 4, minlength=16) / max(1, len(units))
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zc={crossings};hist=" + ",".join(f"{b:.4f}" for b in bins)


def features(payload: str) -> Column:
    """signal_feature of a binary column; null gives null."""

    def of(values: pd.Series) -> pd.Series:
        return values.map(signal_feature, na_action="ignore")

    return F.pandas_udf(of, "string")(payload)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Writes docs to archives in the shared folder and reads them back, with their features."""
    path = run_uri(docs.sparkSession, "media")
    write_media(docs, path).collect()
    return read_media(docs.sparkSession, path).withColumn("feature", features("payload"))
