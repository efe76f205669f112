"""Dictionary-compressed WARC files (.warc.zst).

A file begins with a skippable frame (magic 0x184D2A5D) that holds a zstandard dictionary, itself
compressed, trained on the first records of the file; every record follows as a zstandard frame of its own.
Of records with equal payloads one is a response and the others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import atomic_output, open_input, run_uri, slices, task_each, texts_of, written

DICTIONARY_FRAME = 0x184D2A5D  # fixed values of the format, as the two below
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # pages carry no time
MANIFEST = "path string, shard long, records long, bytes long"
RECORDS = "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, own_id: str, first_url: str | None = None, first_id: str | None = None) -> bytes:
    """One WARC/1.1 record. own_id: its record id. A revisit refers to its response's record id, url and date in the
    standard's fields. The payload's full size, the page_id and the response's page_id are in extension
    fields (X-...), so that a reader needs no other table; a line break in a url becomes %0A or %0D."""
    clean = lambda u: u.replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {own_id}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {first_id}", f"WARC-Refers-To-Target-URI: {clean(first_url or '')}", f"WARC-Refers-To-Date: {DATE}"] if revisit else []
    head += [f"X-Refers-To-Page-ID: {refers_to}"] if revisit and refers_to is not None else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def record_id(*name: object) -> str:
    """The same for the same name: a task that is run again gives its records the ids they had."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, name)))}>"


def parse_record(record: bytes) -> tuple:
    """A row of RECORDS. A response's digest is checked against its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    number = lambda k: int(fields[k]) if k in fields else None
    block, digest = rest[: int(fields["Content-Length"])], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    if payload is not None and (base32_sha1(payload) != digest or len(payload) != number("X-Payload-Length")):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return number("X-Page-ID"), fields["WARC-Target-URI"], fields["WARC-Record-ID"], fields["WARC-Type"], number("X-Payload-Length"), digest, number("X-Refers-To-Page-ID"), payload


def train(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A dictionary of at most `size` bytes; where the samples are too few to train, their bytes themselves."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_shard(out, records: Iterator[bytes], sample_bytes: int, dict_bytes: int, level: int) -> int:
    """Holds the first sample_bytes of records for the dictionary, then streams. Returns the number of records."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= sample_bytes:
            break
    dictionary = train(held, dict_bytes)
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    press, n = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True), 0
    for many in (held, records):
        for r in many:
            out.write(press.compress(r))
            n += 1
    return n


def read_shard(file, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of a file, one frame after another; holds a record and `step` bytes."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no leading dictionary frame")
    data = zstandard.ZstdDecompressor().decompress(file.read(size))
    trained = data[:4] == b"\x37\xa4\x30\xec"
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT))
    rest = file.read(step)
    while rest:
        frame, parts = unpack.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data or file.read(step)
                break
            rest = file.read(step)
            if not rest:
                raise ValueError("the file ends within a record")
        yield b"".join(parts)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with revisit (boolean), refers_to, first_url and shared (others
    have the same html): of rows with equal html of min_bytes or
    more, the one with the least page_id (null last), then url, is no revisit, the others name it.

    Digests, ids and urls alone are grouped, with partial sums, so a payload shared by a third of all rows gives a few
    rows for each task. Payloads that occur more than once are written out and joined from there: where they are
    small, no page is shuffled; else a hot payload's rows can be split by the adaptive join. Only where a first row
    is repeated as a whole must rows be told apart by number; then the pages are written out once with numbers.
    """
    digest = F.unhex(F.sha1(F.col("html").cast("binary")))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", digest)
    long = keyed.where(F.octet_length("html") >= min_bytes)
    place = [F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("url").alias("url")]
    rows = long.groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    groups = rows.groupBy("digest").agg(F.min(F.struct(*place, F.col("n"))).alias("first"), F.sum("n").alias("n")).where("n > 1")
    repeated = written(groups.select("digest", F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"), F.col("first.n").alias("first_n")), "warc-repeated")
    is_first = F.col("page_id").eqNullSafe(F.col("first_page")) & (F.col("url") == F.col("first_url"))
    if repeated.where("first_n > 1").limit(1).count():
        keyed = written(keyed.withColumn("row", F.monotonically_increasing_id()), "warc-pages")
        candidates = keyed.join(repeated, "digest").where(is_first).groupBy("digest").agg(F.min("row").alias("first_row"))
        repeated = written(repeated.join(candidates, "digest"), "warc-repeated")
        is_first = F.col("row") == F.col("first_row")
    revisit = F.coalesce(F.col("first_n").isNotNull() & ~is_first, F.lit(False))
    return keyed.join(repeated, "digest", "left").select(
        "page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first_page")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("first_url"), F.col("first_n").isNotNull().alias("shared")
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, dict_bytes: int = 64 << 10, sample_bytes: int = 2 << 20, level: int = 3) -> DataFrame:
    """A file for each task; returns the manifest. Null html counts as empty, null url as an empty one. An empty
    task writes no file. sample_bytes bounds the records that a file's dictionary is trained on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def records() -> Iterator[bytes]:
            for batch in (b for many in ([first], batches) for b in many):
                for part in slices(batch, "html"):
                    cols = [part.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "revisit", "first_url", "shared")]
                    for key, url, refers_to, revisit, first_url, shared, html in zip(*cols, texts_of(part.column("html")), strict=True):
                        payload = html.encode()
                        # of a shared payload there is one response, which revisits in other files name by its digest
                        response = record_id(path, "response", base32_sha1(payload)) if shared else None
                        own = response if shared and not revisit else record_id(path, shard, next(number))
                        yield make_record(key, url, payload, refers_to, revisit, own, first_url, response)

        shard, number = TaskContext.get().partitionId(), count()
        name = f"{path}/part-{shard:06d}.warc.zst"
        with atomic_output(name) as out:
            n = write_shard(out, records(), sample_bytes, dict_bytes, level)
            size = out.tell()
        yield pa.RecordBatch.from_pylist([{"path": name, "shard": shard, "records": n, "bytes": size}])

    return with_revisits(pages, min_bytes).mapInArrow(run, MANIFEST)


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """RECORDS of the files (a few names for each terabyte), a task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for at in batch.column("id").to_pylist():
                rows, size = [], 0
                with open_input(paths[at]) as file:
                    for record in read_shard(file):
                        rows.append(parse_record(record))
                        size += len(record)
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return task_each(spark, len(paths)).mapInArrow(run, RECORDS)


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to a new folder in the shared folder and reads the files back."""
    spark = pages.sparkSession
    manifest = write_warc(pages, run_uri(spark, "warc"), **options).collect()
    return read_warc(spark, [m["path"] for m in manifest])
