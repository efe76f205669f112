"""WARC files and media archives: round trips, revisits, damage and retries."""

import base64
import hashlib
import io
import struct
import zipfile
import zlib

import pytest
import zstandard
from cases import AWKWARD

from keelson.llm import common, media, warc

PAGES = [(3, "http://a/", "<p>same</p>"), (1, "http://b/\r\nX: y", "<p>same</p>"), (2, None, None), (4, "http://c/", ""), (None, "http://d/", "<p>same</p>"), (7, "http://e/", "né" * 5000), (7, "http://e/", "né" * 5000), (8, "http://f/", "a\r\n\r\nb")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    rows = warc.warc_round_trip(pages(spark).repartition(3)).collect()
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    want = [("1", 11, digest("<p>same</p>"), "response", None), ("2", 0, digest(""), "response", None), ("3", 11, digest("<p>same</p>"), "revisit", 1), ("4", 0, digest(""), "revisit", 2), ("7", 15000, digest("né" * 5000), "response", None), ("7", 15000, digest("né" * 5000), "revisit", 7), ("8", 6, digest("a\r\n\r\nb"), "response", None), ("None", 11, digest("<p>same</p>"), "revisit", 1)]
    assert got == want
    assert {bytes(r["payload"]).decode() for r in rows if r["payload"] is not None} == {"<p>same</p>", "", "né" * 5000, "a\r\n\r\nb"}


def test_small_payloads_can_be_exempt(spark):
    rows = warc.warc_round_trip(pages(spark), min_bytes=12).collect()
    assert sorted(r["page_id"] for r in rows if r["record_type"] == "revisit") == [7]


def test_warc_of_nothing(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_file_form():
    out = io.BytesIO()
    records = [warc.make_record(i, f"http://x/{i}", b"<html>some page text here</html>" * 5, None, False, warc.record_id("a", i)) for i in range(300)]
    assert warc.write_shard(out, iter(records), 1 << 16, 4096, 3) == 300
    data = out.getvalue()
    assert struct.unpack("<I", data[:4])[0] == 0x184D2A5D
    assert list(warc.read_shard(io.BytesIO(data), step=100)) == records
    assert len(data) < sum(map(len, records)) // 3
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_shard(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(records[0].replace(b"some page", b"xxxx page", 1))


def test_record_ids_are_unique_and_revisits_name_their_response(spark):
    rows = [(1, "u/1", "same"), (1, "u/1", "same"), (2, "u/2", "same"), (3, "u/3", "other"), (3, "u/3", None), (None, None, ""), (4, "u/4", "same")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for least in (0, 5):
        manifest = warc.write_warc(pages, warc.run_uri(spark, "warc"), min_bytes=least).collect()
        heads = []
        for m in manifest:
            with open(m["path"].removeprefix("file:"), "rb") as file:
                heads += [dict(x.split(": ", 1) for x in r.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for r in warc.read_shard(file)]
        ids = {h["WARC-Record-ID"]: h for h in heads}
        assert len(heads) == len(rows) == len(ids)
        revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
        assert len(revisits) == (11 if least == 0 else 1)
        for h in revisits:
            first = ids[h["WARC-Refers-To"]]
            assert first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
            assert (first["WARC-Target-URI"], first["WARC-Date"]) == (h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"])


def test_a_shared_folder_is_needed_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

            class _jsc:
                @staticmethod
                def sc():
                    return Cluster.sparkContext

            @staticmethod
            def getCheckpointDir():
                return Cluster

        isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_uri(Cluster)


def test_media_round_trip(spark, awkward):
    rows = media.media_round_trip(awkward.repartition(3)).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], bytes(r["payload"])) for r in rows)
    assert got == sorted((str(i), len((t or "").encode()), media.padded((t or "").encode())) for i, t in AWKWARD)
    for r in rows:
        assert media.to_wav(bytes(r["payload"])) == bytes(r["media"]) and media.from_wav(bytes(r["media"])) == bytes(r["payload"]) and r["feature"] == media.signal_feature(bytes(r["payload"]))


def test_padding():
    assert [len(media.padded(bytes(n))) for n in (0, 1, 63, 64, 65)] == [64, 64, 64, 64, 128]


def test_ranges_cover_each_member_once(spark, awkward, tmp_path):
    media.write_media(awkward.coalesce(1), str(tmp_path)).collect()
    whole = sorted(r["offset"] for r in media.read_media(spark, str(tmp_path)).collect())
    assert len(whole) == len(AWKWARD)
    assert sorted(r["offset"] for r in media.read_media(spark, str(tmp_path), rangeBytes=200, batchBytes=100).collect()) == whole
    assert len(media.ArchiveReader({"path": str(tmp_path), "rangeBytes": "200"}).partitions()) > 3


def test_media_of_nothing(spark, empty, tmp_path):
    assert media.write_media(empty, str(tmp_path)).count() == 0 and media.read_media(spark, str(tmp_path / "none")).count() == 0


def test_a_member_is_read_again_by_itself(tmp_path):
    file = tmp_path / "a.zip"
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("0/1/3.wav", b"one" * 50)
        z.writestr("1/2/3.wav", b"two" * 50)
    m = zipfile.ZipFile(file).infolist()[1]
    args = (m.header_offset, m.compress_size, m.file_size, m.CRC, m.compress_type)
    tries = []

    def unsteady():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("lost")
        return open(file, "rb")

    assert media.read_member(unsteady, *args, wait_s=0) == b"two" * 50 and len(tries) == 3
    damaged = bytearray(file.read_bytes())
    damaged[m.header_offset + 45] ^= 255
    with pytest.raises((OSError, zlib.error)):
        media.read_member(lambda: io.BytesIO(bytes(damaged)), *args, wait_s=0)
