"""Packing, plane files and byte-level BPE against the tokenizer libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from cases import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keelson.llm import byte_bpe, packing, planes
from keelson.llm.common import SEGMENT, IdTable, JsonTokenizer, WordTokenizer, disputed, id_table, json_encoder, segment_begins, segment_ids, text_bytes


@pytest.fixture(scope="module")
def direct():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


PIECES = st.lists(st.one_of(st.sampled_from([" ", "\n", "  ", "\t", "'s", "'ll", "<|endoftext|>", "\x1c", "\xa0", "　", "_", "²"]), st.text(max_size=6)), max_size=15).map("".join)


@given(st.lists(PIECES, max_size=5))
@settings(max_examples=200, deadline=None)
def test_segments_encode_as_the_whole(direct, tik, texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in json_encoder("byte_bpe_50k.json")(texts)] == [direct(t) for t in texts]
    own = byte_bpe.ByteBpe.of("byte_bpe_50k.tiktoken")
    ids = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert ids == [tik.encode_ordinary(t) for t in texts]
    assert [own.decode(x) for x in ids] == [t.encode() for t in texts]


def test_characters_of_any_age(direct, tik):
    """Letters that are newer than one of the libraries, among other letters, signs and digits."""
    own, by_json = byte_bpe.ByteBpe.of("byte_bpe_50k.tiktoken"), json_encoder("byte_bpe_50k.json")
    some = [chr(c) for c in (*range(0x20, 0x3000, 3), *range(0xA000, 0xD800, 7), *range(0xE000, 0x33500, 11))]
    for form in ("{0}'s", "a{0}'s x{0} {0}1", "'{0}!"):
        texts = [form.format(c) for c in some]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [tik.encode_ordinary(t) for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in by_json(texts)] == [direct(t) for t in texts]


@given(st.lists(st.one_of(st.none(), PIECES), max_size=6), st.integers(0, 2), st.booleans())
@settings(max_examples=300, deadline=None)
def test_segments_of_a_column(direct, texts, skip, full):
    """Cut by arrays as by the pattern, and encoded as the whole, by a table that is emptied each time too."""
    column, table = pa.array(texts, pa.string())[skip:], id_table("byte_bpe_50k.json")
    texts = [t or "" for t in texts[skip:]]
    data, ends = text_bytes(column)
    begins = segment_begins(data, ends)
    want = [x for t in texts for x in ([t] if disputed(t) else SEGMENT.findall(t)) if x]
    assert [data[a:b].tobytes().decode() for a, b in zip(begins, [*begins, len(data)][1:], strict=True)] == want
    most, table.most = table.most, 0 if full else table.most
    assert [np.frombuffer(x, "<u4").tolist() for x in segment_ids(column, table)] == [direct(t) for t in texts]
    table.most = most


def test_column_with_characters_of_any_age(direct):
    some = [chr(c) for c in (*range(0x20, 0x3000, 5), *range(0xA000, 0xD800, 17), *range(0xE000, 0x33500, 37))]
    texts = [form.format(c) for c in some for form in (" {0}", "{0}'s", "a{0}'s x{0} {0}1", "'{0}!")]
    got = segment_ids(pa.array(texts), id_table("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [direct(t) for t in texts]


def test_a_table_keeps_repeated_segments_only(direct):
    """What a worker holds is bounded, however many distinct words its texts have; ids stay the same."""
    table = IdTable(JsonTokenizer("byte_bpe_50k.json").flat, most=100)
    for at in range(0, 3000, 60):
        texts = [" ".join(f"the cat{i} sat" for i in range(at, at + 60)), None, "the end"]
        assert [np.frombuffer(x, "<u4").tolist() for x in segment_ids(pa.array(texts), table)] == [direct(t or "") for t in texts]
        assert len(table.words) <= 100 and len(table.index) == len(table.words) == len(set(table.words))
    assert {b" the", b" sat"} <= set(table.words) and table.cleared > 10


def test_tables_of_workers_are_small():
    table = id_table("byte_bpe_50k.json")
    segment_ids(pa.array([" ".join(f"{i:x}q" for i in range(at, at + 40_000)) for at in range(0, 400_000, 40_000)]), table)
    assert len(table.words) <= 300_000
    table.clear()


@given(st.lists(st.integers(1, 70), max_size=40), st.integers(1, 16))
@settings(max_examples=200, deadline=None)
def test_block_is_packed_without_gaps(lengths, capacity):
    pieces = packing.pack_block(lengths, capacity)
    for i, n in enumerate(lengths):
        own = sorted((s, k) for j, s, k, _, _ in pieces if j == i)
        assert [s for s, _ in own] == [sum(k for _, k in own[:x]) for x in range(len(own))] and sum(k for _, k in own) == n
    fill = {}
    for _, _, k, seq, at in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert at == fill.get(seq, 0)
        fill[seq] = at + k
    assert sorted(fill) == list(range(len(fill))) and sum(n < capacity for n in fill.values()) <= 1 and max(fill.values(), default=0) <= capacity


def test_costs_are_balanced():
    pieces = packing.pack_block([1000] * 8 + [100] * 84, 2048)
    cost = {}
    for _, _, n, seq, _ in pieces:
        cost[seq] = cost.get(seq, 0) + n + n * n / 2048
    assert max(cost.values()) < 1.3 * min(c for s, c in cost.items() if s < max(cost))


def check_packed(rows, expected, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    got = sorted(((k[0], np.frombuffer(b"".join(bytes(r["ids"]) for r in sorted(v, key=lambda r: r["start"])), "<u4").tolist()) for k, v in by_doc.items()), key=str)
    assert got == sorted(expected, key=str)
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))] and sum(r["length"] for r in own) <= capacity


def test_pack_awkward(awkward, direct):
    rows = packing.pack(awkward.dropDuplicates(["doc_id", "text"]), capacity=64, block_tokens=256).collect()
    check_packed(rows, [(i, direct(t or "") + [1]) for i, t in dict.fromkeys(AWKWARD)], 64)


def test_pack_repeated_rows_and_nothing(awkward, empty):
    assert sum(r["length"] for r in packing.pack(awkward.where("doc_id = 5")).collect()) == 2 * packing.pack(awkward.where("doc_id = 5").limit(1)).collect()[0]["doc_tokens"]
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(empty, capacity=0)


def test_pack_sample_pads_little(sample, direct):
    rows = packing.pack(sample).collect()
    check_packed(rows, [(r["doc_id"], direct(r["text"] or "") + [1]) for r in sample.collect()], 2048)
    lengths = {}
    for r in rows:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert packing.padding(list(lengths.values()), 2048) < 2048 * sample.rdd.getNumPartitions()
    assert packing.padding([2048, 1024, 3], 2048) == 2045


@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.sampled_from(["bit", "byte"]))
def test_planes_are_lossless(ids, kind):
    data = np.array(ids, np.uint32)
    assert planes.join_planes(planes.split_planes(data, kind), len(data), kind).tolist() == ids


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_plane_files(awkward, direct, kind):
    rows = planes.plane_round_trip(awkward, block=100, kind=kind).orderBy("start").collect()
    want = sorted(((i, t or "") for i, t in AWKWARD), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in rows] == [i for i, _ in want]
    at = 0
    for r, (_, t) in zip(rows, want, strict=True):
        ids = direct(t) + [2]
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_plane_files_of_nothing(empty):
    assert planes.plane_round_trip(empty).count() == 0


def test_files_roll_and_read_back_alike(spark, sample, tmp_path):
    docs = sample.select("doc_id", "text").repartition(3)
    whole = planes.read_planes(spark, planes.write_planes(docs, str(tmp_path / "a")).collect())
    manifest = planes.write_planes(docs, str(tmp_path / "b"), file_bytes=20_000, block=1 << 10).collect()
    assert len(manifest) > 8 and all(m["bytes"] < 200_000 or m["docs"] == 1 for m in manifest)
    assert sorted(map(tuple, planes.read_planes(spark, manifest).collect())) == sorted(map(tuple, whole.collect()))


def test_cut_file_is_refused(awkward, tmp_path):
    manifest = planes.write_planes(awkward, str(tmp_path)).collect()[0]
    data = open(manifest["path"], "rb").read()
    (tmp_path / "cut").write_bytes(data[:-5])
    with pytest.raises(ValueError, match="cut short"):
        planes.PlaneReader(open(tmp_path / "cut", "rb"), len(data) - 5)


def test_bpe_awkward(awkward, empty, tik):
    rows = byte_bpe.decode(byte_bpe.encode(awkward)).collect()
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in rows), key=str) == sorted(((i, tik.encode_ordinary(t or ""), (t or "").encode()) for i, t in AWKWARD), key=str)
    assert byte_bpe.decode(byte_bpe.encode(empty)).count() == 0


def test_words_merged_side_by_side(direct):
    """As the library does one by one; long words, signs at the end, and what is no word, too."""
    r = random.Random(5)
    words = ["".join(r.choices("aeinorstTÉç日ʰ", k=r.randint(1, 12))) + r.choice(["", ".", "'", "$$", "1"]) for _ in range(3000)]
    words += ["", "'s", ".", "a.", "ab" * 31 + "a", "ab" * 32, "ab" * 4000 + ",", "12", "\u3000"]
    some = [" " + w for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in WordTokenizer("byte_bpe_50k.json").encode(some)] == list(map(direct, some))
