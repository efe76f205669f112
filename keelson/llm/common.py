"""Shared pieces: the folder all executors see, batch slicing, cached tokenisation, segment sums."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import json
import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

# Unicode White_Space, a fixed value of the pre-tokenisation pattern's \s.
_WS = " \t-\r" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: White space with the word or the signs after it. No pre-token of the public pattern runs from a non-space
#: into a space, or from a letter or digit into any other sign, and none looks behind itself; so encoding
#: these one by one equals encoding the whole text. (Signs stay with the letters after them: "'s" is one.)
#: That holds for characters that Python and the pattern both take for letters or digits, or both for signs; see disputed().
SEGMENT = re.compile(rf"[{_WS}]*(?:[^\W_]+|(?:_|[^\w{_WS}])+[^\W_]*)|[{_WS}]+")


#: Code points but surrogates, which no UTF-8 has.
_EVERY = (*range(0xD800), *range(0xE000, 0x110000))


@functools.cache
def _kinds() -> np.ndarray:
    """Of every code point: 0 white space, 1 letter or digit, 2 sign, 3 disputed()."""
    out = np.full(0x110000, 2, np.uint8)
    every = "".join(map(chr, _EVERY))
    for kind, some in ((1, re.findall(r"[^\W_]", every)), (0, re.findall(rf"[{_WS}]", every)), (3, _disputed().findall(every))):
        out[list(map(ord, some))] = kind
    return out


@functools.cache
def _disputed() -> re.Pattern:
    """The characters that this Python and a newer Unicode table take for different kinds, most of them new letters: which
    one a tokenizer library follows depends on its own age."""
    import regex

    every = "".join(map(chr, (*range(0x250, 0xD800), *range(0xE000, 0x110000))))
    codes = sorted(map(ord, {*re.findall(r"[^\W_]", every)} ^ {*regex.findall(r"[\p{L}\p{N}]", every)}))
    first = [c for c, before in zip(codes, [-2, *codes], strict=False) if c != before + 1]
    last = [c for c, after in zip(codes, [*codes[1:], -2], strict=False) if c != after - 1]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last, strict=True)) + "]")


def disputed(text: str) -> bool:
    """Whether a text has such a character; then only the library itself may cut it."""
    if text.isascii():
        return False
    with contextlib.suppress(UnicodeEncodeError):
        text.encode("latin-1")
        return False
    return _disputed().search(text) is not None


#: Words of the contracts: runs without the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- shared folder


def shared_uri(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where that is unset, a local one if driver and executors
    are one process (tests), else an error: executors would not see each other's files."""
    uri = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not uri:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        uri = held.get() if held.isDefined() else None
    if not uri:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        uri = tempfile.mkdtemp(prefix="keelson-")
        spark.sparkContext.setCheckpointDir(uri)
    return uri.rstrip("/")


def run_uri(spark: SparkSession, kind: str) -> str:
    """A new folder of its own in the shared folder."""
    return f"{shared_uri(spark)}/keelson/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = run_uri(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def task_each(spark: SparkSession, n: int) -> DataFrame:
    """id from 0 to n - 1, each in a task of its own."""
    return spark.range(0, n, 1, max(1, n))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def atomic_output(uri: str) -> Iterator[pa.NativeFile]:
    """A stream that becomes the file only when it is closed well: a retried or second attempt of a task
    replaces the file by an equal one, and a killed attempt leaves none."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(part) as out:
            yield out
        fs.move(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(part)
        raise


def open_input(uri: str) -> pa.NativeFile:
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


# ---------------------------------------------------------------- batches


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Null text counts as empty."""
    return pc.fill_null(column.cast(pa.string()), "").to_pylist()


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` text bytes (one row at least), so that long texts can't pile up."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ..., n-1 for each n of lengths, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def segment_sum(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; an empty run sums to 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


# ---------------------------------------------------------------- tokenisation


class SegmentEncoder:
    """Encodes texts segment by segment with a bounded cache: natural text repeats most of its words.

    encode: texts to their ids as little-endian unsigned 32-bit integers, for segments that the cache lacks.
    The cache is emptied when it holds `most` segments (about 160 bytes each); segments over `longest`
    characters aren't kept. Neither changes a result.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 800_000, longest: int = 64):
        self.encode, self.most, self.longest, self.cache = encode, most, longest, {}

    def __call__(self, texts: list[str], pattern: re.Pattern = SEGMENT, prefix: str = "") -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return self.joined([[t] if disputed(t) else pattern.findall(t) for t in texts], prefix)

    def fill(self, segments: list[list[str]], prefix: str = "") -> list[str]:
        """Afterwards the cache has every segment; returns those to be dropped by drop()."""
        if len(self.cache) > self.most:
            self.cache.clear()
        new = list(set(filterfalse(self.cache.__contains__, chain.from_iterable(segments))))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.cache.update(zip(part, self.encode([prefix + s for s in part] if prefix else part), strict=True))
        return [s for s in new if len(s) > self.longest]

    def drop(self, long: list[str]) -> None:
        for s in long:
            del self.cache[s]

    def joined(self, segments: list[list[str]], prefix: str = "") -> list[bytes]:
        long = self.fill(segments, prefix)
        get = self.cache.__getitem__
        out = [b"".join(map(get, s)) for s in segments]
        self.drop(long)
        return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and where each begins, then their number. Null text counts as empty."""
    texts = pc.fill_null(column.cast(pa.string()), "")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends.astype(np.int64) - ends[0]


def strings_of(data: np.ndarray, begins: np.ndarray) -> pa.DictionaryArray:
    """data cut at begins (the first is 0), as codes and the distinct strings."""
    ends = np.append(begins, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()


def segment_begins(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the segments of SEGMENT begin in texts as text_bytes() gives them; a disputed() text is one segment. Segments
    begin with white space after anything else, or with a sign after a letter or digit, and with each text."""
    if data.max(initial=0) < 128:
        kind = _kinds()[:128][data]
    else:
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = np.repeat(_kinds()[codes], 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF))
    begin = np.zeros(len(data), bool)
    space, sign = kind == 0, kind == 2
    begin[1:] = (space[1:] & ~space[:-1]) | (sign[1:] & (kind[:-1] == 1))
    for i in np.unique(np.searchsorted(ends, np.flatnonzero(kind == 3), "right") - 1):
        begin[ends[i] : ends[i + 1]] = False
    begin[ends[:-1][np.diff(ends) > 0]] = True
    return np.flatnonzero(begin)


def segment_ids(column: pa.Array | pa.ChunkedArray, table: IdTable) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers, by a table of segments."""
    data, ends = text_bytes(column)
    begins = segment_begins(data, ends)
    ids, sizes = table.ids(table.rows(strings_of(data, begins)))
    at = 4 * np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.searchsorted(begins, ends)]
    table.trim()
    flat = ids.astype("<u4").tobytes()
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


class _Rows(dict):
    """Row numbers of strings, in the order in which they are first asked for."""

    def __missing__(self, string: bytes) -> int:
        n = self[string] = len(self)
        return n


class IdTable:
    """Ids of the strings seen, in arrays, so that a string of a text costs one lookup. When it holds `most` strings or
    `most_bytes` of them, trim() keeps those that two calls of rows() or more have asked for, or none if those fill half of it
    already. That changes no result.

    encode: strings to all their ids, where each one's begin, and how many it has."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = 300_000, most_bytes: int = 16 << 20):
        self.encode, self.most, self.most_bytes, self.cleared = encode, most, most_bytes, 0
        self.clear()

    def clear(self) -> None:
        self.index, self.words, self.bytes, self.held = _Rows(), [], 0, 0
        self.sizes, self.starts, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.calls = np.zeros(0, np.int32)
        self.cleared += 1

    @property
    def full(self) -> bool:
        return len(self.words) > self.most or self.bytes > self.most_bytes

    def trim(self) -> None:
        """Afterwards rows() gives other numbers where `cleared` has grown."""
        if not self.full:
            return
        keep = np.flatnonzero(self.calls[: len(self.words)] > 1)
        words = [self.words[i] for i in keep.tolist()]
        size = sum(map(len, words))
        ids, sizes = self.ids(keep)
        self.clear()
        if 2 * len(words) <= self.most and 2 * size <= self.most_bytes:
            self.index.update(zip(words, range(len(words)), strict=True))
            self.words, self.bytes, self.held = words, size, len(ids)
            self.sizes, self.starts, self.flat, self.calls = sizes, np.cumsum(sizes, dtype=np.int64) - sizes, ids, np.zeros(len(words), np.int32)
        give_back()

    def _grown(self, name: str, used: int, parts: list[np.ndarray]) -> None:
        """Adds parts to an array that has spare room after its first `used` values."""
        old, more = getattr(self, name), sum(map(len, parts))
        if used + more > len(old):
            new = np.empty((used + more) * 5 // 4, old.dtype)
            new[:used] = old[:used]
            setattr(self, name, new)
        np.concatenate([np.zeros(0, old.dtype), *parts], out=getattr(self, name)[used : used + more], casting="unsafe")

    def rows(self, strings: pa.DictionaryArray) -> np.ndarray:
        """The row of each string; those not seen before are added."""
        own = strings.dictionary.to_pylist()
        at = np.fromiter(map(self.index.__getitem__, own), np.int64, len(own))
        if len(self.index) > len(self.words):
            known = len(self.words)
            new = list(islice(self.index, known, None))
            self.words += new
            self.bytes += sum(map(len, new))
            for i in range(0, len(new), 20_000):
                ids, begins, sizes = self.encode([w.decode() for w in new[i : i + 20_000]])
                self._grown("sizes", known + i, [sizes])
                self._grown("starts", known + i, [begins + self.held])
                self._grown("flat", self.held, [ids])
                self.held += len(ids)
            self._grown("calls", known, [np.zeros(len(new), np.int32)])
        self.calls[at] += 1
        return at[strings.indices.to_numpy()] if len(own) else np.zeros(0, np.int64)

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all strings, end to end, and how many each has."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.starts[rows] - ends + sizes, sizes)
        return self.flat[at], sizes


_ENCODERS: dict[str, SegmentEncoder] = {}
_TABLES: dict[tuple, IdTable] = {}


def id_table(name: str, prefix: str = "", tokenizer: type[JsonTokenizer] | None = None, **options) -> IdTable:
    """One for each Python worker, kind of string and vocabulary; strings are encoded with the prefix before them."""
    if (name, prefix) not in _TABLES:
        flat = (tokenizer or JsonTokenizer)(name).flat
        _TABLES[name, prefix] = IdTable(lambda some: flat([prefix + s for s in some] if prefix else some), **options)
    return _TABLES[name, prefix]


def forget() -> None:
    """Empties the caches that encoders have left in this Python worker, for operators that need none of them."""
    for encoder in _ENCODERS.values():
        encoder.cache.clear()
    for table in _TABLES.values():
        table.clear()
    give_back()


def give_back() -> None:
    """Gives the memory that this Python worker has freed back to the system: an executor's limit holds for all its workers
    and the JVM, and an allocator keeps what earlier stages have freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


class JsonTokenizer:
    """The tokenizers library over a file of the public vocabulary package, special tokens' strings as ordinary text."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in own]
        self.chars = dict(zip(others, range(256, 256 + len(others)), strict=True))  # of byte-level tokens, for bytes that aren't their own
        # a character of a byte-level token stands for a byte
        self.sizes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, begins, sizes = self.flat(texts)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip((4 * begins).tolist(), (4 * (begins + sizes)).tolist(), strict=True)]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each text's begin among them, and how many it has. A space and letters are one pre-token,
        which goes to the library's model at once. Other texts that begin with a space or line break and end in a letter are
        encoded in runs, which costs less a text: no token spans two of them, so the tokens' bytes tell where each begins."""
        word = np.fromiter(map(self._is_word, texts), bool, len(texts))
        plain = np.fromiter((bool(t) and t[0] in " \n" and t[-1].isalnum() for t in texts), bool, len(texts)) & ~word
        words, runs, alone = np.flatnonzero(word), np.flatnonzero(plain), np.flatnonzero(~plain & ~word)
        begins, sizes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        parts = self._ids([texts[i] for i in alone])
        sizes[alone] = [len(x) // 4 for x in parts]
        own, sizes[words] = self._words([texts[i] for i in words])
        parts.append(own.tobytes())
        first = np.concatenate([alone, words])
        begins[first] = np.cumsum(sizes[first]) - sizes[first]
        held = int(sizes.sum())
        for at in range(0, len(runs), 400):
            own = runs[at : at + 400]
            part = [texts[i] for i in own]
            data = self._ids(["".join(part)])[0]
            ends = np.cumsum(self.sizes[np.frombuffer(data, np.uint32)])
            cuts = np.concatenate([[0], np.searchsorted(ends, np.cumsum([len(t.encode()) for t in part])) + 1])
            begins[own], sizes[own] = held + cuts[:-1], np.diff(cuts)
            held += len(data) // 4
            parts.append(data)
        return np.frombuffer(b"".join(parts), np.uint32), begins, sizes

    def opening(self) -> np.ndarray:
        """Of every id whether its bytes begin with a space."""
        if self.tokenizer.normalizer is not None:
            raise ValueError("a normalizer may change texts before they are cut")
        space = chr(self.chars[32])
        return np.array([(self.tokenizer.id_to_token(i) or "").startswith(space) for i in range(len(self.sizes))])

    def _is_word(self, text: str) -> bool:
        return text[:1] == " " and text[1:].isalpha()

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, end to end, and how many each has."""
        parts = [[t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.chars))] for text in texts]
        return np.fromiter(chain.from_iterable(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class WordTokenizer(JsonTokenizer):
    """The same ids, for many words that are new: words of up to `longest` bytes are merged side by side in arrays, each by the
    pair of lowest rank, the leftmost of equals, as the library does one by one. A sign after the letters is a pre-token of
    its own, of one byte."""

    longest, at_once, none = 64, 4000, 1 << 30
    signs = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")

    def __init__(self, name: str):
        super().__init__(name)
        model = json.loads(self.tokenizer.to_str())["model"]
        own, size = model["vocab"], len(self.sizes)
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{name} has no plain merges")
        self.first = np.array([own[chr(self.chars.get(b, b))] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([own[a] * size + own[b] for a, b in pairs], np.int64)
        self.made = np.array([own[a + b] for a, b in pairs], np.int64)
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.is_sign = np.isin(np.arange(256), [ord(c) for c in self.signs])
        del model, own, pairs
        give_back()

    def _is_word(self, text: str) -> bool:
        return text[:1] == " " and (text[1:].isalpha() or text[-1] in self.signs and text[1:-1].isalpha())

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [t.encode() for t in texts]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        parts, sizes, short = [], np.zeros(len(data), np.int64), lengths <= self.longest
        for i in np.flatnonzero(~short):
            parts.append(np.frombuffer(self._ids([texts[i]])[0], np.uint32))
            sizes[i] = len(parts[-1])
        number = [np.repeat(np.flatnonzero(~short), sizes[~short])]
        some = np.flatnonzero(short)
        for at in range(0, len(some), self.at_once):
            own = some[at : at + self.at_once]
            ids, word = self._merged(np.frombuffer(b"".join([data[i] for i in own]), np.uint8), lengths[own])
            parts.append(ids)
            number.append(own[word])
        number = np.concatenate(number)
        ids = np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.uint32)
        return ids[np.argsort(number, kind="stable")], np.bincount(number, minlength=len(data))

    def _ranked(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each place; `none` of no pair."""
        key = ids[at] * len(self.sizes) + ids[at + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.rank[found], self.none)

    def _merged(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of so many bytes, and the number of each id's word. A word's ids are in order."""
        ids, number, out, words = self.first[data], np.arange(len(sizes)), [], []
        ends = np.cumsum(sizes)
        joins = np.ones(len(ids), bool)  # whether an id may be merged with the next one
        joins[ends - 1] = False
        joins[ends[self.is_sign[data[ends - 1]]] - 2] = False
        ranks, at = np.full(len(ids), self.none), np.flatnonzero(joins)
        ranks[at] = self._ranked(ids, at)
        while len(number):
            best = np.minimum.reduceat(ranks << 32 | np.arange(len(ids)), np.cumsum(sizes) - sizes)
            more = best < self.none << 32
            at, keep = best[more] & 0xFFFFFFFF, np.repeat(more, sizes)
            out.append(ids[~keep])
            words.append(np.repeat(number[~more], sizes[~more]))
            ids[at], joins[at] = self.made[best[more] >> 32], joins[at + 1]
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            ids, joins, ranks, sizes, number = ids[keep], joins[keep], ranks[keep], sizes[more] - 1, number[more]
            ranks[at] = self.none
            changed = np.concatenate([at, at[at > 0] - 1])
            changed = changed[joins[changed]]
            ranks[changed] = self._ranked(ids, changed)
        return np.concatenate(out), np.concatenate(words)


def json_encoder(name: str) -> SegmentEncoder:
    """One for each Python worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = SegmentEncoder(JsonTokenizer(name).encode)
    return _ENCODERS[name]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
