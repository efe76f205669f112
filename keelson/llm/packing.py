"""Cost-balanced packing of tokenised documents into training sequences.

A document's training cost is estimated as linear * n + quadratic * n^2 (projections and feed-forward
layers grow with its tokens, attention with their square). Documents are taken in descending length, and
each goes to the sequence of least cost so far among those with room for it. Where no sequence has room,
the document is cut: the roomiest sequence is filled and the rest goes on as a shorter document. So every
sequence of a block but the last is full.

A block is a bounded number of tokens of one task's rows, so nothing is shuffled, a task holds one block
at a time however long the documents or however large the input, and a lost task repeats alone. What a
block leaves over, less than one sequence, goes on to the next block of the task: a task pads one sequence
at most.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_table, segment_ids, slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Sequences:
    """Open sequences, by room: for each room a heap of (cost, number); `rooms` is a bit set of rooms in use."""

    def __init__(self, count: int, capacity: int):
        self.by_room = {capacity: [(0.0, k) for k in range(count)]} if count else {}

    def take(self, length: int) -> tuple[float, int, int] | None:
        """The sequence of least cost with room for length."""
        best = min(((heap[0], room) for room, heap in self.by_room.items() if room >= length), default=None)
        return self._pop(best[1]) if best else None

    def roomiest(self) -> tuple[float, int, int] | None:
        return self._pop(max(self.by_room)) if self.by_room else None

    def _pop(self, room: int) -> tuple[float, int, int]:
        cost, k = heapq.heappop(self.by_room[room])
        if not self.by_room[room]:
            del self.by_room[room]
        return cost, k, room

    def put(self, cost: float, k: int, room: int) -> None:
        if room:
            heapq.heappush(self.by_room.setdefault(room, []), (cost, k))


def pack_block(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document's index, start in it, length, sequence, offset there) of every piece; sequences count from 0.

    Whole-sequence stretches of long documents become sequences of their own first; their rest is packed.
    All sequences are full, but for the last if the lengths don't divide. Equal lengths go in input order.
    """
    pieces, count, rest = [], 0, []
    for i, n in enumerate(lengths):
        for k in range(n // capacity):
            pieces.append((i, k * capacity, capacity, count, 0))
            count += 1
        if n % capacity:
            rest.append((-(n % capacity), i, n - n % capacity))
    total = -sum(x[0] for x in rest)
    full, last = divmod(total, capacity)
    open_, filled = _Sequences(full, capacity), {}
    if last:  # a sequence with only that room, so that no other is left short
        open_.put(0.0, full, last)
        filled[full] = 0
    heapq.heapify(rest)
    while rest:
        n, i, start = heapq.heappop(rest)
        n = -n
        cost, k, room = open_.take(n) or open_.roomiest()
        put = min(n, room)
        at = filled.get(k, 0)
        pieces.append((i, start, put, count + k, at))
        filled[k] = at + put
        open_.put(cost + linear * put + quadratic * put * put, k, room - put)
        if put < n:
            heapq.heappush(rest, (put - n, i, start + put))
    return pieces


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 1, capacity: int = 2048, block_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document of docs; a row for each piece, with its ids (little-endian unsigned 32-bit).

    Null or empty text: the end id alone. Null ids stay null; repeated rows are packed each for itself; an
    empty table gives no rows; other columns aren't read. start: the document's ids before the piece.
    sequence_id: unique over all tasks; offset: the piece's place there, from 0 without gaps.
    """
    if capacity < 1 or block_tokens < capacity:
        raise ValueError("capacity must be positive, and block_tokens at least capacity")

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*pieces, strict=True)) or [[] for _ in range(7)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        table, end = id_table(vocabulary), int(end_id).to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 40
        held, tokens = [], 0  # (doc_id, ids, start of ids in the document, doc_tokens)

        def block(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, tokens, base
            pieces = pack_block([len(x[1]) // 4 for x in held], capacity, linear, quadratic)
            last = max((p[3] for p in pieces), default=-1)
            short = not final and sum(p[2] for p in pieces if p[3] == last) < capacity
            out, left = [], []
            for i, start, n, k, at in pieces:
                key, ids, first, doc_tokens = held[i]
                cut = ids[4 * start : 4 * (start + n)]
                if short and k == last:
                    left.append((key, cut, first + start, doc_tokens))
                else:
                    out.append((key, first + start, n, cut, doc_tokens, base + k, at))
            base += last + (not short)
            held, tokens = left, sum(len(x[1]) // 4 for x in left)
            for at in range(0, len(out), 2000):
                yield rows(out[at : at + 2000])

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for key, ids in zip(part.column("doc_id").to_pylist(), segment_ids(part.column("text"), table), strict=True):
                    ids += end
                    held.append((key, ids, 0, len(ids) // 4))
                    tokens += len(ids) // 4
                    if tokens >= block_tokens:
                        yield from block(False)
        if held:
            yield from block(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def piece_crc32(packed: DataFrame) -> DataFrame:
    """packed with ids_crc32 in place of ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def padding(lengths: np.ndarray, capacity: int) -> int:
    """Pad tokens of sequences of these lengths: up to capacity, except at a power of two."""
    lengths = np.asarray(lengths, np.int64)
    return int((capacity - lengths)[(lengths & (lengths - 1)) != 0].sum())


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
