"""DartMinHash near-duplicates (Christiani, "DartMinHash: Fast Sketching for Weighted Sets", 2020).

An element of weight w owns the region [0, w) x [0, infinity) of weight and rank. Every unit cell of that
region holds a number of darts that is Poisson with the cell's area; number, place and signature coordinate
of the darts follow from a hash of element and cell alone, so two sets that share a region share its darts.
A set throws about k ln k + 2k darts, those of rank under theta = that number over its total weight (theta
rounded up to the end of a cell), and keeps the earliest dart of each coordinate; where a coordinate got none,
theta doubles. Two sets agree at a coordinate with the probability of their weighted Jaccard similarity, at a
cost of about n + k ln k hashes in place of n * k.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, ranges, slices, texts_of, written

_TOKEN = re.compile(r"\w+")
_LOW = 3  # ranks under 1 are cut at 1/8, 1/4 and 1/2, so that large sets look at few cells
_EDGES = np.array([0.0, *(2.0 ** (s - _LOW) for s in range(_LOW))])  # lower edges of the cells under rank 1
_AREAS = np.array([2.0**-_LOW, *(2.0 ** (s - _LOW) for s in range(_LOW)), 1.0])
_CDF = np.cumsum([[math.exp(-a) * a**n / math.factorial(n) for n in range(16)] for a in _AREAS], 1)
_COUNTS = np.stack([np.searchsorted(c, (np.arange(1 << 16) + 0.5) / (1 << 16)) for c in _CDF]).astype(np.uint8).reshape(-1)  # darts, by kind of cell and 16 bits

_G = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LAYER = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of shifts and multiplications, in place."""
    t = x >> np.uint64(30)
    x ^= t
    x *= _M1
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= _M2
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


# ---------------------------------------------------------------- shingles


class _Hashes(dict):
    """64-bit hashes of words, worked out when first asked for."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class Shingler:
    """Lower-cased word shingles of `size` words as 64-bit hashes.

    Words are runs of letters, digits and underscores; a text without any takes its white-space words.
    Fewer words than size: one shingle of them all. No word: no shingle.
    """

    def __init__(self, size: int = 5):
        self.size, self.cache = size, _Hashes()
        self.factors = _mix(np.arange(1, size + 1, dtype=np.uint64) * _G) | np.uint64(1)

    def words(self, text: str) -> list[str]:
        text = text.lower()
        return _TOKEN.findall(text) or text.split()

    def all(self, words: list[str]) -> np.ndarray:
        """In the text's order, repeated ones included."""
        if len(self.cache) > 500_000:
            self.cache.clear()
        h = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        n = max(1, len(h) - self.size + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(self.size, len(h))):
            out += h[k : n + k] * self.factors[k]
        return _mix(out)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted and distinct, and their counts."""
        return np.unique(self.all(words), return_counts=True)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: str) -> float:
    """Of sets ("set"), or of multisets ("count")."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if weights == "set":
        return len(both) / max(1, len(a[0]) + len(b[0]) - len(both))
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / max(1, a[1].sum() + b[1].sum() - least))


# ---------------------------------------------------------------- signatures


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """A row of k 16-bit dart ids for each (elements, weights); a set without weight gets zeros. Weights may be fractions.
    An element of weight 1 that is given twice throws the same darts twice, which changes nothing."""
    out = np.zeros((len(sets), k), np.uint16)
    norms = np.array([float(w.sum()) for _, w in sets])
    todo = np.flatnonzero(norms > 0)
    theta = np.zeros(len(sets))
    theta[todo] = (k * math.log(max(k, 2)) + 2 * k) / norms[todo]
    while len(todo):
        cells = np.array([math.ceil(w) for w in norms[todo]]) * (_LOW + 1 + np.maximum(0, np.ceil(theta[todo]) - 1))
        group = (np.cumsum(cells) - cells) // 50_000  # bounds what is held, and keeps it in the processor's cache
        again = [_throw(sets, todo[group == g], theta, k, out) for g in np.unique(group)]
        todo = np.concatenate(again)
        theta[todo] *= 2
    return out


def _throw(sets: list, which: np.ndarray, theta: np.ndarray, k: int, out: np.ndarray) -> np.ndarray:
    """Fills rows of out; returns those with a coordinate still empty."""
    element = np.concatenate([sets[i][0] for i in which])
    weight = np.concatenate([sets[i][1] for i in which]).astype(np.float64)
    owner = np.repeat(np.arange(len(which)), [len(sets[i][0]) for i in which])
    # weight cells [0, 1), [1, 2), ...; the last one is owned in part where the weight is a fraction
    plain = bool((weight == 1).all())
    if plain:
        base, own = _mix(element.copy()), None
    else:
        layers = np.ceil(weight).astype(np.int64)
        layer = ranges(layers)
        base = _mix(np.repeat(element, layers) + layer.astype(np.uint64) * _LAYER)
        own, owner = np.minimum(np.repeat(weight, layers) - layer, 1.0), np.repeat(owner, layers)
    limit = theta[which]
    slabs = np.where(limit > 1, _LOW + np.ceil(limit), np.searchsorted(_EDGES, limit, "left")).astype(np.int64)
    per = slabs[owner]
    slab = ranges(per)
    source = np.repeat(np.arange(len(per)), per)
    cell = base[source]
    cell += (slab.astype(np.uint64) + np.uint64(1)) * _G
    _mix(cell)
    kind = np.minimum(slab, _LOW + 1)
    count = _COUNTS[(kind << 16) | (cell >> np.uint64(48)).astype(np.int64)]
    at = np.repeat(np.arange(len(cell)), count)
    dart = cell[at]
    dart += (ranges(count.astype(np.int64)).astype(np.uint64) + np.uint64(1)) * _M2
    _mix(dart)
    # of a dart's 64 bits the upper half is its rank within the cell, the lower half its coordinate and id
    low = np.where(slab <= _LOW, _EDGES[np.minimum(slab, _LOW)], slab - _LOW)
    rank = low[at] + (dart >> np.uint64(32)).astype(np.float64) * (_AREAS[kind] * 2.0**-32)[at]
    half = dart & np.uint64(0xFFFFFFFF)
    key = owner[source][at] * k + ((half * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
    value = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | half
    if not plain:
        fine = (_mix(dart + np.uint64(1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < own[source][at]
        key, value = key[fine], value[fine]
    first = np.full(len(which) * k, _NONE)
    np.minimum.at(first, key, value)
    first = first.reshape(len(which), k)
    out[which] = first.astype(np.uint16)
    return which[(first == _NONE).any(1)]


# ---------------------------------------------------------------- joining


def sign(docs: DataFrame, k: int, size: int, weights: str) -> DataFrame:
    """row, doc_id, digest (128 bits of the word sequence, so equal for copies), sig (k 16-bit ids; null without words), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingler = Shingler(size)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = [shingler.words(t) for t in texts_of(part.column("text"))]
                if weights == "set":
                    sets = [(e, np.ones(len(e))) for e in (np.unique(shingler.all(w)) for w in words)]
                else:
                    sets = [shingler.of(w) for w in words]
                sig = signatures(sets, k)
                digest = [xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(digest, pa.binary()), pa.array([s.tobytes() if w else None for s, w in zip(sig, words, strict=True)], pa.binary()), part.column("text")],
                    names=["row", "doc_id", "digest", "sig", "text"],
                )

    return docs.mapInArrow(run, "row long, doc_id long, digest binary, sig binary, text string")


def bands(sig: Column, k: int, rows: int) -> Column:
    """struct(band, hash of the band's rows) of each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(k // rows - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring(sig, b * (2 * rows) + 1, F.lit(2 * rows))).alias("bucket")))


def _ids(column: pa.Array | pa.ChunkedArray, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, k)


def _agreeing(pairs: DataFrame, nodes: DataFrame, least: float, k: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree at `least` of the coordinates, and that share."""
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                share = (_ids(batch.column("sig_a"), k) == _ids(batch.column("sig_b"), k)).mean(1)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], names=["a", "b", "share"]).filter(pa.array(share >= least))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, share double")


def _verified(pairs: DataFrame, nodes: DataFrame, size: int, weights: str) -> DataFrame:
    """The pairs with their exact similarity. b's shingles are held while it stays the same."""
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held = Shingler(size), (None, None)
        for batch in batches:
            for part in slices(batch, "text_a", 2 << 20):
                out = []
                columns = (part.column(c) for c in ("b", "text_a", "text_b"))
                for b, x, y in zip(*columns, strict=True):
                    if held[0] != b.as_py():
                        held = b.as_py(), shingler.of(shingler.words(y.as_py() or ""))
                    out.append(jaccard(shingler.of(shingler.words(x.as_py() or "")), held[1], weights))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


# ---------------------------------------------------------------- blocks of buckets


_BLOCK = ["bucket", "i", "j"]


def _blocks(mixed: DataFrame, chunk: int) -> DataFrame:
    """The rows of every block of mixed buckets. A bucket's nodes outside its main component are dealt into chunks of
    about `chunk`, and so are all its nodes; block (i, j) has chunk i of the former (left) and chunk j of the latter
    (right), so it is bounded however large its bucket is, and all blocks of a bucket hold each pair across
    components. Rows grow with nodes times nodes outside the main component, over chunk."""
    other = F.col("label") != F.col("main")
    sized = mixed.withColumns({"rows": F.ceil(F.col("others") / chunk).cast("int"), "columns": F.ceil(F.col("size") / chunk).cast("int")})
    placed = sized.withColumns({"own_i": F.pmod(F.xxhash64("node"), F.col("rows")).cast("int"), "own_j": F.pmod(F.xxhash64("node"), F.col("columns")).cast("int")})
    as_right = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), F.col("own_j").alias("j")))
    as_left = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(F.col("own_i").alias("i"), j.alias("j")))
    at = placed.withColumn("at", F.explode(F.when(other, F.array_union(as_left, as_right)).otherwise(as_right)))
    return at.select("bucket", "at.i", "at.j", "band", "node", "label", other.alias("other"), (other & (F.col("at.i") == F.col("own_i"))).alias("left"), (F.col("at.j") == F.col("own_j")).alias("right"))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by block, in tables that have every block whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        last = [table.column(c)[-1].as_py() for c in _BLOCK]
        same = np.ones(table.num_rows, bool)
        for c, v in zip(_BLOCK, last, strict=True):
            same &= table.column(c).to_numpy() == v
        cut = int(np.argmax(same))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _near(table: pa.Table, k: int, rows: int, least: float, at_once: int = 16_384) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (x, y) in the table of pairs within a block that agree at `least` of the coordinates, and how many those are.
    Pairs of one component don't count, and of several buckets that have a pair only that of the first band does."""
    sig = _ids(table.column("sig"), k)
    node, label, other, left, right, band = (table.column(c).to_numpy() for c in ("node", "label", "other", "left", "right", "band"))
    keys = [table.column(c).to_numpy() for c in _BLOCK]
    new = np.ones(len(node), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    block = np.cumsum(new) - 1
    rights = np.flatnonzero(right)
    per = np.bincount(block[rights], minlength=block[-1] + 1)
    begin = np.cumsum(per) - per
    lefts = np.flatnonzero(left)
    part = (np.cumsum(per[block[lefts]]) - per[block[lefts]]) // at_once
    out = []
    for mine in np.split(lefts, np.flatnonzero(np.diff(part)) + 1):
        n = per[block[mine]]
        x = np.repeat(mine, n)
        y = rights[np.repeat(begin[block[mine]], n) + ranges(n)]
        fine = (label[x] != label[y]) & (~other[y] | (node[x] < node[y]))
        x, y = x[fine], y[fine]
        same = sig[x] == sig[y]
        count = same.sum(1)
        fine = np.flatnonzero(count >= least * k)
        told = (same[fine].reshape(len(fine), k // rows, rows).all(2) & (np.arange(k // rows) < band[x[fine], None])).any(1)
        fine = fine[~told]
        out.append((x[fine], y[fine], count[fine]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _block_links(mixed: DataFrame, nodes: DataFrame, k: int, rows: int, size: int, least: float, near: float, weights: str, chunk: int) -> DataFrame:
    """Links (a, b) between components, of all pairs of nodes in one bucket: of each block a forest that ties what its
    links tie. All pairs are compared by signature, and exactly where that agrees at `near`; texts are joined only for
    nodes that have such a pair."""
    kinds = "bucket long, i int, j int, band int, node long, label long, other boolean, left boolean, right boolean, sig binary"

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            x, y, _ = _near(table, k, rows, near)
            yield from table.take(pa.array(np.unique(np.concatenate([x, y])))).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for table in _whole_blocks(batches):
            node, label = (table.column(c).to_numpy() for c in ("node", "label"))
            x, y, count = _near(table, k, rows, near)
            order = np.argsort(-count, kind="stable")
            sets: dict = {}
            parent: dict = {}  # of components tied by what this table has

            def root(c: int) -> int:
                while c in parent:
                    c = parent[c]
                return c

            def shingles(at: int) -> tuple:
                if node[at] not in sets:
                    sets[node[at]] = shingler.of(shingler.words(table.column("text")[int(at)].as_py() or ""))
                return sets[node[at]]

            out = []
            for a, b in zip(x[order], y[order], strict=True):
                p, q = root(label[a]), root(label[b])
                if p != q and jaccard(shingles(a), shingles(b), weights) >= least:
                    parent[p] = q
                    out.append((int(node[a]), int(node[b])))
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in out], pa.int64()) for c in range(2)], names=["a", "b"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)

    names = [x.split()[0] for x in kinds.split(", ")]
    some = written(dealt(_blocks(mixed, chunk).join(nodes.select("node", "sig"), "node").select(*names)).mapInArrow(candidates, kinds), "darts-block-nodes")
    return written(dealt(some.join(nodes.select("node", "text"), "node").select(*names, "text")).mapInArrow(compare, "a long, b long"), "darts-block-links")


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its connected component) for every node of links (a, b).

    Labels spread along links and by pointer jumping, a written table for each round, until none changes.
    """
    edges = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        own = labels.select(F.col("node").alias("b"), "label")
        spread = edges.join(own, "b").select(F.col("a").alias("node"), "label").unionAll(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
        spread = written(spread, "labels")
        jumped = spread.join(spread.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        new = written(jumped.select("node", F.coalesce("next", "label").alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def classes(docs: DataFrame, k: int = 252, rows: int = 7, size: int = 5, least: float = 0.8, weights: str = "set", chunk: int = 512, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, report: dict | None = None) -> DataFrame:
    """doc_id and class_id of every row: the least doc_id among all rows tied to it by links, a link being two
    texts whose shingles have a Jaccard similarity of `least` or more, or the same words.

    1. Copies (the same words) collapse to one node. Each node has a signature of k coordinates in k / rows
       bands; a link of similarity 0.8 shares a band with probability 0.9998, unlike texts of 0.4 with 0.06 (defaults).
    2. Every node is compared by signature with the least node of each of its band buckets, and with the one that
       agrees best exactly. These links tie what is much alike into components: a pair for each node at most.
    3. In buckets that still have two components or more, all pairs across components are compared by signature, in
       blocks of bounded size, and exactly where the signatures agree; only a forest of each block's links leaves it. So
       every link whose ends share a bucket is found or joins what is tied already. That work grows with nodes times
       nodes outside the bucket's main component.
    Exact comparisons leave out pairs that agree at fewer coordinates than `least` by five standard deviations.

    Null or empty text: all such rows are copies of each other. A null doc_id takes part as any row; it is never
    the class_id unless all of the class are null. Repeated rows come out each. Other columns aren't read. Empty
    table: no rows. Every step is a table in the shared folder, so a lost executor repeats one step at most.
    row_col: a column that numbers the rows of docs, if docs is a written table; its texts are then read again in place
    of being kept. weights: "set", or "count" for the weighted similarity of shingle counts. report: gets the links of step 2 ("leaders")
    and step 3 ("blocks"), as frames.
    """
    if k % rows or weights not in ("set", "count"):
        raise ValueError("rows must divide k, and weights be set or count")
    near = least - 5 * math.sqrt(least * (1 - least) / k)
    keyed = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = sign(keyed, k, size, weights)
    signed = written(signed.drop("text") if row_col else signed, "darts-signed")
    copies = written(signed.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id")), "darts-copies")
    firsts = written(signed.where("sig IS NOT NULL").select(F.col("row").alias("node"), "sig").join(copies.select("node"), "node", "left_semi"), "darts-firsts")
    placed = firsts.select("node", F.inline(bands(F.col("sig"), k, rows)))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("leader")).where("size > 1")
    members = written(placed.join(shared, "bucket").select("bucket", "band", "node", "size", "leader"), "darts-members")
    inside = members.select("node").distinct()
    if row_col:
        texts = keyed.select(F.col("row").alias("node"), "text").join(inside, "node", "left_semi")
        nodes = written(firsts.join(texts, "node"), "darts-nodes")
    else:
        nodes = written(signed.select(F.col("row").alias("node"), "sig", "text").join(inside, "node", "left_semi"), "darts-nodes")

    pairs = members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    best = written(_agreeing(pairs, nodes, near, k).groupBy("a").agg(F.max(F.struct("share", "b")).alias("best")).select("a", "best.b"), "darts-leaders")
    links = written(_verified(best, nodes, size, weights).where(F.col("similarity") >= least).select("a", "b"), "darts-links")
    labels = components(links)

    labelled = members.select("bucket", "band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    buckets = buckets.select("bucket", "size", F.col("most.label").alias("main"), (F.col("size") - F.col("most.n")).alias("others"))
    mixed = written(labelled.join(buckets, "bucket"), "darts-mixed")
    across = _block_links(mixed, nodes, k, rows, size, least, near, weights, chunk)
    if report is not None:
        report.update(leaders=links, blocks=across)
    if across.limit(1).count():
        labels = components(links.unionAll(across))

    tied = labels.join(copies.select("node", "doc_id"), "node")
    lowest = tied.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = tied.join(lowest, "label").select("node", "class_id", F.lit(True).alias("tied"))
    of_copies = written(copies.join(named, "node", "left").select("digest", F.when(F.col("tied"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")), "darts-classes")
    return signed.select("doc_id", "digest").join(of_copies, "digest").select("doc_id", "class_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The first row, all columns, of every class of near-duplicates: the one that comes first in docs' own order of rows.

    Rows without a word (null or empty text) are copies of each other, so one of them stays. Repeated rows: one stays.
    Ids play no part, so null ones are as good as any. Empty table: no rows.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    staged = written(docs.withColumn(row, F.monotonically_increasing_id()), "darts-docs")
    found = classes(staged, id_col=row, row_col=row, **options)
    gone = written(found.where("doc_id <> class_id").select(F.col("doc_id").alias(row)), "darts-gone")
    return staged.join(gone, row, "left_anti").select(*docs.columns)
