"""Language-model scoring: a causal self-attention model over subword ids, trained and run in numpy.

Words (runs without ASCII white space, A-Z in lower case) are encoded one by one, with a leading space, by
a public byte-level vocabulary; a text is its words' ids and one end. The model predicts each id from those
before it in a window: embeddings with positions, one causal attention head, a feed-forward layer, both
residual, and a softmax in two steps (class, then member of the class), so an id costs about the root of
the vocabulary. The most frequent ids have outputs of their own; the others share one, split by their
counts over the whole corpus. The parts multiply to a probability over all texts.

Scoring cuts a text into windows that overlap: each starts `overlap` ids before the last one ended, and
only ids not scored before count, so each counts once, with at least `overlap` ids before it, the text's
first ones aside. Windows of many texts go through as one batch under one causal mask.

Texts are encoded once, in the pass that counts words; later passes read their ids. A word is known by its ids, which are
whole words' bytes: the one that begins with a space begins a word.

Corpus statistics (counts of words and of ids) cover all training texts, and the weights are fitted to all windows of
all of them, on the executors, by rounds of descent whose weights are averaged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdTable, JsonTokenizer, WordTokenizer, forget, id_table, ranges, segment_sum, slices, strings_of, text_bytes, written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOWER_OF = np.frombuffer(_LOWER, np.uint8)
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
LN10 = float(np.log(10.0))


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8. Splitting bytes splits at the six ASCII spaces and nothing else."""
    return text.encode().translate(_LOWER).split()


# ---------------------------------------------------------------- the model


@dataclass
class Units:
    """Outputs of the model: the ids with one of their own by descending count, the end, and the rest, in classes
    of `members` neighbours. unit: of each id and, last, of the end; log_share: of an id within its unit."""

    unit: np.ndarray
    log_share: np.ndarray
    count: int
    members: int

    @classmethod
    def of(cls, counts: np.ndarray, ends: int, own: int = 1022, members: int = 32) -> Units:
        """counts: of every id of the vocabulary in the training texts."""
        size = len(counts)
        order = np.lexsort((np.arange(size), -counts))
        top = order[: min(own, size)]
        ranked = sorted([*((-int(counts[i]), int(i)) for i in top), (-ends, size), (-int(counts.sum() - counts[top].sum()), size + 1)])
        place = {i: k for k, (_, i) in enumerate(ranked)}
        unit = np.full(size + 1, place[size + 1], np.int32)
        unit[top] = [place[int(i)] for i in top]
        unit[size] = place[size]
        share = np.zeros(size + 1)
        rest = order[len(top) :]
        share[rest] = np.log((counts[rest] + 1.0) / (counts[rest] + 1.0).sum()) if len(rest) else 0
        return cls(unit, share.astype(np.float32), len(ranked), members)

    @property
    def classes(self) -> int:
        return -(-self.count // self.members)


SAFE, BIG = 80.0, 1e30  # exponents under SAFE can't overflow 32-bit floats, nor sums of them; sums under 1 / BIG lose digits


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each row. Exponents are shifted by the row's greatest only where a sum would leave the range of floats."""
    if x.max(initial=0) < SAFE:
        out = np.exp(x)
        total = out @ np.ones(x.shape[-1], x.dtype)
        if total.min(initial=1) > 1 / BIG:
            out *= (1 / total)[..., None]
            return out
    out = np.exp(x - x.max(-1, keepdims=True))
    out /= out.sum(-1, keepdims=True)
    return out


def _log_sum_exp(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Of each row. Exponents are shifted by the row's greatest only where its sum would leave the range of floats."""
    one = np.ones(x.shape[1], x.dtype)
    total = np.exp(x, out=room) @ one if x.max(initial=0) < SAFE else np.zeros(len(x), x.dtype)
    out = np.log(np.maximum(total, 1 / BIG))
    weak = np.flatnonzero(total < 1 / BIG)
    if len(weak):
        top = x[weak].max(1)
        out[weak] = top + np.log(np.exp(x[weak] - top[:, None]) @ one)
    return out


@dataclass
class AttentionModel:
    units: Units
    window: int = 32
    overlap: int = 8
    dim: int = 24
    keys: int = 8
    hidden: int = 32
    w: dict[str, np.ndarray] = field(default_factory=dict)
    tables: dict | None = None
    rooms: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int = 0) -> None:
        r, d, h, u = np.random.default_rng(seed), self.dim, self.hidden, self.units
        shapes = {"emb": (u.count + 1, d), "pos": (self.window, d), "qkv": (d, 2 * self.keys + d), "out": (d, d), "up": (d, h), "up_b": (h,), "down": (h, d), "cls": (d, u.classes), "cls_b": (u.classes,), "mem": (u.classes, d, u.members), "mem_b": (u.classes, u.members)}
        self.w = {k: np.zeros(s, np.float32) if k.endswith("_b") else (r.standard_normal(s) * (0.3 if k == "emb" else 0.1 if k == "pos" else s[-2] ** -0.5)).astype(np.float32) for k, s in shapes.items()}
        free = np.arange(u.classes * u.members).reshape(u.classes, -1) >= u.count
        self.w["mem_b"][free] = -1e4  # places of the last class that no unit has

    @property
    def mask(self) -> np.ndarray:
        return np.triu(np.full((self.window, self.window), -1e9, np.float32), 1)

    def _hidden(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        w, d = self.w, self.dim
        e = w["emb"][x]
        e += w["pos"]
        qkv = e.reshape(-1, d) @ w["qkv"]
        q, k, v = (np.ascontiguousarray(z) for z in np.split(qkv.reshape(*x.shape, -1), (self.keys, 2 * self.keys), axis=2))
        q *= q.dtype.type(self.keys**-0.5)
        a = q @ k.transpose(0, 2, 1)
        a += mask
        a = _softmax(a)
        c = a @ v
        h = e + (c.reshape(-1, d) @ w["out"]).reshape(e.shape)
        up = np.maximum(h.reshape(-1, d) @ w["up"] + w["up_b"], 0)
        g = h + (up @ w["down"]).reshape(h.shape)
        if keep is not None:
            keep.update(e=e, q=q, k=k, v=v, a=a, c=c, h=h, up=up)
        return g

    def _by_class(self, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(y // self.units.members, kind="stable")
        ends = np.cumsum(np.bincount(y // self.units.members, minlength=self.units.classes))
        for c, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            if b > a:
                yield c, order[a:b]

    def log_prob(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the units y after the windows x, where scored, in order."""
        g = self._hidden(x, self.mask)[scored]
        target, m = y[scored], self.units.members
        logit = g @ self.w["cls"] + self.w["cls_b"]
        logit -= logit.max(1, keepdims=True)
        out = logit[np.arange(len(target)), target // m] - np.log(np.exp(logit).sum(1))
        for c, rows in self._by_class(target):
            logit = g[rows] @ self.w["mem"][c] + self.w["mem_b"][c]
            logit -= logit.max(1, keepdims=True)
            out[rows] += logit[np.arange(len(rows)), target[rows] % m] - np.log(np.exp(logit).sum(1))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray, low: int = 0) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the scored places, all of them from slot `low` on, and its gradient by every weight. Of the slots
        before `low` only keys and values are worked out."""
        w, d, m, k, classes = self.w, self.dim, self.units.members, self.keys, self.units.classes
        shape, scale = (len(x), x.shape[1] - low), k**-0.5
        e = np.take(w["emb"], x, 0, mode="clip")
        e += w["pos"]
        flat, own = e.reshape(-1, d), e[:, low:].reshape(-1, d)
        key, value = ((flat @ np.ascontiguousarray(z)).reshape(*x.shape, -1) for z in (w["qkv"][:, k : 2 * k], w["qkv"][:, 2 * k :]))
        wq = w["qkv"][:, :k] * scale
        query = (own @ wq).reshape(*shape, k)
        a = query @ key.transpose(0, 2, 1)
        a += self.mask[low:]
        a = _softmax(a)
        c = (a @ value).reshape(-1, d)
        h = c @ w["out"]
        h += own
        up = h @ w["up"]
        up += w["up_b"]
        np.maximum(up, 0, out=up)
        g = up @ w["down"]
        g += h
        at = np.flatnonzero(scored[:, low:])
        target = y[:, low:].reshape(-1)[at]
        order = np.argsort((target // m).astype(np.uint16), kind="stable")
        at, target = at[order], target[order]
        gs, n, place = np.take(g, at, 0, mode="clip"), len(at), np.arange(len(at))
        grad = {}

        def outputs(logit: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, float]:
            p, pick = _softmax(logit), place * logit.shape[1] + pick
            loss = -float(np.log(p.reshape(-1)[pick] + 1e-30).sum())
            p.reshape(-1)[pick] -= 1
            p *= p.dtype.type(1 / max(1, n))
            return p, loss

        logit = gs @ w["cls"]
        logit += w["cls_b"]
        p, loss = outputs(logit, target // m)
        grad["cls"], grad["cls_b"], dgs = gs.T @ p, p.sum(0), np.zeros((n + 1, d), g.dtype)  # the last for places that aren't scored
        np.matmul(p, w["cls"].T, out=dgs[:n])
        per = np.bincount(target // m, minlength=classes)
        cuts = [(i, b - size, b) for i, (size, b) in enumerate(zip(per.tolist(), np.cumsum(per).tolist(), strict=True)) if size]
        logit = np.repeat(w["mem_b"], per, axis=0)
        for i, a0, b0 in cuts:
            logit[a0:b0] += gs[a0:b0] @ w["mem"][i]
        p, more = outputs(logit, target % m)
        grad["mem"], grad["mem_b"] = np.zeros_like(w["mem"]), np.zeros_like(w["mem_b"])
        for i, a0, b0 in cuts:
            np.matmul(gs[a0:b0].T, p[a0:b0], out=grad["mem"][i])
            grad["mem_b"][i] = p[a0:b0].sum(0)
            dgs[a0:b0] += p[a0:b0] @ w["mem"][i].T
        back = np.full(len(g), n)
        back[at] = place
        dg = np.take(dgs, back, 0, mode="clip")
        dup = dg @ w["down"].T
        dup *= up > 0
        grad["down"], grad["up"], grad["up_b"] = up.T @ dg, h.T @ dup, dup.sum(0)
        dh = dup @ w["up"].T
        dh += dg
        grad["out"] = c.T @ dh
        dc = dh @ w["out"].T
        level = np.einsum("ij,ij->i", dc, c).reshape(*shape, 1)  # what the softmax takes off: the weights' mean of the values' gradients
        dc = dc.reshape(*shape, d)
        dvalue = a.transpose(0, 2, 1) @ dc
        ds = dc @ value.transpose(0, 2, 1)
        ds -= level
        ds *= a
        dquery, dkey = (ds @ key).reshape(-1, k), (ds.transpose(0, 2, 1) @ query).reshape(-1, k)
        dvalue = dvalue.reshape(-1, d)
        grad["qkv"] = np.concatenate([own.T @ dquery * scale, flat.T @ dkey, flat.T @ dvalue], 1)
        de = dkey @ w["qkv"][:, k : 2 * k].T
        de += dvalue @ w["qkv"][:, 2 * k :].T
        dh += dquery @ wq.T
        by_slot = de.reshape(*x.shape, d)
        by_slot[:, low:] += dh.reshape(*shape, d)
        grad["pos"] = by_slot.sum(0)
        order = np.argsort(x.reshape(-1).astype(np.uint16 if self.units.count < 1 << 16 else x.dtype), kind="stable")
        ids = x.reshape(-1)[order]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        grad["emb"] = np.zeros_like(w["emb"])
        grad["emb"][ids[first]] = np.add.reduceat(np.take(de, order, 0, mode="clip"), first)
        return (loss + more) / max(1, n), grad

    def windows(self, lengths: np.ndarray) -> np.ndarray:
        """Of texts end to end, of so many places each: a row (first place, places left in the text, number in it) for
        each window."""
        step = self.window - self.overlap
        count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - self.window) // step)), 0)
        number, text = ranges(count), np.repeat(np.arange(len(lengths)), count)
        return np.stack([(np.cumsum(lengths) - lengths)[text] + number * step, lengths[text] - number * step, number], 1)

    def slots(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of every slot of the windows, and which are scored there."""
        first, left, number = (windows[:, i, None] for i in range(3))
        slot = np.arange(self.window)
        return first + np.minimum(slot, left - 1), (slot < left) & ((number == 0) | (slot >= self.overlap))

    def places(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units read and to be predicted at each place of the texts (the end included), log shares, and lengths."""
        end = len(self.units.unit) - 1
        lengths = np.array([len(x) + 1 for x in ids], np.int64)
        flat = np.full(int(lengths.sum()), end, np.int64)
        own = np.ones(len(flat), bool)
        own[np.cumsum(lengths) - 1] = False
        if len(ids):
            flat[own] = np.concatenate(ids)
        target = self.units.unit[flat]
        read = np.concatenate([[self.units.count], target[:-1]]).astype(np.int32)
        read[np.cumsum(lengths) - lengths] = self.units.count  # the start
        return read, target, self.units.log_share[flat], lengths

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array of this shape that is used again at the next call: fresh memory costs more than what is done in it."""
        size = prod(shape)
        if name not in self.rooms or self.rooms[name].size < size:
            self.rooms[name] = np.empty(size, self.w["emb"].dtype)
        return self.rooms[name][:size].reshape(shape)

    def _tables(self) -> dict[str, np.ndarray]:
        """units, slots: for every unit and every slot embedding, zero, query, key, value after the output product, and a one
        (a sum of weights beside the weighted sum), so that no product is worked out for each id. up, down, cls, mem: with
        biases as their last row, for a hidden state that ends in a one."""
        if self.tables is None:
            w, d, n = self.w, self.dim, self.keys
            none = np.zeros((d, 1))
            parts = np.concatenate([np.eye(d), none, w["qkv"][:, :n] * n**-0.5, w["qkv"][:, n : 2 * n], w["qkv"][:, 2 * n :] @ w["out"], none], 1).astype(w["emb"].dtype)
            units, slots = w["emb"] @ parts, w["pos"] @ parts
            units[:, -1] = 1
            biased = {k: np.concatenate([w[k], w[f"{k}_b"][..., None, :]], -2) for k in ("up", "cls", "mem")}
            self.tables = {"units": units, "slots": slots, "down": np.pad(w["down"], ((0, 0), (0, 1))), "seen": np.tri(self.window, dtype=units.dtype), **biased}
        return self.tables

    def _attend(self, x: np.ndarray, low: int, out: np.ndarray) -> None:
        """To out: what goes to the outputs and a one, of the slots from `low` on; no other slot is worked out further than
        its key and value."""
        t, d, n = self._tables(), self.dim + 1, self.keys
        z = self._room("z", *x.shape, 2 * (d + n))
        np.take(t["units"], x, 0, out=z, mode="clip")
        z += t["slots"]
        own, seen, shape = z[:, low:], t["seen"][low:], (len(x), self.window - low, self.window)
        query, key, value = own[..., d : d + n], z[..., d + n : d + 2 * n].transpose(0, 2, 1), z[..., d + 2 * n :]
        a, c = self._room("a", *shape), self._room("c", *shape[:2], d)
        np.matmul(query, key, out=a)
        plain = a.max() < SAFE
        if plain:
            np.exp(a, out=a)
            a *= seen
            np.matmul(a, value, out=c)
        if not plain or c[..., -1].min() < 1 / BIG:  # rows are shifted by their greatest exponent
            a = np.where(seen > 0, query @ key, -np.inf)
            c = np.exp(a - a.max(-1, keepdims=True)) @ value
        np.divide(c, c[..., -1:], out=out)
        out += own[..., :d]
        flat = out.reshape(-1, d)
        up = self._room("up", len(flat), self.hidden)
        np.matmul(flat, t["up"], out=up)
        np.maximum(up, 0, out=up)
        flat += np.matmul(up, t["down"], out=self._room("down", *flat.shape))

    def _infer(self, x: np.ndarray, target: np.ndarray, scored: np.ndarray, low: int, at_once: int = 128) -> np.ndarray:
        """log_prob() of the scored places, all of them from slot `low` on. Attention is worked out for few windows at once,
        which stay in the processor's cache; outputs for all, class by class."""
        t, m, d = self._tables(), self.units.members, self.dim + 1
        scored = scored[:, low:]
        h = self._room("h", len(x), self.window - low, d)
        for at in range(0, len(x), at_once):
            self._attend(x[at : at + at_once], low, h[at : at + at_once])
        h, y = (v.reshape(-1, *v.shape[2:]) if scored.all() else v[scored] for v in (h, target[:, low:]))
        order = np.argsort((y // m).astype(np.uint16), kind="stable")
        h, y = np.take(h, order, 0, out=self._room("sorted", len(order), d), mode="clip"), y[order]
        place, classes = np.arange(len(y)), self.units.classes
        logit = np.matmul(h, t["cls"], out=self._room("cls", len(y), classes))
        log = logit[place, y // m] - _log_sum_exp(logit, self._room("exp", len(y), classes))
        ends = np.cumsum(np.bincount(y // m, minlength=classes))
        logit = self._room("mem", len(y), m)
        for c, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            if b > a:
                np.matmul(h[a:b], t["mem"][c], out=logit[a:b])
        log += logit[place, y % m] - _log_sum_exp(logit, self._room("exp", len(y), m))
        out = np.empty_like(log)
        out[order] = log
        return out

    def score(self, ids: list[np.ndarray], batch: int = 512) -> np.ndarray:
        """log10 probability of each text."""
        read, target, share, lengths = self.places(ids)
        windows, log = self.windows(lengths), share.astype(np.float64)
        first, full = windows[:, 2] == 0, windows[:, 1] >= self.window
        for some, low in ((windows[first & full], 0), (windows[first & ~full], 0), (windows[~first & full], self.overlap), (windows[~first & ~full], self.overlap)):
            for at in range(0, len(some), batch):
                slot, scored = self.slots(some[at : at + batch])
                log[slot[scored]] += self._infer(read[slot], target[slot], scored, low)
        return np.add.reduceat(log, np.cumsum(lengths) - lengths) / LN10 if len(ids) else np.zeros(0)


class Descent:
    """Adam over a model's weights, which it moves into one array, end to end."""

    def __init__(self, model: AttentionModel, rates: tuple[float, float], batch: int = 128, seed: int = 0):
        self.model, self.rates, self.batch, self.random, self.steps, self.losses = model, rates, batch, np.random.default_rng(seed), 0, []
        self.flat = np.concatenate([v.reshape(-1) for v in model.w.values()])
        model.w = {k: x.reshape(v.shape) for (k, v), x in zip(model.w.items(), np.split(self.flat, np.cumsum([v.size for v in model.w.values()])[:-1]), strict=True)}
        self.mean, self.square = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def over(self, ids: list[np.ndarray], begin: float = 0.0, end: float = 1.0) -> None:
        """Once over all windows of the texts in random order, while the rate goes from begin to end of its way from the first
        of `rates` to the second."""
        m = self.model
        read, target, _, lengths = m.places(ids)
        windows, parts = m.windows(lengths), []
        for some, low in ((windows[windows[:, 2] == 0], 0), (windows[windows[:, 2] > 0], m.overlap)):
            some = some[self.random.permutation(len(some))]
            parts += [(some[at : at + self.batch], low) for at in range(0, len(some), self.batch)]
        for number, i in enumerate(self.random.permutation(len(parts))):
            slot, scored = m.slots(parts[i][0])
            done = min(1.0, begin + (end - begin) * number / len(parts))
            self._step(read[slot], target[slot], scored, parts[i][1], self.rates[0] + (self.rates[1] - self.rates[0]) * done)
        m.tables = None

    def _step(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray, low: int, rate: float) -> None:
        loss, grad = self.model.gradient(x, y, scored, low)
        g = np.concatenate([grad[k].reshape(-1) for k in self.model.w])
        self.steps += 1
        self.losses.append(loss)
        self.mean += 0.1 * (g - self.mean)
        g *= g
        g -= self.square
        g *= 0.01
        self.square += g
        np.multiply(self.square, 1 / (1 - 0.99**self.steps), out=g)
        np.sqrt(g, out=g)
        g += 1e-8
        np.divide(self.mean, g, out=g)
        g *= rate / (1 - 0.9**self.steps)
        self.flat -= g


# ---------------------------------------------------------------- corpus counts


VOCABULARY = "byte_bpe_50k.json"
FIXED = 2.0**24  # parts of one in which weights are summed up
END = b""  # the end's key among the words, none of which is empty


def words_in(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """words_of() all texts, end to end, and how many each text has."""
    data, ends = text_bytes(column)
    data = _LOWER_OF[data]
    out = _SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    begin = cut[:-1].copy()
    begin[1:] |= out[:-1]
    begin &= ~out
    begins = np.flatnonzero(begin)
    before = np.cumsum(out, dtype=np.int64)[begins]  # white space, which is left out
    return strings_of(data[~out], begins - before), np.diff(np.searchsorted(begins, ends))


def word_table(vocabulary: str = VOCABULARY) -> IdTable:
    """Ids of words, each with a leading space. Holds fewer words than other encoders, for the joins' sake."""
    return id_table(vocabulary, " ", WordTokenizer, most=400_000)


def text_ids(column: pa.Array, table: IdTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' ids, end to end, how many each has, the rows of all their words in the table, and how many words each has."""
    words, per = words_in(column)
    rows = table.rows(words)
    ids, sizes = table.ids(rows)
    return ids, segment_sum(sizes, per).astype(np.int64), rows, per


def id_kind(size: int) -> np.dtype:
    """Of ids as they are written, of a vocabulary of this size."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def binaries(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of so many ids, end to end, as binary values."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) * ids.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.tobytes())])


def ids_of(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """What binaries() was given. No value is null."""
    _, ends, data = column.cast(pa.binary()).buffers()
    ends = np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(data if data is not None else b"", np.uint8)[ends[0] : ends[-1]]
    return data.view(kind), np.diff(ends) // kind.itemsize


def encoded(docs: DataFrame, held_out: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every text's ids: row, doc_id, held_out, key (a hash) and ids, with word null. Then, with word not null, the words (by their
    ids, from which a word can be told) that aren't held out and how often each occurs, n; a word may come more than once.
    The word of no ids is the end, END. A task gives its counts out when its table is full; words are encoded in this pass only."""
    kind = id_kind(len(JsonTokenizer(vocabulary).sizes))
    names = ["row", "doc_id", "held_out", "key", "ids", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, texts = word_table(vocabulary), 0
        counts = np.zeros(0, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal counts
            seen = np.flatnonzero(counts)
            for at in range(0, len(seen), 50_000):
                some = seen[at : at + 50_000]
                ids, sizes = table.ids(some)
                yield counted(binaries(ids.astype(kind), sizes), counts[some])
            counts = np.zeros(0, np.int64)

        def counted(words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(words), t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())), words, pa.array(n)], names=names)

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, sizes, rows, per = text_ids(part.column("text"), table)
                learned = ~pc.fill_null(part.column("held_out"), True).to_numpy(zero_copy_only=False)
                texts += int(learned.sum())
                times = np.bincount(rows[np.repeat(learned, per)], minlength=len(table.words))
                times[: len(counts)] += counts
                counts = times
                none = (pa.nulls(len(part), pa.binary()), pa.nulls(len(part), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:4]), binaries(ids.astype(kind), sizes), *none], names=names)
                if table.full:
                    yield from flush()
                    table.trim()
        yield from flush()
        if texts:
            yield counted(pa.array([END], pa.binary()), np.array([texts]))

    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), F.expr(held_out).alias("held_out"), F.xxhash64(doc_id, text).alias("key"), text.alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, held_out boolean, key long, ids binary, word binary, n long")


def summed(both: DataFrame) -> DataFrame:
    """word and n of what encoded() gives."""
    return both.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """word (its ids) and n over all texts, and END with their number."""
    return summed(encoded(docs, "false", vocabulary))


def id_counts(words: DataFrame, size: int) -> np.ndarray:
    """How often each id of a vocabulary of this size occurs, from the counts of the words."""
    kind = id_kind(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids, sizes = ids_of(batch.column("word"), kind)
            np.add.at(total, ids, np.repeat(batch.column("n").to_numpy(), sizes))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = words.select("word", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


# ---------------------------------------------------------------- training and scoring


def _learner(shared, kind: np.dtype, rates: tuple[float, float], seed: int, expected: float, at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's texts: place and value of every weight after one pass over all their windows, from the shared model's weights.
    Windows are shuffled among texts of `at_once` ids, and the rate falls over `expected` ids. Values are whole numbers, whose
    sums don't depend on their order."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        descent, held, size, done = None, [], 0, 0

        def descend() -> None:
            nonlocal descent, held, size, done
            if descent is None:
                descent = Descent(replace(shared.value, w=dict(shared.value.w), tables=None, rooms={}), rates, batch=int(min(256, max(32, expected // 12_000))), seed=seed)
            descent.over(held, done / expected, (done + size) / expected)
            held, size, done = [], 0, done + size

        for batch in batches:
            ids, sizes = ids_of(batch.column("ids"), kind)
            for own in np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []:  # one by one, so that batches' bounds change nothing
                held.append(own)
                size += len(own) + 1
                if size >= at_once:
                    descend()
        if held:
            descend()
        if descent is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(descent.flat))), pa.array(np.rint(descent.flat.astype(np.float64) * FIXED).astype(np.int64))], names=["at", "value"])

    return learn


def fit(train: DataFrame, words: DataFrame, texts: int, vocabulary: str = VOCABULARY, least_texts: int = 1500, rounds: int = 4, per_task: int = 1_500_000, at_once: int = 750_000, rate: float = 0.02, **options) -> AttentionModel:
    """Counts of ids come from all training texts (words: their counts, texts: their number), and the weights are fitted to all
    windows of all of them: each text takes part in one round, or in so many more that a round has about least_texts. A hash
    of the row deals the texts over the rounds, and within a round over tasks of about per_task ids, wherever they lay
    before. In a round every task goes once over its texts, all from the same weights, and their weights' means are the next
    round's; Spark sums them up, so the driver holds one model. train: doc_id and text, or key, doc_id and ids of encoded()."""
    spark = train.sparkSession
    vocabulary_size = len(JsonTokenizer(vocabulary).sizes)
    counts = id_counts(words, vocabulary_size)
    model = AttentionModel(Units.of(counts, texts), **options)
    model.start()
    repeats = max(1, min(rounds, -(-rounds * least_texts // max(1, texts))))
    size = (int(counts.sum()) + texts) * repeats / rounds
    tasks = max(1, round(size / per_task))
    dealt = train if "ids" in train.columns else written(encoded(train, "false", vocabulary).where("word IS NULL"), "lm-ids")
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        rates = tuple(rate * (1 - 0.9 * (number + x) / rounds) for x in range(2))
        own = dealt.where(F.pmod(F.xxhash64("key", F.lit("round")) + number, F.lit(rounds)) < repeats).repartition(tasks, "key").sortWithinPartitions("key", "doc_id", "ids").select("ids")
        sums = own.mapInArrow(_learner(shared, id_kind(vocabulary_size), rates, number, max(1.0, size / tasks), at_once), "at long, value long").groupBy("at").agg(F.sum("value").alias("value"), F.count("*").alias("n")).toArrow()
        if sums.num_rows:
            flat = np.empty(sums.num_rows)
            flat[sums["at"].to_numpy()] = sums["value"].to_numpy() / sums["n"].to_numpy() / FIXED
            ends = np.cumsum([v.size for v in model.w.values()])
            model = replace(model, w={k: x.reshape(v.shape).astype(v.dtype) for (k, v), x in zip(model.w.items(), np.split(flat, ends[:-1]), strict=True)}, tables=None, rooms={})
    return model


def score(docs: DataFrame, held_out: str, vocabulary: str = VOCABULARY, most_hot: int = 300_000, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    held_out: SQL for the rows that aren't learned from. Null text counts as empty: one token, the end. Null ids and
    repeated rows come out as they are; other columns aren't read; an empty table gives no rows. Without training
    texts every count is 0.

    Texts are encoded once, and their ids are written. Counts of the commonest words (at most most_hot, of 64 ids or fewer,
    by a threshold that a histogram of the counts gives) are broadcast. The other words of a text are joined with the
    counts; by choice of the threshold none of those words is common among the training texts.
    """
    spark, tokenizer = docs.sparkSession, JsonTokenizer(vocabulary)
    size = len(tokenizer.sizes)
    kind, opening = id_kind(size), tokenizer.opening()
    both = written(encoded(docs, held_out, vocabulary), "lm-ids")
    rows = both.where("word IS NULL").select("row", "doc_id", "held_out", "key", "ids")
    words = written(summed(both), "lm-words")
    short = F.length("word") <= 64 * kind.itemsize
    sums = words.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("n")))).first()
    total, distinct, texts = (int(x or 0) for x in sums)
    by_power = {int(p): n for p, n in words.where(short).groupBy(F.floor(F.log2("n")).alias("p")).count().collect()}
    power, held = max(by_power, default=0) + 1, 0
    while power > 0 and held + by_power.get(power - 1, 0) <= most_hot:
        power -= 1
        held += by_power.get(power, 0)
    hot_table = words.where(short & (F.col("n") >= 2**power)).toArrow()
    hot = dict(zip(hot_table["word"].cast(pa.binary()).to_pylist(), np.log10(hot_table["n"].to_numpy() + 1.0).tolist(), strict=True))
    model = fit(rows.where("NOT held_out"), words, texts, vocabulary, **options)
    shared = spark.sparkContext.broadcast((model, hot, opening))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model, hot, opening = shared.value
        end = hot.get(END, np.nan)
        unknown_end = int(np.isnan(end))
        for batch in batches:
            for part in slices(batch, "ids", 1 << 20):
                ids, sizes = ids_of(part.column("ids"), kind)
                ends = np.cumsum(sizes, dtype=np.int64)
                scores = model.score(np.split(ids, ends[:-1]))
                begins = np.flatnonzero(opening[ids])
                found = strings_of(ids.view(np.uint8), begins * kind.itemsize)
                known, at = found.dictionary.to_pylist(), found.indices.to_numpy()
                logs = np.array([hot.get(w, np.nan) for w in known], np.float64)
                out: list[tuple] = []
                for own in np.split(at, np.searchsorted(begins, ends[:-1])):
                    own_logs = np.append(logs[own], end)
                    rare, times = np.unique(own[np.isnan(own_logs[:-1])], return_counts=True)
                    out.append((len(own_logs), len(own_logs) - int(times.sum()) - unknown_end, float(np.nansum(own_logs)), [known[r] for r in rare] + [END] * unknown_end, times.tolist() + [1] * unknown_end))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())), strict=True)), pa.array(scores)],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "words", "times", "score"],
                )

    kinds = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, words array<binary>, times array<long>, score double"
    scored = written(rows.mapInArrow(run, kinds), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(words, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    none = F.lit(0)
    return scored.drop("words", "times").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", none)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", none.cast("double")) - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        "score",
    )
