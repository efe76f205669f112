"""Language ID, quality rules and language-model scores against brute force and held-out accuracy."""

import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from cases import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import attention, language, quality
from keelson.llm.common import JsonTokenizer
from keelson.llm.ngrams import Words, char_ngrams

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_held_out(spark, sample):
    model = language.fit(sample.where(language.remainder(sample["doc_id"], 5) != 0))
    rows = {r["doc_id"]: r for r in language.predict(sample, model).collect()}
    held = [r for r in sample.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_awkward(spark, awkward, empty):
    model = language.fit(awkward)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(awkward, model).collect()}
    assert {(2, "und"), (3, "und"), (7, "und"), (10, "und"), (1, "en"), (None, "en")} <= got
    assert language.keep_known(awkward, model).columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in language.keep_known(awkward, model).collect()) == sorted(["1", "None", "5", "5", "6", "8", "9"])
    nothing = language.fit(empty)
    assert nothing.languages == [] and {r["lang_pred"] for r in language.predict(awkward, nothing).collect()} == {"und"} and language.predict(empty, model).count() == 0


def test_language_counts_against_brute_force(spark):
    texts = [("ab Ba", "x"), ("ccc", "y"), ("abab", "x")]
    model = language.fit(spark.createDataFrame(texts, "text string, lang string"), sizes=(2,), bits=6, alpha=1.0)
    count = {k: np.zeros(64) for k in "xy"}
    for t, k in texts:
        np.add.at(count[k], char_ngrams([t.lower()], 2, 6)[0], 1)
    want = np.stack([np.log((count[k] + 1) / (count[k].sum() + 64)) for k in "xy"], 1)
    assert np.allclose(model.log_prob, want, atol=1e-6) and np.allclose(np.exp(model.log_prior), [2 / 3, 1 / 3])
    with pytest.raises(ValueError, match="languages"):
        language.fit(spark.createDataFrame(texts, "text string, lang string"), most_languages=1)


@given(st.lists(st.text(alphabet="ab \n\té", max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_counts_against_brute_force(texts):
    words = Words(texts)
    got = quality.base_counts(texts, words)
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        times = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {j + k for j in range(len(w) - 2) if times[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (len(w), sum(map(len, w)), dup, len(marked)) == tuple(got[k][i] for k in ("n_words", "word_chars", "n_dup_lines", "n_repeat_words"))
    for n in (1, 2, 3):
        flat, made = char_ngrams(texts, n, 10)
        alone = [char_ngrams([t], n, 10)[0] for t in texts]
        assert flat.tolist() == [x for a in alone for x in a] and made.tolist() == [len(a) for a in alone]
        flat, made = words.ngrams(n, 10)
        assert flat.tolist() == [x for t in texts for x in Words([t]).ngrams(n, 10)[0]]


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 3 <> 0")
    model = quality.fit(docs, train, rows=400)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [r for r in labels.where("doc_id % 3 = 0").collect() if not got[r["doc_id"]]["base_failed"]]
    assert np.mean([got[r["doc_id"]]["kept"] == (r["quality"] == 1) for r in held]) >= 0.97
    assert all(got[r["doc_id"]]["kept"] for r in held if r["quality"] == 1)


def test_quality_awkward(spark, awkward, empty):
    none = quality.fit(awkward, spark.createDataFrame([(1, None), (1, 1), (None, 0)], "doc_id long, quality int"))
    assert none.weights is None
    rows = quality.score(awkward, none).collect()
    assert len(rows) == len(AWKWARD) and {r["doc_id"] for r in rows if r["kept"]} == {9} and {r["doc_id"] for r in rows if r["n_repeat_words"]} == {1}
    assert quality.keep_good(awkward, none).columns == awkward.columns and quality.score(empty, none).count() == 0


def test_platt_recovers_a_sigmoid():
    r = np.random.default_rng(0)
    x = r.normal(size=20000)
    y = (r.random(20000) < 1 / (1 + np.exp(-(3 * x - 1)))).astype(float)
    slope, shift = quality.platt(x, y)
    assert abs(slope - 3) < 0.2 and abs(shift + 1) < 0.1


def small_model(own=60):
    counts = np.random.default_rng(0).integers(0, 50, 200)
    model = attention.AttentionModel(attention.Units.of(counts, 5, own=own, members=8), window=6, overlap=2, dim=4, keys=3, hidden=6)
    model.start()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    return model


def test_windows_score_each_place_once():
    model = small_model()
    lengths = np.array([1, 2, 5, 6, 7, 10, 11, 29])
    slot, scored = model.slots(model.windows(lengths))
    assert sorted(slot[scored].tolist()) == list(range(lengths.sum()))
    first = np.cumsum(lengths) - lengths
    for row, mark in zip(slot, scored, strict=True):
        at = row[mark]
        own = first[np.searchsorted(first, at[0], "right") - 1]
        assert at[0] == own or at[0] - row[0] >= model.overlap


def texts_of_ids(r, most=40):
    return [r.integers(0, 200, n).astype(np.uint32) for n in (0, 1, 3, 5, 6, 7, 20, most)]


@pytest.mark.parametrize("kind", [np.float32, np.float64])
@pytest.mark.parametrize("scale", [1, 8, 40])
def test_infer_equals_log_prob(scale, kind):
    """Weights that take exponents far beyond the range of floats too."""
    model, r = small_model(), np.random.default_rng(2)
    model.w = {k: (v if k == "mem_b" else v * scale).astype(kind) for k, v in model.w.items()}
    read, target, _, lengths = model.places(texts_of_ids(r))
    windows = model.windows(lengths)
    for some, low in ((windows[windows[:, 2] == 0], 0), (windows[windows[:, 2] > 0], model.overlap)):
        slot, scored = model.slots(some)
        want = model.log_prob(read[slot], target[slot], scored)
        got = model._infer(read[slot], target[slot], scored, low, at_once=3)
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-3 if kind is np.float32 else 1e-9, atol=1e-3 * scale if kind is np.float32 else 1e-9)
    assert scale < 40 or -want.min() > 1000


def test_score_against_brute_force():
    """Every place by itself, over its own window, one product after the other."""
    model, r = small_model(), np.random.default_rng(3)
    w, m, u = model.w, model.units.members, model.units
    ids = texts_of_ids(r)

    def log_softmax(z):
        return z - z.max() - np.log(np.exp(z - z.max()).sum())

    for text, got in zip(ids, model.score(ids, batch=4), strict=True):
        all_ids = [*text.tolist(), len(u.unit) - 1]
        units, total = [int(u.unit[i]) for i in all_ids], 0.0
        read = [u.count, *units[:-1]]
        for place, i in enumerate(all_ids):
            start = 0 if place < model.window else (place - model.overlap) // (model.window - model.overlap) * (model.window - model.overlap)
            e = np.array([w["emb"][x] + w["pos"][n] for n, x in enumerate(read[start : place + 1])])
            q, k, v = np.split(e @ w["qkv"], (model.keys, 2 * model.keys), axis=1)
            a = np.exp(log_softmax(k @ q[-1] / model.keys**0.5))
            h = e[-1] + a @ v @ w["out"]
            g = h + np.maximum(h @ w["up"] + w["up_b"], 0) @ w["down"]
            c, member = divmod(units[place], m)
            total += log_softmax(g @ w["cls"] + w["cls_b"])[c] + log_softmax(g @ w["mem"][c] + w["mem_b"][c])[member] + u.log_share[i]
        assert abs(total / np.log(10) - got) < 1e-6


def test_gradient():
    model, r = small_model(), np.random.default_rng(1)
    ids = [r.integers(0, 200, n).astype(np.uint32) for n in (0, 1, 5, 6, 7, 20)]
    read, target, _, lengths = model.places(ids)
    slot, scored = model.slots(model.windows(lengths))
    loss, grad = model.gradient(read[slot], target[slot], scored)
    assert abs(loss + model.log_prob(read[slot], target[slot], scored).mean()) < 1e-9
    for name, w in model.w.items():
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in w.shape)
            if w[at] < -1e3:
                continue
            old, sides = w[at], []
            for step in (1e-5, -1e-5):
                w[at] = old + step
                sides.append(-model.log_prob(read[slot], target[slot], scored).mean())
            w[at] = old
            assert abs((sides[0] - sides[1]) / 2e-5 - grad[name][at]) < 1e-6


def test_probabilities_sum_to_one():
    model, total = small_model(), 0.0
    for last in [*range(200), None]:
        ids = [5, 7] + ([last] if last is not None else [])
        read, target, share, _ = model.places([np.array(ids, np.uint32)])
        pad = lambda x: np.pad(x, (0, 6 - len(x)))[None]
        total += np.exp(model.log_prob(pad(read), pad(target), np.arange(6)[None] == 2)[0] + share[2])
    assert abs(total - 1) < 1e-9


def test_later_ids_don_t_change_earlier_scores():
    model = small_model()
    a, b = model.places([np.arange(5, dtype=np.uint32)]), model.places([np.array([0, 1, 2, 9, 9], np.uint32)])
    first = np.arange(6)[None] < 3
    assert np.allclose(model.log_prob(a[0][None], a[1][None], first), model.log_prob(b[0][None], b[1][None], first))


HELD = "crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 7 = 2"


def check_scores(rows, docs):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter()
    for i, t in docs:
        if not held(i):
            count.update(WORD.findall(lower(t or "")))
            count[""] += 1
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in docs:
        w = [*WORD.findall(lower(t or "")), ""]
        want.append((str(i), held(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]
    assert sorted(got) == sorted(want)


def test_scores_awkward(awkward, empty):
    rows = attention.score(awkward, HELD, most_hot=3).collect()
    check_scores(rows, AWKWARD)
    assert all(r["score"] < 0 for r in rows)
    assert attention.score(empty, HELD).count() == 0


def test_scores_sample(sample):
    docs = sample.select("doc_id", "text")
    rows = attention.score(docs, HELD, most_hot=500).collect()
    check_scores(rows, [tuple(r) for r in docs.collect()])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 1.1 * sum(r["base_score"] for r in held)  # even of 200 texts


def test_weights_learn_from_every_training_text(spark):
    """The words of one text in another order change no count, but the weights; how the rows lie changes nothing."""
    texts = [(i, f"some words come {'before' if i % 2 else 'after'} others {i % 7}") for i in range(3000)]
    kind = "doc_id long, text string"
    docs = spark.createDataFrame(texts, kind)
    # one that a share of 1,500 texts by a hash of doc_id leaves out
    left_out = docs.where("pmod(xxhash64(xxhash64(doc_id)), 2147483648L) >= 1073741824L").first()["doc_id"]
    other = [(i, " ".join(reversed(t.split())) if i == left_out else t) for i, t in texts]
    words = attention.word_counts(docs).cache()

    def weights(train):
        model = attention.fit(train, words, len(texts), rounds=2, dim=4, keys=3, hidden=4)
        return np.concatenate([x.reshape(-1) for x in model.w.values()])

    own = weights(docs)
    assert (own == weights(docs.repartition(5))).all()
    assert (own != weights(spark.createDataFrame(other, kind))).any()


@pytest.mark.parametrize("scale", [1, 40])
def test_gradient_of_windows_that_go_on(scale):
    """What is left out before the first scored slot has no part in the gradient."""
    model, r = small_model(), np.random.default_rng(5)
    model.w = {k: v if k == "mem_b" else v * scale for k, v in model.w.items()}
    read, target, _, lengths = model.places([r.integers(0, 200, 40).astype(np.uint32)])
    windows = model.windows(lengths)[1:]
    slot, scored = model.slots(windows)
    loss, grad = model.gradient(read[slot], target[slot], scored)
    low_loss, low_grad = model.gradient(read[slot], target[slot], scored, model.overlap)
    assert abs(loss - low_loss) < 1e-9 and all(np.isfinite(g).all() and np.allclose(g, low_grad[k]) for k, g in grad.items())


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBZ \n\t\x0b\x1c\u3000é", max_size=20)), max_size=6), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_words_in_against_one_by_one(texts, skip):
    words, per = attention.words_in(pa.array(texts, pa.string())[skip:])
    own = np.array([*words.dictionary.to_pylist(), b""], object)[words.indices.to_numpy()].tolist()
    assert per.tolist() == [len(attention.words_of(t or "")) for t in texts[skip:]]
    assert own == [w for t in texts[skip:] for w in attention.words_of(t or "")]


def test_texts_are_encoded_once(awkward, monkeypatch):
    """Ids are written with the words' counts; learning reads them and encodes nothing."""
    rows = attention.encoded(awkward, HELD).collect()
    kind, tokenizer = attention.id_kind(50257), JsonTokenizer(attention.VOCABULARY)
    encode = lambda words: tokenizer.encode([" " + w.decode() for w in words])
    want, count = [], Counter()
    for i, text in AWKWARD:
        ids = [np.frombuffer(x, np.uint32).astype(kind).tobytes() for x in encode(attention.words_of(text or ""))]
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        want.append((str(i), held, b"".join(ids)))
        count.update([] if held else [*ids, b""])
    assert sorted((str(r["doc_id"]), r["held_out"], bytes(r["ids"])) for r in rows if r["word"] is None) == sorted(want)
    got = Counter()
    for r in rows:
        if r["word"] is not None:
            got[bytes(r["word"])] += r["n"]
    assert got == count

    model, texts = small_model(), [np.array(x, kind) for x in ([1, 2, 3], [], list(range(40)))]
    column = attention.binaries(np.concatenate(texts), np.array([3, 0, 40]))
    assert [x.tolist() for x in np.split(attention.ids_of(column[1:], kind)[0], [0])] == [[], list(range(40))]
    monkeypatch.setattr(attention, "word_table", None)
    learn = attention._learner(SimpleNamespace(value=model), kind, (0.02, 0.002), 0, 100, 10)
    batches = [pa.RecordBatch.from_arrays([c], names=["ids"]) for c in (column, column[:0], column)]
    assert sum(b.num_rows for b in learn(iter(batches))) == sum(w.size for w in model.w.values())
