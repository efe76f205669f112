"""DartMinHash: estimates, classes against brute force, the pipeline's stages, the queries."""

import re

import numpy as np
import pytest
from cases import AWKWARD, DOCS

import corpus_pipeline
from keelson.llm import darts, queries


def test_estimates():
    r = np.random.default_rng(0)
    for similarity in (0.3, 0.8):
        a, b = [], []
        for _ in range(100):
            n = int(r.integers(3, 2000))
            x = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
            same = round(2 * n * similarity / (1 + similarity))
            a.append((x[:n], np.ones(n)))
            b.append((x[n - same : 2 * n - same], np.ones(n)))
        s = darts.signatures(a + b, 252)
        assert abs((s[:100] == s[100:]).mean() - similarity) < 0.02


def test_weighted_estimates():
    r, a, b, want = np.random.default_rng(0), [], [], []
    for _ in range(200):
        x = np.arange(50, dtype=np.uint64) + np.uint64(r.integers(0, 2**40))
        v, w = r.random(50) * 3, r.random(50) * 3
        a.append((x, v))
        b.append((x, w))
        want.append(np.minimum(v, w).sum() / np.maximum(v, w).sum())
    s = darts.signatures(a + b, 120)
    assert abs((s[:200] == s[200:]).mean() - np.mean(want)) < 0.03
    assert not darts.signatures([(np.zeros(0, np.uint64), np.zeros(0))], 8).any()


def brute(docs, least=0.8):
    """Class of each row: row numbers joined by equal words or a similarity of `least`."""
    words = [re.findall(r"\w+", (t or "").lower()) or (t or "").split() for _, t in docs]
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in words]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if words[i] == words[j] or both and both / (len(sets[i]) + len(sets[j]) - both) >= least:
                parent[root(i)] = root(j)
    members = {}
    for i in range(len(docs)):
        members.setdefault(root(i), []).append(docs[i][0])
    lowest = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted(((d[0], lowest[root(i)]) for i, d in enumerate(docs)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["class_id"]) for r in df.collect()), key=str)


def test_classes_awkward(spark, awkward, empty):
    assert got(darts.classes(awkward)) == brute(AWKWARD)
    assert darts.classes(empty).count() == 0
    with pytest.raises(ValueError, match="divide"):
        darts.classes(empty, k=120)


def test_classes_of_chains_and_hot_groups(spark):
    """A chain in which only neighbours are similar, copies by the dozen, near copies of one text, and texts that share
    one passage without being alike."""
    r = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    docs, base = [], word(200)
    for i in range(12):
        base = base[6:] + word(6)
        docs.append((i, " ".join(base)))
    for i in range(40):
        near = list(docs[0][1].split())
        near[int(r.integers(0, 200))] = f"n{i}"
        docs.append((100 + i, " ".join(near) if i % 2 else docs[3][1].upper() + "!"))
    passage = word(60)
    docs += [(200 + i, " ".join(word(80) + passage + word(80))) for i in range(25)]
    center = word(120)
    for i in range(20):  # similar to the center, hardly to each other
        own = list(center)
        own[int(r.integers(0, 60))], own[int(r.integers(60, 120))] = f"a{i}", f"b{i}"
        docs.append((300 + i, " ".join(own)))
    docs.append((999, " ".join(center)))
    for chunk in (512, 3):  # the second cuts most buckets into several blocks
        report = {}
        assert got(darts.classes(spark.createDataFrame(docs, "doc_id long, text string"), chunk=chunk, report=report)) == brute(docs)
        assert report["leaders"].count() > 20 and report["blocks"].count()


def test_links_within_a_large_template_group(spark):
    """Thousands of texts of one template, each with a passage of its own (so 0.78 alike), and for each a second text with
    another end (0.82, a link). No other two are linked."""
    own = lambda kind, i, n: " ".join(f"{kind}{i}x{j}" for j in range(n))
    template = [f"t{j}" for j in range(400)]
    docs = []
    for i in range(1500):
        head = f"{' '.join(template[:100])} {own('p', i, 44)} {' '.join(template[144:360])} "
        docs += [(2 * i, head + " ".join(template[360:])), (2 * i + 1, head + own("e", i, 40))]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in docs[:4])]
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(4) for j in range(i)}
    assert 0.8 < alike[1, 0] < 0.84 and 0.7 < alike[2, 0] < 0.79 and max(alike[2, 1], alike[3, 0], alike[3, 1]) < 0.7
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(darts.classes(df)) == sorted(((i, i - i % 2) for i, _ in docs), key=str)


def test_recall_of_links(spark):
    """Of links of 0.8 to 0.85, each between two texts of their own, 0.99 are found at least (0.9998 by formula)."""
    r, docs, links = np.random.default_rng(5), [], set()
    for i in range(1500):
        n = int(r.integers(60, 300))
        x = [f"w{i}x{j}" for j in range(n)]
        y, least = list(x), int(r.integers(800, 835)) / 1000
        sets = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        alike, end = 1.0, n
        while alike > least + 0.015:  # words of its own at the end, one more each time
            end -= 1
            y[end] = f"y{i}x{end}"
            alike = len(sets(x) & sets(y)) / len(sets(x) | sets(y))
        docs += [(2 * i, " ".join(x)), (2 * i + 1, " ".join(y))]
        if 0.8 <= alike < 0.85:
            links.add(2 * i + 1)
    assert len(links) > 1000
    found = {d for d, c in got(darts.classes(spark.createDataFrame(docs, "doc_id long, text string"))) if c == d - 1}
    assert len(found & links) >= 0.99 * len(links)


def test_count_weights(spark):
    docs = [(1, "a b c d e f g h i j " * 3), (2, "a b c d e f g h i j " * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(darts.classes(df)) == [(1, 1), (2, 1)] and got(darts.classes(df, weights="count")) == [(1, 1), (2, 2)]


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 9), (20, 21)]
    df = darts.components(spark.createDataFrame(links, "a long, b long"))
    assert sorted((r["node"], r["label"]) for r in df.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7), (9, 7), (20, 20), (21, 20)]


def test_keep_one(spark, awkward):
    kept = darts.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert len({str(c) for _, c in brute([(i, t) for i, (_, t) in enumerate(AWKWARD)])}) == kept.count()


def test_stages_take_nothing_and_awkward_rows(spark, empty, awkward):
    for docs in (empty, spark.createDataFrame([(*x, "en", "s", 0) for x in AWKWARD], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            if name != "packing":
                assert out.columns == docs.columns
                assert out.count() <= docs.count()
            docs = out if name != "packing" else docs


def test_pipeline_against_its_parts(spark):
    d = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = {r["doc_id"] for r in queries.op10_quality_rules(spark, d).collect() if r["kept"]}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    classes = {c for _, c in brute(left)}
    assert len({r["doc_id"] for r in rows}) == len(classes)
    assert {r["doc_id"] for r in rows} <= good


def test_registered_queries(spark):
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries())
    assert numbers == list(range(1, 11))
