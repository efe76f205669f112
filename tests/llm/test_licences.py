"""Licence scan against a plain reading, on every known text and awkward rows."""

import hashlib
import re
import textwrap
from pathlib import Path

import duckdb
from cases import AWKWARD

from keelson.llm import licences


def canonical(text):
    text = re.sub(r"(?m)^[\W_]*?(copyright|\(c\)|©|all rights reserved)[^\n]*$", "", text.lower())
    text = f" {re.sub(r'[\W_]+', ' ', text).strip()} "
    for one, other in licences.SPELLINGS:
        text = text.replace(f" {one} ", f" {other} ")
    return text.strip()


def brute(docs):
    known = {}
    for name, text in sorted(licences.KNOWN):
        known.setdefault(hashlib.md5(canonical(text).encode()).hexdigest(), name)
    of = lambda t: known.get(hashlib.md5(canonical(t).encode()).hexdigest()) if canonical(t) else None
    out = []
    for i, t in docs:
        lines = [x for x in map(of, (t or "").split("\n")) if x]
        out.append((i, of(t or ""), ",".join(sorted(set(lines))) or None, len(lines)))
    return sorted(out, key=str)


def varied(text):
    return "  Copyright (c) 2020 Some One\nAll rights reserved.\n" + text.upper().replace("LICENSE", "LICENCE").replace(" ", "  ").replace(",", " ;")


def test_known_texts_and_awkward_rows(spark, awkward, empty):
    docs = [(100 + i, f(t)) for i, (_, t) in enumerate(licences.KNOWN) for f in (str, varied, lambda t: f"some words\n{t}\nmore words\n{t}")]
    docs += [(900, "Released under the MIT License. And more."), (901, "© 2020"), *AWKWARD]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [tuple(r) for r in licences.scan(df).collect()]
    assert sorted(rows, key=str) == brute(docs)
    assert all(r[1] for r in rows if r[0] is not None and 100 <= r[0] < 100 + len(licences.KNOWN)) or {r[1] for r in rows if r[1]} == {n for n, _ in licences.KNOWN}
    assert licences.scan(empty).count() == 0 and licences.scan(awkward).count() == len(AWKWARD)


def test_own_list(spark):
    df = spark.createDataFrame([(1, "The Licence!"), (2, "the license of it")], "doc_id long, text string")
    assert sorted(tuple(r) for r in licences.scan(df, [("X", "the license")]).collect()) == [(1, "X", "X", 1), (2, None, None, 0)]


def test_sql_gives_the_same(spark, sample):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(tuple(r) for r in licences.scan(sample).collect()) == sorted(con.execute(f"SELECT doc_id, licence, notices, n_notices FROM ({licences.sql()})").fetchall())


def test_entire_texts_and_blocks_of_lines(spark):
    mit = next(t for n, t in licences.KNOWN if n == "MIT")
    wrapped = textwrap.wrap(mit.removeprefix("MIT License "), 60)
    files = sorted((Path(licences.__file__).parent / "licence_texts").glob("*.txt"))
    docs = [(i, f.read_text()) for i, f in enumerate(files)]
    docs += [(100, "\n".join(["import x", "# Copyright 2020 A", *(f"# {w}" for w in wrapped), "", "x()"])), (101, "\n".join(wrapped[:-1])), (102, "a\n" + docs[0][1] + "\nb")]
    found = {r["doc_id"]: tuple(r)[1:] for r in licences.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [found[i][0] for i in range(len(files))] == [f.stem for f in files]
    assert found[100] == (None, "MIT", 1) and found[101] == (None, None, 0) and found[102] == (None, "Apache-2.0", 1)


def test_any_order_of_rows(spark):
    """Inputs whose rows come in another order each time they are read."""
    texts = [t for _, t in licences.KNOWN if len(t) < 200]
    docs = [(i, f"line {i}\n{texts[i % len(texts)]}" if i % 3 else f"plain {i}") for i in range(2000)]
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for shuffled in (df.repartition(7), df.distinct(), df.join(df.select("doc_id").repartition(5), "doc_id"), df.orderBy("text")):
        assert sorted((tuple(r) for r in licences.scan(shuffled).collect()), key=str) == want
