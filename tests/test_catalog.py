"""Folds and filters of catalog frames that no registered query covers."""

from pyspark.sql import functions as F

from keelson.plans import catalog as cat
from keelson.sources.language import compile_text

SOURCE = """
Project p {
  kind: 'test'
}
Enum mood {
  good
  bad
}
Table users as u {
  id int [pk]
  mood mood [default: 'good', check: `mood <> ''`]
  indexes {
    (id, mood) [unique]
  }
}
Table posts {
  id int
  uid int [ref: > u.id]
}
records users(id, mood) {
  1, 'good'
}
"""


def test_every_frame(spark):
    frames = cat.catalog(spark, compile_text(SOURCE).result())
    assert {k: v.count() for k, v in frames.items()} == {"schemas": 1, "tables": 2, "fields": 4, "indexes": 1, "index_columns": 2, "checks": 1, "enums": 1, "enum_values": 2, "refs": 1, "endpoints": 2, "groups": 0, "partials": 0, "notes": 0, "records": 1, "project": 1}
    ends = {(r["side"], r["table_name"], r["field_name"], r["relation"]) for r in frames["endpoints"].collect()}
    assert ends == {(0, "users", "id", "1"), (1, "posts", "uid", "*")}
    assert cat.record_tables(frames["records"], frames["tables"]).first()["alias"] == "u"


def test_inline_keys_become_flags(spark):
    keys = spark.createDataFrame([("t", "a", "pk"), ("t", "a", "unique"), ("t", "b", "unique")], "table_name string, column_name string, kind string")
    assert {tuple(r) for r in cat.flagged_columns(keys).collect()} == {("t", "a", True, False), ("t", "b", False, True)}


def test_checks_of_one_column_are_the_column_s(spark):
    checks = spark.createDataFrame([("t", "c1", "a", "a > 0"), ("t", "c2", "a", "a < b"), ("t", "c2", "b", "a < b")], "table_name string, constraint_name string, column_name string, expression string")
    assert {(r["constraint_name"], r["level"]) for r in cat.table_checks(checks).collect()} == {("c1", "column"), ("c2", "table")}


def test_enum_labels_in_order(spark):
    labels = spark.createDataFrame([("s", "e", "late", 2.0), ("s", "e", "early", 1.0), ("s", "e", "late", 2.0)], "schema_name string, enum_name string, label string, sort_order double")
    assert cat.enum_catalog(labels).first()["labels"] == ["early", "late"]


def test_literal_lists(spark):
    df = spark.createDataFrame([("enum('a','it''s','')",)], "t string")
    assert df.select(cat.literal_list(F.col("t"))).first()[0] == ["a", "it's", ""]


def test_anti_join_ignores_null_names(spark):
    indexes = spark.createDataFrame([("t", "i1"), ("t", "i2"), ("u", "i1")], "table_name string, index_name string")
    constraints = spark.createDataFrame([("t", "i1"), ("t", None)], "table_name string, constraint_name string")
    assert {tuple(r) for r in cat.without_constraints(indexes, constraints).collect()} == {("t", "i2"), ("u", "i1")}


def test_rows_fold_to_tables(spark):
    rows = spark.createDataFrame([("t", 2, "b"), ("t", 1, "a"), ("u", 1, "c")], "table_name string, ordinal int, column_name string")
    folded = {r["table_name"]: [c["column_name"] for c in r["columns"]] for r in cat.to_tables(rows, ["table_name"], "ordinal", "columns").collect()}
    assert folded == {"t": ["a", "b"], "u": ["c"]}
