"""The contract language: reading, binding, and the round trip."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.model import Code
from keelson.sinks.language import export_language
from keelson.sources.language import compile_text, parse
from keelson.sources.lexer import tokens, unescape


FULL = """
Enum app.status {
  active [note: 'on']
  "in active"
}
TablePartial stamped {
  created_at timestamp [default: `now()`]
  owner int [ref: > users.id]
}
Table users as U [headercolor: #123456] {
  id int [pk, increment]
  name varchar(5) [not null, unique, default: 'a', check: `name <> ''`]
  state app.status
  price decimal(10, 2) [default: -1.5]
  tags int[][3]
  "big type" "double precision"
  ~stamped

  indexes {
    (id, name) [unique, name: 'ix', type: btree]
    `lower(name)`
  }
  checks {
    `price > 0` [name: 'positive']
  }
  Note: '''
    two
      lines
  '''
}
Table s.posts {
  id int
  uid int
  indexes {
    (id, uid) [pk]
  }
}
Ref named: s.posts.uid > users.id [delete: set null, update: cascade]
TableGroup g [color: #fff] {
  users
  s.posts
}
Note sticky {
  'hello'
}
DiagramView v {
  Tables {
    users
  }
  Notes {
    *
  }
}
records users(id, name, price) {
  1, 'a', -2.5
  2, ,
  , "x", `f()`
}
"""


def codes(source):
    return [e.code for e in compile_text(source).errors]


def test_full_model():
    db = compile_text(FULL).result()
    users = db.table("U")
    assert [c.name for c in users.columns] == ["id", "name", "state", "price", "tags", "big type", "created_at", "owner"]
    assert users.column("price").default.value == "-1.5" and users.column("tags").type == "int[][3]"
    assert users.note == "two\n  lines\n" and users.indexes[0].columns == ["id", "name"] and users.indexes[1].columns is None
    assert db.refs[0].on_delete == "set null" and [e.table for e in db.refs[0].ends] == ["posts", "users"]
    assert [r.partial for r in db.all_refs()] == [None, "stamped"]
    assert [[c.value for c in row] for row in db.records[0].rows] == [[1, "a", -2.5], [2, None, None], [None, "x", "f()"]]
    assert db.views[0].tables == ["users"] and db.views[0].notes == [] and db.views[0].groups is None


def test_round_trip():
    once = compile_text(FULL).result()
    again = compile_text(export_language(once)).result()
    assert export_language(again) == export_language(once)
    assert [t.columns for t in again.tables] == [t.columns for t in once.tables] and again.records == once.records or [r.rows for r in again.records] == [r.rows for r in once.records]


def test_partial_column_order():
    db = compile_text("TablePartial WithId {\n id int\n extra varchar\n}\nTable users {\n ~WithId\n id int [pk]\n name varchar\n}").result()
    assert [c.name for c in db.tables[0].columns] == ["extra", "id", "name"] and db.tables[0].column("id").pk


def test_later_partial_wins():
    db = compile_text("TablePartial P1 {\n a int\n shared int\n b int\n}\nTablePartial P2 {\n shared varchar\n c int\n}\nTable T {\n ~P1\n x int [pk]\n ~P2\n y int\n}").result()
    assert [(c.name, c.type) for c in db.tables[0].columns] == [("a", "int"), ("b", "int"), ("x", "int"), ("shared", "varchar"), ("c", "int"), ("y", "int")]


def test_local_note_beats_partial():
    db = compile_text("TablePartial p [note: 'theirs', headercolor: #fff] {\n a int\n}\nTable t [note: 'mine'] {\n ~p\n}").result()
    assert db.tables[0].note == "mine" and db.tables[0].color == "#fff"


def test_two_inline_keys_make_one():
    table = compile_text("Table t {\n a int [pk]\n b int [pk]\n}").result().tables[0]
    assert table.primary_key() == ["a", "b"] and not any(c.pk for c in table.columns)


@pytest.mark.parametrize(
    ("source", "code"),
    [
        ("Table t {\n a int\n a int\n}", Code.DUPLICATE_NAME),
        ("Table t {\n a int\n}\nTable t {\n a int\n}", Code.DUPLICATE_NAME),
        ("Table t {\n}", Code.EMPTY_ELEMENT),
        ("Table t {\n a int [pk, pk]\n}", Code.DUPLICATE_SETTING),
        ("Table t {\n a int [null, not null]\n}", Code.CONFLICTING_SETTING),
        ("Table t {\n a int [shiny]\n}", Code.UNKNOWN_SETTING),
        ("Table t {\n a int [ref: > u.id]\n}", Code.NOT_FOUND),
        ("Table t {\n a int\n b int\n}\nRef: t.(a, b) > t.a", Code.UNEQUAL_ENDPOINTS),
        ("Table t {\n a int\n}\nRef: t.a > t.a", Code.SAME_ENDPOINT),
        ("Table t {\n a int\n}\nTable u {\n a int [ref: > t.a]\n}\nRef: t.a < u.a", Code.DUPLICATE_REF),
        ("Table t {\n a int\n}\nTableGroup g {\n t\n}\nTableGroup h {\n t\n}", Code.TABLE_IN_TWO_GROUPS),
        ("Table t {\n a int\n}\nrecords t(a) {\n 1\n}\nrecords t(a) {\n 2\n}", Code.DUPLICATE_RECORDS),
        ("Table t {\n a int\n ~p\n ~p\n}\nTablePartial p {\n b int\n}", Code.DUPLICATE_PARTIAL),
        ("Table a.b.c {\n a int\n}", Code.UNSUPPORTED),
        ("Shelf t {\n a int\n}", Code.UNKNOWN_ELEMENT),
        ("Table t {\n a int [note: 'open\n}", Code.UNCLOSED),
        ("Table t {\n a int", Code.UNCLOSED),
    ],
)
def test_errors(source, code):
    assert code in codes(source)


def test_errors_are_collected():
    report = compile_text("Table t {\n a\n b int [shiny]\n c int\n}\nWhat x {\n}\nEnum e {\n}")
    assert {Code.INVALID_VALUE, Code.UNKNOWN_SETTING, Code.UNKNOWN_ELEMENT, Code.EMPTY_ELEMENT} <= {e.code for e in report.errors}


def test_escapes():
    assert unescape(r"a\tb\\c\'dé\q" + "\\\nx") == "a\tb\\c'déqx"
    assert [t.kind for t in tokens("1a 1.5 1e3 'x' \"y\" `z` #fff a.b // no\n/* no */")[0]] == ["word", "number", "number", "string", "quoted", "expression", "color", "word", "op", "word", "end"]


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_never_raises(text):
    parse(text)
    parse("Table t {\n" + text)


@given(st.lists(st.tuples(st.text(min_size=1, max_size=8), st.sampled_from(["int", "varchar(3)", "decimal(5,2)", "text[]"])), min_size=1, max_size=5, unique_by=lambda x: x[0]))
@settings(max_examples=60, deadline=None)
def test_any_column_name_survives(columns):
    from keelson.model import Column, Database, Table

    db = Database(tables=[Table("t", columns=[Column(n, k) for n, k in columns])])
    again = compile_text(export_language(db)).result()
    assert [(c.name, c.type) for c in again.tables[0].columns] == columns
