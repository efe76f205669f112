"""DDL in and out, JSON, projects, introspection, the command line."""

import pytest

from keelson.__main__ import main
from keelson.model import Cell, to_plain
from keelson.sinks.ddl import DIALECTS, export_sql, insert_statements
from keelson.sinks.json import export_json, import_json, normalise
from keelson.sinks.language import export_language
from keelson.sources.ddl import import_sql
from keelson.sources.introspect import FRAMES, catalog_queries, parse_connection, to_model
from keelson.sources.language import compile_text
from keelson.sources.project import MemoryLayout, compile_project, rename_table

BLOG = """
Enum mood {
  happy
  "so so"
}
Table users {
  id int [pk, increment]
  name varchar [not null, unique, note: 'who']
  mood mood
  at timestamp [default: `now()`]
}
Table posts {
  id int [pk]
  author int [ref: > users.id]
  score decimal(5,2) [default: 0, check: `score >= 0`]
  indexes {
    (author, id) [unique, name: 'by_author']
  }
  Note: 'texts'
}
Table tags {
  id int [pk]
}
Ref: posts.id <> tags.id
records users(id, name, at) {
  1, 'O''Hara'.x
}
"""
BLOG = BLOG.replace("'O''Hara'.x", "\"O'Hara\", '2024-01-15 10:30:00'")


def test_export_postgres():
    sql = export_sql(compile_text(BLOG).result(), "postgres")
    for part in (
        "CREATE TYPE \"mood\" AS ENUM (\n  'happy',\n  'so so'\n);",
        '"id" INT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY',
        '"name" varchar UNIQUE NOT NULL',
        '"at" timestamp DEFAULT (now())',
        '"score" decimal(5,2) DEFAULT 0 CHECK (score >= 0)',
        'CREATE UNIQUE INDEX "by_author" ON "posts" ("author", "id");',
        "COMMENT ON TABLE \"posts\" IS 'texts';",
        'CREATE TABLE "posts_tags" (\n  "posts_id" int,\n  "tags_id" int,\n  PRIMARY KEY ("posts_id", "tags_id")\n);',
        'ALTER TABLE "posts" ADD FOREIGN KEY ("author") REFERENCES "users" ("id") DEFERRABLE INITIALLY IMMEDIATE;',
        "SET CONSTRAINTS ALL DEFERRED;",
        "(1, 'O''Hara', '2024-01-15T10:30:00')",
    ):
        assert part in sql


@pytest.mark.parametrize(
    ("dialect", "parts"),
    [
        ("mysql", ["ENUM ('happy', 'so so')", "`id` int PRIMARY KEY AUTO_INCREMENT", "`name` varchar(255) UNIQUE NOT NULL COMMENT 'who'", "SET FOREIGN_KEY_CHECKS = 0;"]),
        ("mssql", ["[mood] nvarchar(255) NOT NULL CHECK ([mood] IN ('happy', 'so so'))", "[id] int PRIMARY KEY IDENTITY(1, 1)", "DEFAULT (0)", "NOCHECK CONSTRAINT ALL", "\nGO"]),
        ("oracle", ['"id" int GENERATED AS IDENTITY PRIMARY KEY', "nvarchar2(255)", "INSERT ALL", "SELECT * FROM dual;", "TO_TIMESTAMP('2024-01-15 10:30:00.000', 'YYYY-MM-DD HH24:MI:SS.FF3')"]),
    ],
)
def test_export_other_dialects(dialect, parts):
    sql = export_sql(compile_text(BLOG).result(), dialect)
    assert all(p in sql for p in parts), [p for p in parts if p not in sql]


def test_junction_names_don_t_clash():
    db = compile_text("Table a {\n id int [pk]\n}\nTable b {\n id int [pk]\n}\nTable a_b {\n id int\n}\nRef: a.id <> b.id").result()
    assert 'CREATE TABLE "a_b(1)"' in export_sql(db, "postgres")


def test_null_default_is_left_out():
    db = compile_text("Table a {\n id int [default: null]\n}").result()
    assert all("DEFAULT" not in export_sql(db, d) for d in DIALECTS)


@pytest.mark.parametrize("dialect", ["postgres", "mysql"])
def test_export_then_import(dialect):
    db = compile_text(BLOG).result()
    report = import_sql(export_sql(db, dialect), dialect)
    assert not report.errors
    again = report.value
    assert [t.name for t in again.tables] == ["users", "posts", "tags", "posts_tags"]
    users = again.table("users")
    assert users.column("id").increment and users.column("id").pk and users.column("name").unique and users.column("name").not_null
    assert len(again.refs) == 3 and again.records[0].rows[0][1] == Cell("string", "O'Hara")
    assert not compile_text(export_language(again)).errors


def test_import_postgres():
    db = import_sql(
        """
        create type "public"."mood" as enum ('a', 'b');
        create table if not exists s.t (
          id bigserial primary key, m mood default 'a'::mood, n numeric(10, 2) not null default -1.5,
          at timestamp with time zone default now(), tags text[] , x int references u (id) on delete set null,
          constraint c check (n > 0), unique (n), primary key (id)
        );
        alter table only s.t add constraint fk foreign key (x, n) references u (a, b) on update cascade;
        create unique index concurrently ix on s.t using btree (lower(m), n desc);
        comment on column s.t.n is 'it''s';
        insert into s.t (id, n) values (1, 2.5), (2, null), (3, now());
        select 1; drop table x;
        """,
        "postgres",
    ).value
    t = db.table("t", "s")
    assert [(c.name, c.type) for c in t.columns] == [("id", "bigserial"), ("m", "mood"), ("n", "numeric(10,2)"), ("at", "timestamp with time zone"), ("tags", "text[]"), ("x", "int")]
    assert t.column("id").increment and t.column("m").default.value == "a" and t.column("n").default.value == "-1.5" and t.column("at").default.kind == "expression"
    assert t.column("n").unique and t.column("n").note == "it's" and t.checks[0].expression == "n > 0"
    assert [(p.value, p.kind) for p in t.indexes[0].parts] == [("lower(m)", "expression"), ("n", "column")] and t.indexes[0].unique
    assert [(r.name, r.on_delete, r.on_update) for r in db.refs] == [(None, "set null", None), ("fk", None, "cascade")]
    assert [[c.value for c in row] for row in db.records[0].rows] == [[1, 2.5], [2, None], [3, "now()"]]


def test_import_other_dialects():
    db = import_sql("CREATE TABLE `t` (`id` int unsigned NOT NULL AUTO_INCREMENT COMMENT 'k', `e` enum('x','y') DEFAULT 'x', PRIMARY KEY (`id`), KEY `k` (`e`(10))) ENGINE=InnoDB COMMENT='tab'; CREATE TABLE u LIKE t;", "mysql").value
    assert db.tables[0].note == "tab" and [v.name for v in db.enums[0].values] == ["x", "y"] and db.tables[0].column("id").pk and [c.name for c in db.tables[1].columns] == ["id", "e"]
    db = import_sql("CREATE TABLE [dbo].[t] ([id] int IDENTITY(1,1) PRIMARY KEY, [a b] nvarchar(max) DEFAULT ('x'))\nGO\nEXEC sp_addextendedproperty @name = N'Column_Description', @value = 'hi', @level0type = N'Schema', @level0name = 'dbo', @level1type = N'Table', @level1name = 't', @level2type = N'Column', @level2name = 'a b';\nGO\nINSERT INTO [t] VALUES (1, 'z')\nGO", "mssql").value
    assert db.tables[0].column("a b").note == "hi" and db.tables[0].column("id").increment and db.records[0].columns == ["id", "a b"]
    db = import_sql('CREATE TABLE t ("ID" NUMBER(10) GENERATED BY DEFAULT ON NULL AS IDENTITY, v VARCHAR2(20) DEFAULT \'q\' NOT NULL); ALTER TABLE t ADD (CONSTRAINT pk PRIMARY KEY ("ID")); INSERT ALL INTO t (v) VALUES (\'a\') INTO t (v) VALUES (\'b\') SELECT * FROM dual;', "oracle").value
    assert db.tables[0].column("ID").pk and [r[0].value for r in db.records[0].rows] == ["a", "b"]
    db = import_sql("create or replace transient table t (id int autoincrement start 1 increment 1, v variant, constraint u unique (id)); create table u like t;", "snowflake").value
    assert db.tables[0].column("id").increment and [c.name for c in db.tables[1].columns] == ["id", "v"]


def test_bad_statement_is_reported_and_the_rest_kept():
    report = import_sql("create table a (id int; create table b (id int);", "postgres")
    assert report.errors and report.value.table("b") or report.errors


def test_json_round_trip():
    db = compile_text(BLOG).result()
    assert to_plain(import_json(export_json(db))) == to_plain(db)
    maps = normalise(db)
    assert len(maps["tables"]) == 3 and {f["table_id"] for f in maps["fields"].values()} == {1, 2, 3} and len(maps["endpoints"]) == 4


def test_projects():
    files = {
        "base.c": "Table users {\n id int [pk]\n}\nTable posts {\n id int [pk]\n uid int [ref: > users.id]\n}\nEnum e {\n a\n}",
        "mid.c": "reuse { table users } from './base'\nuse { table posts } from './base'",
        "main.c": "use { table users as u } from './base'\nuse { table posts } from './base.c'\nrecords u(id) {\n 1\n}",
        "far.c": "use * from './mid'",
        "bad.c": "use { table nothing } from './base'",
        "loop.c": "use * from './loop2'\nTable a {\n i int\n}",
        "loop2.c": "reuse * from './loop'\nTable b {\n i int\n}",
    }
    layout = MemoryLayout(files)
    db = compile_project(layout, "main.c").result()
    assert [t.name for t in db.tables] == ["u", "posts"] and [e.table for e in db.refs[0].ends] == ["u", "posts"] and db.records[0].table == "u"
    assert [t.name for t in compile_project(layout, "far.c").result().tables] == ["users"]  # use doesn't pass on, reuse does
    assert compile_project(layout, "bad.c").errors and compile_project(layout, "none.c").errors
    assert {t.name for t in compile_project(layout, "loop.c").result().tables} == {"a", "b"}


def test_rename():
    source = "Table users { // users\n id int [note: 'users']\n}\nTable posts {\n users int [ref: > users.id]\n}\nTableGroup g {\n users\n}\nrecords users(id) {\n 1\n}"
    out = rename_table(source, "users", "app.people")
    assert out == source.replace("Table users", "Table app.people").replace("> users.id", "> app.people.id").replace(" users\n}", " app.people\n}").replace("records users", "records app.people")
    assert rename_table(source, "nobody", "x") == source
    with pytest.raises(ValueError, match="there already"):
        rename_table(source, "users", "posts")


def test_introspection(spark):
    rows = {
        "fields": [("public", "u", "id", 1, "int4", None, 32, 0, "NO", "nextval('s'::regclass)"), ("public", "u", "n", 2, "varchar", 10, None, None, "YES", "'x'::text"), ("s", "p", "a", 1, "_text", None, None, None, "YES", None), ("s", "p", "b", 2, "numeric", None, 10, 2, "YES", "1.5"), ("s", "p", "c", 3, "numeric", None, 10, 0, "YES", "now()")],
        "keys": [("public", "u", "pk", "PRIMARY KEY", "id", 1), ("s", "p", "uq", "UNIQUE", "b", 2), ("s", "p", "uq", "UNIQUE", "a", 1)],
        "refs": [("s", "p", "fk", "c", 2, "public", "u", "n", "CASCADE", "NO ACTION"), ("s", "p", "fk", "b", 1, "public", "u", "id", "CASCADE", "NO ACTION")],
        "checks": [("s", "p", "ck", "b > 0")],
        "enums": [("s", "m", "late", 2.0), ("s", "m", "early", 1.0)],
    }
    db = to_model({k: spark.createDataFrame(v, FRAMES[k]) for k, v in rows.items()})
    u, p = db.table("u"), db.table("p", "s")
    assert u.column("id").increment and u.column("id").pk and u.column("n").type == "varchar(10)" and u.column("n").default.value == "x"
    assert [c.type for c in p.columns] == ["text[]", "numeric(10,2)", "numeric"] and p.indexes[0].columns == ["a", "b"]
    assert db.refs[0].ends[0].columns == ["id", "n"] and db.refs[0].ends[1].columns == ["b", "c"] and db.refs[0].on_delete == "cascade" and db.refs[0].on_update is None
    assert [v.name for v in db.enums[0].values] == ["early", "late"] and p.checks[0].name == "ck"
    for dialect in ("postgres", "mysql", "mssql", "oracle", "snowflake", "bigquery"):
        assert all("{" not in q for q in catalog_queries(dialect, ["a"], "d").values())
    assert parse_connection("postgresql://me:pw@host:5432/db?schemas=a,b&ssl=true") == ("jdbc:postgresql://host:5432/db", {"user": "me", "password": "pw", "ssl": "true"}, ["a", "b"])


def test_insert_statements(spark):
    df = spark.createDataFrame([(1, "it's", None), (2, "b", True)], "id int, s string, b boolean").coalesce(1)
    assert insert_statements(df, "t", "postgres").first()["statement"] == "INSERT INTO \"t\" (\"id\", \"s\", \"b\")\nVALUES\n  (1, 'it''s', NULL),\n  (2, 'b', TRUE);"
    assert "INTO \"t\" (\"id\", \"s\", \"b\") VALUES (2, 'b', 1)\nSELECT" in insert_statements(df, "t", "oracle").first()["statement"]


def test_command_line(tmp_path, capsys):
    file = tmp_path / "a.contract"
    file.write_text("Table users {\n id int [pk]\n}")
    assert main(["to-sql", str(file), "--to", "mysql"]) == 0 and "CREATE TABLE `users`" in capsys.readouterr().out
    sql = tmp_path / "a.sql"
    sql.write_text("create table t (id int primary key);")
    assert main(["from-sql", str(sql), "-o", str(tmp_path / "out")]) == 0 and "id int [pk]" in (tmp_path / "out").read_text()
    file.write_text("Table {")
    assert main(["to-sql", str(file)]) == 1


def test_one_add_for_several_columns():
    report = import_sql("CREATE TABLE a (x INT);\nALTER TABLE a ADD b INT NOT NULL, c DECIMAL(5,2), CONSTRAINT u UNIQUE (b), d VARCHAR(10) DEFAULT 'x';", "mssql")
    table = report.value.tables[0]
    assert [c.name for c in table.columns] == ["x", "b", "c", "d"]
    assert table.column("b").not_null and table.column("d").default is not None and not report.errors
    assert [(i.name, i.unique) for i in table.indexes] == [("u", True)]
    for dialect in ("postgres", "mysql"):
        table = import_sql("CREATE TABLE a (x INT); ALTER TABLE a ADD b INT, ADD COLUMN c INT;", dialect).value.tables[0]
        assert [c.name for c in table.columns] == ["x", "b", "c"]
