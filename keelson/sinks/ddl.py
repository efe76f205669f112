"""The model to SQL DDL and inserts of postgres, mysql, mssql and oracle."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.literals import sql_tuple
from ..functions.types import CATEGORIES, is_kind, is_serial, split_type, value_tag
from ..model import Cell, Column, Database, Endpoint, EnumType, Ref, Table
from .language import merged_records

DIALECTS = ("postgres", "mysql", "mssql", "oracle")


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def literal(c: Cell, dialect: str) -> str:
    """A raw cell as the dialect writes it."""
    if c.value is None or c.kind == "null":
        return "NULL"
    if c.kind == "bool":
        return ("1" if c.value else "0") if dialect in ("mssql", "oracle") else str(bool(c.value)).upper()
    if c.kind == "number":
        return repr(c.value)
    if c.kind == "expression":
        return str(c.value)
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:\.(\d{1,3}))?(Z|[+-]\d\d:\d\d)?", str(c.value))
    if dialect == "oracle" and m:
        stamp, zone = f"{m[1]} {m[2]}.{(m[3] or '').ljust(3, '0')}", "+00:00" if m[4] == "Z" else m[4]
        return f"TO_TIMESTAMP_TZ('{stamp} {zone}', 'YYYY-MM-DD HH24:MI:SS.FF3 TZH:TZM')" if zone else f"TO_TIMESTAMP('{stamp}', 'YYYY-MM-DD HH24:MI:SS.FF3')"
    return text(str(c.value))


@dataclass
class Ddl:
    db: Database
    dialect: str

    def __post_init__(self) -> None:
        if self.dialect not in DIALECTS:
            raise ValueError(f"no dialect {self.dialect}")
        self.across: dict[str, None] = {}
        self.end = "\nGO" if self.dialect == "mssql" else ";"

    # ---- names

    def id(self, name: str) -> str:
        opening, closing = {"mysql": "``", "mssql": "[]"}.get(self.dialect, '""')
        return opening + name.replace(closing, closing * 2) + closing

    def ids(self, names: Iterable[str]) -> str:
        return ", ".join(map(self.id, names))

    def table(self, schema: str | None, name: str) -> str:
        return f"{self.id(schema)}.{self.id(name)}" if schema else self.id(name)

    # ---- columns

    def enum_of(self, c: Column) -> EnumType | None:
        return self.db.enum(c.type, c.type_schema)

    def column(self, c: Column, alone: bool) -> str:
        """alone: the column's pk flag is its table's only key."""
        enum, name, args, identity = self.enum_of(c), *split_type(c.type)[:2], c.increment
        words, drop_not_null, drop_default = [self.id(c.name)], False, False
        if enum and self.dialect in ("mysql", "mssql", "oracle"):
            values = ", ".join(text(v.name) for v in enum.values)
            if self.dialect == "mysql":
                words.append(f"ENUM ({values})")
            else:
                words.append(f"{'nvarchar' if self.dialect == 'mssql' else 'nvarchar2'}(255) NOT NULL CHECK ({self.id(c.name)} IN ({values}))")
                drop_not_null = True
        elif self.dialect == "postgres" and identity:
            kind = name.upper()
            if is_serial(c.type):
                words.append(kind)
            elif kind in ("INT", "INTEGER", "BIGINT", "SMALLINT"):
                words.append(f"{kind} GENERATED BY DEFAULT AS IDENTITY")
            else:
                words.append({"TINYINT": "SMALLSERIAL"}.get(kind, "SERIAL"))
        elif name == "varchar" and not args and self.dialect in ("mysql", "mssql"):
            words.append({"mysql": "varchar(255)", "mssql": "nvarchar(255)"}[self.dialect])
        else:
            words.append((f"{self.id(c.type_schema)}." if c.type_schema else "") + self.type_name(c.type))
        if identity and self.dialect == "oracle":
            words.append("GENERATED AS IDENTITY")
            drop_not_null = drop_default = True
        default = ""
        if c.default and not drop_default and c.default.value.lower() != "null":
            value = text(c.default.value) if c.default.kind == "string" else c.default.value
            if c.default.kind == "expression" and self.dialect != "oracle" or self.dialect == "mssql" and c.default.kind == "number":
                value = f"({value})"
            default = f"DEFAULT {value}"
        identity_word = {"mysql": "AUTO_INCREMENT", "mssql": "IDENTITY(1, 1)"}.get(self.dialect, "") if identity else ""
        unique, key, filled = "UNIQUE" * c.unique, "PRIMARY KEY" * (c.pk and alone), "NOT NULL" * (bool(c.not_null) and not drop_not_null)
        order = (default, unique, key, filled) if self.dialect == "oracle" else (unique, key, identity_word, filled, default)
        words += [w for w in order if w]
        words += [f"CHECK ({k.expression})" for k in c.checks]
        if self.dialect == "mysql" and c.note:
            words.append(f"COMMENT {text(c.note)}")
        return " ".join(words)

    def type_name(self, kind: str) -> str:
        """Quoted in postgres if it is no known type and not a plain lower-case name."""
        name = split_type(kind)[0]
        known = any(is_kind(k, name) for k in CATEGORIES) or re.fullmatch(r"[a-z_][a-z0-9_]*(\(.*\))?(\[\d*\])*", kind)
        return kind if known or self.dialect != "postgres" or re.search(r"[()]", kind) else self.id(kind)

    def create_table(self, t: Table) -> str:
        keys = [i for i in t.indexes if i.pk]
        lines = [self.column(c, not keys) for c in t.columns]
        lines += [(f"CONSTRAINT {self.id(k.name)} " if k.name else "") + f"CHECK ({k.expression})" for k in t.checks]
        lines += [f"PRIMARY KEY ({self.index_parts(i)})" for i in keys]
        return f"CREATE TABLE {self.table(t.schema, t.name)} (\n  " + ",\n  ".join(lines) + f"\n){self.end}"

    def index_parts(self, i) -> str:
        name = (lambda n: f'"{n}"') if self.dialect == "mssql" and not i.pk else self.id
        return ", ".join(f"({p.value})" if p.kind == "expression" and self.dialect in ("postgres", "mysql") else p.value if p.kind == "expression" else name(p.value) for p in i.parts)

    def create_indexes(self, t: Table) -> Iterator[str]:
        for n, i in enumerate(x for x in t.indexes if not x.pk):
            name = i.name or (f"{t.name}_index_{n}" if self.dialect in ("mysql", "mssql") else None)
            method = f" USING {i.type.upper()}" if i.type and self.dialect in ("postgres", "mysql") else ""
            on = f" ON {self.table(t.schema, t.name)}"
            tail = f"{on} ({self.index_parts(i)}){method}" if self.dialect == "mysql" else f"{on}{method} ({self.index_parts(i)})"
            yield f"CREATE {'UNIQUE ' if i.unique else ''}INDEX{f' {self.id(name)}' if name else ''}{tail}{self.end}"

    def comments(self, t: Table) -> Iterator[str]:
        where = self.table(t.schema, t.name)
        if self.dialect in ("postgres", "oracle"):
            if t.note:
                yield f"COMMENT ON TABLE {where} IS {text(t.note)};"
            yield from (f"COMMENT ON COLUMN {where}.{self.id(c.name)} IS {text(c.note)};" for c in t.columns if c.note)
        elif self.dialect == "mysql":
            if t.note:
                yield f"ALTER TABLE {where} COMMENT = {text(t.note)};"
        else:
            base = f"@level0type = N'Schema', @level0name = '{t.schema or 'dbo'}',\n@level1type = N'Table',  @level1name = {text(t.name)}"
            if t.note:
                yield f"EXEC sp_addextendedproperty\n@name = N'Table_Description',\n@value = {text(t.note)},\n{base};\nGO"
            for c in t.columns:
                if c.note:
                    yield f"EXEC sp_addextendedproperty\n@name = N'Column_Description',\n@value = {text(c.note)},\n{base},\n@level2type = N'Column', @level2name = {text(c.name)};\nGO"

    # ---- references

    def foreign_key(self, child: Endpoint, parent: Endpoint, ref: Ref) -> str:
        if child.schema != parent.schema:
            self.across[self.table(parent.schema, parent.table)] = None
        words = [f"ALTER TABLE {self.table(child.schema, child.table)} ADD"]
        if ref.name:
            words.append(f"CONSTRAINT {self.id(ref.name)}")
        words.append(f"FOREIGN KEY ({self.ids(child.columns)}) REFERENCES {self.table(parent.schema, parent.table)} ({self.ids(parent.columns)})")
        if ref.on_delete:
            words.append(f"ON DELETE {ref.on_delete.upper()}")
        if ref.on_update and self.dialect != "oracle":
            words.append(f"ON UPDATE {ref.on_update.upper()}")
        if self.dialect in ("postgres", "oracle"):
            words.append("DEFERRABLE INITIALLY IMMEDIATE")
        return " ".join(words) + self.end

    def junction(self, ref: Ref, taken: set[tuple]) -> list[str]:
        """The table that a many-to-many ref stands for, in the schema of its first end, and its two foreign keys."""
        a, b = ref.ends
        base, n = f"{a.table}_{b.table}", 0
        name = base
        while (a.schema, name) in taken:
            n += 1
            name = f"{base}({n})"
        taken.add((a.schema, name))
        lines, sides, used = [], [], set()
        for end in (a, b):
            table, names = self.db.table(end.table, end.schema), []
            for c in end.columns:
                own, k = f"{end.table}_{c}", 0
                while own in used:
                    k += 1
                    own = f"{end.table}_{c}({k})"
                used.add(own)
                names.append(own)
                lines.append(f"{self.id(own)} {table.column(c).type}")
            sides.append((end, names))
        lines.append(f"PRIMARY KEY ({self.ids(n for _, names in sides for n in names)})")
        out = [f"CREATE TABLE {self.table(a.schema, name)} (\n  " + ",\n  ".join(lines) + f"\n){self.end}"]
        return out + [self.foreign_key(Endpoint(name, names, "*", a.schema), end, Ref((a, b))) for end, names in sides]

    def references(self) -> Iterator[str]:
        taken = {(t.schema, t.name) for t in self.db.tables}
        for ref in self.db.all_refs():
            a, b = ref.ends
            if a.relation == b.relation == "*":
                yield from self.junction(ref, taken)
            else:
                child, parent = (a, b) if a.relation == "*" or a.relation == b.relation and self._is_key(b) and not self._is_key(a) else (b, a)
                yield self.foreign_key(child, parent, ref)

    def _is_key(self, e: Endpoint) -> bool:
        return self.db.table(e.table, e.schema).primary_key() == e.columns

    # ---- the whole

    def schemas(self) -> Iterator[str]:
        names = dict.fromkeys(x.schema for x in [*self.db.tables, *self.db.enums] if x.schema)
        for n in names:
            if self.dialect == "oracle":
                user = self.id(n)
                yield f"CREATE USER {user}\n  NO AUTHENTICATION\n  DEFAULT TABLESPACE system\n  TEMPORARY TABLESPACE temp\n  QUOTA UNLIMITED ON system;"
            else:
                yield f"CREATE SCHEMA {self.id(n)}{self.end}"

    def enums(self) -> Iterator[str]:
        if self.dialect == "postgres":
            for e in self.db.enums:
                yield f"CREATE TYPE {self.table(e.schema, e.name)} AS ENUM (\n  " + ",\n  ".join(text(v.name) for v in e.values) + "\n);"

    def grants(self) -> Iterator[str]:
        """Oracle lets a schema refer to another's table only by grant: one for each parent that references() met."""
        for where in self.across if self.dialect == "oracle" else ():
            yield f"GRANT REFERENCES ON {where} TO PUBLIC;"

    def insert_frame(self, where: str, columns: list[str], tuples: Iterable[str]) -> Iterator[str]:
        """One insert over rendered row tuples."""
        head = f"INTO {where} ({self.ids(columns)})"
        if self.dialect == "oracle":
            yield "INSERT ALL\n" + "\n".join(f"  {head} VALUES {t}" for t in tuples) + "\nSELECT * FROM dual;"
        else:
            yield f"INSERT {head}\nVALUES\n  " + ",\n  ".join(tuples) + (";\nGO" if self.dialect == "mssql" else ";")

    def inserts(self) -> list[str]:
        blocks = [r for r in merged_records(self.db.records) if r.rows]
        out = []
        for r in blocks:
            table = self.db.table(r.table, r.schema)
            moment = [table is not None and value_tag(table.column(n).type) == "datetime" for n in r.columns]
            rows = [[Cell(c.kind, re.sub(r"^(\d{4}-\d\d-\d\d) (\d\d:\d\d:\d\d)", r"\1T\2", c.value)) if m and c.kind == "string" else c for c, m in zip(row, moment, strict=False)] for row in r.rows]
            out += self.insert_frame(self.table(r.schema, r.table), r.columns, [f"({', '.join(literal(c, self.dialect) for c in row)})" for row in rows])
        if not out:
            return []
        names = [self.table(r.schema, r.table) for r in blocks]
        before, after = {
            "postgres": ("-- Defer constraint checking for INSERT\nBEGIN;\nSET CONSTRAINTS ALL DEFERRED;", "SET CONSTRAINTS ALL IMMEDIATE;\nCOMMIT;"),
            "mysql": ("-- Disable foreign key checks for INSERT\nSET FOREIGN_KEY_CHECKS = 0;", "-- Re-enable foreign key checks\nSET FOREIGN_KEY_CHECKS = 1;"),
            "mssql": ("-- Disable constraint checks for tables with data\n" + "\n".join(f"ALTER TABLE {n} NOCHECK CONSTRAINT ALL;\nGO" for n in names), "-- Re-enable constraint checks\n" + "\n".join(f"ALTER TABLE {n} WITH CHECK CHECK CONSTRAINT ALL;\nGO" for n in names)),
            "oracle": ("-- Disable constraint checking for INSERT\nSET CONSTRAINTS ALL DEFERRED;", "SET CONSTRAINTS ALL IMMEDIATE;\nCOMMIT;"),
        }[self.dialect]
        return [before, "\n".join(out), after]

    def export(self) -> str:
        parts = [*self.schemas(), *self.enums(), *map(self.create_table, self.db.tables)]
        for t in self.db.tables:
            parts += self.create_indexes(t)
        for t in self.db.tables:
            parts += self.comments(t)
        references = list(self.references())
        parts += [*self.grants(), *references, *self.inserts()]
        return "\n\n".join(parts) + "\n"


def export_sql(db: Database, dialect: str) -> str:
    return Ddl(db, dialect).export()


def insert_statements(df: DataFrame, table: str, dialect: str, schema: str | None = None, rows: int = 1000) -> DataFrame:
    """A frame of statements, each inserting up to about `rows` rows of df; rendered on the executors, so a table of any size
    can be written as text. Rows are grouped by partition and running number, without a shuffle of the whole by key."""
    ddl = Ddl(Database(), dialect)
    where, columns = ddl.table(schema, table), ddl.ids(df.columns)
    tuples = df.select(sql_tuple([(df[f.name], f.dataType) for f in df.schema.fields], dialect).alias("t"), F.monotonically_increasing_id().alias("i"))
    blocks = tuples.groupBy(F.floor(F.col("i") / rows).alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("rows"))
    if dialect == "oracle":
        lines = F.array_join(F.transform("rows", lambda r: F.concat(F.lit(f"  INTO {where} ({columns}) VALUES "), r["t"])), "\n")
        return blocks.select("block", F.concat(F.lit("INSERT ALL\n"), lines, F.lit("\nSELECT * FROM dual;")).alias("statement"))
    lines = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("  "), r["t"])), ",\n")
    return blocks.select("block", F.concat(F.lit(f"INSERT INTO {where} ({columns})\nVALUES\n"), lines, F.lit(";\nGO" if dialect == "mssql" else ";")).alias("statement"))
