"""The contract model: plain data on the driver. Rows live in DataFrames, never here, but for inline records."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from enum import IntEnum
from typing import Any

DEFAULT_SCHEMA = "public"


class Code(IntEnum):
    """Diagnostics: 1000s syntax, 3000s meaning, 4000s names, 5000s unsupported or inconsistent."""

    UNEXPECTED_SYMBOL = 1000
    UNKNOWN_SYMBOL = 1001
    UNCLOSED = 1002
    INVALID_NAME = 3000
    UNKNOWN_ELEMENT = 3001
    INVALID_CONTEXT = 3002
    INVALID_SETTING = 3003
    UNKNOWN_SETTING = 3004
    DUPLICATE_SETTING = 3005
    CONFLICTING_SETTING = 3006
    EMPTY_ELEMENT = 3007
    INVALID_VALUE = 3008
    DUPLICATE_NAME = 3010
    DUPLICATE_REF = 3011
    DUPLICATE_PARTIAL = 3012
    DUPLICATE_RECORDS = 3013
    INVALID_RECORDS_FIELD = 3014
    SAME_ENDPOINT = 3015
    UNEQUAL_ENDPOINTS = 3016
    TABLE_IN_TWO_GROUPS = 3017
    NOT_FOUND = 4000
    AMBIGUOUS = 4001
    UNSUPPORTED = 5000


@dataclass(frozen=True)
class Diagnostic:
    code: Code
    message: str
    line: int = 0
    file: str = ""


@dataclass
class Report:
    """A value with what was found wrong on the way. With errors the value is not to be used."""

    value: Any = None
    errors: list[Diagnostic] = field(default_factory=list)
    warnings: list[Diagnostic] = field(default_factory=list)

    def result(self) -> Any:
        if self.errors:
            raise ContractError(self.errors)
        return self.value


class ContractError(ValueError):
    def __init__(self, errors: list[Diagnostic]):
        super().__init__("\n".join(f"{e.file}:{e.line}: {e.code.name}: {e.message}" for e in errors))
        self.errors = errors


@dataclass(frozen=True)
class Default:
    """kind: number, string, boolean or expression. `default: null` is a boolean kind with the text null."""

    kind: str
    value: str


@dataclass
class Check:
    expression: str
    name: str | None = None
    partial: str | None = None


@dataclass
class Column:
    name: str
    type: str
    type_schema: str | None = None
    pk: bool = False
    unique: bool = False
    not_null: bool | None = None
    increment: bool = False
    default: Default | None = None
    note: str | None = None
    checks: list[Check] = field(default_factory=list)
    partial: str | None = None  # the partial it came from


@dataclass
class IndexPart:
    value: str
    kind: str = "column"  # or expression


@dataclass
class Index:
    parts: list[IndexPart]
    pk: bool = False
    unique: bool = False
    name: str | None = None
    type: str | None = None
    note: str | None = None

    @property
    def columns(self) -> list[str] | None:
        """Its column names; None if it has an expression."""
        return [p.value for p in self.parts] if all(p.kind == "column" for p in self.parts) else None


@dataclass
class Endpoint:
    table: str
    columns: list[str]
    relation: str  # "1" or "*"
    schema: str | None = None


@dataclass
class Ref:
    ends: tuple[Endpoint, Endpoint]
    name: str | None = None
    on_delete: str | None = None
    on_update: str | None = None
    color: str | None = None
    inactive: bool = False
    partial: str | None = None


@dataclass
class EnumValue:
    name: str
    note: str | None = None


@dataclass
class EnumType:
    name: str
    values: list[EnumValue]
    schema: str | None = None
    note: str | None = None


@dataclass
class Injection:
    name: str
    order: int


@dataclass
class Table:
    """A table, or a partial (then `schema` and `alias` are None)."""

    name: str
    schema: str | None = None
    alias: str | None = None
    columns: list[Column] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    checks: list[Check] = field(default_factory=list)
    injections: list[Injection] = field(default_factory=list)
    refs: list[Ref] = field(default_factory=list)  # inline ones of a partial, with an empty first table
    note: str | None = None
    color: str | None = None

    @property
    def key(self) -> tuple[str, str]:
        return (self.schema or DEFAULT_SCHEMA, self.name)

    @property
    def label(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema and self.schema != DEFAULT_SCHEMA else self.name

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def primary_key(self) -> list[str]:
        """Of inline flags (two or more make one composite key), else of the first pk index."""
        inline = [c.name for c in self.columns if c.pk]
        return inline or next((i.columns for i in self.indexes if i.pk and i.columns), [])


@dataclass
class Cell:
    """A raw cell of inline records. kind: number, string, bool, null, expression, enum (value: the last name) or word."""

    kind: str
    value: Any = None


@dataclass
class Records:
    table: str
    columns: list[str]
    rows: list[list[Cell]]
    schema: str | None = None
    line: int = 0


@dataclass
class Group:
    name: str
    tables: list[tuple[str | None, str]]
    schema: str | None = None
    note: str | None = None
    color: str | None = None


@dataclass
class Note:
    name: str
    content: str
    color: str | None = None


@dataclass
class View:
    """Tri-state filters of a diagram: None shows nothing, an empty list everything, a list what it names."""

    name: str
    tables: list[str] | None = None
    notes: list[str] | None = None
    groups: list[str] | None = None
    schemas: list[str] | None = None


@dataclass
class Project:
    name: str | None = None
    values: dict[str, str] = field(default_factory=dict)
    note: str | None = None


@dataclass
class Import:
    names: list[tuple[str, str, str | None]] | None  # kind, name, alias; None: all
    path: str
    reuse: bool = False


@dataclass
class Database:
    tables: list[Table] = field(default_factory=list)
    enums: list[EnumType] = field(default_factory=list)
    refs: list[Ref] = field(default_factory=list)
    groups: list[Group] = field(default_factory=list)
    partials: list[Table] = field(default_factory=list)
    records: list[Records] = field(default_factory=list)
    notes: list[Note] = field(default_factory=list)
    views: list[View] = field(default_factory=list)
    project: Project | None = None
    imports: list[Import] = field(default_factory=list)

    def table(self, name: str, schema: str | None = None) -> Table | None:
        """By schema and name; without a schema, by alias too."""
        if schema is None and (found := next((t for t in self.tables if t.alias == name), None)):
            return found
        return next((t for t in self.tables if t.key == (schema or DEFAULT_SCHEMA, name)), None)

    def enum(self, name: str, schema: str | None = None) -> EnumType | None:
        return next((e for e in self.enums if (e.schema or DEFAULT_SCHEMA, e.name) == (schema or DEFAULT_SCHEMA, name)), None)

    def all_refs(self) -> list[Ref]:
        """Written refs, and those that injected partials bring to each table."""
        out = list(self.refs)
        for table in self.tables:
            for injection in table.injections:
                for ref in next((p.refs for p in self.partials if p.name == injection.name), ()):
                    first, second = ref.ends
                    if not first.table:
                        first = Endpoint(table.name, first.columns, first.relation, table.schema)
                    out.append(Ref((first, Endpoint(table.name, second.columns, second.relation, table.schema)), on_delete=ref.on_delete, on_update=ref.on_update, partial=injection.name))
        return out


def to_plain(value: Any) -> Any:
    """Nested dicts and lists, for JSON."""
    if is_dataclass(value):
        return {f.name: to_plain(getattr(value, f.name)) for f in fields(value)}
    if isinstance(value, (list, tuple)):
        return [to_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: to_plain(v) for k, v in value.items()}
    return value


def from_plain(kind: type, data: Any) -> Any:
    """The inverse of to_plain for the dataclasses above."""
    if data is None:
        return None
    nested = {
        Database: {"tables": Table, "enums": EnumType, "refs": Ref, "groups": Group, "partials": Table, "records": Records, "notes": Note, "views": View, "project": Project, "imports": Import},
        Table: {"columns": Column, "indexes": Index, "checks": Check, "injections": Injection, "refs": Ref},
        Column: {"default": Default, "checks": Check},
        Index: {"parts": IndexPart},
        EnumType: {"values": EnumValue},
    }.get(kind, {})
    out = {}
    for f in fields(kind):
        if f.name not in data:
            continue
        v, inner = data[f.name], nested.get(f.name)
        if inner and isinstance(v, list):
            v = [from_plain(inner, x) for x in v]
        elif inner:
            v = from_plain(inner, v)
        out[f.name] = v
    if kind is Ref:
        out["ends"] = tuple(from_plain(Endpoint, e) for e in data["ends"])
    if kind is Records:
        out["rows"] = [[from_plain(Cell, c) for c in row] for row in data["rows"]]
    if kind is Group:
        out["tables"] = [tuple(t) for t in data["tables"]]
    if kind is Import and out.get("names") is not None:
        out["names"] = [tuple(n) for n in data["names"]]
    return kind(**out)
