"""The model back to the contract language. Reading the text again gives an equal model."""

from __future__ import annotations

import regex

from ..functions.literals import ESCAPES, IDENTIFIER
from ..model import Cell, Column, Database, Default, Endpoint, EnumType, Group, Index, Note, Project, Records, Ref, Table, View

_RELATIONS = {("1", "*"): "<", ("*", "1"): ">", ("1", "1"): "-", ("*", "*"): "<>"}


def name(text: str) -> str:
    return text if regex.fullmatch(IDENTIFIER, text) else '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def full_name(schema: str | None, text: str) -> str:
    return f"{name(schema)}.{name(text)}" if schema else name(text)


def quoted(text: str) -> str:
    for raw, escaped in ESCAPES:
        text = text.replace(raw, escaped)
    return f"'{text}'"


def note_text(text: str) -> str:
    """On one line if it has one, else in triple quotes, flush left."""
    return quoted(text) if "\n" not in text else "'''\n" + text.replace("\\", "\\\\").replace("'''", "\\'''") + "'''"


def _settings(parts: list[str | None]) -> str:
    parts = [p for p in parts if p]
    return f" [{', '.join(parts)}]" if parts else ""


def default_text(d: Default) -> str:
    return quoted(d.value) if d.kind == "string" else f"`{d.value}`" if d.kind == "expression" else d.value


def type_text(text: str) -> str:
    """Plain where it is a name with arguments and brackets, else quoted but for its brackets."""
    body, dims = regex.fullmatch(r"(.*?)((?:\[[^\]]*\])*)", text, regex.S).groups()
    plain = regex.fullmatch(r"([\p{L}\p{M}_][\p{L}\p{M}0-9_]*)(\([^()]*\))?", body)
    return (body if plain else name(body)) + dims


def column_line(c: Column) -> str:
    kind = (f"{name(c.type_schema)}." if c.type_schema else "") + type_text(c.type)
    settings = [c.pk and "pk", c.unique and "unique", "not null" if c.not_null else "null" if c.not_null is False else None, c.increment and "increment", c.default and f"default: {default_text(c.default)}", *(f"check: `{k.expression}`" for k in c.checks), c.note and f"note: {quoted(c.note)}"]
    return f"{name(c.name)} {kind}{_settings(settings)}"


def index_line(i: Index) -> str:
    parts = [f"`{p.value}`" if p.kind == "expression" else name(p.value) for p in i.parts]
    body = parts[0] if len(parts) == 1 else f"({', '.join(parts)})"
    return body + _settings([i.pk and "pk", i.unique and "unique", i.name and f"name: {quoted(i.name)}", i.type and f"type: {name(i.type)}", i.note and f"note: {quoted(i.note)}"])


def table_text(t: Table, keyword: str = "Table") -> str:
    """Columns and checks that partials brought are left to their injections."""
    out = [f"{keyword} {full_name(t.schema, t.name)}" + (f" as {name(t.alias)}" if t.alias else "") + _settings([t.color and f"headercolor: {t.color}"]) + " {"]
    own = [c for c in t.columns if not c.partial]
    at = {i.order: [] for i in t.injections}
    for i in t.injections:
        at[i.order].append(i.name)
    for k in range(len(own) + 1):
        out += [f"  ~{name(n)}" for n in at.get(k, ())]
        if k < len(own):
            out.append("  " + column_line(own[k]))
    if t.indexes:
        out += ["", "  indexes {", *("    " + index_line(i) for i in t.indexes), "  }"]
    checks = [c for c in t.checks if not c.partial]
    if checks:
        out += ["", "  checks {", *(f"    `{c.expression}`{_settings([c.name and f'name: {quoted(c.name)}'])}" for c in checks), "  }"]
    if t.note:
        out += ["", f"  Note: {note_text(t.note)}"]
    return "\n".join([*out, "}"])


def enum_text(e: EnumType) -> str:
    return "\n".join([f"Enum {full_name(e.schema, e.name)} {{", *(f"  {name(v.name)}{_settings([v.note and f'note: {quoted(v.note)}'])}" for v in e.values), "}"])


def endpoint_text(e: Endpoint) -> str:
    columns = name(e.columns[0]) if len(e.columns) == 1 else f"({', '.join(map(name, e.columns))})"
    return f"{full_name(e.schema, e.table)}.{columns}"


def ref_text(r: Ref) -> str:
    a, b = r.ends
    settings = _settings([r.on_delete and f"delete: {r.on_delete}", r.on_update and f"update: {r.on_update}", r.color and f"color: {r.color}", r.inactive and "inactive"])
    return f"Ref{f' {name(r.name)}' if r.name else ''}: {endpoint_text(a)} {_RELATIONS[a.relation, b.relation]} {endpoint_text(b)}{settings}"


def group_text(g: Group) -> str:
    out = [f"TableGroup {full_name(g.schema, g.name)}{_settings([g.color and f'color: {g.color}'])} {{", *(f"  {full_name(s, n)}" for s, n in g.tables)]
    return "\n".join([*out, *([f"  Note: {note_text(g.note)}"] if g.note else []), "}"])


def sticky_text(n: Note) -> str:
    return f"Note {name(n.name)}{_settings([n.color and f'color: {n.color}'])} {{\n{note_text(n.content)}\n}}"


def project_text(p: Project) -> str:
    lines = [f"  {name(k)}: {quoted(v)}" for k, v in p.values.items()] + ([f"  Note: {note_text(p.note)}"] if p.note else [])
    return "\n".join([f"Project{f' {name(p.name)}' if p.name else ''} {{", *lines, "}"])


def view_text(v: View) -> str:
    out = [f"DiagramView {name(v.name)} {{"]
    for word, names in (("Tables", v.tables), ("Notes", v.notes), ("TableGroups", v.groups), ("Schemas", v.schemas)):
        if names is not None:
            out += [f"  {word} {{", *(["    *"] if not names else [f"    {'.'.join(map(name, n.split('.')))}" for n in names]), "  }"]
    return "\n".join([*out, "}"])


def cell_text(c: Cell) -> str:
    if c.value is None or c.kind == "null":
        return "null"
    if c.kind == "string":
        return quoted(c.value)
    if c.kind == "expression":
        return "null" if c.value.strip().lower() == "null" else f"`{c.value}`"
    if c.kind == "bool":
        return "true" if c.value else "false"
    return name(c.value) if c.kind == "word" else quoted(c.value) if c.kind == "enum" else repr(c.value)


def records_text(r: Records) -> str:
    return "\n".join([f"records {full_name(r.schema, r.table)}({', '.join(map(name, r.columns))}) {{", *("  " + ", ".join(map(cell_text, row)) for row in r.rows), "}"])


def merged_records(records: list[Records]) -> list[Records]:
    """One block for each table: columns in the order first seen, missing cells null."""
    blocks: dict[tuple, list[Records]] = {}
    for r in records:
        blocks.setdefault((r.schema, r.table), []).append(r)
    out = []
    for (schema, table), parts in blocks.items():
        columns = list(dict.fromkeys(c for p in parts for c in p.columns))
        rows = [[dict(zip(p.columns, row, strict=False)).get(c, Cell("null")) for c in columns] for p in parts for row in p.rows]
        out.append(Records(table, columns, rows, schema))
    return out


def export_language(db: Database) -> str:
    """Project, enums, partials, tables, groups, refs, notes, views and records, in this order."""
    parts = [project_text(db.project)] if db.project else []
    parts += map(enum_text, db.enums)
    parts += [table_text(p, "TablePartial") for p in db.partials]
    parts += map(table_text, db.tables)
    parts += map(group_text, db.groups)
    parts += map(ref_text, db.refs)
    parts += map(sticky_text, db.notes)
    parts += map(view_text, db.views)
    parts += map(records_text, merged_records(db.records))
    return "\n\n".join(parts) + "\n"
