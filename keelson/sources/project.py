"""Contracts of several files: layouts, imports, renames."""

from __future__ import annotations

import posixpath
import re
from collections import deque
from dataclasses import replace
from pathlib import Path

from ..model import DEFAULT_SCHEMA, Code, Database, Diagnostic, Endpoint, EnumType, Group, Import, Note, Records, Ref, Report, Table
from ..sinks.language import full_name
from .language import bind, parse
from .lexer import tokens

SUFFIX = ".contract"


class MemoryLayout:
    """Sources by path."""

    def __init__(self, files: dict[str, str]):
        self.files = {posixpath.normpath("/" + k.lstrip("/")): v for k, v in files.items()}

    def read(self, path: str) -> str | None:
        return self.files.get(path)

    def resolve(self, base: str, target: str) -> str:
        """target as seen from the file base; without an ending, that of base is meant."""
        path = posixpath.normpath(posixpath.join(posixpath.dirname(base), target))
        return path if self.read(path) is not None else path + (posixpath.splitext(base)[1] or SUFFIX)


class FolderLayout(MemoryLayout):
    """Files under a folder, read when asked for."""

    def __init__(self, root: str | Path):
        super().__init__({})
        self.root = Path(root)

    def read(self, path: str) -> str | None:
        file = self.root / path.lstrip("/")
        return file.read_text() if file.is_file() else None


def load(layout: MemoryLayout, entry: str) -> tuple[dict[str, Database], list[Diagnostic]]:
    """Every file that entry reaches, breadth first; cycles are fine."""
    entry = posixpath.normpath("/" + entry.lstrip("/"))
    found: dict[str, Database] = {}
    errors: list[Diagnostic] = []
    queue = deque([(entry, None)])
    while queue:
        path, by = queue.popleft()
        if path in found:
            continue
        source = layout.read(path)
        if source is None:
            errors.append(Diagnostic(Code.NOT_FOUND, f"no file {path}", 0, by or path))
            found[path] = Database()
            continue
        report = parse(source, path)
        errors += report.errors
        found[path] = report.value
        queue.extend((layout.resolve(path, i.path), path) for i in report.value.imports)
    return found, errors


def _visible(layout: MemoryLayout, files: dict[str, Database], path: str, seen: frozenset[str]) -> dict[tuple[str, str], object]:
    """What another file may import from path: its own elements, and what it re-exports. (kind, full name) to element."""
    if path in seen:
        return {}
    db = files[path]
    out: dict[tuple[str, str], object] = {}
    key = lambda x: x.name if not getattr(x, "schema", None) else f"{x.schema}.{x.name}"
    for kind, items in (("table", db.tables), ("enum", db.enums), ("tablegroup", db.groups), ("tablepartial", db.partials), ("note", db.notes)):
        out |= {(kind, key(x)): x for x in items}
    for i in db.imports:
        if i.reuse:
            out |= _imported(layout, files, path, i, seen | {path})[0]
    return out


def _copy(element, **changes):
    """A changed element that remembers which one it came from."""
    out = replace(element, **{k: v for k, v in changes.items() if hasattr(element, k)})
    out.__dict__["_origin"] = _origin(element)
    return out


def _origin(element):
    return element.__dict__.get("_origin", element)


def _imported(layout: MemoryLayout, files: dict[str, Database], path: str, i: Import, seen: frozenset[str]) -> tuple[dict[tuple[str, str], object], list[Diagnostic]]:
    there = _visible(layout, files, layout.resolve(path, i.path), seen)
    if i.names is None:
        return there, []
    out, errors = {}, []
    for kind, name, alias in i.names:
        if kind == "schema":
            some = {k: v for k, v in there.items() if (getattr(v, "schema", None) or DEFAULT_SCHEMA) == name}
        else:
            some = {k: v for k, v in there.items() if k == (kind, name)}
        if not some:
            errors.append(Diagnostic(Code.NOT_FOUND, f"no {kind} {name} in {i.path}", 0, path))
        for (k, full), v in some.items():
            if alias and kind != "schema":
                v, full = _copy(v, name=alias, schema=None), alias
            out[k, full] = v
    return out, errors


def compile_project(layout: MemoryLayout, entry: str) -> Report:
    """The Database of entry with what it imports; refs come along where both their tables do."""
    entry = posixpath.normpath("/" + entry.lstrip("/"))
    files, errors = load(layout, entry)
    if errors:
        return Report(Database(), errors)
    own = files[entry]
    out = Database(list(own.tables), list(own.enums), list(own.refs), list(own.groups), list(own.partials), list(own.records), list(own.notes), list(own.views), own.project, own.imports)
    slots = {Table: out.tables, EnumType: out.enums, Group: out.groups, Note: out.notes}
    placed: dict[int, Table] = {}  # by the identity of the element that was imported
    for i in own.imports:
        there, found = _imported(layout, files, entry, i, frozenset())
        errors += found
        for (kind, full), v in there.items():
            slot = out.partials if kind == "tablepartial" else slots[type(v)]
            if any(_origin(x) is _origin(v) and x.name == v.name for x in slot):
                continue
            if kind == "table":
                v = _copy(v, refs=[])
                placed[id(_origin(v))] = v
            slot.append(v)
    for path, db in files.items():
        if path == entry:
            continue
        for ref in [*db.refs, *(r for t in db.tables for r in t.refs)]:
            ends = [placed.get(id(db.table(e.table, e.schema))) for e in ref.ends]
            if all(ends):
                a, b = (Endpoint(t.name, e.columns, e.relation, t.schema) for t, e in zip(ends, ref.ends, strict=True))
                out.refs.append(Ref((a, b), ref.name, ref.on_delete, ref.on_update, ref.color, ref.inactive))
    bound = bind(out, entry)
    return Report(bound.value, errors + bound.errors)


def rename_table(source: str, old: str, new: str) -> str:
    """source with the table old ([schema.]name) called new wherever it is named: its element, refs, groups, records
    and imports. Text edits only, so comments and layout stay."""
    report = parse(source)
    if report.errors:
        return source
    schema, _, name = old.rpartition(".")
    new_schema, _, new_name = new.rpartition(".")
    table = report.value.table(name, schema or None)
    if table is None:
        return source
    if report.value.table(new_name, new_schema or None):
        raise ValueError(f"a table {new} is there already")
    found, _ = tokens(source)
    wanted = [*([table.schema] if table.schema else []), table.name]
    edits, i = [], 0
    while i < len(found):
        width = 2 * len(wanted) - 1
        run = found[i : i + width]
        parts = [t.text for t in run if t.kind in ("word", "quoted")]
        dots = all(t.kind == "op" and t.text == "." for t in run[1::2])
        before, after = found[i - 1] if i else None, found[i + width] if i + width < len(found) else None
        if parts == wanted and dots and len(run) == width and not (before and before.kind == "op" and before.text == ".") and _names_table(found, i, after):
            edits.append((run[0].begin, run[-1].end))
            i += width
        else:
            i += 1
    text = full_name(new_schema or None, new_name)
    for begin, end in reversed(edits):
        source = source[:begin] + text + source[end:]
    return source


def _names_table(found: list, i: int, after) -> bool:
    """Whether the name at token i stands where a table's does."""
    before = found[i - 1] if i else None
    if before and before.kind == "word" and before.text.lower() in ("table", "records"):
        return True
    if after is not None and after.kind == "op" and after.text == ".":
        return True  # an endpoint
    depth, j = 0, i - 1
    while j >= 0:  # within a group or an import?
        t = found[j]
        if t.kind == "op" and t.text in "{}":
            depth += 1 if t.text == "}" else -1
            if depth < 0:
                head = [x.text.lower() for x in found[max(0, j - 12) : j] if x.kind == "word"]
                line = source_line(found, j)
                return bool(re.match(r"tablegroup|tables", line[0])) if line else "tablegroup" in head
        j -= 1
    return False


def source_line(found: list, j: int) -> list[str]:
    """The words of the line that token j is on, up to it."""
    out = []
    while j > 0:
        j -= 1
        out.insert(0, found[j].text.lower())
        if found[j].fresh:
            break
    return out


def records_of(db: Database, table: Table) -> list[Records]:
    return [r for r in db.records if (r.schema or DEFAULT_SCHEMA, r.table) == table.key]
