"""The contract language: text to the model. parse() reads one file, bind() resolves names and checks the whole."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

from ..model import (
    DEFAULT_SCHEMA,
    Cell,
    Check,
    Code,
    Column,
    Database,
    Default,
    Diagnostic,
    Endpoint,
    EnumType,
    EnumValue,
    Group,
    Import,
    Index,
    IndexPart,
    Injection,
    Note,
    Project,
    Records,
    Ref,
    Report,
    Table,
    View,
)
from .lexer import Token, tidy_note, tokens

SIDES = {"<": ("1", "*"), ">": ("*", "1"), "-": ("1", "1"), "<>": ("*", "*")}
ACTIONS = {"cascade", "no action", "set null", "set default", "restrict"}
KINDS = {"table", "enum", "tablegroup", "tablepartial", "note", "schema"}


class _Stop(Exception):
    """Leaves the current line or element after an error."""


class _Parser:
    def __init__(self, source: str, file: str):
        self.source, self.file = source, file
        self.tokens, self.errors = tokens(source)
        self.at, self.db = 0, Database()

    # ---- reading tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def take(self) -> Token:
        token = self.now
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return token

    def is_op(self, *ops: str) -> bool:
        return self.now.kind == "op" and self.now.text in ops

    def accept(self, op: str) -> bool:
        if self.is_op(op):
            self.take()
            return True
        return False

    def fail(self, code: Code, message: str, token: Token | None = None) -> None:
        self.note_error(code, message, token)
        raise _Stop

    def note_error(self, code: Code, message: str, token: Token | None = None) -> None:
        self.errors.append(Diagnostic(code, message, (token or self.now).line, self.file))

    def expect(self, op: str) -> Token:
        if not self.is_op(op):
            self.fail(Code.UNCLOSED if op in ")]}" else Code.UNEXPECTED_SYMBOL, f"expected {op!r}, found {self.now.text!r}")
        return self.take()

    def name(self) -> str:
        if self.now.kind not in ("word", "quoted", "number") or self.now.kind == "number" and "." in self.now.text:
            self.fail(Code.INVALID_NAME, f"expected a name, found {self.now.text!r}")
        return self.take().text

    def dotted(self) -> list[str]:
        names = [self.name()]
        while self.accept("."):
            names.append(self.name())
        return names

    def qualified(self) -> tuple[str | None, str]:
        """schema (None for the default one) and name."""
        token, names = self.now, self.dotted()
        if len(names) > 2:
            self.fail(Code.UNSUPPORTED, "schemas don't nest", token)
        schema = names[0] if len(names) == 2 else None
        return None if schema == DEFAULT_SCHEMA else schema, names[-1]

    def string(self) -> str:
        if self.now.kind not in ("string", "quoted"):
            self.fail(Code.INVALID_VALUE, f"expected a string, found {self.now.text!r}")
        return self.take().text

    def skip_block(self) -> None:
        """To behind the brace that closes the current depth."""
        depth = 1
        while self.now.kind != "end":
            token = self.take()
            depth += (token.kind == "op") * ((token.text == "{") - (token.text == "}"))
            if not depth:
                return

    def items(self, item: Callable[[], None]) -> None:
        """`{` item ... `}`; a bad item is noted and skipped to the next line, or behind its own block."""
        opened = self.expect("{")
        while not self.is_op("}"):
            if self.now.kind == "end":
                self.fail(Code.UNCLOSED, "a block is not closed", opened)
            start = self.at
            try:
                item()
            except _Stop:
                self.at = max(self.at, start + 1) if self.at == start and not self.is_op("}") else self.at
                while not (self.now.fresh or self.is_op("}") or self.now.kind == "end"):
                    if self.take().text == "{" and self.tokens[self.at - 1].kind == "op":
                        self.skip_block()
        self.take()

    # ---- settings

    def settings(self) -> dict[str, list]:
        """`[a, b: v, ...]` as lower-case name to the readings of each occurrence; a reading is made by read()."""
        out: dict[str, list] = {}
        if not self.accept("["):
            return out
        while not self.is_op("]"):
            words = [self.name().lower()]
            while self.now.kind == "word":
                words.append(self.take().text.lower())
            key = " ".join(words)
            value = None
            if self.accept(":"):
                begin = self.at
                depth = 0
                while self.now.kind != "end" and (depth or not self.is_op(",", "]")):
                    depth += self.is_op("(", "[") - self.is_op(")", "]")
                    self.take()
                value = (begin, self.at)
                if begin == self.at:
                    self.fail(Code.INVALID_SETTING, f"{key} has no value")
            out.setdefault(key, []).append(value)
            if not self.is_op("]"):
                self.expect(",")
        self.expect("]")
        return out

    def read(self, span: tuple[int, int] | None, how: Callable[[], object], key: str) -> object:
        if span is None:
            self.fail(Code.INVALID_SETTING, f"{key} needs a value")
        held, self.at = self.at, span[0]
        try:
            value = how()
            if self.at != span[1]:
                self.fail(Code.INVALID_VALUE, f"bad value of {key}", self.tokens[span[0]])
            return value
        finally:
            self.at = held

    def only(self, settings: dict[str, list], known: set[str], repeat: frozenset[str] = frozenset()) -> None:
        for key, found in settings.items():
            if key not in known:
                self.note_error(Code.UNKNOWN_SETTING, f"unknown setting {key!r}")
            elif len(found) > 1 and key not in repeat:
                self.note_error(Code.DUPLICATE_SETTING, f"{key!r} is set twice")

    def text_setting(self, settings: dict[str, list], key: str) -> str | None:
        return self.read(settings[key][0], self.string, key) if key in settings else None

    def color(self) -> str | None:
        token = self.take()
        if token.kind == "word" and token.text.lower() == "none":
            return None
        if token.kind != "color" or not re.fullmatch(r"#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})", token.text):
            self.fail(Code.INVALID_VALUE, "a color is #rgb or #rrggbb", token)
        return token.text

    def color_setting(self, settings: dict[str, list], key: str) -> str | None:
        return self.read(settings[key][0], self.color, key) if key in settings else None

    def note_setting(self, settings: dict[str, list]) -> str | None:
        text = self.text_setting(settings, "note")
        return None if text is None else tidy_note(text)

    def sign(self) -> int:
        """-1 or 1 of the signs that come next, 0 if there are none."""
        sign = 0
        while self.is_op("-", "+"):
            sign = (sign or 1) * (-1 if self.take().text == "-" else 1)
        return sign

    def default(self) -> Default:
        sign = self.sign()
        token = self.now
        if token.kind == "number":
            return Default("number", ("-" if sign < 0 else "") + self.take().text)
        if sign:
            self.fail(Code.INVALID_VALUE, "a sign needs a number")
        if token.kind in ("string", "quoted") and not (self.peek().kind == "op" and self.peek().text == "."):
            return Default("string", self.take().text)
        if token.kind == "expression":
            return Default("expression", self.take().text)
        names = self.dotted()
        if len(names) > 1:
            return Default("string", names[-1])
        if names[0].lower() not in ("true", "false", "null"):
            self.fail(Code.INVALID_VALUE, f"{names[0]!r} is no default", token)
        return Default("boolean", names[0].lower())

    # ---- elements

    def program(self) -> Database:
        handlers = {"table": self.table, "tablepartial": self.partial, "enum": self.enum, "ref": self.ref, "tablegroup": self.group, "records": self.records, "note": self.note, "project": self.project, "diagramview": self.view, "use": self.imports, "reuse": self.imports}
        while self.now.kind != "end":
            start = self.at
            try:
                word = self.take()
                handler = handlers.get(word.text.lower()) if word.kind == "word" else None
                if not handler:
                    self.fail(Code.UNKNOWN_ELEMENT, f"unknown element {word.text!r}", word)
                handler()
            except _Stop:
                self.at = max(self.at, start + 1)
                while self.now.kind != "end" and not (self.now.fresh and self.now.kind == "word" and self.now.text.lower() in handlers):
                    if self.is_op("{"):
                        self.take()
                        self.skip_block()
                    else:
                        self.take()
        return self.db

    def imports(self) -> None:
        reuse = self.tokens[self.at - 1].text.lower() == "reuse"
        names: list | None = []
        if self.accept("*"):
            names = None
        else:
            self.expect("{")
            while not self.accept("}"):
                kind = self.name().lower()
                if kind not in KINDS:
                    self.fail(Code.INVALID_CONTEXT, f"{kind!r} can't be imported")
                name = ".".join(self.dotted())
                alias = self.name() if self.now.text.lower() == "as" and self.take() else None
                names.append((kind, name, alias))
                self.accept(",")
        if self.name().lower() != "from":
            self.fail(Code.UNEXPECTED_SYMBOL, "expected from")
        self.db.imports.append(Import(names, self.string(), reuse))

    def table(self) -> None:
        line = self.now
        schema, name = self.qualified()
        alias = self.name() if self.now.kind == "word" and self.now.text.lower() == "as" and self.take() else None
        table = Table(name, schema, alias)
        self._table_body(table, line)
        self.db.tables.append(table)

    def partial(self) -> None:
        line = self.now
        partial = Table(self.name())
        self._table_body(partial, line, True)
        self.db.partials.append(partial)

    def _table_body(self, table: Table, line: Token, partial: bool = False) -> None:
        settings = self.settings()
        self.only(settings, {"headercolor", "note"})
        table.color, table.note = self.color_setting(settings, "headercolor"), self.note_setting(settings)
        self.items(lambda: self._table_item(table, partial))
        if not table.columns and not table.injections and not partial:
            self.note_error(Code.EMPTY_ELEMENT, f"{table.name} has no column", line)

    def _table_item(self, table: Table, partial: bool) -> None:
        word, after = self.now.text.lower(), self.peek()
        block = after.kind == "op" and after.text == "{"
        if self.accept("~"):
            name = self.name()
            if any(i.name == name for i in table.injections):
                self.note_error(Code.DUPLICATE_PARTIAL, f"{name} is injected twice")
            table.injections.append(Injection(name, len(table.columns)))
        elif self.now.kind == "word" and word == "indexes" and block:
            self.take()
            self.items(lambda: table.indexes.append(self._index()))
        elif self.now.kind == "word" and word == "checks" and block:
            self.take()
            self.items(lambda: table.checks.append(self._check()))
        elif self.now.kind == "word" and word == "note" and after.kind == "op" and after.text in ":{":
            self.take()
            table.note = self._note_text()
        elif self.now.kind == "word" and word == "records" and after.kind == "op" and after.text in "({":
            token = self.take()
            columns = self._names() if self.is_op("(") else None
            self._record_rows(table.name, table.schema, columns, token.line, table)
        else:
            self._column(table, partial)

    def _column(self, table: Table, partial: bool) -> None:
        name = self.name()
        column = Column(name, "")
        column.type_schema, column.type = self._type()
        settings = self.settings()
        flags = {"pk", "primary key", "unique", "not null", "null", "increment"}
        self.only(settings, flags | {"default", "note", "ref", "check"}, frozenset({"ref", "check"}))
        for flag in flags & settings.keys():
            if settings[flag][0] is not None:
                self.note_error(Code.INVALID_SETTING, f"{flag!r} takes no value")
        if {"pk", "primary key"} <= settings.keys() or {"null", "not null"} <= settings.keys():
            self.note_error(Code.CONFLICTING_SETTING, f"settings of {name} exclude each other")
        column.pk, column.unique, column.increment = bool({"pk", "primary key"} & settings.keys()), "unique" in settings, "increment" in settings
        column.not_null = True if "not null" in settings else False if "null" in settings else None
        column.note = self.note_setting(settings)
        if "default" in settings:
            column.default = self.read(settings["default"][0], self.default, "default")
        for span in settings.get("check", ()):
            column.checks.append(Check(self.read(span, self._expression, "check")))
        for span in settings.get("ref", ()):
            op, end = self.read(span, self._inline_ref, "ref")
            mine, other = SIDES[op]
            end.relation = other
            if not end.table and not partial:
                end.table, end.schema = table.name, table.schema
            ref = Ref((end, Endpoint(table.name, [name], mine, table.schema)))
            table.refs.append(ref)
        table.columns.append(column)

    def _type(self) -> tuple[str | None, str]:
        token = self.now
        if token.fresh or token.kind not in ("word", "quoted"):
            self.fail(Code.INVALID_VALUE, "a column needs a type", token)
        schema, text = self.qualified()
        if self.is_op("("):
            begin = self.take()
            while not self.is_op(")"):
                if self.now.kind == "end":
                    self.fail(Code.UNCLOSED, "type arguments are not closed", begin)
                self.take()
            end = self.take()
            text += self.source[begin.begin : end.end].replace(", ", ",")
        while self.is_op("[") and self.tokens[self.at - 1].end == self.now.begin:
            begin = self.take()
            while not self.is_op("]"):
                if self.now.kind == "end":
                    self.fail(Code.UNCLOSED, "a bracket is not closed", begin)
                self.take()
            text += self.source[begin.begin : self.take().end]
        return schema, text

    def _inline_ref(self) -> tuple[str, Endpoint]:
        op = self.take().text
        if op not in SIDES:
            self.fail(Code.INVALID_VALUE, f"{op!r} is no relation")
        self.accept(".")
        names = self.dotted()
        if len(names) == 1:  # a column of the table itself
            return op, Endpoint("", names, "")
        if len(names) > 3:
            self.fail(Code.INVALID_VALUE, "a ref names table.column")
        return op, Endpoint(names[-2], [names[-1]], "", names[0] if len(names) == 3 and names[0] != DEFAULT_SCHEMA else None)

    def _expression(self) -> str:
        if self.now.kind != "expression":
            self.fail(Code.INVALID_VALUE, "expected an expression in backticks")
        return self.take().text

    def _names(self) -> list[str]:
        self.expect("(")
        names = [self.name()]
        while self.accept(","):
            names.append(self.name())
        self.expect(")")
        return names

    def _index(self) -> Index:
        def part() -> IndexPart:
            return IndexPart(self.take().text, "expression") if self.now.kind == "expression" else IndexPart(self.name())

        if self.accept("("):
            parts = [part()]
            while self.accept(","):
                parts.append(part())
            self.expect(")")
        else:
            parts = [part()]
        settings = self.settings()
        self.only(settings, {"pk", "unique", "name", "note", "type"})
        kind = self.read(settings["type"][0], self.name, "type") if "type" in settings else None
        return Index(parts, "pk" in settings, "unique" in settings, self.text_setting(settings, "name"), kind, self.note_setting(settings))

    def _check(self) -> Check:
        expression = self._expression()
        settings = self.settings()
        self.only(settings, {"name"})
        return Check(expression, self.text_setting(settings, "name"))

    def _note_text(self) -> str:
        if self.accept(":"):
            return tidy_note(self.string())
        self.expect("{")
        text = tidy_note(self.string())
        self.expect("}")
        return text

    def enum(self) -> None:
        token = self.now
        schema, name = self.qualified()
        values: list[EnumValue] = []

        def value() -> None:
            item = EnumValue(self.name())
            settings = self.settings()
            self.only(settings, {"note"})
            item.note = self.note_setting(settings)
            values.append(item)

        self.items(value)
        if not values:
            self.note_error(Code.EMPTY_ELEMENT, f"enum {name} has no value", token)
        self.db.enums.append(EnumType(name, values, schema))

    def ref(self) -> None:
        name = self.dotted()[-1] if self.now.kind in ("word", "quoted") else None
        if self.accept(":"):
            self.db.refs.append(self._ref_line(name))
        else:
            self.items(lambda: self.db.refs.append(self._ref_line(name)))

    def _endpoint(self) -> Endpoint:
        names = [self.name()]
        columns = None
        while self.accept("."):
            if self.is_op("("):
                columns = self._names()
                break
            names.append(self.name())
        if columns is None:
            columns = [names.pop()]
        if len(names) not in (1, 2):
            self.fail(Code.INVALID_VALUE, "an endpoint is table.column")
        return Endpoint(names[-1], columns, "", names[0] if len(names) == 2 and names[0] != DEFAULT_SCHEMA else None)

    def _ref_line(self, name: str | None) -> Ref:
        token, first = self.now, self._endpoint()
        op = self.take().text
        if op not in SIDES:
            self.fail(Code.INVALID_VALUE, f"{op!r} is no relation", token)
        second = self._endpoint()
        first.relation, second.relation = SIDES[op]
        settings = self.settings()
        self.only(settings, {"delete", "update", "color", "inactive"})

        def action() -> str:
            words = [self.name().lower()]
            while self.now.kind == "word":
                words.append(self.take().text.lower())
            if " ".join(words) not in ACTIONS:
                self.fail(Code.INVALID_VALUE, f"{' '.join(words)!r} is no action")
            return " ".join(words)

        actions = {k: self.read(settings[k][0], action, k) if k in settings else None for k in ("delete", "update")}
        return Ref((first, second), name, actions["delete"], actions["update"], self.color_setting(settings, "color"), "inactive" in settings)

    def group(self) -> None:
        schema, name = self.qualified()
        group = Group(name, [], schema)
        settings = self.settings()
        self.only(settings, {"note", "color"})
        group.note, group.color = self.note_setting(settings), self.color_setting(settings, "color")

        def member() -> None:
            if self.now.text.lower() == "note" and self.peek().text in ":{" and self.peek().kind == "op":
                self.take()
                group.note = self._note_text()
            else:
                group.tables.append(self.qualified())

        self.items(member)
        self.db.groups.append(group)

    def note(self) -> None:
        name = self.name()
        settings = self.settings()
        self.only(settings, {"color"})
        self.db.notes.append(Note(name, self._note_text(), self.color_setting(settings, "color")))

    def project(self) -> None:
        project = Project(self.name() if self.now.kind in ("word", "quoted") else None)

        def item() -> None:
            key = self.name()
            if key.lower() == "note":
                project.note = self._note_text()
            else:
                self.expect(":")
                project.values[key] = self.string()

        token = self.now
        self.items(item)
        if self.db.project:
            self.note_error(Code.DUPLICATE_NAME, "a second project", token)
        self.db.project = project

    def view(self) -> None:
        view, slots = View(self.name()), {"tables": "tables", "notes": "notes", "tablegroups": "groups", "schemas": "schemas"}
        every = False

        def block() -> None:
            nonlocal every
            if self.accept("*"):
                every = True
                return
            word = self.name().lower()
            if word not in slots:
                self.fail(Code.INVALID_CONTEXT, f"{word!r} is no part of a view")
            names: list[str] = []
            star = False

            def member() -> None:
                nonlocal star
                if self.accept("*"):
                    star = True
                else:
                    names.append(".".join(self.dotted()))

            self.items(member)
            if star or names:
                setattr(view, slots[word], [] if star else names)

        self.items(block)
        if every:
            for slot in slots.values():
                setattr(view, slot, [])
        self.db.views.append(view)

    def records(self) -> None:
        token = self.now
        schema, name = self.qualified()
        self._record_rows(name, schema, self._names(), token.line, None)

    def _record_rows(self, name: str, schema: str | None, columns: list[str] | None, line: int, table: Table | None) -> None:
        """columns None: all merged columns of the table, filled in by bind()."""
        rows: list[list[Cell]] = []

        def row() -> None:
            cells: list[Cell] = []
            while True:
                ended = self.is_op("}") or bool(cells) and self.now.fresh  # behind a last comma
                cells.append(Cell("null") if ended or self.is_op(",") else self._cell())
                if ended or not self.accept(","):
                    break
            rows.append(cells)
            if not (self.now.fresh or self.is_op("}")):
                self.fail(Code.UNEXPECTED_SYMBOL, f"unexpected {self.now.text!r} in a record")

        self.items(row)
        self.db.records.append(Records(name, columns or [], rows, schema, line))

    def _cell(self) -> Cell:
        sign = self.sign()
        token = self.now
        if token.kind == "number":
            text = self.take().text
            value = (float(text) if re.search(r"[.eE]", text) else int(text)) * (sign or 1)
            return Cell("number", value)
        if sign:
            self.fail(Code.INVALID_VALUE, "a sign needs a number")
        if token.kind in ("string", "quoted"):
            return Cell("string", self.take().text)
        if token.kind == "expression":
            return Cell("expression", self.take().text)
        names = self.dotted()
        if len(names) > 1:
            return Cell("enum", names[-1])
        word = names[0].lower()
        return Cell("null") if word == "null" else Cell("bool", word == "true") if word in ("true", "false") else Cell("word", names[0])


def parse(source: str, file: str = "") -> Report:
    """One file's text to a Database whose names aren't resolved yet."""
    parser = _Parser(source, file)
    db = parser.program()
    return Report(db, [Diagnostic(e.code, e.message, e.line, file) for e in parser.errors])


# ---------------------------------------------------------------- binding


def inject(table: Table, partials: dict[str, Table]) -> Table:
    """The table with its partials' columns, indexes and checks. Columns of a partial stand where it is injected. Of
    columns of one name the table's own wins, else the last partial's; note and color likewise."""
    placed: list[tuple[float, Column, bool]] = [(float(i), c, True) for i, c in enumerate(table.columns)]
    out = Table(table.name, table.schema, table.alias, [], list(table.indexes), list(table.checks), list(table.injections), list(table.refs), table.note, table.color)
    for n, injection in enumerate(table.injections):
        partial = partials.get(injection.name)
        if partial is None:
            continue
        for k, c in enumerate(partial.columns):
            place = injection.order - 0.5 + (n + k / (len(partial.columns) + 1)) / (2 * (len(table.injections) + 1))
            placed.append((place, Column(**{**c.__dict__, "partial": partial.name}), False))
        out.indexes += partial.indexes
        out.checks += [Check(c.expression, c.name, partial.name) for c in partial.checks]
    for injection in reversed(table.injections):
        partial = partials.get(injection.name)
        if partial:
            out.note, out.color = out.note or partial.note, out.color or partial.color
    own = {c.name for c in table.columns}
    last = {c.name: i for i, (_, c, mine) in enumerate(placed) if mine or c.name not in own}
    out.columns = [c for _, c in sorted(((p, c) for i, (p, c, _) in enumerate(placed) if last.get(c.name) == i), key=lambda x: x[0])]
    return out


def bind(db: Database, file: str = "") -> Report:
    """The Database with partials injected, composite keys formed, inline refs listed and record columns filled in,
    and what is wrong with its names."""
    errors: list[Diagnostic] = []
    say = lambda code, message: errors.append(Diagnostic(code, message, 0, file))
    partials = {p.name: p for p in db.partials}
    out = Database(enums=db.enums, groups=db.groups, partials=db.partials, notes=db.notes, views=db.views, project=db.project, imports=db.imports)
    for code, message in duplicate_names(db):
        say(code, message)
    for table in db.tables:
        for i in table.injections:
            if i.name not in partials:
                say(Code.NOT_FOUND, f"no partial {i.name}")
        merged = inject(table, partials)
        flagged = [c for c in merged.columns if c.pk]
        if len(flagged) > 1:
            merged.columns = [Column(**{**c.__dict__, "pk": False}) for c in merged.columns]
            merged.indexes.insert(0, Index([IndexPart(c.name) for c in flagged], pk=True))
        names = {c.name for c in merged.columns}
        for index in merged.indexes:
            for p in index.parts:
                if p.kind == "column" and p.value not in names:
                    say(Code.NOT_FOUND, f"no column {p.value} in {table.label}")
        out.tables.append(merged)
    out.refs = [r for t in db.tables for r in t.refs] + list(db.refs)
    seen: Counter = Counter()
    for ref in out.all_refs():
        resolved = []
        for end in ref.ends:
            table = out.table(end.table, end.schema)
            if table is None:
                say(Code.NOT_FOUND, f"no table {end.table}")
                continue
            end.table, end.schema = table.name, table.schema
            for c in end.columns:
                if c not in {x.name for x in table.columns}:
                    say(Code.NOT_FOUND, f"no column {c} in {table.label}")
            resolved.append((table.key, tuple(end.columns)))
        if len(ref.ends[0].columns) != len(ref.ends[1].columns):
            say(Code.UNEQUAL_ENDPOINTS, "a ref's ends have unequal numbers of columns")
        if len(resolved) == 2:
            if resolved[0] == resolved[1]:
                say(Code.SAME_ENDPOINT, f"a ref ties {resolved[0]} to itself")
            seen[frozenset(resolved)] += 1
    for pair, n in seen.items():
        if n > 1:
            say(Code.DUPLICATE_REF, f"{n} refs tie {sorted(pair)}")
    placed: Counter = Counter()
    for group in db.groups:
        for schema, name in group.tables:
            table = out.table(name, schema)
            if table is None:
                say(Code.NOT_FOUND, f"no table {name} for group {group.name}")
            else:
                placed[table.key] += 1
    for key, n in placed.items():
        if n > 1:
            say(Code.TABLE_IN_TWO_GROUPS, f"{'.'.join(key)} is in groups {n} times")
    blocks: Counter = Counter()
    for r in db.records:
        table = out.table(r.table, r.schema)
        if table is None:
            say(Code.NOT_FOUND, f"no table {r.table} for records")
            continue
        blocks[table.key] += 1
        columns = r.columns or [c.name for c in table.columns]
        for c in columns:
            if c not in {x.name for x in table.columns}:
                say(Code.NOT_FOUND, f"no column {c} in {table.label}")
        out.records.append(Records(table.name, columns, r.rows, table.schema, r.line))
    for key, n in blocks.items():
        if n > 1:
            say(Code.DUPLICATE_RECORDS, f"{'.'.join(key)} has {n} blocks of records")
    return Report(out, errors)


def duplicate_names(db: Database) -> Iterator[tuple[Code, str]]:
    def twice(what: str, names: list) -> Iterator[tuple[Code, str]]:
        for name, n in Counter(names).items():
            if n > 1:
                yield Code.DUPLICATE_NAME, f"{what} {name} is defined {n} times"

    yield from twice("table", [".".join(t.key) for t in db.tables])
    yield from twice("alias", [t.alias for t in db.tables if t.alias])
    yield from twice("enum", [f"{e.schema or DEFAULT_SCHEMA}.{e.name}" for e in db.enums])
    yield from twice("partial", [p.name for p in db.partials])
    yield from twice("group", [g.name for g in db.groups])
    yield from twice("note", [n.name for n in db.notes])
    yield from twice("view", [v.name for v in db.views])
    yield from twice("ref", [r.name for r in db.refs if r.name])
    for t in [*db.tables, *db.partials]:
        yield from twice(f"column of {t.name}", [c.name for c in t.columns])
        yield from twice(f"index of {t.name}", [i.name for i in t.indexes if i.name])
    for e in db.enums:
        yield from twice(f"value of {e.name}", [v.name for v in e.values])


def compile_text(source: str, file: str = "") -> Report:
    """parse() and bind() of one file."""
    parsed = parse(source, file)
    if parsed.errors:
        return parsed
    bound = bind(parsed.value, file)
    return Report(bound.value, parsed.errors + bound.errors)
