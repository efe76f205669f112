"""Tokens of the contract language."""

from __future__ import annotations

from dataclasses import dataclass

import regex

from ..model import Code, Diagnostic

_TOKEN = regex.compile(
    r"""(?P<space>[ \t\r]+)|(?P<line>\n)
    |(?P<comment>//[^\n]*|/\*.*?\*/)
    |(?P<triple>'''(?:\\.|(?!''').)*''')
    |(?P<single>'(?:\\.|[^'\\\n])*')
    |(?P<quoted>"(?:\\.|[^"\\\n])*")
    |(?P<expression>`[^`]*`)
    |(?P<color>\#[\p{L}\p{M}\d_]*)
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\p{L}\p{M}_\d.]))
    |(?P<word>[\p{L}\p{M}\d_]+)
    |(?P<op><>|<=|>=|==|!=|[<>\-=~{}\[\]():,.*+/%!])""",
    regex.X | regex.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "v": "\v", "f": "\f", "0": "\0", "\n": ""}


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, string, expression, color, number, op, end
    text: str
    line: int
    begin: int
    end: int
    fresh: bool  # first on its line


def unescape(text: str) -> str:
    r"""\t \n \\ \' \" \` \0 \b \v \f \uHHHH; a backslash before a line break joins the lines; others give the character."""
    return regex.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), text, flags=regex.S)


def tidy_note(text: str) -> str:
    """Without leading blank lines and the indent that all lines share."""
    lines = text.split("\n")
    while len(lines) > 1 and not lines[0].strip():
        lines.pop(0)
    indent = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return "\n".join(x[indent:] for x in lines)


def tokens(source: str) -> tuple[list[Token], list[Diagnostic]]:
    out, errors, at, line, fresh = [], [], 0, 1, True
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            code = Code.UNCLOSED if source[at] in "'\"`" or source.startswith("/*", at) else Code.UNKNOWN_SYMBOL
            errors.append(Diagnostic(code, f"unexpected {source[at]!r}", line))
            at += 1
            continue
        kind, text = m.lastgroup, m[0]
        if kind == "line":
            fresh = True
        elif kind not in ("space", "comment"):
            value = text
            if kind in ("triple", "single", "quoted"):
                cut = 3 if kind == "triple" else 1
                value = unescape(text[cut:-cut])
            elif kind == "expression":
                value = text[1:-1]
            out.append(Token({"triple": "string", "single": "string"}.get(kind, kind), value, line, at, m.end(), fresh))
            fresh = False
        line += text.count("\n")
        at = m.end()
    out.append(Token("end", "", line, at, at, True))
    return out, errors
