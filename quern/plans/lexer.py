"""Tokens of the dialect: words, numbers, quoted strings and marks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quern.errors import ParseError

PATTERN = re.compile(
    r"""(?P<blank>\s+)
      | (?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
      | (?P<word>[^\W\d]\w*)
      | (?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")
      | (?P<mark>==|<=|>=|<>|!=|[-+*/=<>(),;.|@:])""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


def tokenize(sql: str) -> list[Token]:
    """All tokens, with an ``end`` token last. Both quotes make strings; doubling one escapes it."""
    out, at = [], 0
    while at < len(sql):
        m = PATTERN.match(sql, at)
        if not m:
            raise ParseError("unclosed string" if sql[at] in "'\"" else f"unexpected {sql[at]!r}", at)
        kind, text = m.lastgroup or "", m[0]
        if kind == "string":
            text = text[1:-1].replace(text[0] * 2, text[0])
        if kind != "blank":
            out.append(Token(kind, text, at))
        at = m.end()
    return [*out, Token("end", "", len(sql))]
