"""Tokens of the SQL dialect: 'text' or "text" strings, `quoted` names, no comments."""

from __future__ import annotations

import re
from typing import NamedTuple


class SQLSyntaxError(ValueError):
    pass


class Token(NamedTuple):
    kind: str  # word, name (quoted), int, float, text, op, end
    value: str
    at: int


_TOKEN = re.compile(
    r"""(?P<space>\s+)
      | (?P<float>\d+\.\d+)
      | (?P<int>\d+)
      | (?P<word>[^\W\d]\w*)
      | (?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")
      | (?P<name>`[^`]+`)
      | (?P<op>@@|<=|>=|<>|!=|[-+*/(),.;=<>])""",
    re.X | re.S,
)


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SQLSyntaxError(f"unexpected {sql[at]!r} at {at}")
        kind, value = m.lastgroup or "", m.group()
        if kind == "text":
            value = value[1:-1].replace(value[0] * 2, value[0])
        elif kind == "name":
            value = value[1:-1]
        if kind != "space":
            out.append(Token(kind, value, at))
        at = m.end()
    return [*out, Token("end", "", len(sql))]
