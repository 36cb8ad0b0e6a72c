"""Strict JSON."""

from __future__ import annotations

import re

GRAMMAR = """
text : value ;
value : object | array | STRING | NUMBER | WORD ;
object : { } | { members } ;
members : member | members , member ;
member : STRING colon value ;
array : [ ] | [ values ] ;
values : value | values , value ;
"""

_TOKEN = re.compile(r'[ \t\r\n]+|(?P<STRING>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUMBER>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![0-9A-Za-z.])|(?P<WORD>(?:true|false|null)\b)|(?P<OP>[][{}:,])')


def tokens(body: str) -> list[tuple[str, int, bool]]:
    return list(_tokens(body))


def _tokens(body: str):
    at, line, n = 0, 1, len(body)
    match = _TOKEN.match
    while at < n:
        m = match(body, at)
        if m is None:
            yield "BAD", line, False
            return
        kind = m.lastgroup
        if kind == "OP":
            op = body[at]
            yield ("colon" if op == ":" else op), line, False
        elif kind:
            yield kind, line, False
        else:
            line += body.count("\n", at, m.end())
        at = m.end()
