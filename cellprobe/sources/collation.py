"""Declared collations, read from the text of CREATE TABLE."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<skip>--[^\n]*|/\*.*?(?:\*/|\Z)|\s+)
      |(?P<literal>'(?:[^']|'')*')
      |(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^\W\d][\w$]*)
      |(?P<other>.)""",
    re.X | re.S,
)
_TABLE_CONSTRAINTS = {"CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN"}


def _plain(token: str) -> str:
    """An identifier or string literal without its quotes."""
    if token[0] in "\"'`" and len(token) > 1:
        return token[1:-1].replace(token[0] * 2, token[0])
    return token[1:-1] if token[0] == "[" else token


def parse(create: str) -> dict[str, str]:
    """Column -> collation (upper case); columns without a clause get BINARY. Virtual tables have none."""
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(create) if m.lastgroup != "skip"]
    words = [t.upper() for _, t in tokens[:6]]
    if "VIRTUAL" in words or ("other", "(") not in tokens:
        return {}
    depth, column, out = 0, [], {}
    for kind, token in tokens[tokens.index(("other", "(")) :]:
        if token == ")" and kind == "other":
            depth -= 1
        if depth == 0 and token != "(" or depth == 1 and (kind, token) == ("other", ","):
            _column(column, out)
            column = []
            if depth == 0:
                break
        elif depth == 1:
            column.append((kind, token))
        if token == "(" and kind == "other":
            depth += 1
    return out


def _column(tokens: list[tuple[str, str]], out: dict[str, str]) -> None:
    """A definition's tokens outside inner parentheses."""
    if not tokens or tokens[0][0] not in ("name", "literal") or tokens[0][0] == "name" and tokens[0][1].upper() in _TABLE_CONSTRAINTS:
        return
    found = "BINARY"
    for (kind, word), (_, value) in zip(tokens[1:], tokens[2:], strict=False):
        if kind == "name" and word.upper() == "COLLATE":
            found = _plain(value).upper()
    out[_plain(tokens[0][1])] = found
