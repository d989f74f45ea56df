"""Chunk templates: SQL text with <driving_table> and <chunking_clause> once each.

A template is one statement: SELECT (rows go to the run's output), INSERT INTO
a registered table SELECT, UPDATE or DELETE of the driving table. UPDATE and
DELETE become queries that rewrite the chunk's rows, as Parquet has no update.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tileforge.errors import EngineError
from tileforge.functions import checks

TABLE, CLAUSE = "<driving_table>", "<chunking_clause>"
#: Characters that rendering keeps for itself.
RESERVED = ("\x00", "\x01")


def assert_template(sql_text: str) -> str:
    checks.text("sql_text", sql_text)
    for token in (TABLE, CLAUSE):
        if sql_text.count(token) != 1:
            raise EngineError("22023", f"the template must have {token} exactly once")
    if any(c in sql_text for c in RESERVED):
        raise EngineError("22023", "the template has a reserved character")
    return assert_single_statement(sql_text)


_TOKENS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|;|[^;'\"`/-]+|.", re.S)


def assert_single_statement(sql_text: str) -> str:
    """The statement without a trailing semicolon; quotes and comments may hold any."""
    pieces = [m.group() for m in _TOKENS.finditer(sql_text)]
    blank = lambda p: not p.strip() or p.startswith(("--", "/*"))
    statements, current = [], []
    for piece in [*pieces, ";"]:
        if piece == ";":
            if any(not blank(p) for p in current):
                statements.append("".join(current).strip())
            current = []
        else:
            current.append(piece)
    if len(statements) != 1:
        raise EngineError("42601", "the template must be one statement")
    return statements[0]


@dataclass(frozen=True)
class Statement:
    """kind: select, insert, update or delete. query selects the chunk's output."""

    kind: str
    query: str
    target: str | None = None
    columns: tuple[str, ...] = ()


_INSERT = re.compile(r"^\s*insert\s+into\s+(?:table\s+)?([\w.`]+)\s*(?:\(([\w`,\s]+)\)\s*)?\s((?:select|with)\b.*|\(.*)$", re.I | re.S)
_UPDATE = re.compile(r"^\s*update\s+<driving_table>\s+set\s+(.*?)\s+where\s+(.*)$", re.I | re.S)
_DELETE = re.compile(r"^\s*delete\s+from\s+<driving_table>\s+where\s+(.*)$", re.I | re.S)


def _assignments(text: str) -> list[tuple[str, str]]:
    """column = expression pairs, split at commas outside brackets and quotes."""
    parts, depth, current = [], 0, ""
    for piece in re.findall(r"'(?:[^'\\]|\\.|'')*'|[(),]|[^'(),]+", text):
        depth += {"(": 1, ")": -1}.get(piece, 0)
        if piece == "," and not depth:
            parts.append(current)
            current = ""
        else:
            current += piece
    found = []
    for part in [*parts, current]:
        name, sign, expression = part.partition("=")
        if not sign:
            raise EngineError("42601", f"no assignment: {part.strip()}")
        found.append((name.strip().strip("`"), expression.strip()))
    return found


def parse(sql_text: str, columns: list[str], alias: str) -> Statement:
    """The template's kind, and a query that still holds both tokens.

    The query of an update or delete yields the rows that stay, with the
    column __hit that says which of them the statement changed (for a delete:
    all the chunk's rows, of which the hit ones go).
    """
    text = assert_template(sql_text)
    if m := _INSERT.match(text):
        columns = tuple(c.strip().strip("`") for c in (m.group(2) or "").split(",") if c.strip())
        return Statement("insert", m.group(3), m.group(1).replace("`", ""), columns)
    if m := _UPDATE.match(text):
        new = dict(_assignments(m.group(1)))
        if unknown := [c for c in new if c not in columns]:
            raise EngineError("22023", f"no column {unknown[0]}")
        rest = f"coalesce({m.group(2).replace(CLAUSE, 'true')}, false)"
        values = ", ".join(f"if({rest}, {new[c]}, `{alias}`.`{c}`) as `{c}`" if c in new else f"`{alias}`.`{c}`" for c in columns)
        return Statement("update", f"select {values}, {rest} as __hit from {TABLE} where {CLAUSE}")
    if m := _DELETE.match(text):
        rest = f"coalesce({m.group(1).replace(CLAUSE, 'true')}, false)"
        return Statement("delete", f"select `{alias}`.*, {rest} as __hit from {TABLE} where {CLAUSE}")
    if not re.match(r"^\s*(select|with)\b", text, re.I):
        raise EngineError("0A000", "a template is a SELECT, INSERT INTO ... SELECT, UPDATE or DELETE")
    return Statement("select", text)


def render(query: str, table: str, alias: str, condition: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*", alias):
        raise EngineError("22023", f"{alias!r} can't be an alias")
    return query.replace(TABLE, f"{table} AS `{alias}`").replace(CLAUSE, condition)
