"""Key ranges as disjoint boxes, which reach the Parquet scan as pushed filters."""

from __future__ import annotations

from tileforge.errors import EngineError

from .keys import Key, compare_form, literal


def boxes(columns: list[str], start: list[str], end: list[str], difference: int, final: bool) -> list[str]:
    """SQL conditions, disjoint, whose union is [start, end), or [start, end] if final.

    difference: the first position, from 1, in which start and end differ; 0 if
    none. columns, start and end are SQL texts.
    """
    n = len(columns)
    equal = lambda upto, values: [f"{columns[i]} = {values[i]}" for i in range(upto)]
    if difference == 0:
        return [" AND ".join(equal(n, start))]
    d = difference - 1
    top = "<=" if final else "<"
    if difference == n:
        return [" AND ".join([*equal(d, start), f"{columns[d]} >= {start[d]}", f"{columns[d]} {top} {end[d]}"])]
    lower = [" AND ".join([*equal(i, start), f"{columns[i]} {'>=' if i == n - 1 else '>'} {start[i]}"]) for i in range(n - 1, d, -1)]
    middle = [" AND ".join([*equal(d, start), f"{columns[d]} > {start[d]}", f"{columns[d]} < {end[d]}"])]
    upper = [" AND ".join([*equal(i, end), f"{columns[i]} {top if i == n - 1 else '<'} {end[i]}"]) for i in range(d + 1, n)]
    return lower + middle + upper


def first_difference(kinds: tuple[str, ...], start: list, end: list) -> int:
    for i, (kind, a, b) in enumerate(zip(kinds, start, end, strict=True), 1):
        if compare_form(kind, a) != compare_form(kind, b):
            return i
    return 0


def condition(key: Key, start: list, end: list, final: bool, alias: str | None = None, ntz: bool = False) -> str:
    """SQL for the rows of a chunk; a hull on the first column helps simple filters."""
    if len(start) != len(key.columns) or len(end) != len(key.columns):
        raise EngineError("22023", "a boundary has another number of values than the key")
    d = first_difference(key.kinds, start, end)
    order = [[compare_form(k, v) for k, v in zip(key.kinds, side, strict=True)] for side in (start, end)]
    if order[0] > order[1]:
        raise EngineError("22023", "the range is reversed")
    if d == 0 and not final:
        raise EngineError("22023", "the range is empty")
    prefix = f"`{alias}`." if alias else ""
    columns = [f"{prefix}`{c}`" for c in key.columns]
    quoted = [[literal(k, v, ntz) for k, v in zip(key.kinds, side, strict=True)] for side in (start, end)]
    found = boxes(columns, quoted[0], quoted[1], d, final)
    if len(found) == 1:
        return f"({found[0]})"
    return f"({columns[0]} >= {quoted[0][0]} AND {columns[0]} <= {quoted[1][0]} AND (" + " OR ".join(f"({x})" for x in found) + "))"
