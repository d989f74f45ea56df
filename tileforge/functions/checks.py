"""Argument domains. Each returns the value or raises 22023 (bad) or 23514 (null)."""

from __future__ import annotations

from tileforge.errors import EngineError

#: Only these are trimmed to see whether text is blank; a no-break space isn't one.
ASCII_SPACE = " \t\n\r\f\v"


def _not_null(name: str, value):
    if value is None:
        raise EngineError("23514", f"{name} must not be null")
    return value


def text(name: str, value) -> str:
    if not isinstance(_not_null(name, value), str) or not value.strip(ASCII_SPACE):
        raise EngineError("23514", f"{name} must be text that isn't blank")
    return value


def integer(name: str, value, least: int) -> int:
    if isinstance(_not_null(name, value), bool) or not isinstance(value, int) or value < least:
        raise EngineError("23514", f"{name} must be an integer of {least} or more")
    return value


def positive(name: str, value) -> int:
    return integer(name, value, 1)


def non_negative(name: str, value) -> int:
    return integer(name, value, 0)


def boolean(name: str, value) -> bool:
    if not isinstance(_not_null(name, value), bool):
        raise EngineError("23514", f"{name} must be true or false")
    return value


def elements(name: str, values, kind: type) -> list:
    """A list without nulls and of one type."""
    found = list(_not_null(name, values))
    if any(not isinstance(x, kind) or isinstance(x, bool) for x in found):
        raise EngineError("23514", f"{name} must hold {kind.__name__} values only")
    return found
