"""The engine's one exception class; codes are part of the contract."""

from __future__ import annotations

#: The codes and what they stand for.
CODES = {
    "22023": "bad argument",
    "23505": "duplicate",
    "23514": "rule of a stored row broken",
    "42P01": "no such table",
    "42704": "no such object",
    "42809": "wrong kind of relation",
    "42601": "bad syntax",
    "3F000": "no such schema",
    "0A000": "unsupported shape",
    "55000": "state changed",
    "P0002": "no such run",
    "P0C01": "claim lost",
    "P0C02": "completion lost",
}


class EngineError(Exception):
    """code is one of CODES."""

    def __init__(self, code: str, message: str, hint: str | None = None):
        super().__init__(f"{code}: {message}" + (f" ({hint})" if hint else ""))
        self.code, self.message, self.hint = code, message, hint


class TransientChunkError(Exception):
    """Raised by a chunk's own code to ask for a retry."""

    code = "40001"
