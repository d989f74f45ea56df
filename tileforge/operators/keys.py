"""Keys of one to three columns, their kinds, and packed keys."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tileforge.errors import EngineError

MAX_COLUMNS = 3
KINDS = ("bigint", "text", "uuid", "timestamptz")
_PACKED = {"bigint": "bigint_values", "text": "text_values", "uuid": "uuid_values", "timestamptz": "timestamptz_values"}
PACKED_TYPE = "struct<bigint_values: array<bigint>, text_values: array<string>, uuid_values: array<string>, timestamptz_values: array<timestamp>>"


def kind_of(data_type: T.DataType, declared: str | None = None) -> str:
    """The kind of a column type; a string column may be declared a uuid."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        found = "bigint"
    elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        found = "timestamptz"
    elif isinstance(data_type, T.StringType):
        found = "uuid" if declared == "uuid" else "text"
    else:
        raise EngineError("22023", f"a {data_type.simpleString()} column can't be a key")
    if declared not in (None, found):
        raise EngineError("22023", f"the column's kind is {found}, not {declared}")
    return found


@dataclass(frozen=True)
class Key:
    """Columns in key order; kinds are filled in from the schema."""

    columns: tuple[str, ...]
    kinds: tuple[str, ...] = ()
    name: str | None = None
    declared: dict[str, str] = field(default_factory=dict, hash=False)

    def resolve(self, schema: T.StructType) -> Key:
        if not 1 <= len(self.columns) <= MAX_COLUMNS:
            raise EngineError("22023", f"a key has 1 to {MAX_COLUMNS} columns")
        if len(set(self.columns)) != len(self.columns):
            raise EngineError("22023", "a key column is named twice")
        types = {f.name: f.dataType for f in schema}
        if missing := [c for c in self.columns if c not in types]:
            raise EngineError("22023", f"no column {missing[0]}")
        return Key(self.columns, tuple(kind_of(types[c], self.declared.get(c)) for c in self.columns), self.name, self.declared)

    def select(self) -> list[Column]:
        """The key as k1..kn, in the types that keys are compared in."""
        out = []
        for i, (c, kind) in enumerate(zip(self.columns, self.kinds, strict=True), 1):
            value = F.col(f"`{c}`")
            out.append({"bigint": value.cast("bigint"), "uuid": F.lower(value)}.get(kind, value).alias(f"k{i}"))
        return out

    def names(self) -> list[str]:
        return [f"k{i}" for i in range(1, len(self.columns) + 1)]


def assert_usable(df: DataFrame, key: Key) -> None:
    """No null and no repeated key, in one pass with partial aggregation."""
    keys = df.select(*key.select())
    if not keys.where(" or ".join(f"{k} is null" for k in key.names())).isEmpty():
        raise EngineError("22023", "a key column holds nulls")
    if not keys.groupBy(*key.names()).count().where("count > 1").isEmpty():
        raise EngineError("22023", "the key isn't unique")


def pack(key: Key) -> Column:
    """Four arrays aligned by position, one value not null in each position."""
    arrays = []
    for kind, name in _PACKED.items():
        kind_type = {"bigint": "bigint", "timestamptz": "timestamp"}.get(kind, "string")
        values = [F.col(n).cast(kind_type) if k == kind else F.lit(None).cast(kind_type) for n, k in zip(key.names(), key.kinds, strict=True)]
        arrays.append(F.array(*values).alias(name))
    return F.struct(*arrays)


def is_canonical(packed: str = "packed") -> Column:
    """Same length of 1 to 3 in all arrays and exactly one value in each position."""
    p = [f"{packed}.{name}" for name in _PACKED.values()]
    size = f"size({p[0]})"
    one = " + ".join(f"if({x}[i] is null, 0, 1)" for x in p)
    return F.expr(f"coalesce({size} between 1 and {MAX_COLUMNS} and {' and '.join(f'size({x}) = {size}' for x in p[1:])} and forall(sequence(0, {size} - 1), i -> {one} = 1), false)")


def unpack(kinds: tuple[str, ...], packed: str = "packed") -> Column:
    """The values as text in key order."""
    return F.array(*[F.col(f"{packed}.{_PACKED[kind]}")[i].cast("string") for i, kind in enumerate(kinds)])


def to_text(value) -> str:
    """The stored form of a boundary value."""
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    return str(value)


def parse(kind: str, value) -> object:
    """A stored or given boundary value, checked for its kind."""
    if value is None:
        raise EngineError("22023", "a boundary value is null")
    try:
        if kind == "bigint":
            found = int(value)
            if not -(2**63) <= found < 2**63:
                raise ValueError
            return found
        if kind == "timestamptz":
            return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))
        if kind == "uuid":
            return str(uuid.UUID(str(value)))
        return str(value)
    except ValueError:
        raise EngineError("22023", f"{value!r} is no {kind}") from None


def literal(kind: str, value, ntz: bool = False) -> str:
    """SQL for a boundary value."""
    value = parse(kind, value)
    if kind == "bigint":
        return f"{value}L" if value > -(2**63) else "(-9223372036854775807L - 1L)"
    if kind == "timestamptz":
        return f"{'TIMESTAMP_NTZ' if ntz else 'TIMESTAMP'} '{value.isoformat(sep=' ')}'"
    escaped = re.sub(r"(['\\])", r"\\\1", value)
    return f"'{escaped}'"


def compare_form(kind: str, value):
    """What orders boundary values as Spark does: text by bytes."""
    value = parse(kind, value)
    return value.encode() if isinstance(value, str) else value
