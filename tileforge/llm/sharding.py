"""Operator 9: a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of (key columns), the number is sent
through a keyed permutation of 0..n-1, and the image p says where the row
goes: shard p mod k, slot p div k. Shard counts differ by one at most (law
"rows"), slots are gapless, and any place can be computed from a row number
and back (`place`, `row_at`) without looking at the data.

The permutation is a Feistel network on pairs (L, R) with L in 0..a-1 and R
in 0..b-1, where a = ceil(sqrt(n)) and b = ceil(n / a). It permutes 0..ab-1;
cycle walking (apply again while the image is n or more) restricts it to
0..n-1. As ab - n < a, a walk of `_walks(n)` further steps always suffices for
small n and fails with a chance below 1e-30 for large n; a row that would need
more raises an error instead of landing in a wrong place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

ROUNDS = 4
#: Modulus and multipliers of the round function, small enough that products stay in 63 bits.
_P, _M1, _M2 = 2147483647, 48271, 1103515245


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _walks(n: int) -> int:
    a, b = _sides(n)
    return min(a * b - n, 48)


def _mix(x: int, key: int) -> int:
    y = (x % _P * _M1 + key) % _P
    y = (y ^ (y // 65536)) * _M2 % _P
    return (y ^ (y // 4096)) * _M1 % _P


def _keys(seed: int) -> list[int]:
    return [_mix(seed * 7919 + i, 12345 + i) for i in range(ROUNDS)]


def permute(x: int, n: int, seed: int) -> int:
    """The image of row number x: the same function as `permuted`, for one number on the driver."""
    (a, b), keys = _sides(n), _keys(seed)
    while True:
        left, right = x // b, x % b
        for i, key in enumerate(keys):
            if i % 2:
                right = (right + _mix(left, key)) % b
            else:
                left = (left + _mix(right, key)) % a
        x = left * b + right
        if x < n:
            return x


def unpermute(x: int, n: int, seed: int) -> int:
    """The row number whose image is x."""
    (a, b), keys = _sides(n), _keys(seed)
    while True:
        left, right = x // b, x % b
        for i, key in reversed(list(enumerate(keys))):
            if i % 2:
                right = (right - _mix(left, key)) % b
            else:
                left = (left - _mix(right, key)) % a
        x = left * b + right
        if x < n:
            return x


def place(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = permute(row, n, seed)
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that lies in a slot of a shard."""
    return unpermute(slot * shards + shard, n, seed)


def _mix_sql(x: str, key: int) -> str:
    y = f"((({x}) % {_P}L * {_M1}L + {key}L) % {_P}L)"
    for shift, factor in ((65536, _M2), (4096, _M1)):
        y = f"aggregate(array({y}), 0L, (z, v) -> (v ^ (v div {shift}L)) * {factor}L % {_P}L)"
    return y


def permuted(row: Column, n: int, seed: int) -> Column:
    """Column form of `permute`; whole in the JVM."""
    a, b = _sides(n)
    step = f"struct(x div {b}L as l, x % {b}L as r)"
    for i, key in enumerate(_keys(seed)):
        change = f"s.l as l, (s.r + {_mix_sql('s.l', key)}) % {b}L as r" if i % 2 else f"(s.l + {_mix_sql('s.r', key)}) % {a}L as l, s.r as r"
        step = f"transform(array({step}), s -> struct({change}))[0]"
    once = f"transform(array({step}), s -> s.l * {b}L + s.r)[0]"
    walked = F.expr(f"aggregate(sequence(0, {_walks(n)}), __row + 0L, (x, i) -> if(i > 0 and x < {n}L, x, {once}))")
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Adds global row numbers 0..n-1 in the given order, without one task seeing all rows.

    A range partitioning deals the rows into ordered pieces, which are written
    once; the pieces' sizes (one number each) give each piece its first row
    number, and rows are numbered within their piece.
    """
    spark = df.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(pieces, *[F.col(c).asc_nulls_first() for c in order]).withColumn("__piece", F.spark_partition_id())
    ranged = materialise(ranged)
    sizes = {r["__piece"]: r["n"] for r in ranged.groupBy("__piece").agg(F.count("*").alias("n")).collect()}
    first, n = {}, 0
    for piece in sorted(sizes):
        first[piece], n = n, n + sizes[piece]
    starts = spark.createDataFrame(list(first.items()), "__piece int, __first long")
    within = Window.partitionBy("__piece").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = ranged.withColumn("__n", F.row_number().over(within)).join(F.broadcast(starts), "__piece")
    return numbered.withColumn(name, F.col("__first") + F.col("__n") - 1).drop("__piece", "__first", "__n"), n


def shard(df: DataFrame, order: list[str], shards: int, seed: int = 20261) -> DataFrame:
    """df with columns shard (int) and slot (long).

    Null and repeated values in `order` are allowed: nulls come first, and rows
    that are equal in all of them are interchangeable. Columns of df called
    row_number, shard or slot are replaced. An empty df stays empty.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    numbered, n = number_rows(df.drop("row_number", "shard", "slot"), order, "__row")
    placed = numbered.withColumn("__p", permuted(F.col("__row"), n, seed) if n else F.lit(0).cast("long"))
    return placed.withColumn("shard", (F.col("__p") % shards).cast("int")).withColumn("slot", F.expr(f"__p div {shards}L")).drop("__row", "__p")


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard(rows, ["doc_id", "text_crc32", "size"], 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_sql(shards: int = 24, seed: int = 20261) -> str:
    """Row numbers by a window, then the permutation's rounds as steps of a recursive query that walks until it is below n."""
    state = "select row_no, k, n, a, b, x // b as l, x % b as r from walk where k = 0 or x >= n"
    for i, key in enumerate(_keys(seed)):
        source, change = ("l", "l, (r + m) % b as r") if i % 2 else ("r", "(l + m) % a as l, r")
        mixed = f"select *, ({source} % {_P} * {_M1} + {key}) % {_P} as y from ({state})"
        mixed = f"select *, xor(y, y // 65536) * {_M2} % {_P} as z from ({mixed})"
        mixed = f"select *, xor(z, z // 4096) * {_M1} % {_P} as m from ({mixed})"
        state = f"select row_no, k, n, a, b, {change} from ({mixed})"
    return f"""
with recursive crc_steps as (
    select i, 0 as k, i as c from (select unnest(range(256)) as i)
    union all select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from crc_steps where k < 8
), crc_table as (
    select list(c order by i) as t from crc_steps where k = 8
), bytes as (
    select doc_id, row_number() over () as id, strlen(coalesce(text, '')) + 8 as size, [('0x' || h)::bigint for h in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] as a from documents
), docs as (
    select doc_id, id, size, xor(list_reduce(list_prepend(4294967295::bigint, a), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) as text_crc32 from bytes, crc_table
), sides as (
    select n, a, greatest(1, (n + a - 1) // a) as b from (select n, greatest(1, floor(sqrt(greatest(n - 1, 0)))::bigint + 1) as a from (select count(*) as n from docs))
), numbered as (
    select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as row_no from docs
), walk as (
    select row_no, row_no as x, 0 as k, n, a, b from numbered, sides
    union all select row_no, l * b + r, k + 1, n, a, b from ({state})
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, (x % {shards})::int as shard, (x // {shards})::bigint as slot, null::int as grown_shard
from numbered join (select row_no, x from walk where k > 0 and x < n) using (row_no)
"""
