"""Chunk boundaries: every n-th key in key order, and the greatest key as terminal.

Row numbers come without one task sorting all rows: keys are dealt into ranges,
each range is sorted on its own, and the ranges' sizes give each its first
number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keys import Key


def _number(rows: DataFrame, names: list[str]) -> DataFrame:
    spark = rows.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(pieces, *names).sortWithinPartitions(*names)
    # The range edges are drawn from a sample, so sizes and numbers must come from one evaluation.
    ranged = ranged.withColumn("__piece", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % F.lit(1 << 33)).persist()
    sizes = {r["__piece"]: r["n"] for r in ranged.groupBy("__piece").agg(F.count("*").alias("n")).collect()}
    first, total = [], 0
    for piece in sorted(sizes):
        first.append((piece, total))
        total += sizes[piece]
    starts = spark.createDataFrame(first, "__piece int, __first long")
    return ranged.join(F.broadcast(starts), "__piece").select(*names, (F.col("__first") + F.col("__at")).alias("row_number"))


def number(df: DataFrame, key: Key) -> DataFrame:
    """k1..kn and row_number from 0, in key order."""
    return _number(df.select(*key.select()), key.names())


def starts(df: DataFrame, key: Key, chunk_size: int) -> DataFrame:
    """boundary_no and the key of each chunk's first row."""
    rows = number(df, key).where(F.col("row_number") % chunk_size == 0)
    return rows.select(F.expr(f"row_number div {chunk_size}").alias("boundary_no"), *key.names())


def terminal(df: DataFrame, key: Key) -> DataFrame:
    """The greatest key; no row for an empty table."""
    return df.select(*key.select()).orderBy(*[F.col(n).desc() for n in key.names()]).limit(1)


def boundaries(df: DataFrame, key: Key, chunk_size: int) -> DataFrame:
    """boundary_no 0..N with k1..kn; N is the terminal. Empty for an empty table."""
    first = starts(df, key, chunk_size).cache()
    top = terminal(df, key).crossJoin(first.agg((F.max("boundary_no") + 1).alias("boundary_no"))).select("boundary_no", *key.names())
    return first.unionByName(top)


def chunk_ranges(bounds: DataFrame, key: Key) -> DataFrame:
    """Each boundary with its successor: start (k*), end (e*), is_final; the terminal has no row."""
    order = Window.orderBy("boundary_no")
    ends = [F.lead(n).over(order).alias(f"e{n[1:]}") for n in key.names()]
    last = F.max("boundary_no").over(Window.partitionBy())
    return bounds.select("boundary_no", *key.names(), *ends, (F.col("boundary_no") == last - 1).alias("is_final"), last.alias("__last")).where("boundary_no < __last").drop("__last")


def chunk_counts(df: DataFrame, key: Key, chunk_size: int) -> DataFrame:
    """boundary_no and the number of rows of each chunk."""
    numbered = number(df, key).select(F.expr(f"row_number div {chunk_size}").alias("boundary_no"))
    return numbered.groupBy("boundary_no").agg(F.count("*").alias("n_rows"))


def leaf_boundaries(df: DataFrame, leaf: str, key: Key, chunk_size: int) -> DataFrame:
    """Partition-wise starts: leaf_ordinal by byte order of the leaf's value, boundary_no over all leaves, k1..kn.

    Numbered within each leaf; leaves follow one another, and one terminal, the
    greatest key of the last leaf, ends the run.
    """
    names = key.names()
    rows = _number(df.select(F.col(leaf).cast("string").alias("__leaf"), *key.select()), ["__leaf", *names])
    sizes = rows.groupBy("__leaf").agg(F.count("*").alias("c"), F.min("row_number").alias("__first"), F.max(F.struct(*names)).alias("top"))
    cut = rows.join(F.broadcast(sizes.select("__leaf", "__first")), "__leaf").withColumn("__n", F.col("row_number") - F.col("__first")).where(F.col("__n") % chunk_size == 0)
    order = Window.orderBy("__leaf")
    chunks = F.expr(f"(c + {chunk_size} - 1) div {chunk_size}")
    leaves = sizes.select("__leaf", "top", F.row_number().over(order).alias("leaf_ordinal"), (F.sum(chunks).over(order.rowsBetween(Window.unboundedPreceding, 0)) - chunks).alias("base"), chunks.alias("n_chunks"))
    first = cut.join(F.broadcast(leaves), "__leaf").select("leaf_ordinal", (F.col("base") + F.expr(f"__n div {chunk_size}")).cast("long").alias("boundary_no"), *names)
    last = leaves.orderBy(F.desc("leaf_ordinal")).limit(1).select("leaf_ordinal", (F.col("base") + F.col("n_chunks")).cast("long").alias("boundary_no"), *[F.col(f"top.{n}").alias(n) for n in names])
    return first.unionByName(last)
