"""Chunks by physical place: a block is a fixed span of row positions in a file.

Row positions need no column of the files; a run asks for them once and keeps
the files' sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_BLOCK = 128


def file_blocks(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """file, n_blocks and first_block of each file, in byte order of path."""
    rows = df.groupBy(F.col("_metadata.file_path").alias("file")).agg((F.max("_metadata.row_index") + 1).alias("n_rows"))  # reads no column; rows of a leaf may lie apart
    sized = rows.select("file", F.expr(f"(n_rows + {rows_per_block} - 1) div {rows_per_block}").alias("n_blocks"))
    order = Window.orderBy("file")
    return sized.withColumn("first_block", F.coalesce(F.sum("n_blocks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def block_boundaries(df: DataFrame, chunk_size: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """boundary_no and first block of each chunk of chunk_size blocks; the terminal is one past the end."""
    spark = df.sparkSession
    total = file_blocks(df, rows_per_block).agg(F.coalesce(F.sum("n_blocks"), F.lit(0)).alias("n")).first()["n"]
    if not total:
        return spark.createDataFrame([], "boundary_no long, block long")
    chunks = -(-total // chunk_size)
    return spark.range(chunks + 1).select(F.col("id").alias("boundary_no"), F.least(F.col("id") * chunk_size, F.lit(total)).alias("block"))


def block_rows(df: DataFrame, start: int, end: int, rows_per_block: int = ROWS_PER_BLOCK, files: list | None = None) -> DataFrame:
    """The rows of blocks [start, end); conditions on files and row positions reach the scan. files: rows of file_blocks, if known."""
    keep = F.lit(False)
    for f in file_blocks(df, rows_per_block).collect() if files is None else files:
        if f["first_block"] >= end or f["first_block"] + f["n_blocks"] <= start:
            continue
        low = max(start - f["first_block"], 0) * rows_per_block
        high = (end - f["first_block"]) * rows_per_block
        keep = keep | ((F.col("_metadata.file_path") == f["file"]) & (F.col("_metadata.row_index") >= low) & (F.col("_metadata.row_index") < high))
    return df.where(keep)


def block_of_row(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """df with the column block."""
    files = file_blocks(df, rows_per_block).withColumnRenamed("file", "__file")
    placed = df.withColumns({"__path": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    return placed.join(F.broadcast(files), F.col("__path") == F.col("__file")).withColumn("block", F.col("first_block") + F.expr(f"__row div {rows_per_block}")).drop("__path", "__row", "__file", "n_blocks", "first_block")
