"""Leaves of a partitioned table and the comparison of a manifest with the live tree."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: What a null partition value is called in a leaf's bound.
NULL = "__null__"


def bound_values(bound: str) -> list[tuple[str, str | None]]:
    """(column, value) pairs of a leaf's bound."""
    parts = [p.split("=", 1) for p in bound.split("/")]
    return [(c, None if v == NULL else unquote(v)) for c, v in parts]


def _bound(columns: list[str]) -> Column:
    escaped = lambda c: F.regexp_replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), "^_", "%5F")
    return F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(escaped(c), F.lit(NULL))) for c in columns])


def enumerate_leaves(df: DataFrame, columns: list[str]) -> DataFrame:
    """leaf_ordinal from 1, leaf_bound (col=value/...) in byte order, n_rows; values have %, / and a leading _ as %25, %2F and %5F."""
    return _ordered(df.groupBy(_bound(columns).alias("leaf_bound")).agg(F.count("*").alias("n_rows")))


def leaf_files(df: DataFrame, columns: list[str]) -> DataFrame:
    """leaf_bound, file, size, modified and n_rows: the files that hold rows of each leaf."""
    file = [F.col(f"_metadata.{m}").alias(n) for m, n in (("file_path", "file"), ("file_size", "size"), ("file_modification_time", "modified"))]
    return df.groupBy(_bound(columns).alias("leaf_bound"), *file).agg(F.count("*").alias("n_rows"))


def manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    """enumerate_leaves with fingerprint: a digest of the names, lengths, modification times and row counts of a leaf's files."""
    file = F.concat_ws("|", "file", "size", F.unix_micros("modified"), "n_rows")
    return _ordered(leaf_files(df, columns).groupBy("leaf_bound").agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(file))), 256).alias("fingerprint")), "fingerprint")


def _ordered(found: DataFrame, *more: str) -> DataFrame:
    return found.withColumn("leaf_ordinal", F.row_number().over(Window.orderBy("leaf_bound"))).select("leaf_ordinal", "leaf_bound", "n_rows", *more)


def manifest_difference(live: DataFrame, stored: DataFrame, columns: list[str], on: str = "leaf_ordinal") -> DataFrame:
    """Leaves that differ: ordinal and change (added, dropped or changed)."""
    a, b = live.select(on, F.struct(*columns).alias("a")), stored.select(on, F.struct(*columns).alias("b"))
    both = a.join(b, on, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(on, F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "dropped").otherwise("changed").alias("change"))
