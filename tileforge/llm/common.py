"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls 0x09 to 0x0D.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (tests, one machine), the session's checkpoint
    folder is used, or a temporary one that is then set as such.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tileforge-"))
        base = context._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/tileforge-{uuid.uuid4().hex}"


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    Cuts the lineage with files that survive lost executors; each step that
    is read more than once goes through here.
    """
    path = scratch_dir(df.sparkSession)
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text):
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tasks(df: DataFrame, per_task: int = 1) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * per_task)


def slices(batch, most: int, text: str = "text"):
    """An Arrow batch in slices of some `most` bytes of text, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    piece = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for at, until in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(at, until - at)


def bounded(batches, most: int, key: str = "key", text: str = "text"):
    """(keys, texts, bytes) of Arrow batches, some `most` bytes of text at a time; null texts are empty ones."""
    for batch in batches:
        for part in slices(batch, most, text):
            texts = [t.as_py() or "" for t in part.column(text)]
            yield part.column(key).to_pylist(), texts, sum(map(len, texts))


def lean(function):
    """function for mapInArrow; after it the worker, which Spark keeps for other stages, returns freed memory to the system."""

    def run(batches):
        yield from function(batches)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return run
