"""Status, progress and summary of runs as Spark queries over the control store's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status() -> Column:
    """The first that holds: archived, cancelled, completed, paused, calculating, active."""
    return (
        F.when(F.col("archived_at").isNotNull(), "archived")
        .when(F.col("cancelled_at").isNotNull(), "cancelled")
        .when(F.col("completed_at").isNotNull(), "completed")
        .when(F.col("paused_at").isNotNull(), "paused")
        .when(F.col("boundaries_calculated_at").isNull(), "calculating")
        .otherwise("active")
    )


def _ms(a: Column | str, b: Column | str) -> Column:
    """Milliseconds from a to b."""
    second = lambda x: (F.col(x) if isinstance(x, str) else x).cast("timestamp").cast("double")
    return F.round((second(b) - second(a)) * 1000).cast("bigint")


def progress(runs: DataFrame, now: Column | None = None) -> DataFrame:
    """One row for each run: status, percent, rates and estimates.

    Elapsed time runs from started_at to the run's end or now, and so includes
    pauses; estimates are given only while a run is active.
    """
    now = F.current_timestamp() if now is None else now
    end = F.coalesce("completed_at", "cancelled_at", "archived_at", now)
    total, done, rows = F.col("total_chunks"), F.col("total_chunks_completed"), F.col("total_rows_affected")
    out = runs.withColumn("status", status()).withColumn("elapsed_ms", _ms("started_at", end))
    calculated = F.col("boundaries_calculated_at").isNotNull()
    remaining = F.when(calculated, total - done)
    percent = F.when(calculated & (total == 0), F.lit(100.0)).when(calculated, F.round(100 * done / total, 2))
    per_second = lambda n: F.when((F.col("elapsed_ms") > 0) & (n > 0), F.round(n * 1000 / F.col("elapsed_ms"), 2))
    left = F.when(F.col("status") == "active", F.when(remaining == 0, F.lit(0)).when((done > 0) & (F.col("elapsed_ms") > 0), F.ceil(remaining * F.col("elapsed_ms") / done))).cast("bigint")
    return out.select(
        "run_id", "label", "chunk_by", "partition_wise", "status", "total_chunks", done.alias("completed_chunks"), remaining.alias("remaining_chunks"), percent.alias("percent_complete"),
        "total_rows_affected", "elapsed_ms", per_second(done).alias("chunks_per_second"), per_second(rows).alias("rows_per_second"), left.alias("estimated_remaining_ms"),
        F.when(left.isNotNull(), now + F.make_dt_interval(secs=(left / 1000).cast("decimal(18,6)"))).alias("estimated_completion_at"),
        "paused_at", "max_retries", "retry_backoff_ms", "started_at", "boundaries_calculated_at", "completed_at", "cancelled_at", "archived_at",
    )


def summary(runs: DataFrame, bounds: DataFrame, leaves: DataFrame, errors: DataFrame) -> DataFrame:
    """One row for each run with counts of its boundaries, leaves and errors."""
    b = bounds.groupBy("run_id").agg(F.count("*").alias("boundary_count"), F.count("completed_at").alias("completed_boundary_count"))
    e = errors.groupBy("run_id").agg(F.count("*").alias("error_count"))
    in_state = lambda s: F.count(F.when(F.col("state").isin(*s), 1))
    f = leaves.groupBy("run_id").agg(F.count("*").alias("leaf_count"), in_state(["calculated"]).alias("leaves_calculated"), in_state(["failed"]).alias("leaves_failed"), in_state(["pending", "calculating"]).alias("leaves_pending"))
    counts = ["boundary_count", "completed_boundary_count", "error_count", "leaf_count", "leaves_calculated", "leaves_failed", "leaves_pending"]
    out = runs.join(b, "run_id", "left").join(e, "run_id", "left").join(f, "run_id", "left").fillna(0, counts)
    columns = ["run_id", "label", "chunk_size", "chunk_by", "threads", "sleep_ms", "schema_name", "table_name", "fingerprint", "created_at", "started_at", "boundaries_calculated_at", "completed_at", "cancelled_at", "archived_at", "partition_wise", "total_chunks", "total_chunks_completed"]
    return out.select(*columns, *counts)


def boundary_report(bounds: DataFrame) -> DataFrame:
    return bounds.withColumn("duration_ms", F.when(F.col("completed_at").isNotNull(), _ms("started_at", "completed_at"))).select("boundary_no", "boundary_id", "leaf_ordinal", "rows_affected", "started_at", "completed_at", "cancelled_at", "duration_ms").orderBy("boundary_no")
