"""Queries over the test tables, one or more for each operator, and their SQL for DuckDB."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileforge.engine import Engine
from tileforge.operators import blocks, boundaries, inspection, keys, leaves, ranges
from tileforge.operators.keys import Key
from tileforge.sources.catalog import Table

#: Query name: table, key columns, chunk size.
_BOUNDARIES = {
    "boundaries_orders": ("orders", ("o_orderkey",), 100),
    "boundaries_orders_ordered_key": ("orders", ("o_orderdate", "o_orderkey"), 1000),
    "boundaries_orders_exact_multiple": ("orders", ("o_orderkey",), 500),
    "boundaries_customer_text_key": ("customer", ("c_name",), 70),
    "boundaries_pages_text_key": ("pages", ("url",), 7),
    "boundaries_events_timestamp_key": ("events", ("ts", "event_id"), 333),
    "boundaries_events_three_columns": ("events", ("event_type", "user_id", "event_id"), 777),
    "boundaries_conversations_composite": ("conversations", ("conv_id", "turn"), 10),
    "boundaries_nation_int_key_of_one": ("nation", ("n_nationkey",), 1),
    "boundaries_region_larger_than_table": ("region", ("r_regionkey",), 1000),
}
#: Query name: table, leaf column, key columns, chunk size.
_LEAVES = {
    "leaf_boundaries_events": ("events", "event_type", ("event_id",), 300),
    "leaf_boundaries_orders": ("orders", "o_orderstatus", ("o_orderkey",), 1000),
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(df: DataFrame, columns) -> Key:
    return Key(tuple(columns)).resolve(df.schema)


def _boundaries(table: str, columns, size: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _read(spark, sf_dir, table)
        return boundaries.boundaries(df, _key(df, columns), size)

    return query


def _leaf_boundaries(table: str, leaf: str, columns, size: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _read(spark, sf_dir, table)
        return boundaries.leaf_boundaries(df, leaf, _key(df, columns), size)

    return query


def chunk_ranges_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "conversations")
    key = _key(df, ("conv_id", "turn"))
    return boundaries.chunk_ranges(boundaries.boundaries(df, key, 25), key)


def chunk_counts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "orders")
    return boundaries.chunk_counts(df, _key(df, ("o_orderdate", "o_orderkey")), 1000)


def range_filter_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicographic range as boxes."""
    df = _read(spark, sf_dir, "conversations")
    return df.where(ranges.condition(_key(df, ("conv_id", "turn")), ["7", "1"], ["41", "2"], False)).select("conv_id", "turn", "role")


def range_filter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of two kinds, the last chunk's inclusive end."""
    df = _read(spark, sf_dir, "events")
    key = _key(df, ("event_type", "user_id", "event_id"))
    return df.where(ranges.condition(key, ["click", "3", "0"], ["login", "40", "500"], True)).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def block_boundaries_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_boundaries(_read(spark, sf_dir, "orders"), 10, 64)


def block_rows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in each chunk of blocks, by row positions."""
    placed = blocks.block_of_row(_read(spark, sf_dir, "orders"), 64)
    return placed.groupBy(F.expr("block div 10").alias("chunk")).agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


def leaf_manifest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves.enumerate_leaves(_read(spark, sf_dir, "events"), ["event_type"])


def manifest_difference_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of orders against a manifest without those of status O, with one more, and one changed."""
    live = leaves.enumerate_leaves(_read(spark, sf_dir, "orders"), ["o_orderstatus"])
    stored = live.withColumn("n_rows", F.when(F.col("leaf_ordinal") == 1, F.col("n_rows") + 1).otherwise(F.col("n_rows"))).where("leaf_bound <> 'o_orderstatus=O'")
    more = spark.createDataFrame([(99, "o_orderstatus=Z", 1)], "leaf_ordinal int, leaf_bound string, n_rows long")
    return leaves.manifest_difference(live, stored.unionByName(more), ["leaf_bound", "n_rows"])


def packed_keys_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "customer")
    key = _key(df, ("c_mktsegment", "c_custkey"))
    packed = df.select(*key.select()).select(keys.pack(key).alias("packed"))
    return packed.select(keys.unpack(key.kinds).alias("v"), keys.is_canonical().alias("canonical")).select(F.col("v")[0].alias("v1"), F.col("v")[1].alias("v2"), "canonical")


def next_chunk_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest boundary that is neither done (every third) nor in flight (1, 2, 4)."""
    df = _read(spark, sf_dir, "orders")
    key = _key(df, ("o_orderkey",))
    pending = boundaries.chunk_ranges(boundaries.boundaries(df, key, 100), key).where("boundary_no % 3 <> 0 and boundary_no not in (1, 2, 4)")
    return pending.orderBy("boundary_no").limit(1)


# ---- whole runs


def _engine(spark: SparkSession) -> Engine:
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tileforge-")
    return Engine(spark, f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}")


def _orders(spark: SparkSession, sf_dir: str) -> tuple[Engine, int]:
    """An engine that knows orders, and a chunk size that makes 12 chunks at any scale."""
    engine = _engine(spark)
    table = engine.register_table(Table("tpch", "orders", f"{sf_dir}/orders.parquet", Key(("o_orderkey",)), {"by_date": Key(("o_orderdate", "o_orderkey"))}, ("o_orderstatus",)))
    return engine, max(1, -(-table.read(spark).count() // 12))


def run_select_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one job for each chunk, four at a time; rows of each chunk."""
    engine, size = _orders(spark, sf_dir)
    engine.run_migration_chunks("select t.o_orderkey, upper(t.o_orderpriority) as priority from <driving_table> where <chunking_clause>", "tpch", "orders", "select", size, 4)
    return engine.output("select").groupBy(F.col("chunk").cast("long").alias("chunk"), "priority").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


def run_select_ordered_key_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, size = _orders(spark, sf_dir)
    engine.run_migration_chunks("select t.o_orderkey, t.o_orderdate from <driving_table> where <chunking_clause>", "tpch", "orders", "fused", size, 2, chunk_by="ordered_key", boundary_key_index="by_date", fuse=6)
    return engine.output("fused").groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


def run_insert_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT ... SELECT with a join and an aggregate inside each chunk; the rows are read from the target."""
    engine, size = _orders(spark, sf_dir)
    path = f"{engine.work_dir}-totals"
    spark.createDataFrame([], "segment string, n long, most double").write.parquet(path)
    engine.register_table(Table("tpch", "totals", path))
    text = f"insert into totals select c.c_mktsegment as segment, count(*) as n, max(t.o_totalprice) as most from <driving_table> join parquet.`{sf_dir}/customer.parquet` c on c.c_custkey = t.o_custkey where <chunking_clause> group by c.c_mktsegment"
    engine.run_migration_chunks(text, "tpch", "orders", "insert", size, 4)
    own = F.regexp_extract(F.col("_metadata.file_name"), "^[0-9a-f]+-([0-9]+)-", 1).cast("long")
    return spark.read.parquet(path).select(own.alias("chunk"), "segment", "n", "most")


_COPY = "select t.o_orderkey, t.o_totalprice from <driving_table> where <chunking_clause>"


def _totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


def run_two_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two threads run one label; every chunk is done once."""
    engine, size = _orders(spark, sf_dir)
    with ThreadPoolExecutor(2) as pool:
        for call in [pool.submit(engine.run_migration_chunks, _COPY, "tpch", "orders", "both", size, 2) for _ in range(2)]:
            call.result()
    return _totals(engine.output("both"))


def run_paused_and_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that a failing chunk stops, is paused, mended by the set_ controls, resumed and ends; its errors are counted."""
    engine, size = _orders(spark, sf_dir)
    bad = _COPY.replace("t.o_totalprice from", "if(t.o_orderkey >= 0, raise_error('planted'), t.o_totalprice) as o_totalprice from")
    with contextlib.suppress(Exception):
        engine.run_migration_chunks(bad, "tpch", "orders", "mended", size, 1, max_retries=0)
    engine.pause_migration_run("mended")
    engine.run_migration_chunks(bad, "tpch", "orders", "mended")  # only says that it is paused
    engine.set_migration_run_sql_text("mended", _COPY)
    engine.set_migration_run_threads("mended", 4)
    engine.set_migration_run_sleep_ms("mended", 1)
    engine.set_migration_run_retries("mended", 2, 10)
    engine.resume_migration_run("mended")
    engine.run_migration_chunks(_COPY, "tpch", "orders", "mended")
    errors = engine.migration_errors(engine._latest("mended")["run_id"]).agg(F.count("*").alias("n_errors"))
    return _totals(engine.output("mended")).crossJoin(errors)  # of one row each


def run_cancelled_and_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of a run that is paused before it begins, cancelled, archived and deleted, and of its label's next run."""
    engine, size = _orders(spark, sf_dir)
    with contextlib.suppress(Exception):
        engine.run_migration_chunks(_COPY.replace("t.o_totalprice from", "raise_error('planted') as x from"), "tpch", "orders", "label", size, 1, max_retries=0)
    first = engine.cancel_migration_run("label")
    engine.archive_migration_run("label")
    deleted = engine.delete_archived_migration_runs("label")
    engine.run_migration_chunks(_COPY, "tpch", "orders", "label", size, 4)
    left = engine.migration_run_summary("label")
    return left.select(F.lit(deleted).cast("long").alias("n_deleted"), (F.col("run_id") > first).alias("is_new"), "total_chunks", "completed_boundary_count")


def run_leaves_by_ordered_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, size = _orders(spark, sf_dir)
    engine.run_migration_chunks("select t.o_orderkey, t.o_orderstatus from <driving_table> where <chunking_clause>", "tpch", "orders", "leaves", size, 4, chunk_by="ordered_key", boundary_key_index="by_date", partition_wise=True)
    return engine.output("leaves").groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


def run_leaves_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _orders(spark, sf_dir)
    engine.run_migration_chunks("select t.o_orderkey, t.o_orderstatus from <driving_table> where <chunking_clause>", "tpch", "orders", "leaves", 500, 4, chunk_by="blocks", partition_wise=True)
    return engine.output("leaves").groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


def explain_function_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of a function run, of one of its chunks and of a stored chunk."""
    engine, size = _orders(spark, sf_dir)
    engine.register_function("tpch", "seen", lambda key: None)
    whole = engine.explain_function_over_table("tpch", "orders", "tpch", "seen", size)
    one = engine.explain_function_over_table_chunk("tpch", "orders", "tpch", "seen", [1], [100], False)
    engine.run_migration_chunks(_COPY, "tpch", "orders", "stored", size, 4)
    stored = engine.explain_migration_run_chunk(engine._latest("stored")["run_id"], 0)
    return whole.union(one).union(stored).groupBy("o_plan_kind").agg(F.count("*").alias("n"))


def run_update_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, size = _orders(spark, sf_dir)
    engine.run_migration_chunks("update <driving_table> set o_orderpriority = lower(t.o_orderpriority), o_totalprice = 0 where <chunking_clause> and t.o_orderstatus = 'F'", "tpch", "orders", "update", size, 4)
    return engine.table_version("update").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))


def run_delete_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, size = _orders(spark, sf_dir)
    engine.run_migration_chunks("delete from <driving_table> where <chunking_clause> and t.o_totalprice > 250000", "tpch", "orders", "delete", size, 4)
    return engine.table_version("delete").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


def run_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, size = _orders(spark, sf_dir)
    engine.run_migration_chunks("select t.o_orderkey from <driving_table> where <chunking_clause>", "tpch", "orders", "blocks", -(-size // blocks.ROWS_PER_BLOCK), 4, chunk_by="blocks")
    return engine.output("blocks").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


def run_partition_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries and rows of a run, leaf by leaf."""
    engine, size = _orders(spark, sf_dir)
    engine.run_migration_chunks("select t.o_orderkey from <driving_table> where <chunking_clause>", "tpch", "orders", "leaves", size, 4, partition_wise=True)
    run = engine.store.one("select run_id from run")["run_id"]
    return engine.migration_boundaries(run).select("boundary_no", F.get_json_object("boundary_id", "$[0]").cast("long").alias("k1"), "leaf_ordinal", "rows_affected")


def run_function_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each row that passes a filter; rows affected by chunk."""
    engine, size = _orders(spark, sf_dir)
    engine.register_function("f", "check", lambda orderkey: int(orderkey))
    engine.run_function_over_table("tpch", "orders", "f", "check", size, 4, "function", "o_orderstatus = 'P'")
    run = engine.store.one("select run_id from run")["run_id"]
    return engine.migration_boundaries(run).where("rows_affected is not null").select("boundary_no", "rows_affected")


def run_summary_and_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inspection says of a finished run, without clock columns."""
    engine, size = _orders(spark, sf_dir)
    engine.run_migration_chunks("select t.o_orderkey from <driving_table> where <chunking_clause>", "tpch", "orders", "inspect", size, 4)
    run = engine.store.one("select run_id from run")["run_id"]
    s, p = engine.migration_run_summary("inspect"), engine.migration_run_progress(run)
    return s.join(p.select("run_id", "status", "percent_complete", "remaining_chunks", "total_rows_affected"), "run_id").select("run_id", "label", "chunk_by", "total_chunks", "boundary_count", "completed_boundary_count", "error_count", "leaf_count", "status", "percent_complete", "remaining_chunks", "total_rows_affected")


def explain_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of a template's chunks; whether the key range is pushed to the scan."""
    engine, size = _orders(spark, sf_dir)
    plans = engine.explain_migration_chunks("select t.o_orderkey from <driving_table> where <chunking_clause>", "tpch", "orders", size)
    return plans.select("o_plan_kind", F.col("o_plan").rlike(r"PushedFilters: \[[^\]]*GreaterThanOrEqual").alias("pushed"))


def progress_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and rates of planted runs in each state."""
    stamp = "timestamp '2024-01-01 00:00:{:02d}'"
    at = lambda s: stamp.format(s) if s is not None else "cast(null as timestamp)"
    rows = [(1, 10, 5, 100, 0, None, None, None, None), (2, 10, 5, 100, 0, 20, None, None, None), (3, 10, 10, 200, 0, None, 40, None, None), (4, 10, 5, 100, 0, None, None, 30, None), (5, 10, 5, 100, 0, None, None, 30, 35), (6, 0, 0, 0, 0, None, None, None, None)]
    values = ", ".join(f"({i}L, {t}L, {d}L, {n}L, {at(s)}, {at(p)}, {at(c)}, {at(x)}, {at(a)})" for i, t, d, n, s, p, c, x, a in rows)
    runs = spark.sql(f"select *, 'l' as label, 'primary_key' as chunk_by, false as partition_wise, 3 as max_retries, 1000 as retry_backoff_ms, started_at as boundaries_calculated_at from values {values} as v(run_id, total_chunks, total_chunks_completed, total_rows_affected, started_at, paused_at, completed_at, cancelled_at, archived_at)")
    found = inspection.progress(runs, F.expr(at(50)))
    return found.select("run_id", "status", "percent_complete", "remaining_chunks", "elapsed_ms", "chunks_per_second", "rows_per_second", "estimated_remaining_ms")


_PLAIN = [
    chunk_ranges_conversations, chunk_counts_orders, range_filter_conversations, range_filter_events, block_boundaries_orders, block_rows_orders, leaf_manifest_events, manifest_difference_planted, packed_keys_customer, next_chunk_planted,
    run_two_callers, run_paused_and_resumed, run_cancelled_and_archived, run_leaves_by_ordered_key, run_leaves_by_blocks, explain_function_kinds,
    run_select_orders, run_select_ordered_key_fused, run_insert_join, run_update_orders, run_delete_orders, run_by_blocks, run_partition_wise, run_function_rows, run_summary_and_progress, explain_kinds, progress_planted,
]


def queries() -> dict:
    out = {name: _boundaries(*x) for name, x in _BOUNDARIES.items()} | {name: _leaf_boundaries(*x) for name, x in _LEAVES.items()}
    return out | {f.__name__: f for f in _PLAIN}


# ---- SQL


def _sql_boundaries(table: str, columns, size: int) -> str:
    """Text keys are compared by bytes, as DuckDB does too."""
    order = ", ".join(columns)
    ks = ", ".join(f"{c} as k{i}" for i, c in enumerate(columns, 1))
    kind = {"n_nationkey": "::bigint", "r_regionkey": "::bigint"}.get(columns[0], "")
    ks = ks.replace(columns[0], columns[0] + kind) if kind else ks
    desc = ", ".join(f"{c} desc" for c in columns)
    return f"""with n as (select *, row_number() over (order by {order}) - 1 as rn from {table})
select (rn // {size})::bigint as boundary_no, {ks} from n where rn % {size} = 0
union all select * from (select ((select max(rn) from n) // {size} + 1)::bigint as boundary_no, {ks} from n order by {desc} limit 1)"""


def _sql_leaves(table: str, leaf: str, columns, size: int) -> str:
    (c,) = columns
    return f"""with n as (select {leaf} as leaf, {c} as k1, row_number() over (partition by {leaf} order by {c}) - 1 as rn from {table}),
l as (select leaf, (max(rn) + {size}) // {size} as c, max(k1) as top, row_number() over (order by leaf)::int as leaf_ordinal from n group by leaf),
b as (select *, coalesce(sum(c) over (order by leaf rows between unbounded preceding and 1 preceding), 0) as base from l)
select leaf_ordinal, (base + rn // {size})::bigint as boundary_no, k1 from n join b using (leaf) where rn % {size} = 0
union all select * from (select leaf_ordinal, (base + c)::bigint, top from b order by leaf_ordinal desc limit 1)"""


_CHUNKED = "with s as (select (count(*) + 11) // 12 as size from orders), n as (select o.*, ((row_number() over (order by {}) - 1) // s.size)::bigint as chunk from orders o, s)"

_SQL = {
    "chunk_ranges_conversations": f"""with b as ({_sql_boundaries("conversations", ("conv_id", "turn"), 25)}), r as (select *, lead(k1) over (order by boundary_no) as e1, lead(k2) over (order by boundary_no) as e2, max(boundary_no) over () as m from b)
select boundary_no, k1, k2, e1, e2, boundary_no = m - 1 as is_final from r where boundary_no < m""",
    "chunk_counts_orders": "select (rn // 1000)::bigint as boundary_no, count(*) as n_rows from (select row_number() over (order by o_orderdate, o_orderkey) - 1 as rn from orders) group by 1",
    "range_filter_conversations": "select conv_id, turn, role from conversations where (conv_id > 7 or (conv_id = 7 and turn >= 1)) and (conv_id < 41 or (conv_id = 41 and turn < 2))",
    "range_filter_events": "select event_type, count(*) as n, min(event_id) as first_id from events where (event_type > 'click' or (event_type = 'click' and (user_id > 3 or (user_id = 3 and event_id >= 0)))) and (event_type < 'login' or (event_type = 'login' and (user_id < 40 or (user_id = 40 and event_id <= 500)))) group by 1",
    "block_boundaries_orders": "with t as (select (count(*) + 63) // 64 as n from orders) select i::bigint as boundary_no, least(i * 10, n)::bigint as block from t, unnest(range(0, (n + 9) // 10 + 1)) u(i)",
    "block_rows_orders": "select (rn // 640)::bigint as chunk, count(*) as n_rows, sum(o_orderkey)::bigint as key_sum from (select o_orderkey, row_number() over () - 1 as rn from orders) group by 1",
    "leaf_manifest_events": "select row_number() over (order by 'event_type=' || event_type)::int as leaf_ordinal, 'event_type=' || event_type as leaf_bound, count(*) as n_rows from events group by event_type",
    "manifest_difference_planted": "with l as (select row_number() over (order by o_orderstatus)::int as leaf_ordinal, o_orderstatus as s from orders group by o_orderstatus) select leaf_ordinal, 'added' as change from l where s = 'O' union all select leaf_ordinal, 'changed' from l where leaf_ordinal = 1 and s <> 'O' union all select 99, 'dropped'",
    "packed_keys_customer": "select c_mktsegment as v1, c_custkey::varchar as v2, true as canonical from customer",
    "next_chunk_planted": f"""with b as ({_sql_boundaries("orders", ("o_orderkey",), 100)}), r as (select *, lead(k1) over (order by boundary_no) as e1, max(boundary_no) over () as m from b)
select boundary_no, k1, e1, boundary_no = m - 1 as is_final from r where boundary_no < m and boundary_no % 3 <> 0 and boundary_no not in (1, 2, 4) order by boundary_no limit 1""",
    "run_select_orders": _CHUNKED.format("o_orderkey") + " select chunk, upper(o_orderpriority) as priority, count(*) as n_rows, sum(o_orderkey)::bigint as key_sum from n group by all",
    "run_select_ordered_key_fused": _CHUNKED.format("o_orderdate, o_orderkey") + " select chunk, count(*) as n_rows, sum(o_orderkey)::bigint as key_sum from n group by all",
    "run_insert_join": _CHUNKED.format("o_orderkey") + " select chunk, c_mktsegment as segment, count(*) as n, max(o_totalprice) as most from n join customer on c_custkey = o_custkey group by all",
    "run_two_callers": "select count(*) as n_rows, sum(o_orderkey)::bigint as key_sum from orders",
    "run_paused_and_resumed": "select count(*) as n_rows, sum(o_orderkey)::bigint as key_sum, 1::bigint as n_errors from orders",
    "run_cancelled_and_archived": "with s as (select count(*) as n, (count(*) + 11) // 12 as size from orders) select 1::bigint as n_deleted, true as is_new, ((n + size - 1) // size)::bigint as total_chunks, ((n + size - 1) // size)::bigint as completed_boundary_count from s",
    "run_leaves_by_ordered_key": "select o_orderstatus, count(*) as n_rows, sum(o_orderkey)::bigint as key_sum from orders group by all",
    "run_leaves_by_blocks": "select o_orderstatus, count(*) as n_rows, sum(o_orderkey)::bigint as key_sum from orders group by all",
    "explain_function_kinds": "select * from (values ('boundary_population', 1::bigint), ('chunk_non_final', 3::bigint), ('chunk_final', 1::bigint)) v(o_plan_kind, n)",
    "run_update_orders": "select o_orderstatus, case when o_orderstatus = 'F' then lower(o_orderpriority) else o_orderpriority end as o_orderpriority, count(*) as n, max(case when o_orderstatus = 'F' then 0 else o_totalprice end)::double as most from orders group by all",
    "run_delete_orders": "select o_orderstatus, count(*) as n, sum(o_orderkey)::bigint as key_sum from orders where not coalesce(o_totalprice > 250000, false) group by all",
    "run_by_blocks": "select count(*) as n_rows, sum(o_orderkey)::bigint as key_sum from orders",
    "run_partition_wise": """with s as (select (count(*) + 11) // 12 as size from orders), n as (select o_orderstatus as leaf, o_orderkey as k1, row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as rn from orders),
c as (select leaf, rn // size as i, min(k1) as k1, count(*) as rows_affected, max(k1) as top from n, s group by all), l as (select leaf, row_number() over (order by leaf) as leaf_ordinal from (select distinct leaf from n)),
b as (select (row_number() over (order by leaf_ordinal, i) - 1)::bigint as boundary_no, k1, leaf_ordinal::bigint as leaf_ordinal, rows_affected, top from c join l using (leaf))
select boundary_no, k1, leaf_ordinal, rows_affected from b union all select * from (select boundary_no + 1, top, leaf_ordinal, null from b order by boundary_no desc limit 1)""",
    "run_function_rows": _CHUNKED.format("o_orderkey") + " select chunk as boundary_no, count(*) filter (o_orderstatus = 'P') as rows_affected from n group by all",
    "run_summary_and_progress": "with s as (select count(*) as n, (count(*) + 11) // 12 as size from orders), c as (select n, ((n + size - 1) // size)::bigint as chunks from s) select 1::bigint as run_id, 'inspect' as label, 'primary_key' as chunk_by, chunks as total_chunks, chunks + 1 as boundary_count, chunks as completed_boundary_count, 0::bigint as error_count, 0::bigint as leaf_count, 'completed' as status, 100.0::double as percent_complete, 0::bigint as remaining_chunks, n as total_rows_affected from c",
    "explain_kinds": "select * from (values ('boundary_population', false), ('chunk_non_final', true), ('chunk_final', true)) v(o_plan_kind, pushed)",
    "progress_planted": """select run_id::bigint as run_id, status, percent::double as percent_complete, remaining::bigint as remaining_chunks, elapsed::bigint as elapsed_ms, cps::double as chunks_per_second, rps::double as rows_per_second, eta::bigint as estimated_remaining_ms from (values
(1, 'active', 50, 5, 50000, 0.1, 2, 50000), (2, 'paused', 50, 5, 50000, 0.1, 2, null), (3, 'completed', 100, 0, 40000, 0.25, 5, null), (4, 'cancelled', 50, 5, 30000, 0.17, 3.33, null), (5, 'archived', 50, 5, 30000, 0.17, 3.33, null), (6, 'active', 100, 0, 50000, null, null, 0)) v(run_id, status, percent, remaining, elapsed, cps, rps, eta)""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _sql_boundaries(*x) for name, x in _BOUNDARIES.items()} | {name: _sql_leaves(*x) for name, x in _LEAVES.items()} | _SQL
