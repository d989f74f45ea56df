"""The engine: cuts a registered table into chunks and runs a template or function on each as a Spark job.

Data live in Parquet, run state in a `Store`. A chunk's attempt writes to a
folder of its own; the folder is renamed to chunk=<number> in one step, and
then the boundary is completed. A chunk folder without a completed boundary
(the driver stopped in between) is adopted when the label runs again. UPDATE
and DELETE write the chunk's new rows beside the table; `table_version` is the
table with these in place of what they cover.

Chunk code may run more than once (retries, lost executors), so functions with
side effects must be idempotent. Access rights, grants and row policies are
the file system's affair, not the engine's. Template text is run as it is.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import inspect
import json
import os
import re
import threading
import time
import uuid
import warnings
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tileforge.errors import EngineError, TransientChunkError
from tileforge.functions import checks
from tileforge.operators import blocks, boundaries, inspection, keys, leaves, ranges
from tileforge.plans import templates
from tileforge.sources.catalog import Catalog, Table, assert_plain, file_system, fingerprint
from tileforge.sources.store import Store, now

STRATEGIES = ("primary_key", "ordered_key", "blocks")
POLL_S = 0.1
#: Threads beyond this many times the default parallelism only queue.
THREADS_PER_CORE = 4
#: A caller that gave no sign for so long is taken to have ended, and its claims are free.
LEASE_S = 60.0
#: Operators of a plan under which a fused chunk would not be the chunks one by one.
_NOT_ROW_WISE = re.compile(r"^[\s:+|-]*(Aggregate|Window|Sort|GlobalLimit|LocalLimit|Distinct|Deduplicate|Except|Intersect|Sample|Offset)\b", re.M)


def is_transient(error: BaseException) -> bool:
    """What is worth a retry: the chunk's own wish, and a locked store."""
    return isinstance(error, TransientChunkError) or "database is locked" in str(error)


def _store_path(work_dir: str) -> str:
    path = re.sub("^file:/+", "/", work_dir)
    if "://" in path:
        warnings.warn("runs are forgotten when the driver ends: give a store", stacklevel=3)
        return ":memory:"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return f"{path}.runs.sqlite"


class Engine:
    """work_dir holds chunk outputs; on a cluster it must be in a store that all executors reach.

    The control store is the file <work_dir>.runs.sqlite, unless another is
    given; where work_dir isn't a local path one must be, to outlast the driver.
    """

    def __init__(self, spark: SparkSession, work_dir: str, store: Store | None = None, transient: Callable[[BaseException], bool] = is_transient):
        self.spark, self.work_dir, self.transient = spark, work_dir.rstrip("/"), transient
        self.store = store or Store(_store_path(self.work_dir))
        self.catalog = Catalog(spark)
        self._functions: dict[str, Callable] = {}
        self._views: dict[int, str] = {}
        self._files: dict[tuple, list] = {}
        self._calculating = threading.Lock()

    # ---- registration

    def register_table(self, table: Table) -> Table:
        return self.catalog.register(table)

    def register_function(self, schema_name: str, name: str, function: Callable) -> None:
        """A function of the primary key's columns, called once for each row on the executors."""
        self._functions[f"{schema_name}.{name}"] = function

    # ---- runs

    def run_migration_chunks(
        self, sql_text: str, driving_table_schema_name: str, driving_table_name: str, label: str, chunk_size: int = 1000, threads: int = 1, driving_table_alias: str = "t", chunk_by: str = "primary_key",
        poll_timeout_ms: int = 1, sleep_ms: int = 0, boundary_key_index: str | None = None, partition_wise: bool = False, max_retries: int = 3, retry_backoff_ms: int = 1000, fuse: int = 1,
    ) -> None:
        """Runs the template once for each chunk; returns when the run is complete or paused.

        A label that has an unfinished run resumes it with its stored inputs; a
        completed label does nothing. The first failure stops the launch of
        chunks, lets those in flight finish, and is raised. fuse > 1 runs so
        many consecutive chunks of a row-wise template as one job and completes
        them together.
        """
        checks.positive("fuse", fuse)
        checks.positive("poll_timeout_ms", poll_timeout_ms)
        run = self._resolve(templates.assert_template(sql_text), driving_table_schema_name, driving_table_name, label, chunk_size, threads, driving_table_alias, chunk_by, sleep_ms, boundary_key_index, partition_wise, max_retries, retry_backoff_ms)
        if run["completed_at"]:
            return
        if run["cancelled_at"]:
            raise EngineError("55000", f"the run of {label} is cancelled", "archive it to use the label again")
        if run["paused_at"]:
            warnings.warn(f"the run of {label} is paused", stacklevel=2)
            return
        self.store.write("update run set started_at = coalesce(started_at, ?) where run_id = ?", now(), run["run_id"])
        self._views.pop(run["run_id"], None)  # files may have been replaced by equal ones since
        if run["boundaries_calculated_at"] is None and not self._calculate(run["run_id"]):
            return
        self._schedule(run["run_id"], fuse)

    def run_function_over_table(
        self, driving_table_schema_name: str, driving_table_name: str, function_schema_name: str, function_name: str, chunk_size: int = 1000, threads: int = 1, label: str | None = None, filter: str | None = None, chunk_by: str = "primary_key",
        poll_timeout_ms: int = 1, sleep_ms: int = 0, boundary_key_index: str | None = None, partition_wise: bool = False, max_retries: int = 3, retry_backoff_ms: int = 1000,
    ) -> None:
        """Calls a registered function for each row that passes filter; rows_affected counts the rows."""
        template = self._function_template(driving_table_schema_name, driving_table_name, function_schema_name, function_name, filter)
        label = label or json.dumps(["function", driving_table_schema_name, driving_table_name, function_schema_name, function_name, hashlib.sha256(filter.encode()).hexdigest() if filter else None, chunk_by, boundary_key_index, partition_wise])
        self.run_migration_chunks(template, driving_table_schema_name, driving_table_name, label, chunk_size, threads, "t", chunk_by, poll_timeout_ms, sleep_ms, boundary_key_index, partition_wise, max_retries, retry_backoff_ms)

    def _function_template(self, schema: str, table: str, function_schema: str, function: str, filter: str | None) -> str:
        found = self._functions.get(f"{function_schema}.{function}")
        if found is None:
            raise EngineError("42704", f"no function {function_schema}.{function}")
        key = self.catalog.key(self.catalog.get(schema, table), "primary_key", None)
        if len(inspect.signature(found).parameters) != len(key.columns):
            raise EngineError("22023", "the function must take the key's columns in order")
        columns = ", ".join(f"`t`.`{c}`" for c in key.columns)
        return f"select {columns}, '{function_schema}.{function}' as __function from {templates.TABLE} where {templates.CLAUSE}" + (f" and ({checks.text('filter', filter)})" if filter is not None else "")

    def _assert_threads(self, threads: int) -> int:
        if checks.positive("threads", threads) > (most := self.spark.sparkContext.defaultParallelism * THREADS_PER_CORE):
            raise EngineError("22023", f"threads must be at most {most}")
        return threads

    def _resolve(self, sql_text, schema_name, table_name, label, chunk_size, threads, alias, chunk_by, sleep_ms, ordered_key, partition_wise, max_retries, backoff) -> dict:
        checks.text("label", label)
        wanted = {"sql_text": sql_text, "schema_name": checks.text("schema", schema_name), "table_name": checks.text("table", table_name), "alias": checks.text("alias", alias), "chunk_by": chunk_by, "chunk_size": checks.positive("chunk_size", chunk_size), "threads": self._assert_threads(threads), "sleep_ms": checks.non_negative("sleep_ms", sleep_ms), "max_retries": checks.non_negative("max_retries", max_retries), "retry_backoff_ms": checks.non_negative("retry_backoff_ms", backoff), "partition_wise": int(checks.boolean("partition_wise", partition_wise)), "ordered_key": ordered_key}
        if chunk_by not in STRATEGIES:
            raise EngineError("22023", f"chunk_by is one of {', '.join(STRATEGIES)}")
        if run := self.store.active(label):
            for name, value in wanted.items():
                if run[name] != value:
                    warnings.warn(f"{name} differs; the run keeps {run[name]!r}", stacklevel=3)
            if not (run["completed_at"] or run["cancelled_at"]):
                self._assert_unchanged(run)
            return run
        table = self.catalog.get(schema_name, table_name)
        key = self.catalog.key(table, chunk_by, ordered_key)
        if key is None:
            assert_plain(self.spark, table)
        if partition_wise and not table.partition_columns:
            raise EngineError("42809", f"{table_name} isn't partitioned")
        statement = templates.parse(sql_text, table.read(self.spark).columns, alias)
        templates.render(statement.query, "x", alias, "true")
        self._target(statement, table)
        if key:
            keys.assert_usable(table.read(self.spark), key)
        try:
            run_id = self.store.create_run(label=label, **wanted, key_columns=list(key.columns) if key else None, key_kinds=list(key.kinds) if key else None, fingerprint=fingerprint(self.spark, table.path))
        except EngineError as error:
            if error.code != "23505":
                raise
            return self.store.active(label)  # another caller was first
        if partition_wise:
            found = leaves.manifest(table.read(self.spark), list(table.partition_columns)).collect()
            for leaf in found:
                self.store.write("insert into leaf (run_id, leaf_ordinal, leaf_bound, fingerprint, created_at) values (?, ?, ?, ?, ?)", run_id, leaf["leaf_ordinal"], leaf["leaf_bound"], leaf["fingerprint"], now())
        return self._run(run_id)

    def _target(self, statement: templates.Statement, source: Table) -> Table | None:
        """The registered table that an INSERT fills; a name without a schema is in the driving table's."""
        if statement.kind != "insert":
            return None
        schema, _, name = statement.target.rpartition(".")
        target = self.catalog.get(schema or source.schema_name, name)
        if target.path.rstrip("/") == source.path.rstrip("/") or target.partition_columns:
            raise EngineError("0A000", "rows go into another table than the driving one, without partition columns")
        if unknown := [c for c in statement.columns if c not in target.schema.names]:
            raise EngineError("42703", f"no column {unknown[0]} in {name}")
        return target

    def _fitted(self, df: DataFrame, statement: templates.Statement, target: Table) -> DataFrame:
        """df in the columns of the target, by position; columns that aren't named are null."""
        names = statement.columns or tuple(target.schema.names)
        if len(names) != len(df.columns):
            raise EngineError("42601", f"{len(df.columns)} columns for {len(names)} of {target.name}")
        renamed = df.toDF(*[f"__{n}" for n in names])
        return renamed.select(*[(F.col(f"`__{f.name}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields])

    def _insert(self, run: dict, number: int, out: str, target: Table) -> None:
        """Moves a published chunk's files into the target; what an earlier attempt moved stays, as names are the chunk's own."""
        fs, folder = file_system(self.spark, out)
        into, _ = file_system(self.spark, target.path)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("part-"):
                to = path(f"{target.path.rstrip('/')}/{run['uid']}-{number}-{name}")
                if not into.exists(to) and not fs.rename(status.getPath(), to):
                    raise EngineError("55000", f"chunk {number} can't be put into {target.name}")

    def _inserted(self, run: dict, target: Table) -> DataFrame:
        """What the completed chunks of a run put into the target, with the column chunk."""
        rows = target.read(self.spark).withColumn("chunk", F.regexp_extract(F.col("_metadata.file_name"), f"^{run['uid']}-([0-9]+)-", 1)).where("chunk <> ''")
        done = self.spark.createDataFrame([(r["boundary_no"],) for r in self.store.rows("select boundary_no from boundary where run_id = ? and completed_at is not null", run["run_id"])], "chunk int")
        return rows.withColumn("chunk", F.col("chunk").cast("int")).join(F.broadcast(done), "chunk", "left_semi")

    def _run(self, run_id: int) -> dict:
        if not (run := self.store.one("select * from run where run_id = ?", run_id)):
            raise EngineError("P0002", f"no run {run_id}")
        return run

    def _table(self, run: dict) -> Table:
        return self.catalog.get(run["schema_name"], run["table_name"])

    def _key(self, run: dict) -> keys.Key | None:
        return keys.Key(tuple(json.loads(run["key_columns"])), tuple(json.loads(run["key_kinds"]))) if run["key_columns"] else None

    def _assert_unchanged(self, run: dict) -> None:
        """The table's files and key are those that the run began with."""
        table = self._table(run)
        live, stored = self.catalog.key(table, run["chunk_by"], run["ordered_key"]), self._key(run)
        if stored and (live.columns, live.kinds) != (stored.columns, stored.kinds):
            raise EngineError("55000", "the key has changed since the run began")
        if fingerprint(self.spark, table.path) != run["fingerprint"]:
            if run["partition_wise"]:
                self._assert_tree(run, table)  # says which leaf it is
            raise EngineError("55000" if run["partition_wise"] else "22023", "the table's files have changed since the run began")

    # ---- boundaries

    def _leaf_filter(self, table: Table, bound: str):
        out = F.lit(True)
        for column, value in leaves.bound_values(bound):
            out = out & (F.col(column).isNull() if value is None else F.col(column).cast("string") == value)
        return out

    def _calculate(self, run_id: int) -> bool:
        """All boundaries of a run; false if it was paused or cancelled between leaves."""
        with self._calculating:
            run = self._run(run_id)
            if run["boundaries_calculated_at"] is not None:
                return True  # another caller was first
            table, key = self._table(run), self._key(run)
            source = table.read(self.spark)
            if not run["partition_wise"]:
                self.store.add_boundaries(run_id, [(n, k, None) for n, k in self._starts(source, key, run["chunk_size"])])
                return True
            self._assert_tree(run, table)
            if not self._calculate_leaves(run, table, key):
                return False
            self._assert_tree(run, table)
            self.store.finish_leaves(run_id)
            return True

    def _calculate_leaves(self, run: dict, table: Table, key) -> bool:
        """Up to `threads` leaves at a time, beside other callers; false if the run was paused or cancelled before the last."""
        flight: set[Future] = set()
        run_id, error, owner, beaten = run["run_id"], None, uuid.uuid4().hex, 0.0
        self.store.reopen_leaves(run_id)
        with ThreadPoolExecutor(self.spark.sparkContext.defaultParallelism * THREADS_PER_CORE) as pool:
            while True:
                if time.time() - beaten > LEASE_S / 6:
                    beaten = time.time()
                    self.store.beat(owner)
                run = self._run(run_id)
                stopped = error is not None or run["paused_at"] or run["cancelled_at"]
                while not stopped and len(flight) < run["threads"] and (leaf := self.store.claim_leaf(run_id, owner, LEASE_S)):
                    flight.add(pool.submit(inheritable_thread_target(self.spark)(self._calculate_leaf), run, table, key, leaf, owner))
                if not flight:
                    if stopped or not self.store.open_leaves(run_id):
                        break
                    time.sleep(POLL_S)  # leaves that another caller calculates
                    continue
                done = wait(flight, timeout=POLL_S, return_when=FIRST_COMPLETED).done
                flight -= done
                error = next((f.exception() for f in done if f.exception()), error)
        self.store.end_lease(owner)
        if error is not None:
            raise error
        return not stopped or not self.store.open_leaves(run_id)

    def _calculate_leaf(self, run: dict, table: Table, key, leaf: dict, owner: str) -> None:
        try:
            source = table.read(self.spark).where(self._leaf_filter(table, leaf["leaf_bound"]))
            self._assert_leaf(table, leaf, source, key)
            found = self._starts(source, key, run["chunk_size"])
            self.store.add_leaf(run["run_id"], leaf["leaf_ordinal"], [k for _, k in found])
        except Exception as error:
            self.store.fail_leaf(run["run_id"], leaf["leaf_ordinal"], owner, getattr(error, "code", "XX000"), str(error)[:2000])
            raise

    def _assert_leaf(self, table: Table, leaf: dict, source: DataFrame, key) -> None:
        """The leaf's files are those of the manifest, and each has the key's columns in their kinds."""
        columns = list(table.partition_columns)
        live = leaves.manifest(source, columns).first()
        if live is None or live["fingerprint"] != leaf["fingerprint"]:
            raise EngineError("55000", f"leaf {leaf['leaf_bound']} isn't as the manifest has it")
        if key is None:
            return
        files = [r["file"] for r in leaves.leaf_files(source, columns).collect()]
        own = {f.name: f.dataType for f in self.spark.read.option("mergeSchema", "true").parquet(*files).schema}  # Spark reads the footers as a job
        for column, kind in zip(key.columns, key.kinds, strict=True):
            if column in own and keys.kind_of(own[column], "uuid" if kind == "uuid" else None) == kind or column not in own and column in columns:
                continue
            raise EngineError("0A000", f"leaf {leaf['leaf_bound']} has no matching key column {column}")

    def _starts(self, source: DataFrame, key, chunk_size: int) -> list[tuple[int, list[str]]]:
        """Boundary numbers and keys as text: one for each chunk, and the terminal."""
        if key is None:
            return [(r["boundary_no"], [str(r["block"])]) for r in blocks.block_boundaries(source, chunk_size).orderBy("boundary_no").collect()]
        found = boundaries.boundaries(source, key, chunk_size).orderBy("boundary_no").collect()
        return [(r["boundary_no"], [keys.to_text(r[n]) for n in key.names()]) for r in found]

    def _assert_tree(self, run: dict, table: Table) -> None:
        """Live leaves are those of the manifest."""
        live = {(r["leaf_ordinal"], r["leaf_bound"], r["fingerprint"]) for r in leaves.manifest(table.read(self.spark), list(table.partition_columns)).collect()}
        stored = {(r["leaf_ordinal"], r["leaf_bound"], r["fingerprint"]) for r in self.store.rows("select leaf_ordinal, leaf_bound, fingerprint from leaf where run_id = ?", run["run_id"])}
        if difference := sorted(live ^ stored):
            raise EngineError("55000", f"leaf {difference[0][1]} isn't as the manifest has it")

    # ---- chunks

    def _chunk(self, run: dict, chunk: dict) -> tuple[str, str | None]:
        """SQL condition of a chunk, and for blocks the view that holds its rows."""
        table, key = self._table(run), self._key(run)
        start, end = json.loads(chunk["start_id"]), json.loads(chunk["end_id"])
        final = bool(chunk["is_final"])
        if key is None:
            view = f"tf_{uuid.uuid4().hex}"
            source = table.read(self.spark)
            if chunk["leaf_ordinal"] is not None:
                source = source.where(self._leaf_filter(table, self._leaf(run, chunk)["leaf_bound"]))
            if chunk["leaf_ordinal"] != chunk["end_leaf"]:
                end = json.loads(chunk["terminal_boundary_id"])
            known = (run["run_id"], chunk["leaf_ordinal"])
            if known not in self._files:
                self._files[known] = blocks.file_blocks(source).collect()
            blocks.block_rows(source, int(start[0]), int(end[0]), files=self._files[known]).createOrReplaceTempView(view)
            return "true", view
        if chunk["leaf_ordinal"] is not None and (final or chunk["leaf_ordinal"] != chunk["end_leaf"]):
            end, final = json.loads(chunk["terminal_boundary_id"]), True
        types = {f.name: f.dataType.typeName() for f in table.read(self.spark).schema}
        ntz = any(types[c] == "timestamp_ntz" for c in key.columns)
        condition = ranges.condition(key, start, end, final, run["alias"], ntz)
        if chunk["leaf_ordinal"] is not None:
            bound = self._leaf(run, chunk)["leaf_bound"]
            own = [f"`{run['alias']}`.`{c}` is null" if v is None else f"cast(`{run['alias']}`.`{c}` as string) = {keys.literal('text', v)}" for c, v in leaves.bound_values(bound)]
            condition = " AND ".join([*own, condition])
        return condition, None

    def _leaf(self, run: dict, chunk: dict) -> dict:
        return self.store.one("select * from leaf where run_id = ? and leaf_ordinal = ?", run["run_id"], chunk["leaf_ordinal"])

    def _view(self, run: dict) -> str:
        """A view of the run's table, made once, so that chunks don't list and read its files' footers anew."""
        if run["run_id"] not in self._views:
            name = f"tileforge_{run['run_id']}_{uuid.uuid4().hex[:8]}"
            self._table(run).read(self.spark).createOrReplaceTempView(name)
            self._views[run["run_id"]] = name
        return self._views[run["run_id"]]

    def _query(self, run: dict, chunk: dict) -> tuple[templates.Statement, str]:
        """The statement and its SQL text for a chunk."""
        table = self._table(run)
        statement = templates.parse(run["sql_text"], table.read(self.spark).columns, run["alias"])
        condition, view = self._chunk(run, chunk)
        return statement, templates.render(statement.query, view or self._view(run), run["alias"], condition)

    def output_path(self, run: dict) -> str:
        """Its name is the run's own, so that no run takes another's chunks for its."""
        return f"{self.work_dir}/run={run['uid']}"

    def _process(self, run_id: int, chunk: dict, group: str) -> int:
        """One attempt: claim, run, publish, complete. Returns rows affected."""
        run, number = self._run(run_id), chunk["boundary_no"]
        self.store.claim(run_id, number, group)
        try:
            self.spark.sparkContext.setJobGroup(group, f"{run['label']} chunk {number}", interruptOnCancel=True)
            out, attempt = f"{self.output_path(run)}/chunk={number}", f"{self.output_path(run)}/_attempt={number}-{uuid.uuid4().hex}"
            fs, target = file_system(self.spark, out)
            source = self._table(run)
            statement = templates.parse(run["sql_text"], source.read(self.spark).columns, run["alias"])
            into = self._target(statement, source)
            if fs.exists(target):  # published by a driver that stopped before it could complete the chunk
                if into:
                    self._insert(run, number, out, into)
                    prefix = f"{run['uid']}-{number}-"
                    rows = into.read(self.spark).where(F.col("_metadata.file_name").startswith(prefix)).count()
                else:
                    written = self.spark.read.parquet(out)
                    rows = written.where("__hit").count() if "__hit" in written.columns else written.count()
            else:
                _, sql = self._query(run, chunk)
                df = self.spark.sql(sql)
                if "__function" in df.columns:
                    df = self._called(df)
                if into:
                    df = self._fitted(df, statement, into)
                seen = Observation()
                df.observe(seen, F.count(F.when(F.col("__hit"), 1) if "__hit" in df.columns else F.lit(1)).alias("n")).write.parquet(attempt)
                _, made = file_system(self.spark, attempt)
                if not fs.rename(made, target):
                    raise EngineError("55000", f"chunk {number} can't be published")
                rows = seen.get["n"]
                if into:
                    self._insert(run, number, out, into)
            self.store.complete(run_id, number, group, rows)
            return rows
        except BaseException:
            self.store.release(run_id, number)
            raise

    def _called(self, df: DataFrame) -> DataFrame:
        """Calls the function for each row, in the executors; the keys of the rows are the output."""
        functions, columns = dict(self._functions), [c for c in df.columns if c != "__function"]

        def call(frames):
            for frame in frames:
                for row in frame.itertuples(index=False):
                    functions[row[-1]](*row[:-1])
                yield frame[columns]

        return df.mapInPandas(call, df.select(*columns).schema)

    def _process_fused(self, run_id: int, chunks: list[dict], group: str) -> int:
        """Consecutive chunks of a row-wise template as one job, published together."""
        run, total = self._run(run_id), 0
        parts = []
        for chunk in chunks:
            self.store.claim(run_id, chunk["boundary_no"], group)
        try:
            self.spark.sparkContext.setJobGroup(group, f"{run['label']} chunks {chunks[0]['boundary_no']} to {chunks[-1]['boundary_no']}", interruptOnCancel=True)
            table = self._table(run)
            statement = templates.parse(run["sql_text"], table.read(self.spark).columns, run["alias"])
            plan = self.spark.sql(templates.render(statement.query, self._view(run), run["alias"], "true"))._jdf.queryExecution().analyzed().toString()
            if statement.kind == "insert" or _NOT_ROW_WISE.search(plan):
                raise EngineError("0A000", "only templates that work row by row, and don't insert, can be fused")
            conditions = [self._chunk(run, c)[0] for c in chunks]
            whole = {**chunks[0], "end_id": chunks[-1]["end_id"], "is_final": chunks[-1]["is_final"]}
            number = "case " + " ".join(f"when {c} then {k['boundary_no']}" for c, k in zip(conditions, chunks, strict=True)) + " end"
            sql = templates.render(re.sub(r"(?i)^\s*select\s", lambda m: f"{m.group()}{number} as __chunk, ", statement.query, count=1), self._view(run), run["alias"], self._chunk(run, whole)[0])
            attempt = f"{self.output_path(run)}/_attempt={chunks[0]['boundary_no']}-{uuid.uuid4().hex}"
            self.spark.sql(sql).write.partitionBy("__chunk").parquet(attempt)
            fs, _ = file_system(self.spark, attempt)
            names = self.spark.sql(sql).drop("__chunk").schema
            for chunk in chunks:
                out = f"{self.output_path(run)}/chunk={chunk['boundary_no']}"
                _, source = file_system(self.spark, f"{attempt}/__chunk={chunk['boundary_no']}")
                _, target = file_system(self.spark, out)
                if fs.exists(source):
                    if not fs.exists(target) and not fs.rename(source, target):
                        raise EngineError("55000", f"chunk {chunk['boundary_no']} can't be published")
                elif not fs.exists(target):
                    self.spark.createDataFrame([], names).write.parquet(out)
                parts.append(out)
            root = self.output_path(run)
            written = self.spark.read.option("basePath", root).parquet(*parts)
            written = written.where("__hit") if "__hit" in written.columns else written
            counts = {r["chunk"]: r["n"] for r in written.groupBy("chunk").agg(F.count("*").alias("n")).collect()}
            for chunk in chunks:
                rows = counts.get(chunk["boundary_no"], 0)
                self.store.complete(run_id, chunk["boundary_no"], group, rows)
                total += rows
            return total
        except BaseException:
            for chunk in chunks:
                self.store.release(run_id, chunk["boundary_no"])
            raise

    def _schedule(self, run_id: int, fuse: int) -> None:
        """Keeps up to `threads` chunks in flight until none is left, the run is stopped, or one fails."""
        flight: dict[Future, tuple[list[dict], str]] = {}
        attempts: dict[int, int] = {}
        error, wait_until = None, 0.0
        run = self._run(run_id)
        if run["key_columns"] is None or run["partition_wise"]:
            fuse = 1
        owner, beaten = uuid.uuid4().hex, 0.0
        self.store.beat(owner)
        self.store.expire(run_id, LEASE_S)  # chunks that another driver left claimed when it stopped
        with ThreadPoolExecutor(self.spark.sparkContext.defaultParallelism * THREADS_PER_CORE) as pool:
            while True:
                if time.time() - beaten > LEASE_S / 6:
                    beaten = time.time()
                    self.store.beat(owner)
                    self.store.expire(run_id, LEASE_S)
                run = self._run(run_id)
                stopped = error is not None or run["paused_at"] or run["cancelled_at"]
                if run["cancelled_at"]:
                    for _, group in flight.values():
                        self.spark.sparkContext.cancelJobGroup(group)
                while not stopped and len(flight) < run["threads"] and time.time() >= wait_until:
                    busy = {c["boundary_no"] for chunks, _ in flight.values() for c in chunks}
                    chunks: list[dict] = []
                    while len(chunks) < fuse and (chunk := self.store.next_chunk(run_id, busy)):
                        if chunks and chunk["boundary_no"] != chunks[-1]["boundary_no"] + 1:
                            break
                        chunks.append(chunk)
                        busy.add(chunk["boundary_no"])
                    if not chunks:
                        break
                    group = f"{owner}/tileforge-{run_id}-{chunks[0]['boundary_no']}-{uuid.uuid4().hex[:8]}"
                    work = inheritable_thread_target(self.spark)(self._process) if len(chunks) == 1 else inheritable_thread_target(self.spark)(self._process_fused)
                    flight[pool.submit(work, run_id, chunks[0] if len(chunks) == 1 else chunks, group)] = (chunks, group)
                if not flight:
                    if stopped or (time.time() >= wait_until and not self.store.held(run_id) and self.store.next_chunk(run_id, set()) is None):
                        break
                    time.sleep(POLL_S)  # a pause that was asked for, or another caller's chunks
                    continue
                for future in wait(flight, timeout=POLL_S, return_when=FIRST_COMPLETED).done:
                    chunks, _ = flight.pop(future)
                    number, failure = chunks[0]["boundary_no"], future.exception()
                    if failure is None:
                        wait_until = max(wait_until, time.time() + run["sleep_ms"] / 1000)
                    elif getattr(failure, "code", "") == "P0C01" or run["cancelled_at"]:
                        pass
                    elif self._retryable(failure) and attempts.get(number, 0) < run["max_retries"]:
                        attempts[number] = attempts.get(number, 0) + 1
                        wait_until = max(wait_until, time.time() + run["retry_backoff_ms"] / 1000)
                    else:
                        self.store.record_error(run_id, number, getattr(failure, "code", "XX000"), str(failure)[:4000])
                        error = error or failure
        self.store.end_lease(owner)
        run = self._run(run_id)
        if run["cancelled_at"]:
            self.store.mark_cancelled(run_id)
            raise EngineError("55000", f"the run of {run['label']} was cancelled")
        if error is not None:
            raise error
        if not self.store.complete_run(run_id) and not self._run(run_id)["paused_at"] and not self._run(run_id)["completed_at"]:
            raise EngineError("55000", "chunks are left that another caller holds")

    def _retryable(self, failure: BaseException) -> bool:
        return self.transient(failure) or "TransientChunkError" in str(failure)

    # ---- results

    def output(self, label_or_id: str | int) -> DataFrame:
        """What the completed chunks of a run wrote, with the column chunk."""
        run = self._run(label_or_id) if isinstance(label_or_id, int) else self._latest(label_or_id)
        done = [r["boundary_no"] for r in self.store.rows("select boundary_no from boundary where run_id = ? and completed_at is not null", run["run_id"])]
        root = self.output_path(run)
        if not done:
            raise EngineError("55000", "no chunk is complete")
        table = self._table(run)
        if into := self._target(templates.parse(run["sql_text"], table.read(self.spark).columns, run["alias"]), table):
            return self._inserted(run, into)
        return self.spark.read.option("basePath", root).parquet(*[f"{root}/chunk={n}" for n in done])

    def table_version(self, label: str) -> DataFrame:
        """The driving table as an UPDATE or DELETE run left it; rows outside completed chunks are as they were."""
        run = self._latest(label)
        table = self._table(run)
        base = table.read(self.spark)
        statement = templates.parse(run["sql_text"], base.columns, run["alias"])
        if statement.kind not in ("update", "delete"):
            raise EngineError("0A000", "only UPDATE and DELETE make a new version")
        if not self.store.one("select 1 from boundary where run_id = ? and completed_at is not null", run["run_id"]):
            return base
        new = self.output(run["run_id"])
        new = new.where("not __hit") if statement.kind == "delete" else new
        key = self._key(run)
        if key is None:
            raise EngineError("0A000", "versions of runs by blocks are only their output")
        covered = [f"({self._chunk(run, c)[0]})" for c in self._covered(run)]
        return base.alias(run["alias"]).where(f"not coalesce({' or '.join(covered)}, false)").unionByName(new.select(*base.columns))

    def _covered(self, run: dict) -> list[dict]:
        """Completed chunks, neighbours of one leaf joined into one range."""
        rows = self.store.rows(
            """select b.boundary_no, b.boundary_id as start_id, e.boundary_id as end_id, b.leaf_ordinal, e.leaf_ordinal as end_leaf, e.boundary_no = (select max(boundary_no) from boundary where run_id = b.run_id) as is_final, f.terminal_boundary_id
            from boundary b join boundary e on e.run_id = b.run_id and e.boundary_no = b.boundary_no + 1 left join leaf f on f.run_id = b.run_id and f.leaf_ordinal = b.leaf_ordinal
            where b.run_id = ? and b.completed_at is not null order by b.boundary_no""", run["run_id"])  # fmt: skip
        out: list[dict] = []
        for r in rows:
            if out and out[-1]["boundary_no"] + out[-1]["n"] == r["boundary_no"] and out[-1]["leaf_ordinal"] == r["leaf_ordinal"]:
                out[-1] |= {"end_id": r["end_id"], "end_leaf": r["end_leaf"], "is_final": r["is_final"], "n": out[-1]["n"] + 1}
            else:
                out.append(r | {"n": 1})
        return out

    def _latest(self, label: str) -> dict:
        run = self.store.one("select * from run where label = ? order by archived_at is null desc, run_id desc limit 1", label)
        if not run:
            raise EngineError("P0002", f"no run of {label}")
        return run

    # ---- controls

    def _active_id(self, label: str, unfinished: bool = False) -> int | None:
        run = self.store.active(checks.text("label", label))
        return run["run_id"] if run and not (unfinished and (run["completed_at"] or run["cancelled_at"])) else None

    def pause_migration_run(self, label: str) -> int | None:
        if run_id := self._active_id(label, True):
            self.store.write("update run set paused_at = coalesce(paused_at, ?), updated_at = ? where run_id = ?", now(), now(), run_id)
        return run_id

    def resume_migration_run(self, label: str) -> int | None:
        """Clears the pause; run_migration_chunks with the label goes on."""
        if run_id := self._active_id(label, True):
            self.store.write("update run set paused_at = null, updated_at = ? where run_id = ?", now(), run_id)
        return run_id

    def cancel_migration_run(self, label: str) -> int | None:
        if run_id := self._active_id(label, True):
            self.store.cancel_run(run_id)
        return run_id

    def archive_migration_run(self, label: str) -> int | None:
        if run_id := self._active_id(label):
            self.store.cancel_run(run_id)
            self.store.write("update run set archived_at = ?, updated_at = ? where run_id = ? and archived_at is null", now(), now(), run_id)
        return run_id

    def delete_archived_migration_runs(self, label: str | None = None, limit: int = 1000) -> int:
        return self.store.delete_archived(label, checks.positive("limit", limit))

    def _set(self, label: str, **values) -> None:
        run_id = self._active_id(label, True)
        if run_id is None:
            raise EngineError("P0002", f"no unfinished run of {label}")
        self.store.write(f"update run set {', '.join(f'{k} = ?' for k in values)}, updated_at = ? where run_id = ?", *values.values(), now(), run_id)

    def set_migration_run_sql_text(self, label: str, sql_text: str) -> None:
        self._set(label, sql_text=templates.assert_template(sql_text))

    def set_migration_run_function(self, label: str, function_schema_name: str, function_name: str, filter: str | None = None) -> None:
        run = self._latest(label)
        if run["alias"] != "t":
            raise EngineError("0A000", "a function template needs the alias t")
        self._set(label, sql_text=self._function_template(run["schema_name"], run["table_name"], function_schema_name, function_name, filter))

    def set_migration_run_threads(self, label: str, threads: int) -> None:
        self._set(label, threads=self._assert_threads(threads))

    def set_migration_run_sleep_ms(self, label: str, sleep_ms: int) -> None:
        self._set(label, sleep_ms=checks.non_negative("sleep_ms", sleep_ms))

    def set_migration_run_retries(self, label: str, max_retries: int, retry_backoff_ms: int) -> None:
        self._set(label, max_retries=checks.non_negative("max_retries", max_retries), retry_backoff_ms=checks.non_negative("retry_backoff_ms", retry_backoff_ms))

    # ---- inspection

    def migration_run_summary(self, label: str) -> DataFrame:
        frames = [self.store.frame(self.spark, n) for n in ("boundary", "leaf", "error")]
        return inspection.summary(self.store.frame(self.spark, "run", "label = ?", label), *frames)

    def migration_run_progress(self, run_id: int, at: dt.datetime | None = None) -> DataFrame:
        return inspection.progress(self.store.frame(self.spark, "run", "run_id = ?", run_id), F.lit(at) if at else None)

    def migration_boundaries(self, run_id: int) -> DataFrame:
        return inspection.boundary_report(self.store.frame(self.spark, "boundary", "run_id = ?", run_id))

    def migration_run_leaves(self, run_id: int) -> DataFrame:
        return self.store.frame(self.spark, "leaf", "run_id = ?", run_id).orderBy("leaf_ordinal")

    def migration_errors(self, run_id: int) -> DataFrame:
        return self.store.frame(self.spark, "error", "run_id = ?", run_id).select("error_id", "boundary_no", "sqlstate", "message", "created_at").orderBy("error_id")

    # ---- explain: nothing is run or written

    def _plan(self, kind: str, sql: str, leaf: dict | None = None) -> tuple:
        plan = "\n".join(r[0] for r in self.spark.sql(f"EXPLAIN FORMATTED {sql}").collect())
        return (kind, sql, plan, None, leaf["leaf_bound"] if leaf else None, leaf["leaf_ordinal"] if leaf else None)

    def _plans(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, "o_plan_kind string, o_sql_text string, o_plan string, o_leaf_schema_name string, o_leaf_name string, o_leaf_ordinal int")

    #: Sample keys of each kind for the first and last chunk of an explained template.
    _SAMPLES = {"bigint": ("1", "1000"), "text": ("a", "b"), "uuid": ("00000000-0000-0000-0000-000000000001", "00000000-0000-0000-0000-000000001000"), "timestamptz": ("2000-01-01 00:00:00", "2000-01-02 00:00:00")}

    def explain_migration_chunks(self, sql_text, driving_table_schema_name, driving_table_name, chunk_size=1000, driving_table_alias="t", chunk_by="primary_key", boundary_key_index=None, partition_wise=False, leaf_ordinal=None) -> DataFrame:
        """Plans of the boundary query and of a chunk that isn't and one that is the last."""
        checks.positive("chunk_size", chunk_size)
        table = self.catalog.get(driving_table_schema_name, driving_table_name)
        key = self.catalog.key(table, chunk_by, boundary_key_index)
        leaf, source = self._explained_leaf(table, partition_wise, leaf_ordinal)
        statement = templates.parse(sql_text, table.read(self.spark).columns, driving_table_alias)
        if key is None:
            population = f"SELECT _metadata.file_path, max(_metadata.row_index) FROM {source} GROUP BY 1"
            condition = lambda final: f"_metadata.row_index >= 0 AND _metadata.row_index < {chunk_size * blocks.ROWS_PER_BLOCK}"
        else:
            columns = ", ".join(f"`{c}`" for c in key.columns)
            population = f"SELECT * FROM (SELECT {columns}, row_number() OVER (ORDER BY {columns}) AS rn FROM {source}) WHERE (rn - 1) % {chunk_size} = 0"
            condition = lambda final: ranges.condition(key, [self._SAMPLES[k][0] for k in key.kinds], [self._SAMPLES[k][1] for k in key.kinds], final, driving_table_alias)
        chunk = lambda final: templates.render(statement.query, source, driving_table_alias, condition(final))
        return self._plans([self._plan("boundary_population", population, leaf), self._plan("chunk_non_final", chunk(False), leaf), self._plan("chunk_final", chunk(True), leaf)])

    def _explained_leaf(self, table: Table, partition_wise: bool, ordinal: int | None) -> tuple[dict | None, str]:
        source = f"parquet.`{table.path}`"
        if not partition_wise:
            if ordinal is not None:
                raise EngineError("22023", "a leaf is named for partition-wise runs only")
            return None, source
        found = leaves.enumerate_leaves(table.read(self.spark), list(table.partition_columns)).orderBy("leaf_ordinal").collect()
        leaf = next((r.asDict() for r in found if ordinal in (None, r["leaf_ordinal"])), None)
        if leaf is None:
            raise EngineError("22023", "no such leaf")
        parts = leaves.bound_values(leaf["leaf_bound"])
        return leaf, f"(SELECT * FROM {source} WHERE " + " AND ".join(f"`{c}` is null" if v is None else f"cast(`{c}` as string) = {keys.literal('text', v)}" for c, v in parts) + ")"

    def explain_migration_chunk(self, sql_text, driving_table_schema_name, driving_table_name, start_values, end_values, is_final, driving_table_alias="t", chunk_by="primary_key", boundary_key_index=None, partition_wise=False, leaf_ordinal=None) -> DataFrame:
        table = self.catalog.get(driving_table_schema_name, driving_table_name)
        key = self.catalog.key(table, chunk_by, boundary_key_index)
        if key is None:
            raise EngineError("0A000", "a chunk of blocks has no key values")
        leaf, source = self._explained_leaf(table, partition_wise, leaf_ordinal)
        statement = templates.parse(sql_text, table.read(self.spark).columns, driving_table_alias)
        condition = ranges.condition(key, start_values, end_values, checks.boolean("is_final", is_final), driving_table_alias)
        return self._plans([self._plan("chunk_final" if is_final else "chunk_non_final", templates.render(statement.query, source, driving_table_alias, condition), leaf)])

    def explain_migration_run_chunk(self, run_id: int, boundary_no: int) -> DataFrame:
        """The plan of a stored chunk, as the runner renders it."""
        run = self._run(checks.non_negative("run_id", run_id))
        chunk = self.store.one(
            """select b.boundary_no, b.boundary_id as start_id, e.boundary_id as end_id, b.leaf_ordinal, e.leaf_ordinal as end_leaf, e.boundary_no = (select max(boundary_no) from boundary where run_id = b.run_id) as is_final, f.terminal_boundary_id
            from boundary b join boundary e on e.run_id = b.run_id and e.boundary_no = b.boundary_no + 1 left join leaf f on f.run_id = b.run_id and f.leaf_ordinal = b.leaf_ordinal where b.run_id = ? and b.boundary_no = ?""", run_id, checks.non_negative("boundary_no", boundary_no))  # fmt: skip
        if chunk is None:
            raise EngineError("22023", f"boundary {boundary_no} starts no chunk")
        if run["partition_wise"]:
            self._assert_tree(run, self._table(run))
        _, sql = self._query(run, chunk)
        return self._plans([self._plan("chunk_final" if chunk["is_final"] else "chunk_non_final", sql, self._leaf(run, chunk) if run["partition_wise"] else None)])

    def explain_function_over_table(self, driving_table_schema_name, driving_table_name, function_schema_name, function_name, chunk_size=1000, filter=None, chunk_by="primary_key", boundary_key_index=None, partition_wise=False, leaf_ordinal=None) -> DataFrame:
        template = self._function_template(driving_table_schema_name, driving_table_name, function_schema_name, function_name, filter)
        return self.explain_migration_chunks(template, driving_table_schema_name, driving_table_name, chunk_size, "t", chunk_by, boundary_key_index, partition_wise, leaf_ordinal)

    def explain_function_over_table_chunk(self, driving_table_schema_name, driving_table_name, function_schema_name, function_name, start_values, end_values, is_final, filter=None, chunk_by="primary_key", boundary_key_index=None, partition_wise=False, leaf_ordinal=None) -> DataFrame:
        template = self._function_template(driving_table_schema_name, driving_table_name, function_schema_name, function_name, filter)
        return self.explain_migration_chunk(template, driving_table_schema_name, driving_table_name, start_values, end_values, is_final, "t", chunk_by, boundary_key_index, partition_wise, leaf_ordinal)
