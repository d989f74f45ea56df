import threading
import time
import warnings

import pytest
from pyspark.sql import functions as F

from tileforge.engine import Engine
from tileforge.errors import EngineError, TransientChunkError
from tileforge.operators.keys import Key
from tileforge.sources.catalog import Table

SELECT = "select t.id, upper(t.payload) as payload from <driving_table> where <chunking_clause>"


@pytest.fixture
def engine(spark, tmp_path):
    rows = [(i, f"p{i}", i % 3) for i in range(1, 26)]
    spark.createDataFrame(rows, "id long, payload string, part int").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame(rows, "id long, payload string, part int").write.partitionBy("part").parquet(str(tmp_path / "parts"))
    found = Engine(spark, str(tmp_path / "work"))
    found.register_table(Table("s", "t", str(tmp_path / "t"), Key(("id",)), {"by_part": Key(("part", "id"))}))
    found.register_table(Table("s", "parts", str(tmp_path / "parts"), Key(("id",)), {}, ("part",)))
    return found


def run_id(engine, label):
    return engine._latest(label)["run_id"]


@pytest.mark.parametrize("options", [{}, {"threads": 3}, {"fuse": 2}, {"chunk_by": "blocks", "chunk_size": 1}, {"chunk_by": "ordered_key", "boundary_key_index": "by_part"}])
def test_select_covers_every_row_once(engine, options):
    engine.run_migration_chunks(SELECT, "s", "t", "x", **({"chunk_size": 10} | options))
    assert sorted(r.id for r in engine.output("x").collect()) == list(range(1, 26))
    progress = engine.migration_run_progress(run_id(engine, "x")).first()
    assert (progress.status, progress.percent_complete, progress.total_rows_affected) == ("completed", 100.0, 25)
    engine.run_migration_chunks(SELECT, "s", "t", "x")  # a completed label is done


def test_partition_wise(engine):
    engine.run_migration_chunks(SELECT, "s", "parts", "x", chunk_size=4, partition_wise=True)
    assert sorted(r.id for r in engine.output("x").collect()) == list(range(1, 26))
    found = engine.migration_run_leaves(run_id(engine, "x")).collect()
    assert [(r.leaf_bound, r.state, r.boundary_count) for r in found] == [("part=0", "calculated", 2), ("part=1", "calculated", 3), ("part=2", "calculated", 2)]
    summary = engine.migration_run_summary("x").first()
    assert (summary.total_chunks, summary.leaf_count, summary.boundary_count, summary.completed_boundary_count) == (7, 3, 8, 7)


def test_update_and_delete_make_a_version(engine):
    engine.run_migration_chunks("update <driving_table> set payload = concat('n', t.payload), part = part + 1 where <chunking_clause> and id > 20", "s", "t", "u", chunk_size=10)
    rows = {r.id: r for r in engine.table_version("u").collect()}
    assert len(rows) == 25 and rows[25].payload == "np25" and rows[3].payload == "p3" and rows[21].part == 1
    assert engine._latest("u")["total_rows_affected"] == 5
    engine.run_migration_chunks("delete from <driving_table> where <chunking_clause> and id % 2 = 0", "s", "t", "d", chunk_size=10)
    assert sorted(r.id for r in engine.table_version("d").collect()) == list(range(1, 26, 2))


def test_failure_stops_and_resume_goes_on(engine):
    bad = SELECT.replace("upper(t.payload)", "if(t.id = 15, raise_error('planted'), t.payload)")
    with pytest.raises(Exception, match="planted"):
        engine.run_migration_chunks(bad, "s", "t", "x", chunk_size=10)
    assert engine.migration_errors(run_id(engine, "x")).count() == 1
    assert engine.migration_run_progress(run_id(engine, "x")).first().completed_chunks == 1
    engine.set_migration_run_sql_text("x", SELECT)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        engine.run_migration_chunks(SELECT, "s", "t", "x", chunk_size=7)
    assert any("chunk_size differs" in str(w.message) for w in caught)
    assert engine.output("x").count() == 25


def test_published_chunk_is_adopted(engine, monkeypatch):
    """The driver stops between the rename and the completion of a chunk."""
    complete, left = engine.store.complete, [True]

    def lost(*args):
        if left.pop() if left else False:
            raise RuntimeError("driver lost")
        complete(*args)

    monkeypatch.setattr(engine.store, "complete", lost)
    with pytest.raises(RuntimeError):
        engine.run_migration_chunks(SELECT, "s", "t", "x", chunk_size=10)
    engine.run_migration_chunks(SELECT, "s", "t", "x", chunk_size=10)
    assert engine.output("x").count() == 25 and engine._latest("x")["total_rows_affected"] == 25


def test_transient_errors_are_retried(engine, monkeypatch):
    process, left = engine._process, [1, 1]

    def flaky(*args):
        if left:
            left.pop()
            raise TransientChunkError("later")
        return process(*args)

    monkeypatch.setattr(engine, "_process", flaky)
    engine.run_migration_chunks(SELECT, "s", "t", "x", chunk_size=10, retry_backoff_ms=1)
    assert engine.migration_errors(run_id(engine, "x")).count() == 0
    left += [1] * 9
    with pytest.raises(TransientChunkError):
        engine.run_migration_chunks(SELECT, "s", "t", "y", chunk_size=10, retry_backoff_ms=1, max_retries=2)


def test_pause_resume_cancel_archive(engine):
    work = threading.Thread(target=lambda: engine.run_migration_chunks(SELECT, "s", "t", "x", chunk_size=2, sleep_ms=200))
    work.start()
    while not engine.store.one("select 1 from boundary where completed_at is not null"):
        time.sleep(0.05)
    assert engine.pause_migration_run("x") == engine.pause_migration_run("x")
    work.join()
    progress = engine.migration_run_progress(run_id(engine, "x")).first()
    assert progress.status == "paused" and 0 < progress.completed_chunks < 13 and progress.estimated_remaining_ms is None
    engine.set_migration_run_sleep_ms("x", 0)
    engine.resume_migration_run("x")
    engine.cancel_migration_run("x")
    with pytest.raises(EngineError):
        engine.run_migration_chunks(SELECT, "s", "t", "x", chunk_size=2)
    assert engine.pause_migration_run("x") is None
    engine.archive_migration_run("x")
    assert engine.delete_archived_migration_runs("x") == 1
    engine.run_migration_chunks(SELECT, "s", "t", "x", chunk_size=20)


def test_function_over_table(engine, tmp_path):
    folder = tmp_path / "called"
    folder.mkdir()
    with pytest.raises(EngineError):
        engine.run_function_over_table("s", "t", "f", "missing")
    engine.register_function("f", "mark", _marker(str(folder)))
    engine.run_function_over_table("s", "t", "f", "mark", chunk_size=10, filter="id > 5")
    assert len(list(folder.iterdir())) == 20


def _marker(folder):
    def mark(i):
        open(f"{folder}/{i}", "w").close()

    return mark


def test_explain_writes_nothing(engine, tmp_path):
    plans = engine.explain_migration_chunks(SELECT, "s", "t").collect()
    assert [p.o_plan_kind for p in plans] == ["boundary_population", "chunk_non_final", "chunk_final"]
    assert engine.store.rows("select * from run") == [] and not (tmp_path / "work").exists()
    engine.run_migration_chunks(SELECT, "s", "t", "x", chunk_size=10)
    plan = engine.explain_migration_run_chunk(run_id(engine, "x"), 2).first()
    assert plan.o_plan_kind == "chunk_final" and "PushedFilters" in plan.o_plan
    assert engine.explain_migration_chunk(SELECT, "s", "t", ["1"], ["9"], False).count() == 1


def test_changed_files_stop_a_run(engine, spark, tmp_path):
    bad = SELECT.replace("upper(t.payload)", "if(t.id = 25, raise_error('planted'), t.payload)")
    with pytest.raises(Exception, match="planted"):
        engine.run_migration_chunks(bad, "s", "t", "x", chunk_size=10)
    spark.createDataFrame([(99, "z", 0)], "id long, payload string, part int").write.mode("append").parquet(str(tmp_path / "t"))
    with pytest.raises(EngineError) as error:
        engine.run_migration_chunks(SELECT, "s", "t", "x")
    assert error.value.code == "22023"


def test_store_rules(engine):
    engine.run_migration_chunks(SELECT, "s", "t", "x", chunk_size=10)
    for sql in ("update run set label = 'y'", "update run set completed_at = 'now'", "update run set paused_at = 'now'", "update boundary set rows_affected = 1", "insert into leaf (run_id, leaf_ordinal, leaf_bound, created_at) values (1, 1, 'a', 'b')"):
        with pytest.raises(EngineError):
            engine.store.write(sql)
    with pytest.raises(EngineError) as error:
        engine.store.create_run(**{k: engine._latest("x")[k] for k in "label sql_text schema_name table_name alias chunk_by chunk_size threads sleep_ms max_retries retry_backoff_ms partition_wise fingerprint".split()})
    assert error.value.code == "23505"


@pytest.mark.parametrize("text", ["select 1", "select <driving_table> <driving_table> <chunking_clause>", " \t", "select 1 from <driving_table> where <chunking_clause>; select 2", "drop table <driving_table> <chunking_clause>"])
def test_bad_templates(engine, text):
    with pytest.raises(EngineError):
        engine.run_migration_chunks(text, "s", "t", "x")


def test_templates_may_join_aggregate_and_use_windows(engine):
    text = "select part, count(*) as n, max(r) as r from (select t.*, row_number() over (partition by t.part order by t.id) as r from <driving_table> join (select 1 as one) on true where <chunking_clause>) group by part"
    engine.run_migration_chunks(text, "s", "t", "x", chunk_size=100)
    assert sorted((r.part, r.n, r.r) for r in engine.output("x").collect()) == [(0, 8, 8), (1, 9, 9), (2, 8, 8)]
    assert engine.output("x").agg(F.sum("n")).first()[0] == 25


# ---- identity of runs, callers, targets and leaves


def _other(engine, tmp_path, store=None):
    found = Engine(engine.spark, str(tmp_path / "work"), store)
    for table in engine.catalog._tables.values():
        found.register_table(table)
    return found


def test_another_engine_keeps_its_chunks_apart(engine, tmp_path):
    """With the store of the folder the label is known; with another one the chunks of the first run aren't taken."""
    from tileforge.sources.store import Store

    engine.run_migration_chunks(SELECT, "s", "t", "one", chunk_size=10)
    again = _other(engine, tmp_path)
    assert again._latest("one")["total_rows_affected"] == 25 and again.output("one").count() == 25
    apart = _other(engine, tmp_path, Store())
    apart.run_migration_chunks(SELECT.replace("upper(t.payload)", "concat('two', t.id)"), "s", "t", "two", chunk_size=10)
    assert {r.payload for r in apart.output("two").collect()} == {f"two{i}" for i in range(1, 26)}


@pytest.mark.parametrize("same", [True, False])
def test_two_callers_of_one_label(engine, tmp_path, same):
    other = engine if same else _other(engine, tmp_path)
    failures = []

    def call(one):
        try:
            one.run_migration_chunks(SELECT, "s", "t", "x", chunk_size=3, threads=2)
        except Exception as error:
            failures.append(error)

    callers = [threading.Thread(target=call, args=(one,)) for one in (engine, other)]
    for caller in callers:
        caller.start()
    for caller in callers:
        caller.join()
    assert failures == []
    assert sorted(r.id for r in engine.output("x").collect()) == list(range(1, 26))
    assert engine.store.rows("select * from error") == [] and engine._latest("x")["total_rows_affected"] == 25


def test_claims_of_a_dead_caller_are_taken_back(engine):
    engine.run_migration_chunks(SELECT, "s", "t", "x", chunk_size=10, threads=1)
    engine.archive_migration_run("x")
    bad = SELECT.replace("upper(t.payload)", "if(t.id = 25, raise_error('planted'), t.payload)")
    with pytest.raises(Exception, match="planted"):
        engine.run_migration_chunks(bad, "s", "t", "x", chunk_size=10, max_retries=0)
    engine.store.write("insert into lease (owner, beat) values ('dead', 0)")
    engine.store.write("update boundary set claim = 'dead/1', started_at = 'then' where run_id = ? and boundary_no = 2", run_id(engine, "x"))
    engine.set_migration_run_sql_text("x", SELECT)
    engine.run_migration_chunks(SELECT, "s", "t", "x")
    assert sorted(r.id for r in engine.output("x").collect()) == list(range(1, 26))


def test_insert_fills_its_target(engine, spark, tmp_path, monkeypatch):
    spark.createDataFrame([(0, "old", 1)], "id long, payload string, more int").write.parquet(str(tmp_path / "target"))
    engine.register_table(Table("s", "target", str(tmp_path / "target")))
    text = "insert into s.target (payload, id) select upper(t.payload), t.id from <driving_table> where <chunking_clause>"
    move, broken = Engine._insert, []

    def stops_once(self, run, number, out, target):
        if number == 1 and not broken:
            broken.append(number)
            raise RuntimeError("planted")
        move(self, run, number, out, target)

    monkeypatch.setattr(Engine, "_insert", stops_once)
    with pytest.raises(RuntimeError, match="planted"):
        engine.run_migration_chunks(text, "s", "t", "x", chunk_size=10)
    engine.run_migration_chunks(text, "s", "t", "x")
    rows = spark.read.parquet(str(tmp_path / "target")).collect()
    assert sorted((r.id, r.payload, r.more) for r in rows) == [(0, "old", 1), *((i, f"P{i}", None) for i in range(1, 26))]
    assert engine.output("x").count() == 25 and engine._latest("x")["total_rows_affected"] == 25
    for wrong, code in (("insert into nowhere select t.id from", "42P01"), ("insert into target (nothing) select t.id from", "42703"), ("insert into t select t.* from", "0A000")):
        with pytest.raises(EngineError) as error:
            engine.run_migration_chunks(f"{wrong} <driving_table> where <chunking_clause>", "s", "t", wrong)
        assert error.value.code == code


def test_leaves_of_odd_values(engine, spark, tmp_path):
    values = [None, "a/b", "__null__", "_x", "100%", "plain"]
    rows = [(i, values[i % 6]) for i in range(30)]
    spark.createDataFrame(rows, "id long, leaf string").write.parquet(str(tmp_path / "odd"))
    engine.register_table(Table("s", "odd", str(tmp_path / "odd"), Key(("id",)), {"by_id": Key(("id",))}, ("leaf",)))
    for k, options in enumerate(({}, {"chunk_by": "ordered_key", "boundary_key_index": "by_id"}, {"chunk_by": "blocks"})):
        engine.run_migration_chunks("select t.id, t.leaf from <driving_table> where <chunking_clause>", "s", "odd", f"x{k}", chunk_size=3, partition_wise=True, **options)
        assert sorted((r.id, r.leaf) for r in engine.output(f"x{k}").collect()) == rows
    engine.run_migration_chunks("delete from <driving_table> where <chunking_clause> and id % 2 = 0", "s", "odd", "d", chunk_size=3, partition_wise=True)
    assert sorted((r.id, r.leaf) for r in engine.table_version("d").collect()) == rows[1::2]


def test_version_keeps_rows_of_chunks_not_done(engine, spark, tmp_path):
    rows = [(i, None if i % 4 == 0 else "p") for i in range(20)]
    spark.createDataFrame(rows, "id long, leaf string").write.parquet(str(tmp_path / "some"))
    engine.register_table(Table("s", "some", str(tmp_path / "some"), Key(("id",)), {}, ("leaf",)))
    bad = "update <driving_table> set id = if(t.id = 19, raise_error('planted'), t.id) where <chunking_clause>"
    with pytest.raises(Exception, match="planted"):
        engine.run_migration_chunks(bad, "s", "some", "u", chunk_size=5, partition_wise=True, max_retries=0)
    assert sorted((r.id, r.leaf) for r in engine.table_version("u").collect()) == rows


@pytest.mark.parametrize("text", ["select t.id, row_number() over (order by t.id) as n from <driving_table> where <chunking_clause>", "select count(*) as n from <driving_table> where <chunking_clause>", "select t.id from <driving_table> where <chunking_clause> limit 2"])
def test_only_row_wise_templates_are_fused(engine, text):
    with pytest.raises(EngineError, match="row by row"):
        engine.run_migration_chunks(text, "s", "t", "x", chunk_size=5, fuse=4)


def test_leaves_are_calculated_side_by_side_and_numbered_in_order(engine, tmp_path, monkeypatch):
    at_once, most, lock, real = [0], [0], threading.Lock(), Engine._starts

    def slow(self, source, key, chunk_size):
        with lock:
            at_once[0] += 1
            most[0] = max(most[0], at_once[0])
        time.sleep(1)
        try:
            return real(self, source, key, chunk_size)
        finally:
            with lock:
                at_once[0] -= 1

    monkeypatch.setattr(Engine, "_starts", slow)
    engine.run_migration_chunks(SELECT, "s", "parts", "x", chunk_size=4, threads=3, partition_wise=True)
    assert most[0] > 1
    found = engine.migration_boundaries(run_id(engine, "x")).orderBy("boundary_no").collect()
    assert [r.leaf_ordinal for r in found] == [1, 1, 2, 2, 2, 3, 3, 3]
    assert sorted(r.id for r in engine.output("x").collect()) == list(range(1, 26))


def test_leaf_claims_of_a_dead_caller_are_taken_back(engine, monkeypatch):
    def fails(self, *_):
        raise EngineError("XX001", "planted")

    with monkeypatch.context() as m:
        m.setattr(Engine, "_starts", fails)
        with pytest.raises(EngineError, match="planted"):
            engine.run_migration_chunks(SELECT, "s", "parts", "x", chunk_size=4, partition_wise=True)
    leaves = engine.migration_run_leaves(run_id(engine, "x")).collect()
    assert [(r.state, r.error_sqlstate) for r in leaves] == [("failed", "XX001"), ("pending", None), ("pending", None)]
    store = engine.store
    store.beat("live")
    assert store.claim_leaf(run_id(engine, "x"), "live", 60)["leaf_ordinal"] == 2
    assert store.claim_leaf(run_id(engine, "x"), "dead", 60)["leaf_ordinal"] == 3  # an owner without a lease
    assert store.claim_leaf(run_id(engine, "x"), "other", 60)["leaf_ordinal"] == 3
    store.end_lease("live")
    engine.run_migration_chunks(SELECT, "s", "parts", "x", chunk_size=4, partition_wise=True)
    assert sorted(r.id for r in engine.output("x").collect()) == list(range(1, 26))
    assert store.claim_leaf(run_id(engine, "x"), "late", 60) is None


def test_a_changed_leaf_is_named(engine, spark, tmp_path):
    with pytest.raises(Exception, match="planted"):
        engine.run_migration_chunks(SELECT.replace("upper(t.payload)", "raise_error('planted')"), "s", "parts", "x", chunk_size=4, partition_wise=True, max_retries=0)
    spark.createDataFrame([(100, "new")], "id long, payload string").write.mode("append").parquet(str(tmp_path / "parts" / "part=1"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with pytest.raises(EngineError, match="leaf part=1 isn't as the manifest") as error:
            engine.run_migration_chunks(SELECT, "s", "parts", "x", chunk_size=4, partition_wise=True)
    assert error.value.code == "55000"


def test_every_leaf_has_the_key(engine, spark, tmp_path):
    path = str(tmp_path / "mixed")
    spark.createDataFrame([(1, 10)], "id long, at int").write.parquet(f"{path}/part=1")
    spark.createDataFrame([(2, "x")], "id long, other string").write.parquet(f"{path}/part=2")
    schema = "id long, at int, other string, part int"
    engine.register_table(Table("s", "mixed", path, Key(("id",)), {"by_at": Key(("at",))}, ("part",), spark.createDataFrame([], schema).schema))
    engine.run_migration_chunks("select t.id from <driving_table> where <chunking_clause>", "s", "mixed", "by_id", chunk_size=4, partition_wise=True)
    assert sorted(r.id for r in engine.output("by_id").collect()) == [1, 2]
    with pytest.raises(EngineError) as error:
        engine._assert_leaf(engine.catalog.get("s", "mixed"), {"leaf_bound": "part=2", "fingerprint": engine.migration_run_leaves(run_id(engine, "by_id")).collect()[1].fingerprint}, engine.catalog.get("s", "mixed").read(spark).where("part = 2"), engine.catalog.get("s", "mixed").ordered_keys["by_at"])
    assert error.value.code == "0A000"


def test_blocks_need_plain_parquet(engine, tmp_path):
    (tmp_path / "t" / "_delta_log").mkdir()
    with pytest.raises(EngineError) as error:
        engine.run_migration_chunks(SELECT, "s", "t", "x", chunk_by="blocks")
    assert error.value.code == "42809"
