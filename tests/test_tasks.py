import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemill.operators import machine
from tidemill.streaming import tasks

AT = dt.datetime(2024, 1, 1)


def _brute(events):
    """{task: (state, n_rejected)} and the judged events, one after another."""
    state, bad, out = {}, {}, []
    for task, ts, i, status in sorted(events, key=lambda e: (e[1], e[2])):
        old = state.get(task, machine.START)
        ok = status in machine.LEGAL.get(old, ())
        state[task], bad[task] = status if ok else old, bad.get(task, 0) + (not ok)
        out.append((task, i, old, state[task], not ok))
    return {t: (state[t], bad[t]) for t in state}, sorted(out)


def _events(n, n_tasks, seed, hot=0.5):
    rng = random.Random(seed)
    asked = [*machine.LEGAL, "unknown"]
    return [(0 if rng.random() < hot else rng.randrange(n_tasks), AT + dt.timedelta(milliseconds=rng.randrange(n * 500)), i, rng.choice(asked)) for i in range(n)]


@pytest.mark.parametrize(("n", "range_rows"), [(3000, 10**6), (3000, 170), (5, 2), (9000, 5000)])
def test_machine_equals_one_event_after_another(spark, n, range_rows):
    """One task has half of the events; ranges cut it into many pieces."""
    events = _events(n, 40, n)
    rows = spark.createDataFrame(events, "task long, ts timestamp, event_id long, status string").repartition(7)
    final, judged = _brute(events)
    got = machine.final_states(rows, "task", ["ts", "event_id"], "status", range_rows=range_rows)
    assert {r.task: (r.state, r.n_rejected) for r in got.collect()} == final
    got = machine.transitions(rows, "task", ["ts", "event_id"], "status", range_rows=range_rows)
    assert sorted(got.select("task", "event_id", "before", "after", "rejected").collect()) == judged


def test_machine_of_nothing_and_nulls(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, "searching"), (1, 2, "searching"), (None, 3, "searching")], "task long, event_id long, status string")
    assert machine.final_states(rows.limit(0), "task", ["event_id"], "status").count() == 0
    assert machine.transitions(rows.limit(0), "task", ["event_id"], "status").count() == 0
    got = {r.task: (r.state, r.n_rejected) for r in machine.final_states(rows.where("task = 1"), "task", ["event_id"], "status").collect()}
    assert got == {1: ("searching", 1)}


def _streamed(spark, folder, schema, parts, run):
    """Write parts one by one and let the query take each as a batch of its own."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        run(i)


def test_stream_states_equal_the_table(spark, tmp_path):
    """Events out of order and told twice, within and across batches."""
    own = tasks.with_state_store(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    events = _events(240, 6, 5, 0.3)
    order = sorted(events, key=lambda e: (e[1] + dt.timedelta(seconds=random.Random(e[2]).randrange(20)), e[2]))
    parts = [order[i : i + 80] + order[max(0, i - 10) : i + 5] for i in range(0, 240, 80)]
    parts.append([(99, AT + dt.timedelta(days=1), 10_000, "searching")])
    parts.append([(99, AT + dt.timedelta(days=1), 10_001, "searching")])
    schema = "task long, ts timestamp, event_id long, status string"
    out, at = str(tmp_path / "out"), str(tmp_path / "check")
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))

    def run(_):
        stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        judged = tasks.task_states(stream, "task", "30 seconds")
        # A new query each time: state and watermark come from the checkpoint.
        judged.writeStream.foreachBatch(tasks.written_once(out)).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    _streamed(spark, tmp_path / "in", schema, parts, run)
    final, judged = _brute(events)
    got = spark.read.parquet(out).where("task <> 99")
    assert sorted(got.select("task", "event_id", "before", "after", "rejected").collect()) == judged
    last = got.groupBy("task").agg(F.max_by(F.struct("after", "n_rejected"), F.struct("ts", "event_id")).alias("l")).collect()
    assert {r.task: tuple(r.l) for r in last} == final
    table = machine.final_states(spark.createDataFrame(events, schema), "task", ["ts", "event_id"], "status")
    assert {r.task: (r.state, r.n_rejected) for r in table.collect()} == final


def test_a_page_that_never_loads_is_told_once(spark, tmp_path):
    s = lambda n: AT + dt.timedelta(seconds=n)
    asked = [[("d", 1, s(0)), ("d", 2, s(1)), ("d", 3, s(2))], [("d", 4, s(500))], [("e", 9, s(9000))], [("e", 10, s(9001))]]
    loads = [[("d", 1, s(60))], [("d", 2, s(500)), ("d", 4, s(510))], [("e", 9, s(9010))], [("e", 11, s(9011))]]
    a, b = "doc string, page int, asked_at timestamp", "doc string, page int, loaded_at timestamp"
    for name, schema in (("a", a), ("b", b)):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))

    def run(i):
        spark.createDataFrame(loads[i], b).coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
        got = tasks.page_loads(spark.readStream.schema(a).parquet(str(tmp_path / "a")), spark.readStream.schema(b).parquet(str(tmp_path / "b")), ["doc", "page"], late="10 seconds")
        got.writeStream.foreachBatch(tasks.written_once(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    _streamed(spark, tmp_path / "a", a, asked, run)
    told = sorted((r.doc, r.page, r.timed_out) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert told == [("d", 1, False), ("d", 2, True), ("d", 3, True), ("d", 4, False), ("e", 9, False)]
    flat = lambda parts: [r for p in parts for r in p]
    batch = tasks.page_loads(spark.createDataFrame(flat(asked), a), spark.createDataFrame(flat(loads), b), ["doc", "page"])
    assert sorted((r.doc, r.page, r.timed_out) for r in batch.collect()) == [*told, ("e", 10, True)]


def test_sessions_of_late_and_repeated_events(spark, tmp_path):
    """A stream that is stopped between batches, with repeats across them, tells each session once."""
    m = lambda n: AT + dt.timedelta(minutes=n)
    schema = "task string, event_id long, ts timestamp"
    parts = [[("a", 1, m(0)), ("b", 2, m(1)), ("a", 1, m(0))], [("a", 3, m(20)), ("a", 1, m(0)), ("b", 4, m(15))], [("a", 5, m(100)), ("b", 2, m(1))], [("z", 6, m(900))], [("z", 7, m(901))]]
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))

    def run(_):
        got = tasks.sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "task", late="30 minutes")
        got.writeStream.foreachBatch(tasks.written_once(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    _streamed(spark, tmp_path / "in", schema, parts, run)
    told = sorted((r.task, (r.start - AT).seconds // 60, (r.end - AT).seconds // 60, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert told == [("a", 0, 50, 2), ("a", 100, 130, 1), ("b", 1, 45, 2)]
    batch = tasks.sessions(spark.createDataFrame([r for p in parts for r in p], schema), "task")
    assert sorted((r.task, (r.start - AT).seconds // 60, (r.end - AT).seconds // 60, r.n) for r in batch.where("task <> 'z'").collect()) == told


def test_hot_task_has_no_window_of_its_own(spark):
    began = time.time()
    rows = spark.range(0, 300_000, 1, 16).select(F.lit(7).alias("task"), F.col("id").alias("event_id"), F.expr("element_at(array('searching', 'downloading', 'success', 'ready', 'stopped'), cast(pmod(xxhash64(id), 5) + 1 as int))").alias("status"))
    got = machine.final_states(rows, "task", ["event_id"], "status", range_rows=20_000).first()
    want, _ = _brute([(7, r.event_id, 0, r.status) for r in rows.collect()])
    assert (got.state, got.n_rejected) == want[7] and time.time() - began < 120
