"""Tasks on streams: the state machine over late and repeated events, pages that never load, sessions, and writes that count once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.cluster import ship
from tidemill.operators.machine import LEGAL, START

#: What streams with a state of their own for each task need of the session.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TaskStates(StatefulProcessor):
    """One row of state for each task, and the events that the watermark has not passed yet.

    An event waits until the watermark has passed its time, so late ones find their place; one that is told twice has the same
    place and waits once. Then events are judged in order of time and number, like those of a table.
    """

    def __init__(self, legal: dict[str, tuple[str, ...]] = LEGAL, start: str = START):
        self.legal, self.start = legal, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "state string, n_rejected long")
        self.waiting = handle.getMapState("waiting", "ms long, us long, event_id long, status string", "there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for ts, event_id, status in zip(part["ts"], part["event_id"], part["status"], strict=True):
                us = ts.value // 1000
                # A timer goes off once the watermark is above its time.
                self.waiting.updateValue((us // 1000, us, event_id, "" if pd.isna(status) else status), (True,))
                self.handle.registerTimer(us // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((us, event_id, status) for ms, us, event_id, status in map(tuple, self.waiting.keys()) if ms < upto)
        if not due:
            yield pd.DataFrame()
            return
        state, n = (self.task.get() if self.task.exists() else (self.start, 0))
        out = []
        for us, event_id, status in due:
            ok = status in self.legal.get(state, ())
            out.append((key[0], event_id, pd.Timestamp(us, unit="us"), state, status if ok else state, not ok, n + (not ok)))
            state, n = (status, n) if ok else (state, n + 1)
            self.waiting.removeKey((us // 1000, us, event_id, status))
        self.task.update((state, n))
        yield pd.DataFrame(out, columns=["task", "event_id", "ts", "before", "after", "rejected", "n_rejected"])

    def close(self) -> None:
        pass


def task_states(events: DataFrame, by: str, late: str = "10 minutes", legal: dict[str, tuple[str, ...]] = LEGAL, start: str = START) -> DataFrame:
    """Every event of a stream with the task's state ``before`` and ``after`` it, whether it is ``rejected`` and the task's
    rejections so far; write in append mode. ``events`` has ``by``, ts, event_id and status.

    Events up to ``late`` behind the newest are put in order; later ones are dropped, as their successors have been judged. The
    accepted and the rejected ones are told apart by a filter. State is one row for each task and its waiting events.
    """
    ship(events.sparkSession)
    rows = events.select(F.col(by).alias("task"), "ts", "event_id", "status").withWatermark("ts", late)
    kind = dict(rows.dtypes)["task"]
    out = rows.groupBy("task").transformWithStateInPandas(TaskStates(legal, start), f"task {kind}, event_id long, ts timestamp, before string, after string, rejected boolean, n_rejected long", "Append", "EventTime")
    return out.withColumnRenamed("task", by)


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session of the same application in which streams keep their state on disk, as ``task_states`` needs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return own


def page_loads(asked: DataFrame, loaded: DataFrame, by: list[str], patience: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """Each row of ``asked`` with the time of the load that came within ``patience``; null, and ``timed_out``, where none came.

    ``asked`` has ``by``, asked_at and more, ``loaded`` ``by`` and loaded_at. On streams a page that never loads is told once, as soon as
    both watermarks have passed its deadline; write in append mode. State holds what lies within patience and lateness. On
    tables the same join gives the same rows. Of several loads in time each gives a row.
    """
    a = asked
    b = loaded.select(*(F.col(c).alias(f"{c}_") for c in by), "loaded_at")
    if asked.isStreaming:
        a, b = a.withWatermark("asked_at", late), b.withWatermark("loaded_at", late)
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"{c}_"))
    inside = (F.col("loaded_at") >= F.col("asked_at")) & (F.col("loaded_at") <= F.col("asked_at") + F.expr(f"INTERVAL {patience}"))
    return a.join(b, same & inside, "left_outer").select(*asked.columns, "loaded_at", F.col("loaded_at").isNull().alias("timed_out"))


def sessions(events: DataFrame, by: str, ts: str = "ts", number: str = "event_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(by, start, end, n): bursts of activity of each task, parted by ``gap``, of events that may come late and twice.

    ``number`` tells events apart: repeats within ``late`` count once. On streams write in append mode; a session is told once the watermark has
    passed its end. On tables repeats are dropped wherever they are.
    """
    if events.isStreaming:
        once = events.withWatermark(ts, late).dropDuplicatesWithinWatermark([number])
    else:
        once = events.dropDuplicates([number])
    found = once.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))
    return found.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def written_once(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch into its own folder under ``path`` and replaces it when the batch runs again,
    so a stream that is stopped and started neither loses nor repeats rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
