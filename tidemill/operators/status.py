"""Task status: latest states, counts, the overall badge, progress events and lookups with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import progress

# States and the colours that show them.
RUNNING = ("searching", "downloading")
COLOURS = {"ready": "gray", "searching": "blue", "downloading": "blue", "success": "green", "stopped": "orange", "error": "red"}


def latest(events: DataFrame, by: str, value: str, *order: str) -> DataFrame:
    return events.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias(value))


def final_status(stopped: Column) -> Column:
    return F.when(stopped, "stopped").otherwise("success")


def badge(tasks: DataFrame, status: str = "status") -> DataFrame:
    """One row: running tasks, the rest, and the overall state (running before stopped before all done, else ready)."""
    s = F.col(status)
    counts = tasks.agg(F.count_if(s.isin(*RUNNING)).alias("n_running"), F.count("*").alias("n"), F.coalesce(F.bool_or(s == "stopped"), F.lit(False)).alias("any_stopped"), F.coalesce(F.bool_and(s == "success"), F.lit(False)).alias("all_done"))
    return counts.select("n_running", (F.col("n") - F.col("n_running")).alias("n_idle"), "any_stopped", "all_done", F.when(F.col("n_running") > 0, "running").when(F.col("any_stopped"), "stopped").when(F.col("all_done"), "done").otherwise("ready").alias("badge"))


def progress_events(items: DataFrame, by: str, order: str) -> DataFrame:
    """Two events for each item, before and after it; both count it as current."""
    w = Window.partitionBy(by)
    current = F.row_number().over(w.orderBy(order))
    out = items.withColumn("current", current).withColumn("total", F.count("*").over(w)).withColumn("stage", F.explode(F.array(F.lit("before"), F.lit("after"))))
    return out.withColumn("fraction", progress(F.col("current"), F.col("total")))


def routed(messages: DataFrame, registry: DataFrame, key: str, default: str) -> DataFrame:
    """Messages with the sink of their key, else the default one."""
    return messages.join(registry.select(key, "sink"), key, "left").withColumn("sink", F.coalesce("sink", F.lit(default)))


def colour(status: Column, default: str = "gray") -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv)), status), F.lit(default))


def first_of_name(wanted: DataFrame, tasks: DataFrame, name: str, order: str, value: str, default: str) -> DataFrame:
    """``wanted`` with the value of the first task of its name, else the default."""
    first = tasks.groupBy(name).agg(F.min_by(value, order).alias(value))
    return wanted.join(first, name, "left").withColumn(value, F.coalesce(value, F.lit(default)))
