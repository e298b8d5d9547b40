"""Outcomes of processing: skipped repeats, counters, failure lists, roll-up, cut-off and the sequential fold over keywords."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.runs import Run


def repeats(items: DataFrame, target: str, ok: str, order: str) -> DataFrame:
    """With ``status``: skipped where an earlier item made the same target, else success or failed."""
    before = F.max(F.col(ok).cast("int")).over(Window.partitionBy(target).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return items.withColumn("status", F.when(before == 1, "skipped").when(F.col(ok), "success").otherwise("failed"))


def skip_held(items: DataFrame, files: DataFrame, target: str = "filename") -> DataFrame:
    """With ``held``: a file of that name and some size is there."""
    there = files.where("size > 0").select(F.col("name").alias(target)).distinct().withColumn("held", F.lit(True))
    return items.join(there, target, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def counters(outcomes: DataFrame, by: str, order: str = "ord") -> DataFrame:
    """total, success, skipped, failed and the ordered list of failures for each key."""
    failed = F.col("status") == "failed"
    return outcomes.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(failed).alias("failed"),
        F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct(F.col(order).alias("o"), F.col("url").alias("url"), F.col("reason").alias("reason"))))), lambda f: F.struct(f["url"].alias("url"), f["reason"].alias("reason"))).alias("failed_urls"),
    )


def overall(stats: DataFrame, order: str = "ord", stopped: str = "stopped") -> DataFrame:
    """One row over all keywords, in their order: the keyword at which the run was stopped still counts as processed, those behind it do not."""
    # One number, found by a subquery of the same plan.
    first = stats.agg(F.min(F.when(F.col(stopped), F.col(order)))).scalar()
    rows = stats.withColumn("first_", first)
    done = F.coalesce(F.col(order) <= F.col("first_"), F.lit(True))
    total = {f"total_{name}": F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long") for name, c in (("downloaded", "success"), ("skipped", "skipped"), ("failed", "failed"))}
    return rows.agg(F.count("*").alias("total_keywords"), F.count_if(done).alias("processed_keywords"), *(c.alias(k) for k, c in total.items()), F.coalesce(F.bool_or(F.col(stopped)), F.lit(False)).alias("stopped"))


def before_stop(rows: DataFrame, by: str, order: str, stop: str) -> DataFrame:
    """Rows of each key before the first at which ``stop`` holds."""
    seen = F.max(F.col(stop).cast("int")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("seen_", seen).where("seen_ = 0").drop("seen_")


def fold(keywords: list[str], held: DataFrame, step: Callable[[str, DataFrame], DataFrame], run: Run | None = None) -> DataFrame:
    """Keywords one after another over a shared folder: what one takes is held for the next.

    ``step(keyword, held)`` gives rows with an id. The result depends on the order of the keywords, by design: what a keyword
    may take, and where its pages end, depends on all before it. For searches of many keywords see ``turns.in_turn``, which
    needs no job for each; this is for any other ``step``. Each step's rows are written to the checkpoint folder
    once, so held ids are files, and a step's plan grows by one scan for each keyword before it. A ``run`` that is stopped ends
    before its next keyword, and breaks off the one under way; the keywords before it stay. One that stops before the first is an error.
    """
    if not keywords:
        raise ValueError("no keywords")
    out, held = None, held.select("id")
    for k in keywords:
        got = None
        with run.step() if run else nullcontext(True) as go:
            if go:
                got = checkpointed(step(k, held))
        if got is None:
            break
        out = got if out is None else out.unionByName(got)
        held = held.unionByName(got.select("id"))
    if out is None:
        raise RuntimeError("stopped before the first keyword was done")
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the folder that spark.checkpoint.dir names; a local session without one gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="tidemill-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint()
