"""Runs that can be stopped from elsewhere while they are under way."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from tidemill.cluster import shared_dir


class Run:
    """A run of many steps. ``stop`` may be called from any thread, or from another application that shares the folder and knows the name.

    Jobs that are started inside ``step`` carry the run's tag. A stop leaves a mark in the shared folder, which ends the run before its next
    step, and cancels the jobs of the step that is under way; what earlier steps wrote stays.
    """

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark, self.name = spark, name or uuid.uuid4().hex
        self.tag = f"tidemill-run-{self.name}"
        jvm = spark.sparkContext._jvm
        self._mark = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemill/stops/{self.name}")
        self._fs = self._mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def stopped(self) -> bool:
        return self._fs.exists(self._mark)

    def stop(self) -> None:
        self._fs.create(self._mark, True).close()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def clear(self) -> None:
        """Forget a stop, so that the run may go on."""
        self._fs.delete(self._mark, False)

    @contextmanager
    def step(self) -> Iterator[bool]:
        """Whether the step may be done. A job of it that a stop cancels ends the step without an error."""
        if self.stopped:
            yield False
            return
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            yield True
        except Exception:
            if not self.stopped:
                raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
