"""Results files of many keywords in one job, through a writer that commits all of them or none.

Each task writes its keywords' files into a folder of its own attempt, below a hidden folder of the job. Only when every task is
done are the files that the successful attempts named moved to their places and the job's manifest written; a job that fails
removes its hidden folder. A task that runs twice, or dies half way, leaves nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidemill.cluster import ship
from tidemill.functions.text import slug
from tidemill.sources.sinks import result_lines


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: list[tuple[str, int]]  # name, rows


class _Writer(DataSourceWriter):
    """Rows (file, head, line) in order; a file's rows come together."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = self._fs()
        attempt = uuid.uuid4().hex
        folder, files, out = f"{root}/.job-{self.job}/{attempt}", [], None
        fs.create_dir(folder, recursive=True)
        try:
            for r in iterator:
                if not files or files[-1][0] != r.file:
                    if out is not None:
                        out.close()
                    out = fs.open_output_stream(f"{folder}/{r.file}")
                    out.write(r.head.encode())
                    files.append((r.file, 0))
                if r.line is not None:
                    out.write(f"{r.line}\n".encode())
                    files[-1] = (r.file, files[-1][1] + 1)
        finally:
            if out is not None:
                out.close()
        return Written(attempt, files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = self._fs()
        done = {}
        for m in filter(None, messages):
            for name, rows in m.files:
                fs.move(f"{root}/.job-{self.job}/{m.attempt}/{name}", f"{root}/{name}")
                done[name] = rows
        with fs.open_output_stream(f"{root}/_results-{self.job}.json") as out:
            out.write(json.dumps(done, sort_keys=True).encode())
        fs.delete_dir(f"{root}/.job-{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = self._fs()
        if fs.get_file_info(f"{root}/.job-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/.job-{self.job}")


class ResultFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "result_files"

    def schema(self) -> str:
        return "file string, head string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def result_rows(hits: DataFrame, stamp: str, order: str = "pos", keyword: str = "keyword") -> DataFrame:
    """(file, head, line, o): the lines of all keywords' results files in one shuffle. ``hits`` has keyword, url, title and ``order``.

    Keywords of equal slugs would write one file: as when they are saved one after another, the last one (by text) stays.
    """
    named = hits.select(F.col(keyword).alias("keyword"), F.concat(F.lit("search_results_"), slug(F.col(keyword)), F.lit(".txt")).alias("file"), F.col(order).alias("o"), result_lines(F.col("url"), F.col("title")).alias("line"))
    by = Window.partitionBy("file")
    last = named.withColumn("last", F.max("keyword").over(by)).where("keyword = last")
    head = F.concat(F.lit("# Keyword: "), F.col("keyword"), F.lit(f"\n# Saved: {stamp}\n# Results: "), F.count("*").over(by).cast("string"), F.lit("\n\n"))
    return last.select("file", head.alias("head"), "line", "o")


def save_all_results(hits: DataFrame, folder: str, stamp: str, order: str = "pos", keyword: str = "keyword") -> None:
    """A results file for every keyword of ``hits``, all in one job; files of earlier runs are replaced."""
    spark = hits.sparkSession
    ship(spark)
    spark.dataSource.register(ResultFiles)
    rows = result_rows(hits, stamp, order, keyword).sortWithinPartitions("file", "o").select("file", "head", "line")
    rows.write.format("result_files").option("path", folder).mode("append").save()
