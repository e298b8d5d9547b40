"""Stored pages and held files as a Spark data source: folder trees and archives, read by tasks.

``spark.read.format("stored_files").load(folder)`` gives a row for each file below the folder and for each member of its ``.zip`` and
``.tar`` (also compressed) archives: folder, archive, name, size, modified, content. Empty files are rows like others. With
``content`` set to ``false`` nothing is opened but archives' tables of contents, and content is null.

The planner lists one level. Every subfolder and every archive there is a part of the work, and files that lie in the folder itself
are dealt out by name to ``splits`` parts, each of which lists the folder and keeps its own; all other listing and all reading is
done by tasks. Parts are put together where there are more than ``parts``. Conditions on ``name`` and ``folder`` (equality,
IN, beginning, end) are applied before a file is read; the condition that ``folder`` is empty lists no subfolder.

As a stream, a batch is what was modified since the one before, up to ``settle`` seconds before now, so that files of one instant come together.
A folder that is missing has no rows. Paths may be those of any store that pyarrow opens.
"""

from __future__ import annotations

import datetime as dt
import tarfile
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from tidemill.cluster import ship

SCHEMA = "folder string, archive string, name string, size long, modified timestamp, content binary"
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")
Row = tuple[str, str | None, str, int, dt.datetime, bytes | None]


@dataclass
class Part(InputPartition):
    """Subfolders and archives to be read whole, and the share of the folder's own files: those whose name leaves ``k`` by ``of``."""

    whole: list[tuple[str, bool]]  # path, whether it is an archive
    loose: tuple[int, int] | None
    since: float = float("-inf")
    upto: float = float("inf")


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _Files:
    """What both readers share."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.content = options.get("content", "true").lower() != "false"
        self.splits, self.parts = (int(options.get(k, v)) for k, v in (("splits", "8"), ("parts", "1024")))
        self.settle = float(options.get("settle", "2"))
        self.filters: list[Filter] = []

    def planned(self, since: float = float("-inf"), upto: float = float("inf")) -> list[Part]:
        fs, root = _opened(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        flat = any(isinstance(f, EqualTo) and f.attribute == ("folder",) and not f.value for f in self.filters)
        whole = [(f.path, f.type == pafs.FileType.File) for f in found if f.type == pafs.FileType.Directory and not flat or f.type == pafs.FileType.File and f.base_name.endswith(ARCHIVES)]
        n = min(self.splits, sum(f.type == pafs.FileType.File for f in found))
        dealt = [whole[i :: min(len(whole), self.parts)] for i in range(min(len(whole), self.parts))]
        return [Part(w, None, since, upto) for w in dealt] + [Part([], (k, n), since, upto) for k in range(n)]

    def wanted(self, folder: str, name: str) -> bool:
        for f in self.filters:
            value = folder if f.attribute == ("folder",) else name
            if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value:
                return False
            if isinstance(f, StringStartsWith) and not value.startswith(f.value) or isinstance(f, StringEndsWith) and not value.endswith(f.value):
                return False
        return True

    def rows(self, part: Part) -> Iterator[Row]:
        fs, root = _opened(self.path)
        inside = lambda f: part.since < f.mtime.timestamp() <= part.upto
        for path, archive in part.whole:
            if not archive:
                for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)):
                    if f.type == pafs.FileType.File and inside(f):
                        yield from self._file(fs, root, f)
            elif inside(f := fs.get_file_info(path)):
                yield from self._file(fs, root, f)
        if part.loose:
            k, of = part.loose
            for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if f.type == pafs.FileType.File and not f.base_name.endswith(ARCHIVES) and zlib.crc32(f.base_name.encode()) % of == k and inside(f):
                    yield from self._file(fs, root, f)

    def _file(self, fs: pafs.FileSystem, root: str, f: pafs.FileInfo) -> Iterator[Row]:
        folder = f.path.rpartition("/")[0].removeprefix(root).strip("/")
        at = f.mtime.astimezone(dt.UTC).replace(tzinfo=None)
        if f.base_name.endswith(ARCHIVES):
            with fs.open_input_file(f.path) as raw:
                yield from (self._zipped if f.base_name.endswith(".zip") else self._tarred)(raw, folder, f.base_name, at)
        elif self.wanted(folder, f.base_name):
            data = None
            if self.content:
                with fs.open_input_file(f.path) as raw:
                    data = raw.read()
            yield folder, None, f.base_name, f.size, at, data

    def _zipped(self, raw, folder: str, archive: str, at: dt.datetime) -> Iterator[Row]:
        with zipfile.ZipFile(raw) as z:
            for m in z.infolist():
                inner, _, name = m.filename.rpartition("/")
                where = "/".join(p for p in (folder, inner) if p)
                if not m.is_dir() and self.wanted(where, name):
                    yield where, archive, name, m.file_size, at, z.read(m) if self.content else None

    def _tarred(self, raw, folder: str, archive: str, at: dt.datetime) -> Iterator[Row]:
        with tarfile.open(fileobj=raw, mode="r:*") as t:
            for m in t:
                inner, _, name = m.name.rpartition("/")
                where = "/".join(p for p in (folder, inner) if p)
                if m.isfile() and self.wanted(where, name):
                    yield where, archive, name, m.size, at, t.extractfile(m).read() if self.content else None


class _Reader(DataSourceReader, _Files):
    def __init__(self, options: dict[str, str]):
        _Files.__init__(self, options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("name",), ("folder",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Part]:
        return self.planned() or [Part([], None)]

    def read(self, partition: Part) -> Iterator[Row]:
        return self.rows(partition)


class _StreamReader(DataSourceStreamReader, _Files):
    def __init__(self, options: dict[str, str]):
        _Files.__init__(self, options)

    def initialOffset(self) -> dict[str, float]:
        return {"upto": 0.0}

    def latestOffset(self) -> dict[str, float]:
        """The newest file that has settled: metadata of the tree, listed once a batch."""
        fs, root = _opened(self.path)
        old = time.time() - self.settle
        times = (f.mtime.timestamp() for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)) if f.type == pafs.FileType.File)
        return {"upto": max((t for t in times if t <= old), default=0.0)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.planned(start["upto"], end["upto"])

    def read(self, partition: Part) -> Iterator[Row]:
        return self.rows(partition)


class StoredFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``stored_files`` known to a session and its executors, and let the session push conditions to such sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredFiles)
