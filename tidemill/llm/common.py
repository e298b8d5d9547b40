"""What the operators share: tables, the shared folder, stored tables and shipping this package."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one Arrow batch: a batch of texts exists several times at once, in the JVM and in Python.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: functions sent to them are found by import.

    The session's Arrow batches are made smaller where they are larger; plans read that setting when they run.
    """
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    tmp = Path(tempfile.mkdtemp(prefix="tidemill-"))
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    zipped = tmp / f"tidemill_{uuid.uuid4().hex[:12]}.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(zipped))
    _shipped.add(app)


_kept: dict[str, Any] = {}


def release() -> None:
    """Empty what this Python worker keeps between tasks and give the memory back."""
    if _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:
            pass  # another C library


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps between tasks under ``name``. One thing at a time: another name empties it."""
    if name not in _kept:
        release()
        _kept[name] = make()
    return _kept[name]


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session, as in tests, gets a temporary one where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidemill-shared-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
        at = f"file://{at}"
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles() if "/tidemill/" in p}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions of about ``rows_each`` rows, never below the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def meet(left: DataFrame, right: DataFrame, key: str, size: str, spread: str | Column, total: int, most: int = 1024) -> DataFrame:
    """``left`` joined to ``right`` by ``key``, which is unique in ``right``; ``size`` there is about the rows of ``left`` with
    that key.

    Keys with more than ``most`` rows and a thousandth of ``total`` are hot: at most a thousand keys are, so they are
    broadcast. Rows of a hot key are dealt out by the hash of ``spread``, and its row of ``right`` is repeated for each share.
    """
    hot = right.where(F.col(size) > max(most, total // 1000)).select(F.col(key).alias("hot_"), F.ceil(F.col(size) / max(most, total // 1000)).alias("shares_"))
    share = F.pmod(F.xxhash64(spread), F.coalesce("shares_", F.lit(1)).cast("long"))
    dealt = left.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("hot_")), "left").withColumn("share_", share).drop("hot_", "shares_")
    shares = F.when(F.col(size) > max(most, total // 1000), F.ceil(F.col(size) / max(most, total // 1000))).otherwise(F.lit(1)).cast("long")
    repeated = right.withColumn("share_", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
    return dealt.join(repeated, [key, "share_"]).drop("share_")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where it is a plain scan of fewer parts, as of one small file; else as it is.

    Where rows are much work and files few, cores would idle. A larger input has more parts than cores and is not moved.
    """
    plan = df._jdf.queryExecution().executedPlan()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in plan.toString() or not df.inputFiles():
        return df
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if parts >= cores else df.repartition(cores)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text as string (null: empty) and other named columns; everything else is left in the file."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
