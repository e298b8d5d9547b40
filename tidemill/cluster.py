"""What jobs need of a cluster: a folder that all machines share, tables stored in it, and rows in ranges of equal size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


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
    """``df`` written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_ranges(rows: DataFrame, order: list[str | Column], rows_each: int, name: str, number: str = "slice_", for_all_cores: bool = True) -> tuple[DataFrame, int]:
    """``rows`` stored with the number of the range of ``order`` that they lie in, about ``rows_each`` to a range, and how many
    ranges there may be. Ranges ascend with their number and rows that are equal in ``order`` lie in one range. With
    ``for_all_cores`` fewer rows make smaller ranges, down to 10,000 rows, while cores are left."""
    total = rows.count()
    n = max(1, -(-total // rows_each))
    if for_all_cores:
        n = max(n, min(rows.sparkSession.sparkContext.defaultParallelism, -(-total // 10_000)))
    dealt = rows.repartitionByRange(n, *order) if n > 1 else rows.coalesce(1)
    return stored(dealt.withColumn(number, F.spark_partition_id().cast("long")), name), n


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: classes that run there are found by import."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp(prefix="tidemill-"))
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    zipped = made / f"tidemill_{uuid.uuid4().hex[:12]}.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(zipped))
    _shipped.add(app)
