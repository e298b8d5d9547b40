"""Pages of documents: geometry, batches, missing and failed pages, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import inches, page_name


def printable(pages: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Pages with both sides positive, with their sizes in inches."""
    return pages.where((F.col(width) > 0) & (F.col(height) > 0)).withColumn("w_in", inches(F.col(width))).withColumn("h_in", inches(F.col(height)))


def batched(pages: DataFrame, size: int = 8, by: str = "doc_id") -> DataFrame:
    """With batch number, whether the page ends its batch, and its file name."""
    n = F.col("page_num")
    last = F.max(n).over(Window.partitionBy(by))
    return pages.withColumn("batch", F.floor((n - 1) / size)).withColumn("ends_batch", (n % size == 0) | (n == last)).withColumn("file", page_name(n))


def load_failures(wanted: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """Wanted pages that are missing or not complete, with the reason. ``pages``: loaded, pending_images, error."""
    j = wanted.join(pages.withColumn("there_", F.lit(True)), by, "left")
    reason = F.when(F.col("there_").isNull(), "page object missing").when(F.col("error").isNotNull() | ~F.col("loaded") | (F.col("pending_images") > 0), F.coalesce("error", F.lit("page or image load timed out")))
    return j.withColumn("reason", reason).where("reason IS NOT NULL").drop("there_")


def loaded(pages: DataFrame, by: str) -> DataFrame:
    """Pages loaded of all, and whether all are."""
    done = F.coalesce(F.col("loaded"), F.lit(False))
    return pages.groupBy(by).agg(F.count_if(done).alias("n_loaded"), F.count("*").alias("n_pages"), F.bool_and(done).alias("ready"))


def sheet_violations(sheets: DataFrame, by: list[str]) -> DataFrame:
    """Pages that do not have exactly one sheet."""
    return sheets.groupBy(*by).agg(F.count("*").alias("n_sheets")).where("n_sheets <> 1")


def within(rows: DataFrame, elapsed: str, limit: float) -> DataFrame:
    """With ``timed_out``."""
    return rows.withColumn("timed_out", F.coalesce(F.col(elapsed) > limit, F.lit(False)))


def settled(samples: DataFrame, by: str, order: str, value: str, repeats: int = 2) -> DataFrame:
    """(by, settled_at): the first sample that repeats its predecessor for the ``repeats``-th time in a row."""
    w = Window.partitionBy(by).orderBy(order)
    same = F.coalesce((F.col(value).eqNullSafe(F.lag(value).over(w))) & (F.row_number().over(w) > 1), F.lit(False))
    runs = samples.withColumn("same_", same).withColumn("run_", F.sum(F.when(F.col("same_"), 0).otherwise(1)).over(w))
    k = F.row_number().over(Window.partitionBy(by, "run_").orderBy(order)) - 1
    return runs.withColumn("k_", k).groupBy(by).agg(F.min(F.when(F.col("k_") == repeats, F.col(order))).alias("settled_at"))


def without_pages(documents: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """Documents that have no page at all, which is an error of the document."""
    return documents.join(pages.select(*by), by, "left_anti").withColumn("reason", F.lit("no pages"))


def without_exports(documents: DataFrame, pages: DataFrame, by: list[str], exported: str = "exported") -> DataFrame:
    """Documents none of whose pages was exported, which is an error of the document too."""
    done = pages.where(F.col(exported)).select(*by)
    return documents.join(done, by, "left_anti").withColumn("reason", F.lit("no valid document pages"))


def pending(images: Column) -> Column:
    """Whether any of a page's images is not done."""
    return F.coalesce(F.exists(images, lambda done: ~done), F.lit(False))
