"""Sinks: the results file and rows routed by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import slug


def result_lines(url: Column, title: Column) -> Column:
    return F.concat(url, F.lit("  # "), title)


def save_results(hits: DataFrame, keyword: str, folder: str, stamp: str, order: str = "pos") -> str:
    """Write one keyword's hits (url, title) as a text file: three header lines, a blank one, then a line for each hit.

    A keyword's hits are bounded by its limit, so they are written as one part. Returns the folder written.
    """
    spark = hits.sparkSession
    name = spark.range(1).select(slug(F.lit(keyword)).alias("s")).first()["s"]
    head = spark.createDataFrame([(-4, f"# Keyword: {keyword}"), (-3, f"# Saved: {stamp}"), (-2, f"# Results: {hits.count()}"), (-1, "")], "o long, value string")
    body = hits.select(F.col(order).cast("long").alias("o"), result_lines(F.col("url"), F.col("title")).alias("value"))
    path = f"{folder}/search_results_{name}.txt"
    head.unionByName(body).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)
    return path


def save_routed(messages: DataFrame, path: str, sink: str = "sink") -> None:
    """One folder for each sink."""
    messages.write.mode("overwrite").partitionBy(sink).json(path)
